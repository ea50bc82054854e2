"""PII surrogates: detected entities get keyed replacements of their own kind.

Detection is one regular expression over a text: email addresses, phone numbers,
payment cards (with a valid Luhn digit), IPv4 addresses, social security numbers
and personal names (after a title, or a known given name before a surname).

A replacement is drawn from a keyed hash of the normalised entity, so one entity
has one replacement in all documents and spellings (coreference): digits and
separators of a phone number stay in their format, a card keeps its length and
gets a valid check digit, an email keeps the pattern of its local part, a given
name is replaced by one of its gender and script, a surname by one of its script.
Surnames and given names are entities of their own, so "Mrs Anna Berg" and "Frau
Berg" still share a name afterwards.

Distinct entities must stay distinct: replacements that coincide, or that are an
entity of the corpus themselves, are drawn again, with one more syllable or name,
until none do. Numbers get more digits from the ``ROOMY``-th draw on, as the corpus
may hold all numbers of a short length; an entity that still has no surrogate of
its own after ``DRAWS`` draws raises an error.

A given name has one gender in the corpus: its own where it is a known name, else
that of most mentions with a title, so that "Dr Kim Berg" and "Mrs Kim Berg" stay
one person.

Only DataFrame functions are used. Texts are written once with their mentions and
those without one never move again; the join that brings the replacements back
is on a digest of the text, both of its sides are written tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize
from .common import table

# Titles and given names by gender.
TITLES = {
    "m": ["Mr", "Herr", "Sr", "Señor", "Monsieur", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Mlle", "Madame", "г-жа"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    ("m", "latin"): """James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew
        Anthony Mark Paul Steven Andrew Peter Hans Klaus Jürgen Stefan Wolfgang Carlos Miguel José Javier
        Antonio Manuel Pierre Jacques Michel Philippe Luc""".split(),
    ("f", "latin"): """Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Laura
        Emma Anna Julia Helen Claire Ursula Monika Sabine Petra Heike María Carmen Lucía Isabel Pilar Teresa
        Marie Sophie Camille Nathalie Françoise Sylvie""".split(),
    ("m", "cyrillic"): "Иван Сергей Алексей Дмитрий Николай Андрей Михаил Павел".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
}
SYLLABLES = {
    "latin": """ba be bo da de do fa fe ga go ha he ka ke la le li lo ma me mi mo na ne ni no ra re ri ro
        sa se so ta te to va ve""".split(),
    "cyrillic": "ба ве го да жи ка ла ли ма ми на но па ре ро са та то ва ле".split(),
}
_NAMES = "|".join(sorted({n for names in GIVEN.values() for n in names}))
_TITLES = "|".join(sorted((t for own in TITLES.values() for t in own), key=len, reverse=True))
_PROPER = r"\p{Lu}[\p{L}'’-]+"
#: Digits by group of a card that stands beside other numbers.
LAYOUTS = r"^(?:4-4-4-4(?:-[123])?|4-6-[45]|1[3-9])$"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERN = (
    r"(?<![\p{L}\p{N}_.])(?:"
    r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}"
    rf"|{_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}_]|\.\d)"
    r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
    r"|\d{3}-\d{2}-\d{4}(?![\d-])"
    # a whole run of numbers; the cards are looked for in it
    r"|(?=\d(?:[ -]?\d){12})\d++(?![\p{L}\p{N}_])(?:[ -]\d++(?![\p{L}\p{N}_]))*+"
    rf"|(?:{_TITLES})\.? {_PROPER}(?: {_PROPER})?"
    rf"|(?:{_NAMES}) {_PROPER}"
    r")"
)


def _array(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit counted once."""
    size = F.length(digits)
    values = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.when((size - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.substring(digits, i, F.lit(1)).cast("int") * 2 % 10 + F.floor(F.substring(digits, i, F.lit(1)).cast("int") / 5)
        ),
    )
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, v: total + v)


def _kind(mention: Column) -> Column:
    """The type of a mention; null if it only looks like one."""
    digits = _digits(mention)
    return (
        F.when(F.contains(mention, F.lit("@")), "email")
        .when(mention.rlike(r"^\p{L}"), "name")
        .when(mention.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(mention.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0), "card")
    )


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _pieces(mention: Column) -> Column:
    """A mention as an array; a run of numbers that is no card as a whole is cut at the cards in it.

    Such a card has one of ``LAYOUTS``, the first digits of an issuer and a valid
    Luhn digit. Of overlapping ones the first and longest is taken.
    """
    digits = _digits(mention)
    whole = ~mention.rlike(r"^\d[\d -]{12,}$") | F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0)

    def cut(tokens: Column) -> Column:
        every = F.sequence(F.lit(1), F.size(tokens))

        def is_card(i: Column, n: int) -> Column:
            own = F.slice(tokens, i, n)
            sizes = F.array_join(F.transform(own, lambda t: F.length(_digits(t)).cast("string")), "-")
            likely = F.element_at(tokens, i).rlike("^(?:[3-6]|2[2-7])") & sizes.rlike(LAYOUTS)
            return F.when(likely, luhn_sum(_digits(F.array_join(own, ""))) % 10 == 0).otherwise(False)

        def longest(i: Column) -> Column:
            return F.struct(i.alias("i"), F.coalesce(*(F.when(is_card(i, n), F.lit(n)) for n in (5, 4, 3, 1)), F.lit(0)).alias("n"))

        def part(found: Column, p: Column) -> Column:
            card = F.get(F.filter(found, lambda c: (c["i"] <= p) & (p < c["i"] + c["n"])), F.lit(0))
            text = F.array_join(F.slice(tokens, p, card["n"]), "")
            own = F.array(F.regexp_replace(text, "[ -]$", ""), F.regexp_extract(text, "[ -]?$", 0))
            return F.when(card.isNull(), F.array(F.element_at(tokens, p))).when(card["i"] == p, own).otherwise(F.array().cast("array<string>"))

        cards = F.aggregate(
            F.filter(F.transform(every, longest), lambda c: c["n"] > 0),
            F.array().cast("array<struct<i:int,n:int>>"),
            lambda got, c: F.when(F.exists(got, lambda g: c["i"] < g["i"] + g["n"]), got).otherwise(F.concat(got, F.array(c))),
        )
        return _bind(cards, lambda found: F.flatten(F.transform(every, lambda p: part(found, p))))

    return F.when(whole, F.array(mention)).otherwise(
        _bind(F.regexp_extract_all(mention, F.lit(r"\d+[ -]?"), F.lit(0)), cut)
    )


def atoms(mentions: DataFrame) -> DataFrame:
    """Columns ``kind, title, given, other`` of a column ``mention``: what there is to replace.

    ``given`` and ``other`` are structs ``type, gender, script, norm, raw``;
    ``given`` is null but for names of two words.
    """
    m = F.col("mention")
    title = F.when(F.col("kind") == "name", F.regexp_extract(m, rf"^(?:{_TITLES})\.? ", 0)).otherwise("")
    rest = F.substring(m, F.length("title") + 1, F.length(m))
    first = F.substring_index(rest, " ", 1)
    double = (F.col("kind") == "name") & F.contains(rest, F.lit(" "))
    last = F.when(double, F.substring_index(rest, " ", -1)).otherwise(rest)
    bare_title = F.regexp_replace("title", r"[. ]", "")
    gender = F.lit("n")
    for sex in ("m", "f"):
        gender = F.when(
            bare_title.isin(TITLES[sex]) | first.isin(GIVEN[sex, "latin"] + GIVEN[sex, "cyrillic"]), sex
        ).otherwise(gender)
    script = lambda c: F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    kind = F.when(F.col("kind") == "name", "surname").otherwise(F.col("kind"))
    norm = (
        F.when(F.col("kind").isin("phone", "card", "ssn"), _digits(last))
        .otherwise(F.lower(last))
    )
    entity = lambda t, g, n, raw: F.struct(
        t.alias("type"), g.alias("gender"), script(raw).alias("script"), n.alias("norm"), raw.alias("raw")
    )
    return (
        mentions.withColumn("kind", _kind(m))
        .filter("kind is not null")
        .withColumn("title", title)
        .withColumn("given", F.when(double, entity(F.lit("given"), gender, F.lower(first), first)))
        .withColumn("other", entity(kind, F.lit("n"), norm, last))
    )


def _pick(digest: Column, at: Column | int, of: int) -> Column:
    """A number below ``of`` from four digits of a hexadecimal digest."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.pmod(F.conv(F.substring(digest, at % 15 * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(of))


def _shaped(digest: Column, text: Column) -> Column:
    """Letters for letters and digits for digits; other characters stay."""
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    one = lambda i: F.substring(text, i + 1, F.lit(1))
    return F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.length(text) - 1),
            lambda i: F.when(one(i).rlike("[a-z]"), F.substring(F.lit(letters), _pick(digest, i, 26) + 1, F.lit(1)))
            .when(one(i).rlike("[0-9]"), F.substring(F.lit(digits), _pick(digest, i, 10) + 1, F.lit(1)))
            .otherwise(one(i)),
        ),
        "",
    )


#: Letters of a replaced domain at least, so that different domains stay different.
LABEL = 12


def _draw(secret: str) -> Column:
    """The replacement of an entity (columns ``type, gender, script, norm, attempt``) in normal form."""
    own = F.sha2(F.concat_ws("|", F.lit(secret), "type", "gender", "script", "norm", F.col("attempt").cast("string")).cast("binary"), 256)
    size = F.length("norm") + F.greatest(F.col("attempt") - ROOMY + 1, F.lit(0))
    number = F.array_join(
        F.transform(F.sequence(F.lit(1), size), lambda i: _pick(own, i, 10).cast("string")), ""
    )
    digits = F.concat(F.substring("norm", 1, 1), F.substring(number, F.lit(2), size))
    card = F.substring(digits, F.lit(1), F.length("norm") - 1)
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(card, F.lit("0"))), F.lit(10)), F.lit(10))
    address = F.concat_ws(
        ".", (_pick(own, 0, 223) + 1).cast("string"), *(_pick(own, i, 256).cast("string") for i in (1, 2, 3))
    )
    domain = F.substring_index("norm", "@", -1)
    label = F.substring_index(domain, ".", 1)
    named = F.sha2(F.concat_ws("|", F.lit(secret), F.lit("domain"), domain).cast("binary"), 256)
    host = F.concat(
        _shaped(named, F.rpad(label, F.greatest(F.length(label), F.lit(LABEL)), "x")), F.lit(".example."), F.substring_index(domain, ".", -1)
    )
    again = F.repeat(F.lit("x"), F.col("attempt").cast("int"))  # a longer local part at each new draw
    email = F.concat(_shaped(own, F.concat(again, F.substring_index("norm", "@", 1))), F.lit("@"), host)

    def syllables(script: str, count: Column) -> Column:
        own_list = SYLLABLES[script]
        return F.array_join(
            F.transform(
                F.sequence(F.lit(0), count - 1), lambda i: F.element_at(_array(own_list), _pick(own, i, len(own_list)) + 1)
            ),
            "",
        )

    def given(names: list[str]) -> Column:
        return F.array_join(
            F.transform(
                F.sequence(F.lit(0), F.col("attempt")),
                lambda i: F.lower(F.element_at(_array(names), _pick(own, i, len(names)) + 1)),
            ),
            "-",
        )

    names = F.lit(None).cast("string")
    for script in SYLLABLES:
        for gender in ("m", "f", "n"):
            pool = GIVEN["m", script] + GIVEN["f", script] if gender == "n" else GIVEN[gender, script]
            names = F.when((F.col("gender") == gender) & (F.col("script") == script), given(pool)).otherwise(names)
    surname = F.when(F.col("script") == "latin", syllables("latin", F.col("attempt") + 3)).otherwise(
        syllables("cyrillic", F.col("attempt") + 3)
    )
    return (
        F.when(F.col("type") == "email", email)
        .when(F.col("type") == "ip", address)
        .when(F.col("type") == "card", F.concat(card, check.cast("string")))
        .when(F.col("type").isin("phone", "ssn"), digits)
        .when(F.col("type") == "given", names)
        .otherwise(surname)
    )


ENTITY = ["type", "gender", "script", "norm"]
ROOMY, DRAWS = 4, 64


def draw_distinct(entities: DataFrame, secret: str) -> DataFrame:
    """``type, gender, script, norm, surrogate`` with one surrogate per entity and type.

    Of entities that drew the same one the first keeps it; the others, and those
    that drew an entity of the corpus, draw again.
    """
    entities = materialize(entities.select(*ENTITY).distinct(), "pii-entities")
    real = entities.select("type", F.col("norm").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    current, draws = entities.withColumn("attempt", F.lit(0)), 1
    while True:
        drawn = materialize(current.withColumn("surrogate", _draw(secret)), "pii-draws")
        order = F.struct("gender", "script", "norm")
        owners = materialize(
            drawn.groupBy("type", "surrogate").agg(F.min(order).alias("owner"), F.count("*").alias("n"))
            .join(real, ["type", "surrogate"], "left").filter("n > 1 or real"),
            "pii-collisions",
        )
        if owners.isEmpty():
            return drawn.select(*ENTITY, "surrogate")
        if draws == DRAWS:
            raise RuntimeError(f"no distinct surrogates after {DRAWS} draws")
        draws += 1
        lost = F.col("n").isNotNull() & (F.coalesce("real", F.lit(False)) | (F.col("owner") != order))
        current = drawn.join(owners, ["type", "surrogate"], "left").select(
            *ENTITY, (F.col("attempt") + F.when(lost, 1).otherwise(0)).alias("attempt")
        )


def _written(raw: Column, surrogate: Column, kind: Column) -> Column:
    """A surrogate in the spelling of the mention it replaces."""
    at_digit = F.aggregate(
        F.split(raw, ""),
        F.struct(F.lit("").alias("text"), F.lit(1).alias("at")),
        lambda got, c: F.when(
            c.rlike("[0-9]"),
            F.struct(
                F.concat(got["text"], F.substring(surrogate, got["at"], F.lit(1))).alias("text"), (got["at"] + 1).alias("at")
            ),
        ).otherwise(F.struct(F.concat(got["text"], c).alias("text"), got["at"].alias("at"))),
        lambda got: F.concat(got["text"], F.substring(surrogate, got["at"], F.length(surrogate))),  # more digits than before
    )
    capital = F.regexp_replace(F.initcap(F.regexp_replace(surrogate, "-", "- ")), "- ", "-")
    name = F.when(raw == F.upper(raw), F.upper(surrogate)).otherwise(capital)
    return (
        F.when(kind.isin("phone", "card", "ssn"), at_digit)
        .when(kind.isin("given", "surname"), name)
        .when(raw == F.upper(raw), F.upper(surrogate))
        .otherwise(surrogate)
    )


def _settled(cut: DataFrame) -> DataFrame:
    """``cut`` with one gender per given name."""
    named = cut.filter("given is not null")
    first, votes = F.col("norm"), lambda sex: F.count(F.when(F.col("gender") == sex, 1))
    counts = named.select("given.*").groupBy("script", "norm").agg(votes("m").alias("m"), votes("f").alias("f"))
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")
    for (sex, script), known in GIVEN.items():
        gender = F.when((F.col("script") == script) & first.isin([n.lower() for n in known]), sex).otherwise(gender)
    own = materialize(counts.select(F.col("script").alias("__script"), F.col("norm").alias("__norm"), gender.alias("__gender")), "pii-genders")
    same = (F.col("given.script") == F.col("__script")) & (F.col("given.norm") == F.col("__norm"))
    settled = named.join(own, same).withColumn("given", F.col("given").withField("gender", F.col("__gender")))
    return settled.select(*cut.columns).union(cut.filter("given is null"))


def _joined(mentions: DataFrame, drawn: DataFrame, part: str) -> DataFrame:
    """Add ``<part>_new``: the replacement of the atom ``part`` in the mention's spelling."""
    names = drawn.select(*(F.col(c).alias(f"__{c}") for c in (*ENTITY, "surrogate")))
    same = [F.col(f"{part}.{c}") == F.col(f"__{c}") for c in ENTITY]
    return mentions.join(names, same, "left").withColumn(
        f"{part}_new", _written(F.col(f"{part}.raw"), F.col("__surrogate"), F.col(f"{part}.type"))
    ).drop(*names.columns)


def replace_pii(docs: DataFrame, secret: str = "surrogates", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten; ``n_replaced`` (long) follows the other columns.

    Texts without an entity, null and empty ones are returned as they are with
    ``n_replaced`` 0. Repeated rows are rewritten alike. A column ``n_replaced``
    of ``docs`` is replaced; all others pass through, their names don't matter.
    """
    plain = docs.drop("n_replaced")
    names = plain.columns
    packed = plain.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    found = packed.withColumn(
        "mentions", F.transform(F.regexp_extract_all(F.col("row")[text], F.lit(PATTERN), F.lit(0)), _pieces)
    )
    found = materialize(found.withColumn("digest", F.when(F.size("mentions") > 0, F.sha2(F.col("row")[text].cast("binary"), 256))), "pii-found")
    own = found.filter("digest is not null").select("digest", F.explode(F.array_distinct(F.flatten("mentions"))).alias("mention")).distinct()
    cut = materialize(_settled(materialize(atoms(own), "pii-atoms")), "pii-settled")
    entities = cut.select("other.*").drop("raw").union(cut.filter("given is not null").select("given.*").drop("raw"))
    drawn = draw_distinct(entities, secret)
    new = _joined(materialize(_joined(cut, drawn, "other"), "pii-other"), drawn, "given")
    spelt = F.concat("title", F.when(F.col("given").isNotNull(), F.concat("given_new", F.lit(" "))).otherwise(""), "other_new")
    maps = materialize(
        new.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("mention", spelt.alias("new")))).alias("map")),
        "pii-maps",
    )
    parts = F.split(F.col("row")[text], PATTERN, -1)
    # resolved before the columns of docs, whose names may be the same, come back
    swapped = F.transform(
        "mentions", lambda m: F.array_join(F.transform(m, lambda p: F.coalesce(F.element_at("map", p), p)), "")
    )
    rewritten = F.concat(
        F.element_at(parts, 1),
        F.array_join(F.zip_with(swapped, F.slice(parts, 2, F.size("mentions")), lambda a, b: F.concat(a, b)), ""),
    )
    count = F.size(F.filter(F.flatten("mentions"), lambda m: F.element_at("map", m).isNotNull())).cast("long")
    columns = [F.col("row")[c].alias(c) for c in names]
    done = found.join(maps, "digest").select("row", F.struct(rewritten.alias("text"), count.alias("n")).alias("made"))
    changed = done.select(
        *(F.col("made")["text"].alias(c) if c == text else column for c, column in zip(names, columns)),
        F.col("made")["n"].alias("n_replaced"),
    )
    # what has no mention, or only mentions that proved to be none
    kept = found.filter("digest is null").unionByName(
        found.filter("digest is not null").join(maps.select("digest"), "digest", "left_anti").select(*found.columns)
    )
    return changed.unionByName(kept.select("row").select(*columns, F.lit(0).cast("long").alias("n_replaced")))


def op2_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, text, n_replaced`` of every document."""
    return replace_pii(table(spark, folder, "documents").select("doc_id", "text"))
