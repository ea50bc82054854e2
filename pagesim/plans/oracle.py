"""The same answers in plain SQL, by other means than the Spark operators use.

Trees come from tag tokens and running depths in windows (the parser uses a
stack, the operators intervals); sketches from cross-joined permutations.
"""

from __future__ import annotations

from ..functions import sketch as fn, vocabulary as vc
from ..operators import records
from .queries import ARCHIVE_DATE, MIN_JACCARD, MIN_LENGTH, VOCABULARIES

LEAVES = "('p','meta','link','input','img','hr','br')"
HEAD = "Content-Type: text/html"
CRLF = "chr(13)||chr(10)"


def _values(rows):
    return ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)


# DOM and trees ----------------------------------------------------------------


def tree_ctes(name: str, source: str = "pages") -> str:
    """opens: kept nodes with depth; tree: page_id, n, tag_id, depth, left_id, right_id."""
    ids = {t: i for t, i in VOCABULARIES[name].ids.items() if i != 0}
    vocab = _values((f"'{t}'", i) for t, i in ids.items())
    return f"""
vocab(tag, tag_id) AS (VALUES {vocab}),
clean AS (SELECT page_id, regexp_replace(html,
    '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') AS h FROM {source}),
tokens AS (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM
    (SELECT page_id, regexp_extract_all(h, '<(/?[a-zA-Z][a-zA-Z0-9]*)', 1) AS l FROM clean)),
known AS (SELECT page_id, pos, tag_id, t LIKE '/%' AS closing, v.tag IN {LEAVES} AS leaf
    FROM tokens JOIN vocab v ON v.tag = lower(ltrim(t, '/'))),
walk AS (SELECT *, sum(CASE WHEN leaf THEN 0 WHEN closing THEN -1 ELSE 1 END)
    OVER (PARTITION BY page_id ORDER BY pos) AS level FROM known),
opens AS (SELECT page_id, pos, tag_id, CASE WHEN leaf THEN level ELSE level - 1 END AS depth,
    row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS n
    FROM walk WHERE NOT closing),
kids AS (SELECT o.page_id, o.n, o.pos, o.tag_id, o.depth, p.pos AS parent
    FROM opens o ASOF LEFT JOIN (SELECT page_id, pos, depth + 1 AS below FROM opens) p
    ON o.page_id = p.page_id AND o.depth = p.below AND o.pos > p.pos),
firsts AS (SELECT page_id, parent, arg_min(tag_id, pos) AS left_id FROM kids
    WHERE parent IS NOT NULL GROUP BY ALL),
tree AS (SELECT k.page_id, k.n, k.tag_id, k.depth, coalesce(f.left_id, 0) AS left_id,
    CASE WHEN k.parent IS NULL THEN 0 ELSE coalesce(lead(k.tag_id) OVER
        (PARTITION BY k.page_id, k.parent ORDER BY k.pos), 0) END AS right_id
    FROM kids k LEFT JOIN firsts f ON k.page_id = f.page_id AND k.pos = f.parent),
grams AS (SELECT page_id, tag_id || '.' || left_id || '.' || right_id AS gram,
    count(*) AS times, any_value(tag_id) AS i, any_value(left_id) AS j,
    any_value(right_id) AS k FROM tree GROUP BY page_id, gram)"""


WITHOUT_RAW = (
    r"regexp_replace(html, '(?s)<(script|style)([^>]*)>.*?</(script|style)>', '<\1\2>', 'g')"
)

HTML_NODES = f"""
WITH t AS (SELECT page_id, regexp_extract_all({WITHOUT_RAW},
    '<(!--|[a-zA-Z][a-zA-Z0-9]*)', 1) AS l FROM pages)
SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos,
    replace(lower(unnest(l)), '!--', '#comment') AS tag FROM t"""

NODE_ATTRIBUTES = f"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all({WITHOUT_RAW}, '<[a-zA-Z][^>]*>')) AS t
    FROM pages),
n(name) AS (VALUES ('href'), ('class'), ('name'), ('lang')),
a AS (SELECT page_id, lower(regexp_extract(t, '^<([a-zA-Z0-9]+)', 1)) AS tag, name,
    CASE name WHEN 'href' THEN regexp_extract(t, ' href="([^"]*)"', 1)
        WHEN 'class' THEN regexp_extract(t, ' class="([^"]*)"', 1)
        WHEN 'name' THEN regexp_extract(t, ' name="([^"]*)"', 1)
        ELSE regexp_extract(t, ' lang="([^"]*)"', 1) END AS value FROM t CROSS JOIN n)
SELECT page_id, tag, name, value, count(*) AS nodes FROM a WHERE value <> '' GROUP BY ALL"""

VOCABULARY_USE = f"""
WITH t AS (SELECT replace(lower(unnest(regexp_extract_all({WITHOUT_RAW},
    '<(!--|[a-zA-Z][a-zA-Z0-9]*)', 1))), '!--', '#comment') AS tag FROM pages),
c AS (SELECT tag, count(*) AS nodes FROM t GROUP BY tag),
r(tag, tag_id) AS (VALUES {_values((f"'{t}'", i) for t, i in vc.REFERENCE.ids.items())}),
f(tag, full_id) AS (VALUES {_values((f"'{t}'", i) for t, i in vc.FULL.ids.items())}),
e(tag) AS (VALUES {_values((f"'{t}'",) for t in vc.EXCLUDED_TAGS)})
SELECT c.tag, nodes, tag_id, full_id, e.tag IS NOT NULL AS excluded
FROM c LEFT JOIN r ON c.tag = r.tag LEFT JOIN f ON c.tag = f.tag LEFT JOIN e ON c.tag = e.tag"""

WITH_EMPTY = """p2 AS (SELECT page_id, url,
    CASE WHEN contains(url, 'utm_source') THEN '' ELSE html END AS html FROM pages)"""


def structural_nodes(name):
    return f"""WITH {tree_ctes(name)}
SELECT page_id, CAST(n AS INTEGER) AS n, tag_id, CAST(depth AS INTEGER) AS depth FROM tree"""


def preorder_string(name):
    return f"""WITH {tree_ctes(name)}
SELECT page_id, string_agg(CAST(tag_id AS VARCHAR), '.' ORDER BY n) AS preorder
FROM tree GROUP BY page_id"""


def binary_tree(name):
    return f"""WITH {tree_ctes(name)}
SELECT page_id, CAST(n AS INTEGER) AS n, tag_id, left_id, right_id FROM tree"""


def structural_grams(name):
    return f"WITH {tree_ctes(name)} SELECT page_id, gram, times FROM grams"


def gram_set(name):
    return f"""WITH {tree_ctes(name)}
SELECT page_id, string_agg(gram, ' ' ORDER BY gram) AS grams FROM grams GROUP BY page_id"""


def gram_vector(name):
    n = VOCABULARIES[name].size
    return f"""WITH {tree_ctes(name)}
SELECT page_id, CAST(i * {n * n} + j * {n} + k AS INTEGER) AS cell, times FROM grams"""


EMPTY_ERRORS = (
    "HtmlParser: Document is empty; TreeParser: NoneType object; TreeStringify: NoneType object"
)
NULL_TREES = f"""WITH {WITH_EMPTY}, {tree_ctes("reference", "p2")},
s AS (SELECT page_id, string_agg(CAST(tag_id AS VARCHAR), '.' ORDER BY n) AS preorder
    FROM tree GROUP BY page_id),
g AS (SELECT page_id, string_agg(gram, ' ' ORDER BY gram) AS grams FROM grams GROUP BY page_id)
SELECT p.page_id, coalesce(preorder, '') AS preorder, coalesce(grams, 'None.0.0') AS grams,
    CASE WHEN grams IS NULL THEN '{EMPTY_ERRORS}' ELSE '' END AS errors
FROM p2 p LEFT JOIN s ON p.page_id = s.page_id LEFT JOIN g ON p.page_id = g.page_id"""

LINEAGE = f"""WITH {WITH_EMPTY}, {tree_ctes("reference", "p2")},
s AS (SELECT page_id, string_agg(CAST(tag_id AS VARCHAR), '.' ORDER BY n) AS preorder
    FROM tree GROUP BY page_id)
SELECT p.page_id, 'extract,html_parse,tree_parse,tree_stringify' AS lineage,
    CASE WHEN preorder IS NULL THEN '{EMPTY_ERRORS}' ELSE '' END AS errors,
    coalesce(preorder, '') AS preorder
FROM p2 p LEFT JOIN s ON p.page_id = s.page_id"""

# Sketches ---------------------------------------------------------------------

DOCUMENT_ITEMS = r"""
words AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\r\n]+'),
    lambda x: x <> '') AS w FROM documents),
items AS (SELECT CAST(doc_id AS VARCHAR) AS key, unnest(list_distinct(
    CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2]) END
    )) AS item FROM words)"""


def sketch_ctes(bands: bool = True) -> str:
    """From items(key, item): ids (key, sketch_id), sigs (key, sig list), bands."""
    limb = 1 << 32
    rows = [
        (i, *(f"{v}::UBIGINT" for v in (int(a) // limb, int(a) % limb, int(b) // limb, int(b) % limb)))
        for i, (a, b) in enumerate(zip(*fn.permutations()))
    ]
    out = f"""
perms(i, a1, a0, b1, b0) AS (VALUES {_values(rows)}),
hashed AS MATERIALIZED (SELECT key, ('0x'||substr(d,7,2)||substr(d,5,2)||substr(d,3,2)||
    substr(d,1,2))::UBIGINT AS h FROM (SELECT key, sha1(item) AS d FROM items)),
limbs AS (SELECT key, i, a0 * h AS t, a1 * h % {limb} + b1 AS high, b0
    FROM hashed CROSS JOIN perms),
carried AS (SELECT key, i, (t // {limb} + high + (t % {limb} + b0) // {limb}) % {limb} AS high,
    (t % {limb} + b0) % {limb} AS low FROM limbs),
mins AS (SELECT key, i, CAST(min((high * {limb} + low) % {fn.MERSENNE_PRIME} % {limb}) AS BIGINT) AS v
    FROM carried GROUP BY key, i),
sigs AS MATERIALIZED (SELECT key, list(v ORDER BY i) AS sig FROM mins GROUP BY key)"""
    if bands:
        out += f""",
bands AS MATERIALIZED (SELECT key, CAST(band AS INTEGER) AS band, ('0x' || substr(md5(array_to_string(
    sig[band * {fn.ROWS} + 1 : (band + 1) * {fn.ROWS}], ',')), 1, 15))::BIGINT AS band_hash
    FROM sigs CROSS JOIN (SELECT unnest(range({fn.BANDS})) AS band)),
ids AS MATERIALIZED (SELECT key, md5(string_agg(length(item) || ':' || item, '' ORDER BY item)) AS sketch_id,
    list(item) AS grams FROM items GROUP BY key),
linked AS MATERIALIZED (SELECT DISTINCT a.key AS x, b.key AS y FROM bands a JOIN bands b
    ON a.band = b.band AND a.band_hash = b.band_hash),
scored AS MATERIALIZED (SELECT x, y, ia.sketch_id AS sx, ib.sketch_id AS sy,
    list_sum(list_transform(list_zip(sa.sig, sb.sig), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END))
        / {fn.NUM_PERM}.0 AS est,
    len(list_intersect(ia.grams, ib.grams)) AS common, len(ia.grams) AS na, len(ib.grams) AS nb
    FROM linked JOIN sigs sa ON sa.key = x JOIN sigs sb ON sb.key = y
    JOIN ids ia ON ia.key = x JOIN ids ib ON ib.key = y),
measured AS (SELECT *, CAST(est AS DOUBLE) AS jaccard_est,
    common / (na + nb - common)::DOUBLE AS jaccard_exact FROM scored)"""
    return out


DOCS = DOCUMENT_ITEMS + "," + sketch_ctes()
MINHASH = f"""WITH {DOCUMENT_ITEMS}, {sketch_ctes(False)}
SELECT CAST(key AS BIGINT) AS doc_id, array_to_string(sig, ',') AS sig FROM sigs"""

# Pages: distinct 3-gram sets are sketched once.
PAGE_ITEMS = tree_ctes("block") + """,
page_sets AS MATERIALIZED (SELECT page_id, string_agg(gram, ' | ' ORDER BY gram) AS grams
    FROM grams GROUP BY page_id),
items AS (SELECT grams AS key, unnest(string_split(grams, ' | ')) AS item
    FROM (SELECT DISTINCT grams FROM page_sets))"""

MINHASH_PAGES = f"""WITH {PAGE_ITEMS}, {sketch_ctes(False)}
SELECT page_id, array_to_string(sig, ',') AS sig FROM page_sets JOIN sigs ON grams = key"""

PAGE_SCORES = f"""WITH {PAGE_ITEMS}, {sketch_ctes()},
norms AS (SELECT page_id, sqrt(sum(times * times)::DOUBLE) AS norm FROM grams GROUP BY page_id)"""


def page_scores(pairs: str, first: str) -> str:
    """Scores of pages p against query pages q, for a FROM clause naming both."""
    return f"""{PAGE_SCORES},
pairs AS MATERIALIZED ({pairs}),
dots AS (SELECT q, p, sum(gq.times * gp.times)::DOUBLE AS dot FROM pairs
    JOIN grams gq ON gq.page_id = q JOIN grams gp ON gp.page_id = p AND gp.gram = gq.gram
    GROUP BY q, p),
final AS (SELECT pairs.q, pairs.p, round(jaccard_est, 6) AS jaccard_est,
    round(jaccard_exact, 6) AS jaccard_exact,
    round(greatest(0.0, 1 - coalesce(dot, 0) / (np.norm * nq.norm)), 6) AS cosine_distance
    FROM pairs JOIN page_sets sq ON sq.page_id = pairs.q JOIN page_sets sp ON sp.page_id = pairs.p
    JOIN measured ON x = sq.grams AND y = sp.grams
    LEFT JOIN dots ON dots.q = pairs.q AND dots.p = pairs.p
    JOIN norms nq ON nq.page_id = pairs.q JOIN norms np ON np.page_id = pairs.p)
{first}"""


SIMILAR_PAGES = page_scores(
    "SELECT a.page_id AS q, b.page_id AS p FROM pages a, pages b "
    "WHERE a.url = (SELECT min(url) FROM pages)",
    """SELECT a.url AS query_url, b.url, jaccard_est, jaccard_exact, cosine_distance
FROM final JOIN pages a ON a.page_id = q JOIN pages b ON b.page_id = p
WHERE cosine_distance <= 0.5
UNION ALL SELECT min(url), min(url) || '*', 1.0, 1.0, 0.0 FROM pages""",
)
FIRST_PAGES = page_scores(
    "SELECT a.page_id AS q, b.page_id AS p FROM "
    "(SELECT page_id FROM pages ORDER BY url LIMIT 11) a, pages b",
    """SELECT a.url AS query_url, b.url, jaccard_est, jaccard_exact, cosine_distance
FROM final JOIN pages a ON a.page_id = q JOIN pages b ON b.page_id = p""",
)
SITE = "regexp_extract(url, '^https?://([^/]+)/', 1)"
SITE_SCORES = f"""{PAGE_SCORES},
sites AS (SELECT page_id, url, {SITE} AS site FROM pages),
firsts2 AS (SELECT site, arg_min(page_id, url) AS q FROM sites GROUP BY site),
pairs AS MATERIALIZED (SELECT q, page_id AS p FROM sites JOIN firsts2 USING (site)),
dots AS (SELECT q, p, sum(gq.times * gp.times)::DOUBLE AS dot FROM pairs
    JOIN grams gq ON gq.page_id = q JOIN grams gp ON gp.page_id = p AND gp.gram = gq.gram
    GROUP BY q, p),
sets AS (SELECT page_id, list(gram) AS g FROM grams GROUP BY page_id)
SELECT pairs.p AS page_id,
    round(list_sum(list_transform(list_zip(mq.sig, mp.sig),
        lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END)) / 128.0::DOUBLE, 6) AS jaccard_est,
    round(len(list_intersect(eq.g, ep.g))::DOUBLE
        / (len(eq.g) + len(ep.g) - len(list_intersect(eq.g, ep.g))), 6) AS jaccard_exact,
    round(greatest(0.0, 1 - coalesce(dot, 0) / (np.norm * nq.norm)), 6) AS cosine_distance
FROM pairs JOIN page_sets sq ON sq.page_id = pairs.q JOIN page_sets sp ON sp.page_id = pairs.p
JOIN sigs mq ON mq.key = sq.grams JOIN sigs mp ON mp.key = sp.grams
JOIN sets eq ON eq.page_id = pairs.q JOIN sets ep ON ep.page_id = pairs.p
LEFT JOIN dots ON dots.q = pairs.q AND dots.p = pairs.p
JOIN norms nq ON nq.page_id = pairs.q JOIN norms np ON np.page_id = pairs.p"""

WORD = "('0x' || substr(d, {at}, 8))::UBIGINT"
UNIFORMS = ", ".join(
    f"(('0x' || substr(d, {8 * i + 1}, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0 AS u{i}"
    for i in range(5)
)
WEIGHTED_MINHASH = f"""WITH {tree_ctes("block")},
cells AS (SELECT page_id, i * {VOCABULARIES["block"].size ** 2} + j * {VOCABULARIES["block"].size} + k AS dim,
    times AS w FROM grams),
draws AS MATERIALIZED (SELECT dim, sample, -ln(u0 * u1) AS r, ln(-ln(u2 * u3)) AS lc, u4 AS beta FROM
    (SELECT dim, sample, {UNIFORMS} FROM (SELECT dim, sample, sha1('{fn.SEED}:' || dim || ':' || sample) AS d
    FROM (SELECT DISTINCT dim FROM cells) CROSS JOIN (SELECT unnest(range({fn.NUM_PERM})) AS sample)))),
steps AS (SELECT page_id, sample, c.dim, floor(ln(w) / r + beta) AS t, r, lc, beta
    FROM cells c JOIN draws d ON c.dim = d.dim)
SELECT page_id, CAST(sample AS INTEGER) AS sample, CAST(arg_min(dim, lc - r * (t - beta) - r) AS BIGINT) AS dim,
    CAST(arg_min(t, lc - r * (t - beta) - r) AS BIGINT) AS t FROM steps GROUP BY page_id, sample"""

BAND_INDEX = f"WITH {DOCS} SELECT 'doc:' || key AS url, band, band_hash FROM bands"
CANDIDATES = f"WITH {DOCS} SELECT DISTINCT sx AS query_sketch, sy AS sketch_id FROM scored"
SIMILAR_DOCUMENTS = f"""WITH {DOCS}
SELECT 'doc:' || x AS query_url, 'doc:' || y AS url, round(jaccard_est, 6) AS jaccard_est,
    round(jaccard_exact, 6) AS jaccard_exact FROM measured WHERE jaccard_est >= {MIN_JACCARD}"""
SIMILAR_PAIRS = f"""WITH {DOCS},
named AS (SELECT sketch_id, min('doc:' || key) AS url, count(*) AS copies FROM ids GROUP BY sketch_id),
pairs AS (SELECT DISTINCT sx, sy, jaccard_est, jaccard_exact FROM measured
    WHERE sx <> sy AND jaccard_est >= {MIN_JACCARD})
SELECT a.url AS url_a, b.url AS url_b, a.copies AS copies_a, b.copies AS copies_b,
    round(jaccard_est, 6) AS jaccard_est, round(jaccard_exact, 6) AS jaccard_exact
FROM pairs JOIN named a ON a.sketch_id = sx JOIN named b ON b.sketch_id = sy WHERE a.url < b.url
UNION ALL SELECT n.url, 'doc:' || key, n.copies, n.copies, 1.0::DOUBLE, 1.0::DOUBLE
FROM ids i JOIN named n ON n.sketch_id = i.sketch_id WHERE 'doc:' || key <> n.url"""
BUCKETS = f"""WITH {DOCS},
sized AS (SELECT band, band_hash, count(*) AS bucket_size FROM bands GROUP BY ALL HAVING count(*) > 1)
SELECT b.band, b.band_hash, bucket_size, 'doc:' || key AS url FROM bands b
JOIN sized s ON b.band = s.band AND b.band_hash = s.band_hash"""


def clusters(edges: str) -> str:
    return f"""WITH RECURSIVE {DOCS},
edges AS MATERIALIZED (SELECT 'doc:' || x AS a, 'doc:' || y AS b FROM measured {edges}),
reach(url, seen) AS (SELECT 'doc:' || key, 'doc:' || key FROM ids
    UNION SELECT r.url, e.b FROM reach r JOIN edges e ON e.a = r.seen),
named AS (SELECT url, min(seen) AS cluster FROM reach GROUP BY url)
SELECT url, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM named"""


CLUSTER_PAGES = f"""WITH RECURSIVE {PAGE_ITEMS}, {sketch_ctes()},
reach(k, seen) AS (SELECT key, key FROM sigs UNION SELECT r.k, l.y FROM reach r JOIN linked l ON l.x = r.seen),
roots AS (SELECT k, min(seen) AS root FROM reach GROUP BY k),
placed AS (SELECT url, root FROM pages p JOIN page_sets s ON p.page_id = s.page_id JOIN roots ON k = s.grams)
SELECT url, min(url) OVER (PARTITION BY root) AS cluster, count(*) OVER (PARTITION BY root) AS cluster_size
FROM placed"""

INDEX_ROWS = f"""WITH {tree_ctes("block")}
SELECT url, md5(string_agg(length(gram) || ':' || gram, '' ORDER BY gram)) AS sketch_id, CAST(count(*) AS INTEGER) AS grams,
    CAST({fn.BANDS} AS BIGINT) AS bands, CAST(count(*) AS INTEGER) AS cells
FROM grams g JOIN pages p ON g.page_id = p.page_id {{where}} GROUP BY p.page_id, url"""

DENSE_COSINE = """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(round(x, 4)) AS m FROM e GROUP BY ALL)
SELECT vec_id, round(1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 5) AS cosine_distance
FROM e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY vec_id"""

STREAM_SIMILAR = f"""WITH {PAGE_ITEMS}, {sketch_ctes()}
SELECT least(p.url, q.url) AS url_a, greatest(p.url, q.url) AS url_b
FROM page_sets s JOIN linked l ON l.x = s.grams JOIN page_sets t ON l.y = t.grams
JOIN pages p ON p.page_id = s.page_id JOIN pages q ON q.page_id = t.page_id WHERE p.url < q.url
UNION SELECT url, url || '*' FROM pages"""

# Archives and records ---------------------------------------------------------

MOVED = "contains(url, 'utm_source')"
BROKEN = "(contains(url, '/es/') AND ends_with(url, '#top'))"
STATUS = f"CASE WHEN {MOVED} THEN '301 Moved Permanently' ELSE '200 OK' END"
RECORDS = f"""r AS (SELECT page_id, url, html, regexp_extract(url, '/([a-z][a-z])/', 1) AS file,
    CASE WHEN starts_with(url, 'http://blog.') THEN 'request' ELSE 'response' END AS record_type,
    {MOVED} AS moved, {BROKEN} AS broken, 'HTTP/1.1 ' || {STATUS} AS status,
    CASE WHEN {MOVED} THEN '' ELSE html END AS page FROM pages),
recs AS (SELECT *, CASE WHEN broken THEN status ELSE status || {CRLF} || '{HEAD}' || {CRLF} || {CRLF}
    || ' ' || chr(10) || page || {CRLF} || chr(9) END AS payload FROM r),
sized AS (SELECT *, CAST(strlen(payload) AS BIGINT) AS content_length FROM recs)"""
HTTP_HEADERS = f"CASE WHEN broken THEN NULL ELSE status || {CRLF} || '{HEAD}' END"
KEPT = f"record_type = 'response' AND content_length > {MIN_LENGTH}"

WARC_PAYLOAD = f"'HTTP/1.1 200 OK' || {CRLF} || '{HEAD}' || {CRLF} || {CRLF} || html"
WARC_DATE = ARCHIVE_DATE.replace(" ", "T") + "Z"
WARC = f"""w AS (SELECT page_id, url, html, {WARC_PAYLOAD} AS payload FROM pages),
w2 AS (SELECT *, CAST(strlen(payload) AS BIGINT) AS content_length,
    'sha1:' || sha1(payload) AS checksum, '<urn:uuid:' || md5(url) || '>' AS record_id FROM w),
w3 AS (SELECT *, 'WARC/1.0' || {CRLF} || 'WARC-Type: response' || {CRLF} || 'WARC-Target-URI: ' || url
    || {CRLF} || 'WARC-Record-ID: ' || record_id || {CRLF} || 'WARC-Date: {WARC_DATE}' || {CRLF}
    || 'Content-Type: application/http; msgtype=response' || {CRLF} || 'Content-Length: '
    || content_length || {CRLF} || 'WARC-Payload-Digest: ' || checksum || {CRLF} || {CRLF}
    || payload || {CRLF} || {CRLF} AS record FROM w2)"""

NAMES_SQL = r"""
WITH n AS (SELECT page_id, 'WARC-ip-' || regexp_replace(regexp_replace(url, '^https?://', ''),
    '[^a-zA-Z0-9]+', '-', 'g') || '-id-uri' AS name FROM pages),
parts AS (SELECT page_id, regexp_extract_all(name, '[a-zA-Z]+|[^a-zA-Z]') AS l FROM n)
SELECT page_id, replace(replace(replace(replace(array_to_string(list_transform(l,
    lambda x: upper(x[1]) || lower(x[2:])), ''),
    'Warc-', 'WARC-'), '-Ip-', '-IP-'), '-Id', '-ID'), '-Uri', '-URI') AS name FROM parts"""

ARC_COLUMNS = f"""'Example Org' AS org, url, '127.0.0.1' AS ip_address, '{ARCHIVE_DATE}' AS date,
    'text/html' AS content_type"""
ARC_SCAN = f"""
SELECT 1 AS version, {ARC_COLUMNS}, NULL AS result_code, NULL AS checksum, NULL::BIGINT AS "offset",
    NULL AS filename, CAST(strlen(html) AS BIGINT) AS length, html FROM pages
UNION ALL SELECT 2, {ARC_COLUMNS}, '200', sha1(html), page_id, 'pages.arc',
    CAST(strlen(html) AS BIGINT), html FROM pages"""
ARC_FIELDS = f"""
SELECT page_id, 1 AS version, url, '{ARCHIVE_DATE}' AS date, NULL AS checksum, NULL::BIGINT AS "offset",
    CAST(strlen(html) AS BIGINT) AS length, html AS payload FROM pages
UNION ALL SELECT page_id, 2, url, '{ARCHIVE_DATE}', md5(url), page_id, CAST(strlen(html) AS BIGINT), html FROM pages"""

WARC_DEFAULTS = f"""WITH {RECORDS},
d AS (SELECT page_id, record_type, payload FROM recs)
SELECT page_id, 'warc-type' AS name, record_type AS value FROM d
UNION ALL SELECT page_id, 'warc-date', '{WARC_DATE}' FROM d
UNION ALL SELECT page_id, 'content-type', 'application/http; msgtype=' || record_type FROM d
UNION ALL SELECT page_id, 'content-length', CAST(strlen(payload) AS VARCHAR) FROM d
UNION ALL SELECT page_id, 'warc-payload-digest', 'sha1:' || sha1(payload) FROM d"""

ORACLE = {
    "s2_k1_warc_scan": f"""WITH {WARC}
SELECT '1.0' AS version, 'response' AS record_type, record_id, url, content_length, checksum,
    '{ARCHIVE_DATE}' AS date, 'application/http; msgtype=response' AS content_type,
    'HTTP/1.1 200 OK' || {CRLF} || '{HEAD}' AS http_headers, html FROM w2""",
    "s2_warc_scan_pushdown": f"""WITH {WARC}
SELECT url, content_length FROM w2 WHERE content_length > {MIN_LENGTH}""",
    "s3_warc_header_block": """
SELECT page_id, 'warc-type' AS name, 'resource: ' || page_id AS value FROM pages
UNION ALL SELECT page_id, 'warc-target-uri', url FROM pages
UNION ALL SELECT page_id, 'x-copy', CAST(page_id AS VARCHAR) FROM pages""",
    "s2_split_gzip": f"""WITH {WARC}
SELECT url, CAST(strlen(record) AS BIGINT) AS size, least(content_length, 1048576) AS payload_bytes FROM w3""",
    "s4_k5_arc_scan": ARC_SCAN,
    "s4_split_scan": ARC_SCAN,
    "s5_arc_fields": ARC_FIELDS,
    "s6_warc_offsets": f"""WITH {WARC}
SELECT url, CAST(strlen(record) AS BIGINT) AS size, least(content_length, 1048576) AS payload_bytes FROM w3""",
    "s7_s8_vocabulary_use": VOCABULARY_USE,
    "s7_load_vocabulary": f"""WITH u AS ({VOCABULARY_USE})
SELECT tag, CAST(row_number() OVER (ORDER BY tag) - 1 AS INTEGER) AS tag_id FROM u""",
    "s8_load_excluded": f"WITH u AS ({VOCABULARY_USE}) SELECT tag FROM u",
    "s9_k6_saved_index": INDEX_ROWS.format(where=""),
    "s9_l4_stored_lookup": FIRST_PAGES,
    "s10_pages_as_records": "SELECT url, html, 'extract' AS lineage, 0 AS errors FROM pages",
    "k2_warc_header_names": NAMES_SQL,
    "k3_warc_defaults": WARC_DEFAULTS,
    "k4_pages_to_warc": f"WITH {WARC} SELECT page_id, record FROM w3",
    "f1_filter_responses": f"WITH {RECORDS} SELECT page_id, url, content_length FROM sized WHERE {KEPT}",
    "f2_split_http": f"""WITH {RECORDS} SELECT page_id, {HTTP_HEADERS} AS http_headers,
    CASE WHEN broken THEN NULL ELSE ' ' || chr(10) || page || {CRLF} || chr(9) END AS body,
    CASE WHEN broken THEN '{records.NO_BLANK_LINE}' ELSE '' END AS errors FROM recs""",
    "f3_drop_moved": f"""WITH {RECORDS} SELECT page_id, {HTTP_HEADERS} AS http_headers
FROM recs WHERE broken OR NOT moved""",
    "f4_project_html": f"""WITH {RECORDS} SELECT url,
    CASE WHEN broken THEN NULL ELSE page END AS html, 'extract' AS lineage,
    CASE WHEN broken THEN '{records.NO_BLANK_LINE}' ELSE '' END AS errors
FROM sized WHERE {KEPT} AND (broken OR NOT moved)""",
    "f5_limit_records": f"""WITH {RECORDS} SELECT file, page_id AS "offset", url FROM sized
WHERE {KEPT} ORDER BY file, page_id LIMIT 50""",
    "f6_dedupe_urls": f"""WITH s AS (SELECT page_id, {SITE} AS site,
    regexp_extract(url, '/([a-z][a-z])/', 1) AS file FROM pages),
o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY file, page_id) AS rn,
    count(*) OVER (PARTITION BY site) AS copies FROM s)
SELECT site AS url, file, page_id AS "offset", copies FROM o WHERE rn = 1""",
    "f5_first_records": "SELECT url, html FROM pages ORDER BY url DESC LIMIT 100",
    "f6_first_of_urls": "SELECT url, CAST(2 AS BIGINT) AS copies, html FROM pages",
    "f6_split_gzip": f"SELECT {SITE} AS url, count(*) AS copies FROM pages GROUP BY 1",
    "f7_typed_headers": f"""WITH {WARC} SELECT 'response' AS record_type, record_id, url,
    CAST(NULL AS VARCHAR) AS ip_address, '{ARCHIVE_DATE}' AS date, content_length, checksum FROM w2""",
    "t1_html_nodes": HTML_NODES,
    "t2_parse_errors": f"""SELECT 'HtmlParser: Document is empty' AS error, count(*) AS pages
FROM pages WHERE {MOVED} HAVING count(*) > 0""",
    "t4_node_attributes": NODE_ATTRIBUTES,
    "t7_null_trees": NULL_TREES,
    "m1_minhash_documents": MINHASH,
    "m1_minhash_rows": MINHASH,
    "m1_minhash_pages": MINHASH_PAGES,
    "m2_weighted_minhash": WEIGHTED_MINHASH,
    "p4_ingest_counters": f"""SELECT count(*) AS rows, count(*) AS processed,
    count(*) FILTER ({MOVED}) AS failed, CAST(1000000 AS BIGINT) AS maximum,
    count(DISTINCT url) AS inserted FROM pages""",
    "l2_band_index": BAND_INDEX,
    "l3_candidates": CANDIDATES,
    "l4_similar_documents": SIMILAR_DOCUMENTS,
    "l4_l5_similar_pages": SIMILAR_PAGES,
    "l6_similar_pairs": SIMILAR_PAIRS,
    "l6_first_pages_report": FIRST_PAGES,
    "l7_cluster_documents": clusters(""),
    "l7_cluster_documents_verified": clusters(f"WHERE jaccard_exact >= {MIN_JACCARD}"),
    "l7_cluster_pages": CLUSTER_PAGES,
    "l8_bucket_contents": BUCKETS,
    "m3_m4_m5_page_scores": SITE_SCORES,
    "m5_dense_cosine": DENSE_COSINE,
    "p1_required_lineage": "SELECT page_id, 'extract,html_parse' AS lineage FROM pages",
    "p2_p3_lineage": LINEAGE,
    "p3_saved_stages": LINEAGE,
    "p4_stream_counters": f"""SELECT count(*) AS rows, count(*) AS processed,
    count(*) FILTER ({MOVED}) AS failed, count(DISTINCT url) AS inserted, CAST(4 AS BIGINT) AS batches FROM pages""",
    "p5_build_index": INDEX_ROWS.format(where=""),
    "p5_archive_ingest": INDEX_ROWS.format(where=""),
    "p5_arc_ingest": INDEX_ROWS.format(where=""),
    "r1_stream_mixed_archives": INDEX_ROWS.format(where=""),
    "r1_stream_index": INDEX_ROWS.format(where=""),
    "r1_compacted": INDEX_ROWS.format(where=""),
    "r2_stream_unique_urls": "SELECT url, CAST(1 AS BIGINT) AS times FROM pages",
    "r2_two_streams_disjoint": INDEX_ROWS.format(where=""),
    "r2_two_streams_overlap": INDEX_ROWS.format(where=""),
    "k6_rebuild_over_stream": INDEX_ROWS.format(where=""),
    "k6_append_overlap": INDEX_ROWS.format(where=""),
    "r3_stream_similar": STREAM_SIMILAR,
    "r3_stream_similar_small_batches": STREAM_SIMILAR,
}
ORACLE["r1_stream_archives"] = ORACLE["p5_archive_ingest"]
for _name in VOCABULARIES:
    ORACLE[f"t3_structural_nodes_{_name}"] = structural_nodes(_name)
    ORACLE[f"t5_preorder_string_{_name}"] = preorder_string(_name)
    ORACLE[f"t6_binary_tree_{_name}"] = binary_tree(_name)
    ORACLE[f"g1_structural_grams_{_name}"] = structural_grams(_name)
    ORACLE[f"g2_gram_set_{_name}"] = gram_set(_name)
    ORACLE[f"g3_gram_vector_{_name}"] = gram_vector(_name)
