"""Secret scans: keyword automaton first, anchored patterns at its hits, then checksums.

One Aho-Corasick pass over a text finds where a keyword stands. A pattern is
tried only there, anchored at the hit, never as a search over the text. Runs of
hexadecimal digits have no keyword; they are found by one scan for long runs.
Tokens that carry a checksum (the last six base-62 digits are the CRC-32 of the
thirty before) are reported only if it holds.

Spans count Unicode code points, the end is exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

# The keywords and patterns of the base kinds.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]

SPANS = "array<struct<kind:string,start:int,end:int>>"
_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _base62(number: int, width: int) -> str:
    out = ""
    while number:
        number, rest = divmod(number, 62)
        out = _DIGITS[rest] + out
    return out.rjust(width, "0")


def checksum_holds(body: str) -> bool:
    """Whether the last six of 36 base-62 digits are the CRC-32 of the first thirty."""
    return body[30:] == _base62(zlib.crc32(body[:30].encode()), 6)


class Scanner:
    """The automaton and the anchored patterns; built once per Python worker."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access = re.compile(ACCESS)
        self.hex = re.compile(HEX)
        self.checked = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """Spans by start, then by kind in the order of ``KINDS``; none for null."""
        if not text:
            return []
        lower = text.lower()
        if len(lower) != len(text):  # a few capitals grow when they are lowered
            lower = text.translate(_ASCII_LOWER)
        found = []
        hits: dict[str, list[int]] = {}
        for last, (kind, length) in self.automaton.iter(lower):
            hits.setdefault(kind, []).append(last - length + 1)
        for kind, starts in hits.items():
            free = 0  # matches of a kind do not overlap, also those that fail later
            for start in sorted(starts):
                if start < free:
                    continue
                pattern = getattr(self, kind, self.checked)
                match = pattern.match(text, start)
                if not match:
                    continue
                free = match.end()
                if (
                    kind == "assign" and len(match[2]) >= 12
                    or kind == "access" and free - start >= 18
                    or kind in ("github", "npm") and checksum_holds(match[1])
                ):
                    found.append((kind, start, free))
        found += [("hex", m.start(), m.end()) for m in self.hex.finditer(text)]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    scanner = Scanner()
    for texts in batches:
        yield pd.Series(
            [[{"kind": k, "start": s, "end": e} for k, s, e in scanner.spans(t)] for t in texts],
            dtype=object,
        )


def secret_spans(text: Column) -> Column:
    """``kind, start, end`` of every secret in a text column; an empty list for null."""
    return F.pandas_udf(_scan, SPANS)(text)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, secrets`` per row; one narrow pass without a shuffle.

    Null and empty texts have no secrets, repeated rows are reported each for
    itself, other columns are not read.
    """
    return docs.select(F.col(key), secret_spans(F.col(text)).alias("secrets"))


def _joined(spans: Column) -> Column:
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, line), ",")


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per base kind, digest of the base spans and all spans, per document."""
    found = scan_secrets(table(spark, folder, "documents"))
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(_joined(of(*BASE)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )
