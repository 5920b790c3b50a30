"""Secret scans by assignment-aware lexing.

Three patterns find what looks like a secret anywhere: a value after a telling word
(``assign``), an access key (``access``) and a long run of hex digits (``hex``).  The
lexer adds what only the syntax tells (``literal``): a text's source and configuration
syntax is read into pairs of a name and a literal, constants are propagated through
names, sums and references, and each literal is scored by the names it ends up in and
by what it is made of.  A literal that a pattern covers already is not added.

Every row is judged on its own and whole, so the scan is one pass without a shuffle.

Defined results: a null text counts as empty and has no span; repeated rows and null ids
are rows like others; names are not scoped, and a name stands for its last value before
the use or, without one, its first after it; cycles of names resolve to the literals on
them; further columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.assignments import Value, literals, read_pairs
from tidemark.llm.common import prepare, query, table, whole_text

KINDS = ("assign", "access", "hex", "literal")
SPANS = "array<struct<kind:string,start:long,end:long,name:string,score:double>>"

# The three patterns, letters of the telling words in either case.
WORDS = ("password", "passwd", "secret", "token", "api_?key")
LEAST = {"assign": 8, "access": 16, "hex": 32}


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    f"({'|'.join(map(_either_case, WORDS))})" + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Only whole runs can be long enough, so shorter ones are passed over at once.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

# What a word of a name says about the value, in log odds.
NAME_WEIGHTS = {
    "password": 4.0, "passwd": 4.0, "passphrase": 4.0, "pwd": 4.0, "pass": 3.0, "secret": 4.0, "secrets": 3.5,
    "credential": 4.0, "credentials": 4.0, "token": 3.5, "bearer": 3.0, "apikey": 4.0, "api": 1.0, "key": 1.5,
    "private": 1.5, "access": 1.0, "auth": 2.0, "authorization": 2.5, "signing": 1.5, "encryption": 1.5, "client": 0.5,
    "pin": 1.5, "salt": 2.0, "webhook": 1.5, "dsn": 1.5, "cookie": 1.0, "session": 1.0, "license": 1.0,
    "public": -2.5, "id": -1.5, "name": -2.0, "count": -3.0, "length": -3.0, "size": -3.0, "limit": -3.0, "max": -2.0,
    "min": -2.0, "file": -2.0, "path": -2.0, "url": -1.5, "uri": -1.5, "type": -3.0, "field": -3.0, "label": -3.0,
    "hint": -3.0, "policy": -3.0, "prompt": -3.0, "message": -3.0, "error": -3.0, "regex": -3.0, "pattern": -3.0,
    "expiry": -3.0, "expires": -3.0, "ttl": -3.0, "timeout": -3.0, "header": -2.0, "column": -3.0, "class": -3.0,
    "text": -2.0, "title": -2.0, "env": -1.0, "var": -1.0,
}
LEAST_NAME = 2.5
LEAST_SCORE = 5.0
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

_DIGITS = sum(1 << c for c in range(48, 58))
_UPPER = sum(1 << c for c in range(65, 91))
_LOWER = sum(1 << c for c in range(97, 123))
_BLANK = sum(1 << c for c in (9, 10, 13, 32))


def name_score(name: str) -> float:
    """The evidence of a name's words: ``dbPassword``, ``DB_PASSWORD`` and ``db.password`` are alike."""
    return sum(NAME_WEIGHTS.get(w.lower(), 0.0) for w in _PARTS.findall(name))


def value_score(value: Value) -> float:
    """The evidence of a literal: long, of many kinds of characters, no phrase and no placeholder."""
    if value.placeholder:
        return -6.0
    seen = value.seen
    other = seen & ~(_DIGITS | _UPPER | _LOWER | _BLANK)
    kinds = sum(bool(k) for k in (seen & _DIGITS, seen & _UPPER, seen & _LOWER, other))
    score = (value.length >= 8) + (value.length >= 16) + (kinds >= 2) + (kinds >= 3) + (seen.bit_count() >= 10)
    if value.length < 4:
        score -= 3.0
    if seen & _BLANK:
        score -= 2.0
    if kinds == 1:
        score -= 1.5
    return float(score)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, leftmost and without overlap for each kind."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_text(text: str) -> list[dict]:
    """All spans of a text by start, then kind."""
    base = base_spans(text)
    spans = [{"kind": k, "start": s, "end": e, "name": None, "score": None} for s, e, k in base]
    covered = []
    for start, end, _ in base:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    found = []
    for name, value in read_pairs(text):
        named = name_score(name)
        if named < LEAST_NAME or named + value_score(value) < LEAST_SCORE:
            continue
        score = named + value_score(value)
        found += [(part.start, part.end, name, score) for part in literals(value) if part.end > part.start]
    at = 0
    for start, end, name, score in sorted(found):
        while at < len(covered) and covered[at][1] < end:
            at += 1
        if at == len(covered) or not covered[at][0] <= start:
            spans.append({"kind": "literal", "start": start, "end": end, "name": name, "score": score})
    return sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per row; a span has its kind, place in code points, and for literals name and score."""
    prepare(docs.sparkSession)
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, spans {SPANS}")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


@query("op13_secret_scan")
def op13_secret_scan(spark, folder):
    found = scan_secrets(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )
