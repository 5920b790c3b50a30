"""URL verdicts from host rules and an exact Bloom filter cascade.

The key universe is every host of the corpus.  The first filter encodes the
listed hosts; hosts of the universe that pass it without being listed are encoded
by the second; listed hosts that pass that one by the third, and so on until no
host is misjudged.  Because every key that will be asked for is in the
universe, membership is exact, and a url is judged by bit tests alone: filters
are scalar subqueries, so there is no join with the list.

All work is DataFrame functions.  Hosts are reduced to distinct ones before
anything is built, so a hot host counts once.  A filter beyond ``FILTER_BYTES``
is not sent to the tasks; then listed hosts are found by a shuffled join.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; empty labels are ordinary labels; repeated rows are
judged each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import freeze, query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILTER_BYTES = 16 << 20
LN2 = math.log(2)

# The rules and the blocked host labels of the registered query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
BLOCKED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; of rules of one length the longer host wins."""
    text = verdict = F.lit(None).cast("string")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        below = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        fits = below & F.startswith(path, F.lit(rule_path))
        text = F.when(fits, rule_host + rule_path).otherwise(text)
        verdict = F.when(fits, action).otherwise(verdict)
    return text, verdict


def _bits(key: Column, level: int, size: int, hashes: int) -> list[Column]:
    a = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(size))
    b = F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(size))
    return [F.pmod(a + F.lit(i) * b, F.lit(size)) for i in range(hashes)]


@dataclass
class Level:
    """One Bloom filter: a stored one-row table with the words of its bit set."""

    words: DataFrame
    number: int
    size: int
    hashes: int

    def holds(self, key: Column) -> Column:
        words = self.words.scalar()
        tests = [
            F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
            for p in _bits(key, self.number, self.size, self.hashes)
        ]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def _size(n: int, rate: float) -> tuple[int, int]:
    size = max(64, -(-int(math.ceil(n * -math.log(rate) / LN2**2)) // 64) * 64)
    return size, max(1, min(16, round(size / n * LN2)))


def _level(keys: DataFrame, number: int, size: int, hashes: int) -> Level:
    bit = keys.select(F.explode(F.array(*_bits(F.col("key"), number, size, hashes))).alias("bit"))
    mask = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    words = bit.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(mask).alias("mask"))
    # words without a bit are added, so that a word's place is its number
    whole = keys.sparkSession.range(size // 64).select(F.col("id").cast("int").alias("word"))
    rows = whole.join(words, "word", "left").select("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    packed = rows.agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("w"))
    return Level(freeze(packed.select(F.transform("w", lambda x: x["mask"]).alias("words"))), number, size, hashes)


@dataclass
class Cascade:
    levels: list[Level]

    def member(self, key: Column) -> Column:
        """Exact membership of a key of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            inside = out
            out = F.when(level.holds(key), inside).otherwise(F.lit(level.number % 2 == 0))
        return out


def build_cascade(universe: DataFrame) -> Cascade | None:
    """Filters over (key, listed) rows with distinct keys; None if the first would be beyond the bound."""
    universe = freeze(universe.select("key", "listed"))
    encode, other = universe.where("listed"), universe.where("not listed")
    levels: list[Level] = []
    while True:
        n, m = encode.count(), other.count()
        if n == 0:
            return Cascade(levels)
        rate = min(0.5, n / (math.sqrt(2) * m)) if not levels and m else 0.5
        size, hashes = _size(n, rate)
        if size // 8 > FILTER_BYTES:
            return None
        level = _level(encode, len(levels) + 1, size, hashes)
        levels.append(level)
        encode, other = freeze(other.where(level.holds(F.col("key")))), encode


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    blocked_labels: Sequence[str] = BLOCKED_LABELS,
) -> DataFrame:
    """(id, host, path, rule, verdict) per row.

    A host is listed if one of its labels is a blocked one; a url that fits no
    rule is blocked if its host is listed.
    """
    url = F.col(f"`{url_col}`")
    urls = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    blocked = F.array(*[F.lit(x) for x in blocked_labels]).cast("array<string>")
    universe = urls.select(F.col("host").alias("key")).distinct()
    universe = universe.withColumn("listed", F.arrays_overlap(F.split("key", r"\."), blocked))
    cascade = build_cascade(universe)
    if cascade is not None:
        listed = cascade.member(F.col("host"))
    else:
        hit = universe.where("listed").select(F.col("key").alias("__hit"))
        urls = urls.join(hit, urls["host"] == hit["__hit"], "left")
        listed = F.col("__hit").isNotNull()
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return urls.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(listed, "block").otherwise("allow")).alias("verdict"),
    )


@query(
    "op6_url_filters",
    r"""
    WITH a AS (
      SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                           THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (
      SELECT page_id,
             translate(regexp_extract(rest, '^([^/?#]*)', 1),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    r AS (
      SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
                WHEN rule IS NOT NULL THEN 'block'
                WHEN list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills',
                                                            'free-bets', 'spam-farm']) THEN 'block'
                ELSE 'allow' END AS verdict
    FROM r
    """,
)
def op6_url_filters(spark, folder):
    return judge_urls(table(spark, folder, "pages"))
