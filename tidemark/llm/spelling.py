"""Spelling variants by permuterm rotations.

Each word, closed by a terminator, is rotated to every place.  With the last character of
a rotation skipped, the prefix that is left, ``after + '$' + before``, is shared by all
words that differ in that one character; a word whose whole rotation is that prefix lacks
the character altogether.  So the rotations are sorted by prefix and scanned group by
group: a group holds every replacement of one place and the word without it, at most one
word for each letter of the alphabet and one more.  No pairs are emitted; each member gets
the number of the others and the most frequent of them.

An inserted character next to its equal can be skipped at several places; it counts only at
the first of its run, so no pair counts twice.  Words are numbered by falling count, ties by
code points, hence the form of a word is its smallest near number.  Prefixes of up to
``LONGEST_TEXT`` characters are kept as text, longer ones as a 127-bit polynomial digest,
so that a word of any length costs one short row for each of its characters.

Defined results: a null text has no words; a null id counts as empty in the checksum;
repeated rows count as often as they come; further columns are not looked at; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import freeze, prepare, query, table, whole_text
from tidemark.plans.ordered import with_position

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MARK = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
TERMINATOR = "$"
LONGEST_TEXT = 48
# A task hands its counts on after so many words or characters.
WORDS_KEPT = 100_000
CHARACTERS_KEPT = 4 << 20
ROWS_KEPT = 20_000
MODULUS = (1 << 127) - 1
BASE = 0x1D8A3F5C96E7B2410F6C5A3B9D1E2F47

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(doc: str, text: str) -> Counter:
    """The words of one document after the marked deletions, with their counts; any length."""
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text.encode().translate(_LOWER).decode())).items():
        h = zlib.crc32(f"{doc}:{run}".encode())
        if h % MARK == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over whole texts, for words of enough length and occurrences."""
    prepare(docs.sparkSession)

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                for word, n in words_of(doc.as_py(), text.as_py()).items():
                    if len(word) >= LEAST_LENGTH:
                        held += len(word) if word not in counts else 0
                        counts[word] += n
                if len(counts) > WORDS_KEPT or held > CHARACTERS_KEPT:
                    yield flush(counts)
                    counts.clear()
                    held = 0
        yield flush(counts)

    doc = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc")
    found = docs.select(doc, whole_text(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def prefixes(word: str) -> Iterator[tuple[str, bool, bool]]:
    """(prefix, lacks, repeated) of all rotations of a word.

    ``lacks``: the prefix is the whole word, rotated, so the others of its group have one
    character more.  ``repeated``: the skipped character follows its equal.
    """
    size = len(word)
    short, shorter = size <= LONGEST_TEXT, size - 1 <= LONGEST_TEXT
    if not (short and shorter):
        powers, sums = [1], [0]
        for c in word:
            powers.append(powers[-1] * BASE % MODULUS)
            sums.append((sums[-1] * BASE + ord(c)) % MODULUS)

    def digest(at: int, skip: int) -> str:
        tail = (sums[size] - sums[at + skip] * powers[size - at - skip]) % MODULUS
        return f"#{size - skip}:{at}:{(tail * BASE * powers[at] + sums[at]) % MODULUS:x}"

    for at in range(size + 1):
        yield word[at:] + TERMINATOR + word[:at] if short else digest(at, 0), True, False
        if at < size:
            key = word[at + 1 :] + TERMINATOR + word[:at] if shorter else digest(at, 1)
            yield key, False, at > 0 and word[at] == word[at - 1]


def rotations(numbered: DataFrame) -> DataFrame:
    """(prefix, pos, lacks, repeated) of (word, pos)."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["prefix", "pos", "lacks", "repeated"])

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, pos in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for prefix, lacks, repeated in prefixes(word):
                    rows.append((prefix, pos, lacks, repeated))
                    if len(rows) >= ROWS_KEPT:
                        yield flush(rows)
                        rows = []
            if rows:
                yield flush(rows)

    return numbered.select("word", "pos").mapInArrow(rotate, "prefix string, pos long, lacks boolean, repeated boolean")


def neighbours(rotated: DataFrame) -> DataFrame:
    """(pos, n_near, best): how many words are near and the smallest number among them."""
    group = W.partitionBy("prefix")
    ordered = group.orderBy("pos")
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shorter, once = F.col("lacks").cast("long"), (~F.col("lacks") & ~F.col("repeated")).cast("long")
    scanned = rotated.withColumns(
        {
            "size": F.count(F.lit(1)).over(group),
            "shorter": F.sum(shorter).over(group),
            "once": F.sum(once).over(group),
            "first": F.min("pos").over(whole),
            "second": F.nth_value("pos", 2).over(whole),
        }
    ).where("size > 1")
    others = F.when(F.col("lacks"), F.col("once")).otherwise(
        F.col("size") - F.col("shorter") - 1 + F.when(F.col("repeated"), 0).otherwise(F.col("shorter"))
    )
    other = F.when(F.col("first") == F.col("pos"), F.col("second")).otherwise(F.col("first"))
    return scanned.select("pos", others.alias("others"), other.alias("other")).groupBy("pos").agg(
        F.sum("others").alias("n_near"), F.min("other").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(pos, root) of (pos, form): a form is twice as frequent, so halving the way ends after a few rounds."""
    state = freeze(forms.select("pos", F.col("form").alias("root")))
    while True:
        up = state.select(F.col("pos").alias("root"), F.col("root").alias("higher"))
        moved = freeze(
            state.join(up, "root", "left").select("pos", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved"))
        )
        state = moved.select("pos", "root")
        if moved.where("moved").isEmpty():
            return state


def spelling_variants(counts: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n)."""
    prepare(counts.sparkSession)
    falling = counts.withColumn("fall", -F.col("n"))
    numbered = freeze(with_position(falling, ["fall", "word"], size="words").select("word", "n", "pos"))
    near = neighbours(rotations(numbered))
    found = numbered.join(near, "pos", "left")
    better = numbered.select(F.col("pos").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    judged = freeze(
        found.join(better, "best", "left")
        .withColumn("is", F.coalesce(F.col("form_n") >= 2 * F.col("n"), F.lit(False)))
        .select(
            "pos",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("is"), F.col("best")).alias("to"),
            F.when(F.col("is"), F.col("form")).alias("form"),
            F.when(F.col("is"), F.col("form_n")).alias("form_n"),
        )
    )
    last = roots(judged.where("to is not null").select("pos", F.col("to").alias("form")))
    names = numbered.select(F.col("pos").alias("root"), F.col("word").alias("name"))
    rooted = last.join(names, "root").select("pos", F.col("name").alias("root"))
    return judged.join(rooted, "pos", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


@query(
    "op12_spelling_variants",
    r"""
    WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)) AS t),
    runs AS (
      SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
    h AS (
      SELECT run, n, xor(list_reduce(range(len(x) // 2), lambda c, i: xor(c >> 8, t[(xor(c, ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT) & 255) + 1]),
        4294967295::BIGINT), 4294967295::BIGINT) AS h
      FROM (SELECT run, n, hex(encode(concat(doc_id, ':', run))) AS x FROM runs), bits),
    w AS (
      SELECT w, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w, n FROM h)
      WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
    del AS (SELECT w, n, i, left(w, i) || substr(w, i + 2) AS d FROM (SELECT w, n, unnest(range(length(w))) AS i FROM w)),
    near AS (
      SELECT a.w, b.w AS v, b.n AS vn FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.w <> b.w
      UNION SELECT a.w, b.w, b.n FROM del a JOIN w b ON a.d = b.w
      UNION SELECT b.w, a.w, a.n FROM del a JOIN w b ON a.d = b.w),
    best AS (SELECT w, count(*) AS n_near, max(vn) AS top FROM near GROUP BY w),
    pick AS (SELECT near.w, min(v) AS form, any_value(top) AS top, any_value(n_near) AS n_near
             FROM near JOIN best ON near.w = best.w AND vn = top GROUP BY near.w),
    j AS (SELECT w.w AS word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN form END AS form,
            CASE WHEN top >= 2 * n THEN top END AS form_n FROM w LEFT JOIN pick ON w.w = pick.w),
    up AS (SELECT word, word AS at FROM j UNION ALL SELECT up.word, j.form FROM up JOIN j ON up.at = j.word WHERE j.form IS NOT NULL)
    SELECT j.word, j.form, up.at AS root, j.n, j.n_near, j.form_n
    FROM j JOIN up ON j.word = up.word JOIN j AS stop ON stop.word = up.at AND stop.form IS NULL
    """,
)
def op12_spelling_variants(spark, folder):
    return spelling_variants(word_counts(table(spark, folder, "documents")))
