"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined in one posterior per document:

* the text: a byte-trigram model per language, counted over all documents by their
  declared language, its log-likelihood tempered because trigrams overlap;
* the declared language (a markup ``lang`` attribute or a ``lang`` column) and the
  address suffix, each weighed by how often it goes with each language, counted
  over all documents against what the text alone says;
* the host: its share of each language, smoothed towards its suffix's share, which
  is smoothed towards the share in the whole corpus; grouped aggregations.

A noise model that draws bytes one by one, half of them at their frequency in
the corpus and half evenly, competes with the languages.  A document
is rejected if it has no letter or if noise explains it better.

All counts cover all documents, every declared language and every value of the
evidence.  Models are made and sent in blocks of ``LANGUAGES`` languages, one block
on the driver and one in a task at a time; a document is scored by all of them.
Host shares and evidence counts are joined to documents by broadcast below a
checked size and by a join that can be split above it.  Declared tags count by
their primary language (``en-US`` as ``en``).

Defined results: null and empty texts are rejected with a null language; null or
unknown evidence counts as none; where no row declares a language there is one
unnamed model over all documents, which still competes with noise, and every row has
a null language and confidence 0; repeated rows are judged each; an empty table gives
no rows; all columns of a row are kept as they are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, freeze, prepare, query, table

BUCKETS = 1 << 15
# Languages whose models are in memory at once; there may be any number of such blocks.
LANGUAGES = 64
# A text counts as at most so many independent trigrams.
EFFECTIVE_TRIGRAMS = 200
# Weight, in documents, of the level above when shares are smoothed.
HOST_WEIGHT = 20.0
SUFFIX_WEIGHT = 50.0
NOISE_PRIOR = 1e-3


def declared_in_markup(html: Column) -> Column:
    """The primary language of a page's ``lang`` attribute, lower-cased; null if there is none."""
    found = F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]+)", 1)
    return F.nullif(F.lower(found), F.lit(""))


def address_suffix(url: Column) -> Column:
    """The last label of a url's host, lower-cased; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"://(?:[^/?#]*\.)?([^/?#.:]+)(?::\d+)?(?:[/?#]|$)", 1)), F.lit(""))


def primary_language(tag: Column) -> Column:
    """The primary language of a declared tag, lower-cased; private tags (``x-...``) stay whole; null if empty."""
    whole = F.lower(F.trim(F.translate(tag, "_", "-")))
    first = F.substring_index(whole, "-", 1)
    return F.nullif(F.when(F.length(first) > 1, first).otherwise(whole), F.lit(""))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte trigram, the bytes) of a lower-cased text set between spaces."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)
    wide = raw.astype(np.uint32)
    with np.errstate(over="ignore"):
        joined = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
        return (joined * np.uint32(2654435761)) >> np.uint32(17), raw


def _texts(column: pa.Array) -> Iterator[str]:
    return (t.as_py() or "" for t in column)


def count_trigrams(rows: DataFrame, languages: list[str | None]) -> DataFrame:
    """(language number, bucket, n) over all documents; number -1 counts bytes instead of trigrams."""
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for i, sums in total.items():
                at = np.flatnonzero(sums)
                columns = [pa.array(np.full(len(at), i)), pa.array(at), pa.array(sums[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["language", "bucket", "n"])
            total.clear()

        def sums_of(i: int) -> np.ndarray:
            if i not in total:
                total[i] = np.zeros(BUCKETS, dtype=np.int64)
            return total[i]

        for batch in batches:
            for text, name in zip(_texts(batch.column(0)), batch.column(1).to_pylist()):
                bucket, raw = trigrams(text)
                sums_of(-1)[:256] += np.bincount(raw, minlength=256)
                if name in number:
                    sums_of(number[name])[:] += np.bincount(bucket, minlength=BUCKETS)
                if len(total) > LANGUAGES:
                    yield from flush()
        yield from flush()

    kinds = "language long, bucket long, n long"
    return rows.mapInArrow(count, kinds).groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def models(rows: DataFrame, languages: list[str | None]) -> list[Broadcast]:
    """The tables of ``likelihoods`` for each block of languages, held for the tasks."""
    sums = count_trigrams(rows, languages)
    if len(languages) > LANGUAGES:
        sums = freeze(sums)

    def dense(first: int, size: int) -> np.ndarray:
        found = sums.where(F.col("language").between(first, first + size - 1)).toArrow()
        total = np.zeros((size, BUCKETS))
        at = [found.column(c).to_numpy() for c in ("language", "bucket")]
        total[at[0] - first, at[1]] = found.column("n").to_numpy()
        return total

    held, context, byte_counts = [], rows.sparkSession.sparkContext, None
    for first in range(0, len(languages), LANGUAGES):
        size = min(LANGUAGES, len(languages) - first)
        if byte_counts is None:
            both = dense(-1, size + 1)
            byte_counts, counts = both[0, :256], both[1:]
        else:
            counts = dense(first, size)
        held.append(context.broadcast(likelihoods(counts, byte_counts)))
    return held


def likelihoods(counts: np.ndarray, byte_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of each bucket per language, log-probability of each byte under noise)."""
    smooth = counts + 0.01
    noise = 0.5 * byte_counts / max(1.0, byte_counts.sum()) + 0.5 / 256
    return np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32).copy(), np.log(noise)


def text_scores(text: str, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, float, bool]:
    """(tempered log-likelihood per language, that of noise, whether the text has a letter)."""
    bucket, raw = trigrams(text)
    language, noise = tables
    n = len(bucket)
    weight = min(1.0, EFFECTIVE_TRIGRAMS / max(n, 1))
    # under noise a trigram is three independent bytes
    flat = noise[raw]
    drawn = float(flat[:-2].sum() + flat[1:-1].sum() + flat[2:].sum())
    own = np.zeros(language.shape[1])
    for at in range(0, n, 1 << 16):
        own += language[bucket[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
    return own * weight, drawn * weight, any(map(str.isalpha, text))


def batch_scores(texts: list[str], held: list[Broadcast]) -> list[tuple[np.ndarray, float, bool]]:
    """``text_scores`` of every text by all blocks of languages; of several blocks one is in memory at a time."""
    if len(held) == 1:
        return [text_scores(t, held[0].value) for t in texts]
    parts = []
    for block in held:
        tables = block.value
        parts.append([text_scores(t, tables) for t in texts])
        del tables
        block.__dict__.pop("_value", None)
    return [(np.concatenate([own for own, _, _ in each]), *each[0][1:]) for each in zip(*parts)]


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose scores, ``width`` to a row, take at most some 16 MB."""
    step = max(1, (2 << 20) // width)
    return (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def evidence_counts(rows: DataFrame, held: list[Broadcast], languages: list[str | None], column: str) -> DataFrame:
    """(value, best, n): how often each value of the evidence goes with each language, by the text alone."""
    width = len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, width):
                pairs = [(t, v) for t, v in zip(_texts(part.column(0)), part.column(1).to_pylist()) if v is not None and t]
                best = [int(own.argmax()) for own, _, _ in batch_scores([t for t, _ in pairs], held)] if pairs else []
                columns = [pa.array([v for _, v in pairs], pa.string()), pa.array(best, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["value", "best"])

    found = rows.select("text", column).mapInArrow(count, "value string, best int")
    return found.groupBy("value", "best").agg(F.count("*").alias("n"))


def join_evidence(
    docs: DataFrame, rows: DataFrame, held: list[Broadcast], languages: list[str | None], column: str
) -> tuple[DataFrame, np.ndarray]:
    """``docs`` with the counts of their ``__own_`` value, in its place, and the size of each language's row."""
    counts = freeze(evidence_counts(rows, held, languages, column))
    size = np.full(len(languages), 0.5 * (counts.select("value").distinct().count() + 1))
    for r in counts.groupBy("best").agg(F.sum("n").alias("n")).collect():
        size[r["best"]] += r["n"]
    by_value = counts.groupBy("value").agg(F.collect_list("best").alias("__best"), F.collect_list("n").alias("__n"))
    widest = by_value.agg(F.max(F.size("__best") * 12 + F.length("value") * 4)).first()[0] or 0
    small = broadcast_if_small(freeze(by_value.withColumnRenamed("value", "__value")), 100 + widest)
    joined = docs.join(small, docs[f"__own_{column}"] == small["__value"], "left")
    packed = F.when(F.col("__value").isNotNull(), F.struct("__best", "__n")).alias("__own_" + column)
    keep = [F.col(f"`{c}`") for c in docs.columns if c != f"__own_{column}"]
    return joined.select(*keep, packed), size


def evidence(entry: dict | None, size: np.ndarray | None) -> np.ndarray | float:
    """log P(value | language) of a value with the given counts; nothing for an unknown one."""
    if entry is None:
        return 0.0
    seen = np.full(len(size), 0.5)
    seen[entry["__best"]] += entry["__n"]
    return np.log(seen / size)


def host_shares(rows: DataFrame, languages: list[str], suffixed: bool = True) -> DataFrame:
    """(__host, __suffix, __share): the smoothed share of each language at each host.

    Without suffixes hosts are smoothed towards the whole corpus.
    """

    spark, named = rows.sparkSession, [(x, i) for i, x in enumerate(languages) if x is not None]
    numbers = F.broadcast(spark.createDataFrame(named, "declared string, number int"))
    known = rows.join(numbers, "declared").groupBy("host", "suffix", "number").agg(F.count("*").alias("n"))

    def counted(keys: list[str], name: str) -> DataFrame:
        sums = known.groupBy(*keys, "number").agg(F.sum("n").cast("double").alias("n"))
        by = F.map_from_entries(F.collect_list(F.struct("number", "n")))
        each = sums.groupBy(*keys).agg(by.alias("by"))
        all_numbers = F.sequence(F.lit(0), F.lit(len(languages) - 1))
        return each.select(*keys, F.transform(all_numbers, lambda i: F.coalesce(F.col("by")[i], F.lit(0.0))).alias(name))

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def smooth(counts: str, above: Column, weight: float) -> Column:
        size = total(F.col(counts)) + weight
        return F.zip_with(counts, above, lambda c, p: (c + weight * p) / size)

    overall = [0.0] * len(languages)
    for r in known.groupBy("number").agg(F.sum("n").alias("n")).collect():
        overall[r["number"]] = float(r["n"])
    flat = [(c + 1.0) / (sum(overall) + len(languages)) for c in overall]
    base = F.from_json(F.lit(json.dumps(flat)), "array<double>")
    if not suffixed:
        hosts = counted(["host"], "h")
        none = F.lit(None).cast("string").alias("__suffix")
        return hosts.select(F.col("host").alias("__host"), none, smooth("h", base, HOST_WEIGHT).alias("__share"))
    suffixes = counted(["suffix"], "s").select(F.col("suffix").alias("__s"), smooth("s", base, SUFFIX_WEIGHT).alias("of_suffix"))
    hosts = counted(["host", "suffix"], "h")
    joined = hosts.join(suffixes, hosts["suffix"].eqNullSafe(suffixes["__s"]))
    return joined.select(
        F.col("host").alias("__host"), F.col("suffix").alias("__suffix"), smooth("h", F.col("of_suffix"), HOST_WEIGHT).alias("__share")
    )


def identify(
    docs: DataFrame,
    text_col: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
) -> DataFrame:
    """All columns of ``docs`` and __lang, __confidence, __kept."""
    prepare(docs.sparkSession)
    none = F.lit(None).cast("string")
    given = {
        "declared": none if declared is None else primary_language(declared.cast("string")),
        "suffix": none if suffix is None else suffix.cast("string"),
        "host": none if host is None else host.cast("string"),
    }
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), *[c.alias(k) for k, c in given.items()])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    outputs = "__lang string, __confidence double, __kept boolean"
    named = rows.where("declared is not null").groupBy("declared").count().orderBy(F.desc("count"), "declared")
    languages = [r["declared"] for r in named.collect()]
    if not languages:
        if docs.isEmpty():
            return docs.selectExpr("*", "cast(null as string) __lang", "0d __confidence", "false __kept")
        languages = [None]
    held = models(rows.select("text", "declared"), languages)
    shares = freeze(host_shares(rows, languages, suffix is not None))
    small = broadcast_if_small(shares, 100 + 8 * len(languages))
    keyed = docs.withColumns({f"__own_{k}": c for k, c in given.items()})
    on = keyed["__own_host"].eqNullSafe(small["__host"])
    if suffix is not None:
        on &= keyed["__own_suffix"].eqNullSafe(small["__suffix"])
    keyed = keyed.join(small, on, "left").drop("__host", "__suffix", "__own_host")
    sizes: list[np.ndarray | None] = []
    for column in ("declared", "suffix"):
        size = None
        if not (column == "declared" and languages == [None]) and not (column == "suffix" and suffix is None):
            keyed, size = join_evidence(keyed, rows, held, languages, column)
        sizes.append(size)
    keyed = keyed.select(*[F.col(f"`{c}`") for c in docs.columns], "__own_declared", "__own_suffix", "__share")
    flat = np.full(len(languages), 1.0 / len(languages))
    noise_prior, at_text = math.log(NOISE_PRIOR), docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, len(languages)):
                names, confidence, kept = [], [], []
                *own, said, suffixes, share = batch.columns
                texts = list(_texts(own[at_text]))
                found = batch_scores(texts, held)
                for (scores, noise, letters), d, s, p in zip(found, said, suffixes, share):
                    if not letters:
                        names.append(None)
                        confidence.append(0.0)
                        kept.append(False)
                        continue
                    prior = np.log(flat if not p.is_valid else p.values.to_numpy())
                    scores = scores + prior + evidence(d.as_py(), sizes[0]) + evidence(s.as_py(), sizes[1])
                    best = int(scores.argmax())
                    against = np.append(scores, noise + noise_prior)
                    names.append(languages[best])
                    sure = float(1.0 / np.exp(against - scores[best]).clip(0, 1e300).sum())
                    confidence.append(0.0 if languages[best] is None else round(sure, 4))
                    kept.append(bool(scores[best] >= noise + noise_prior))
                out = [pa.array(names, pa.string()), pa.array(confidence, pa.float64()), pa.array(kept, pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [*own, *out], names=[*batch.schema.names[:-3], "__lang", "__confidence", "__kept"]
                )

    return keyed.mapInArrow(judge, f"{schema}, {outputs}")


def keep_identified(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents whose language could be identified, with declared ``lang`` and ``source`` as host."""
    found = identify(docs, text_col, F.col("lang"), F.col("source"))
    return found.where("__kept").drop("__lang", "__confidence", "__kept")


@query("op10_language_id")
def op10_language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return identify(docs, "text", F.col("lang"), F.col("source")).select(
        "doc_id",
        F.col("__lang").alias("lang"),
        F.col("lang").alias("declared"),
        F.col("__confidence").alias("confidence"),
        F.col("__kept").alias("kept"),
    )
