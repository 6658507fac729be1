"""Operator 4: exact token counts as a length histogram.

Every text is encoded once; documents are aggregated by encoded length, and
suffix sums over the lengths answer totals, quantiles and truncated totals
for every context limit without another look at the texts: of a limit L,
the documents longer than L count L each and the others their length.

The histogram has one row for each distinct length. The suffix sums run in
two levels (ranges of lengths, then the lengths inside a range), so no task
holds more than one range.

The tokenizer's rank file is read on the driver and travels with the tasks
(1 MB); its path is a parameter.

Defined results. Null and empty texts have length 0. Special tokens' strings
count as ordinary text. Repeated rows count each. An empty table gives no
rows.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths in a range of the suffix sums.
RANGE = 4096

_encoders: dict[int, object] = {}


def _encoder(raw: bytes, pattern: str):
    key = hash((raw, pattern))
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def encoded_lengths(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and length of each document."""
    with open(tokenizer, "rb") as file:
        raw = file.read()

    def encode(batches):
        enc = _encoder(raw, pattern)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64())], [*keep, "length"])

    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "length bigint"])
    return docs.select(*keep, text_or_empty().alias("text")).mapInArrow(encode, fields)


def length_histogram(lengths: DataFrame, by: int = RANGE) -> DataFrame:
    """length, n_docs, n_tokens, docs_from, tokens_from, truncated_tokens, quantile.

    ``docs_from`` and ``tokens_from`` are suffix sums (this length or more),
    ``truncated_tokens`` is the corpus total at this length as limit, and
    ``quantile`` the share of documents of this length or less.
    """
    flat = cut(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("n_tokens", F.col("length") * F.col("n_docs")), "lengths")
    part = F.floor(F.col("length") / by)
    ranges = flat.groupBy(part.alias("r")).agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = Window.orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    ranges = ranges.select("r", F.coalesce(F.sum("d").over(above), zero).alias("d_above"), F.coalesce(F.sum("t").over(above), zero).alias("t_above"), F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("t_all"))
    inside = Window.partitionBy("r").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = flat.withColumn("r", part).join(ranges, "r")
    out = out.withColumn("docs_from", F.col("d_above") + F.sum("n_docs").over(inside)).withColumn("tokens_from", F.col("t_above") + F.sum("n_tokens").over(inside))
    return out.select(
        "length", "n_docs", "n_tokens", "docs_from", "tokens_from",
        (F.col("t_all") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_tokens"),
        ((F.col("d_all") - F.col("docs_from") + F.col("n_docs")) / F.col("d_all")).alias("quantile"),
    )


def answer(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """max_length, n_docs, n_tokens, n_longer, truncated_tokens for each limit, in one pass."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "max_length bigint")
    sums = histogram.groupBy().agg(*[F.struct(F.sum("n_docs").alias("n"), F.sum("n_tokens").alias("t"), F.sum(F.when(F.col("length") > x, F.col("n_docs"))).alias("longer"), F.sum(F.least("length", F.lit(int(x))) * F.col("n_docs")).alias("cut")).alias(f"l{x}") for x in sorted(set(limits))])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(int(x)).cast("bigint").alias("max_length"), F.col(f"l{x}").alias("s")) for x in sorted(set(limits))])).alias("e")).select("e.max_length", "e.s.*")
    zero = F.lit(0).cast("bigint")
    return asked.join(rows, "max_length", "left").select("max_length", *[F.coalesce(c, zero).alias(n) for c, n in (("n", "n_docs"), ("t", "n_tokens"), ("longer", "n_longer"), ("cut", "truncated_tokens"))])


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the smallest length that at least this share of documents does not exceed."""
    spark = histogram.sparkSession
    one = histogram.groupBy().agg(*[F.min(F.when(F.col("quantile") >= s, F.col("length"))).alias(f"q{i}") for i, s in enumerate(shares)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("length")) for i, s in enumerate(shares)])).alias("e")).select("e.*")


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    return length_histogram(encoded_lengths(docs, tokenizer, pattern))
