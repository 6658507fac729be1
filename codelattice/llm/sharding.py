"""Operator 9: sharding by extendible hashing.

The directory is indexed by the leading bits of a document's hash. A bucket
(a prefix) that holds more bytes than a shard may have is split on the next
bit; the others keep their shorter prefix. Splitting works on sums: one
histogram of bytes by directory entry, from which the sums of all shorter
prefixes follow, decides all splits down to its depth, and only entries that
are still too large are looked at again with more bits.

Keys are cut once from the texts (hash and size, 16 bytes a row); a second and
last look at the texts adds the shards. The compact directory has one entry
for each shard. Up to ``DIRECTORY_ENTRIES`` of them (checked) it travels to
the tasks, which search it by hash, so texts enter no shuffle; a larger
directory is joined.

Defined results. Null text has zero bytes. A document that alone exceeds the
limit gets a shard of its own. Rows with one key (repeated rows) cannot be
told apart by more bits; if together they exceed the limit, they go to
numbered overflow pages of their bucket, each at the limit or below unless a
single row is larger. A null key hashes as the empty string. Columns of the
input that are called like those added (shard, depth, n_bytes, shard_bytes)
are replaced; all others stay. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Bytes of text in a shard at most.
SHARD_BYTES = 64 * 1024 * 1024
HASH_BITS = 60
#: Levels that each further look adds.
STEP = 8
#: Shards (25 bytes each) up to which the directory travels to the tasks: 50 MB.
DIRECTORY_ENTRIES = 1 << 21
#: Pages that rows of one key fill in one group of a window.
PAGES_AT_ONCE = 64

ADDED = ("shard", "depth", "n_bytes", "shard_bytes")


def hash_bits(key):
    """The leading 60 bits of the key's MD5, as a bigint."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def directory(keys: DataFrame, limit: int) -> DataFrame:
    """One row for each shard of ``keys`` (h, n_bytes): first (its smallest hash), depth, shard_bytes, shard_rows, alone.

    A shard has the hashes from ``first`` on that agree with it in ``depth``
    bits. ``alone`` marks shards of one single key.
    """
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + 3))
    found, base, left = None, 0, keys
    while True:
        leaf = left.groupBy(F.shiftright("h", HASH_BITS - bits).alias("entry")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        leaf = cut(leaf, "entries")
        every = leaf.select("entry", "b", "n", "lo", "hi", F.explode(F.sequence(F.lit(base), F.lit(bits))).alias("depth")).withColumn("p", F.expr(f"shiftright(entry, {bits} - depth)"))
        sums = every.groupBy("depth", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"), (F.min("lo") == F.max("hi")).alias("alone"))
        fits = sums.filter((F.col("shard_bytes") <= limit) | F.col("alone") | (F.col("depth") == HASH_BITS))
        # Of an entry's prefixes that fit the shortest is its shard.
        met = every.select("entry", "depth", "p").join(fits, ["depth", "p"])
        piece = cut(met.groupBy("entry").agg(F.min_by(F.struct("depth", "p", "shard_bytes", "shard_rows", "alone"), "depth").alias("s")), "directory")
        shards = piece.select("s.*").distinct().select(F.expr(f"shiftleft(p, {HASH_BITS} - depth)").alias("first"), "depth", "shard_bytes", "shard_rows", "alone")
        found = shards if found is None else found.unionByName(shards)
        over = leaf.select("entry").join(piece, "entry", "left_anti")
        if bits == HASH_BITS or over.isEmpty():
            return cut(found, "shards")
        left = left.withColumn("entry", F.shiftright("h", HASH_BITS - bits)).join(over, "entry", "left_semi").select("h", "n_bytes")
        base, bits = bits + 1, min(HASH_BITS, bits + STEP)


PLACE = "first long, depth int, shard_bytes long, shard_rows long, alone boolean"


def _searched(marked: DataFrame, shards: DataFrame) -> DataFrame:
    """``marked`` (__h) with __s, its shard, found by each task in the whole directory."""
    rows = shards.toPandas().sort_values("first")  # at most DIRECTORY_ENTRIES, as the caller checked
    held = marked.sparkSession.sparkContext.broadcast({c: rows[c].to_numpy() for c in rows.columns})

    @F.pandas_udf(PLACE)
    def place(h: pd.Series) -> pd.DataFrame:
        table = held.value
        at = np.searchsorted(table["first"], h.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({c: table[c][at] for c in ("first", "depth", "shard_bytes", "shard_rows", "alone")})

    return marked.withColumn("__s", place("__h"))


def _joined(marked: DataFrame, shards: DataFrame) -> DataFrame:
    """As ``_searched``, for directories that are too large: one join on the depths that occur."""
    depths = [r[0] for r in shards.select("depth").distinct().collect()]  # at most 61
    of = F.explode(F.array(*[F.struct(F.lit(d).cast("int").alias("depth"), F.shiftright("__h", HASH_BITS - d).alias("p")) for d in depths]))
    # Hashes alone look for their shard; the texts meet it by the hash.
    asked = marked.select("__h").distinct().select("__h", of.alias("k")).select("__h", "k.*")
    named = shards.select(F.col("depth").cast("int").alias("depth"), F.expr(f"shiftright(first, {HASH_BITS} - depth)").alias("p"), F.struct("first", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows", "alone").alias("__s"))
    return marked.join(asked.join(named, ["depth", "p"]).select("__h", "__s"), "__h")


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", entries: int = DIRECTORY_ENTRIES) -> DataFrame:
    """``docs`` with shard, depth, n_bytes, shard_bytes.

    ``shard`` names prefix bits and overflow page, like ``0101`` or
    ``0101.1``; the root bucket is ``-``.
    """
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    marked = docs.select(*[docs[f"`{c}`"] for c in keep], hash_bits(docs[f"`{key}`"]).alias("__h"), F.octet_length(text_or_empty()).cast("bigint").alias("__b"))
    keys = cut(marked.select(F.col("__h").alias("h"), F.col("__b").alias("n_bytes")), "keys")
    shards = directory(keys, limit)
    out = _searched(marked, shards) if shards.count() <= entries else _joined(marked, shards)
    name = F.when(F.col("__s.depth") == 0, F.lit("-")).otherwise(F.expr(f"lpad(bin(shiftright(__h, {HASH_BITS} - __s.depth)), __s.depth, '0')"))
    plain = out.withColumn("__name", name).withColumn("__page", F.col("__s.shard_bytes"))
    # Overflow pages: shards of one key with more than a shard's bytes, in several rows.
    crowded = F.col("__s.alone") & (F.col("__s.shard_bytes") > limit) & (F.col("__s.shard_rows") > 1)
    if not shards.filter(F.col("alone") & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)).isEmpty():
        # Rows of one key are dealt to groups of some pages each, so a key with
        # a third of all rows is no single window.
        groups = F.ceil(F.col("__s.shard_bytes") / F.lit(PAGES_AT_ONCE * limit))
        some = plain.filter(crowded).withColumn("__g", F.pmod(F.xxhash64(F.monotonically_increasing_id(), text_or_empty()), groups))
        mine = Window.partitionBy("__h", "__g")
        some = some.withColumn("__n", F.row_number().over(mine.orderBy("__b", F.xxhash64(text_or_empty()))) - 1).withColumn("__most", F.max("__b").over(mine))
        some = some.withColumn("__p", F.floor(F.col("__n") / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("__most", F.lit(1))))))
        some = some.withColumn("__page", F.sum("__b").over(Window.partitionBy("__h", "__g", "__p")))
        number = F.when(groups > 1, F.concat_ws("-", "__g", "__p")).otherwise(F.col("__p").cast("string"))
        some = some.withColumn("__name", F.concat_ws(".", "__name", number)).select(*plain.columns)
        plain = plain.filter(~crowded).unionByName(some)
    return plain.select(*[F.col(f"`{c}`") for c in keep], F.col("__name").alias("shard"), F.col("__s.depth").cast("int").alias("depth"), F.col("__b").alias("n_bytes"), F.col("__page").alias("shard_bytes"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard as a folder ``shard=...`` below ``path``.

    A shard is below its byte limit, so a task that holds some shards holds a
    bounded number of bytes.
    """
    sharded.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)
