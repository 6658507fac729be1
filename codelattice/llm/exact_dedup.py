"""Operator 1: exact dedup through a minimal perfect hash of known digests.

The history is the set of distinct SHA-256 digests seen so far. It is dealt
into buckets of bounded size, and every bucket gets a minimal perfect hash (a
cascade of bit arrays: a key that is alone on its bit at a level keeps that
bit, the others go one level down; the rank of the bit is the slot). A slot
holds the whole digest and the locator of the winner (its doc_id and the
number of its row) with the group's size. A lookup hashes to a slot and
compares all 32 bytes, so a stranger that falls on a slot is recognised;
strangers form groups of their own. The index is a table: it is saved, loaded
and extended by batches that come later.

Only digests, ids and row numbers are shuffled, never texts. Both sides are
aggregated by digest before they meet, so a text that holds a third of all
rows is one row for each map task, and so is a doc_id that does.

Defined results. Null text counts as empty. Rows that repeat (doc_id, text)
count in ``group_size``, and exactly one row of the winner's doc_id is kept;
where the history and the batch both have it, that of the history. A null
doc_id loses against any other; in a group that has only null ids one row
stays. Ids are integers from end to end, so ids over 2^53 are exact. Empty
tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Digests in a bucket of the index, on average.
BUCKET_KEYS = 50_000
#: Bits for each key that is left at a level.
GAMMA = 2.0
MAX_LEVELS = 48

INDEX_SCHEMA = "bucket bigint, buckets bigint, sizes array<bigint>, bits binary, rest binary, digests binary, winners binary, has_winner binary, rows binary, counts binary"
#: The winner of a group: its id, whether it has one, its row, whether it is of the batch; ``known``: the index had the digest.
GROUP_SCHEMA = "digest binary, winner bigint, has_winner boolean, row bigint, n bigint, known boolean, of_batch boolean"


def _mix(words: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = words[:, 1] + words[:, 2] * np.uint64(2 * level + 1) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _words(digests: np.ndarray) -> np.ndarray:
    return digests.reshape(-1, 32).view("<u8")


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        words, left = _words(digests), np.arange(len(digests) // 32)
        sizes, levels = [], []
        while len(left) and len(sizes) < MAX_LEVELS:
            n = max(8, int(GAMMA * len(left)))
            at = (_mix(words[left], len(sizes)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            sizes.append(n)
            levels.append(alone)
            left = left[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(sizes, bits, digests.reshape(-1, 32)[left].reshape(-1))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; of strangers any slot or -1."""
        words = _words(digests)
        out, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, n in enumerate(self.sizes):
            at = (_mix(words[left], level) % np.uint64(n)).astype(np.int64) + self.starts[level]
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        if len(self.rest) and len(left):
            last = {self.rest[32 * i : 32 * i + 32].tobytes(): int(self.rank[-1]) + i for i in range(len(self.rest) // 32)}
            for i in left:
                out[i] = last.get(digests[32 * i : 32 * i + 32].tobytes(), -1)
        return out


def _flat(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8)


def _build_bucket(buckets: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        digests = _flat(rows["digest"])
        phash = PerfectHash.build(digests)
        order = np.empty(len(rows), np.int64)
        order[phash.slots(digests)] = np.arange(len(rows))
        number = lambda c: rows[c].to_numpy(np.int64)[order].tobytes()
        return pd.DataFrame({
            "bucket": [int(rows["bucket"].iloc[0])], "buckets": [buckets], "sizes": [phash.sizes], "bits": [np.packbits(phash.bits).tobytes()], "rest": [phash.rest.tobytes()],
            "digests": [digests.reshape(-1, 32)[order].tobytes()], "winners": [number("winner")], "has_winner": [rows["has_winner"].to_numpy(bool)[order].astype(np.uint8).tobytes()],
            "rows": [number("row")], "counts": [number("n")],
        })

    return run


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket of ``groups`` (digest, winner, has_winner, row, n: distinct digests)."""
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets))).groupBy("bucket").applyInPandas(_build_bucket(buckets), INDEX_SCHEMA)


class _Bucket:
    """A bucket of the index as arrays; an empty one for no row."""

    def __init__(self, row=None):
        if row is None:
            empty = np.zeros(0, np.uint8)
            self.phash, self.held = PerfectHash.build(empty), empty.reshape(-1, 32)
            self.winners = self.rows = self.counts = np.zeros(0, np.int64)
            self.has = np.zeros(0, bool)
            return
        sizes = [int(x) for x in row["sizes"]]
        self.phash = PerfectHash(sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)].astype(bool), np.frombuffer(row["rest"], np.uint8))
        self.held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        self.winners, self.rows, self.counts = (np.frombuffer(row[c], np.int64).copy() for c in ("winners", "rows", "counts"))
        self.has = np.frombuffer(row["has_winner"], np.uint8).astype(bool)


def _lookup(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    b = _Bucket(index.iloc[0]) if len(index) else _Bucket()
    asked = _flat(batch["digest"]) if len(batch) else np.zeros(0, np.uint8)
    slots, keys = b.phash.slots(asked), asked.reshape(-1, 32)
    member = slots >= 0
    member[member] = (b.held[slots[member]] == keys[member]).all(axis=1)
    ids, row, n = (batch[c].to_numpy(np.int64) for c in ("winner", "row", "n"))
    there = batch["has_winner"].to_numpy(bool)
    to = slots[member]
    b.counts[to] += n[member]
    newer = there[member] & (~b.has[to] | (ids[member] > b.winners[to]))
    at = to[newer]
    b.winners[at], b.rows[at], b.has[at] = ids[member][newer], row[member][newer], True
    of_batch = np.zeros(len(b.held), bool)
    of_batch[at] = True
    new = ~member
    both = lambda x, y: np.concatenate([x, y[new]])
    return pd.DataFrame({
        "digest": [x.tobytes() for x in b.held] + [x.tobytes() for x in keys[new]], "winner": both(b.winners, ids), "has_winner": both(b.has, there), "row": both(b.rows, row),
        "n": both(b.counts, n), "known": both(np.ones(len(b.held), bool), np.zeros(len(keys), bool)), "of_batch": both(of_batch, np.ones(len(keys), bool)),
    })


def _groups(digests: DataFrame) -> DataFrame:
    """Distinct digests with their winner; of rows that repeat the winner's id any one."""
    best = F.coalesce(F.max_by("row", "doc_id"), F.min("row"))
    found = digests.groupBy("digest").agg(F.max("doc_id").alias("w"), best.alias("row"), F.count(F.lit(1)).alias("n"))
    return found.select("digest", F.coalesce("w", F.lit(0).cast("bigint")).alias("winner"), F.col("w").isNotNull().alias("has_winner"), "row", "n")


def _buckets_for(*counts: int) -> int:
    return max(1, math.ceil(sum(counts) / BUCKET_KEYS))


def index_of(digests: DataFrame, more: int = 0) -> DataFrame:
    """The index of rows (doc_id, digest, row), with room for ``more`` digests."""
    groups = cut(_groups(digests), "history")
    return cut(build_index(groups, _buckets_for(groups.count(), more)), "index")


def save_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_batch(index: DataFrame, batch: DataFrame) -> DataFrame:
    """Groups of the index and of ``batch`` (doc_id, digest, row), every digest once.

    Members of the index are folded into their slots; nonmembers are groups
    of their own. See ``GROUP_SCHEMA``.
    """
    new = cut(_groups(batch), "batch")
    size = new.count()
    first = index.select("buckets").first()
    buckets = first[0] if first else _buckets_for(size)
    if size > 2 * BUCKET_KEYS * buckets:
        # A batch that is much larger than the history: deal the index anew, so no bucket is crowded.
        held = cut(index_groups(index), "held")
        buckets = _buckets_for(held.count(), size)
        index = build_index(held, buckets)
    asked = new.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    return index.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(_lookup, GROUP_SCHEMA)


def index_groups(index: DataFrame) -> DataFrame:
    """The slots of an index as rows (digest, winner, has_winner, row, n)."""

    def run(batches):
        for frame in batches:
            for _, row in frame.iterrows():
                b = _Bucket(row)
                yield pd.DataFrame({"digest": [x.tobytes() for x in b.held], "winner": b.winners, "has_winner": b.has, "row": b.rows, "n": b.counts})

    return index.mapInPandas(run, "digest binary, winner bigint, has_winner boolean, row bigint, n bigint")


def extend_index(groups: DataFrame) -> DataFrame:
    """The index for the next batch, from the groups of ``merge_batch``."""
    groups = cut(groups.select("digest", "winner", "has_winner", "row", "n"), "history")
    return cut(build_index(groups, _buckets_for(groups.count())), "index")


def digests_of(docs: DataFrame) -> DataFrame:
    """doc_id, digest, row of each row; row numbers are written, so they stay."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"), *[c for c in ("in_history",) if c in docs.columns])
    return cut(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def decide(digests: DataFrame, groups: DataFrame, of_batch=True) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of rows (doc_id, digest, row).

    ``of_batch`` says which rows came as the batch: a row stays if it is the
    winner's, and a winner of the history is no row of the batch.
    """
    stays = (F.col("row") == F.col("winner_row")) & (F.lit(of_batch) == F.col("of_batch") if isinstance(of_batch, bool) else of_batch == F.col("of_batch"))
    met = digests.join(groups.select("digest", "winner", "has_winner", F.col("row").alias("winner_row"), "n", "of_batch"), "digest", "left")
    return met.select("doc_id", F.when(F.col("has_winner"), F.col("winner")).alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *[c for c in ("in_history",) if c in digests.columns])


def exact_dedup(history: DataFrame, batch: DataFrame) -> DataFrame:
    """Decide every row of ``history`` and ``batch`` (doc_id, text).

    Returns doc_id, keep_id, group_size, kept, text_sha256, in_history.
    """
    pick = lambda df, old: df.select("doc_id", "text", F.lit(old).alias("in_history"))
    both = digests_of(pick(history, True).unionByName(pick(batch, False)))
    new = both.filter("not in_history")
    groups = cut(merge_batch(index_of(both.filter("in_history"), new.count()), new), "groups")
    return decide(both, groups, ~F.col("in_history"))
