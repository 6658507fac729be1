"""Operator 2: mixing sources to target weights by cube-method sampling.

A source whose target is r times its size takes every document floor(r) times
and one more time with inclusion probability r - floor(r). The flight phase of
the cube method turns these fractions into 0 or 1 along the null space of the
two balance constraints (words and documents of the source), so both totals
stay exact:

* First the long documents, largest first: one moves to 0 or 1 and all smaller
  undecided ones together make up for it, each by a little. Were they left to
  the end, the last few documents could not outweigh one of them.
* Then the rest, three undecided documents at a time.

It runs in blocks that hold a bounded number of rows; what a block leaves
undecided (a dozen documents for each source at most) moves on to a merged
block, and so on until a source is down to a handful, which the landing phase
decides: it draws, by their probabilities, one of the 0/1 outcomes whose word
total misses by at most ``MISS`` of the target. Where none does (a source of a
few documents), the sample is drawn again, a bounded number of times, and the
nearest one stands.

Blocks are dealt by a hash of doc_id and text and sorted inside, so a source
with a third of all rows is spread over as many blocks as any, and reruns
agree. Rows that repeat in larger numbers than a block should hold are dealt by
their number too.

Defined results. Null text has size 0. A null source is a source of its own,
after all others. Documents of size 0 are balanced like the others. Sources
of size 0 take each of their documents once, at no cost. Equal rows are taken
or not by their order, which nothing can tell apart. An empty table gives no
rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_or_empty

MAX_REPEAT = 3.0
BLOCK_ROWS = 50_000
#: Blocks whose leftovers are merged into one.
FAN_IN = 256
#: Undecided documents that a flight leaves, and with which a source lands: 2 ** LANDING outcomes.
LANDING = 12
#: Part of a block's words (of one source) from which a document is long, and part that an outcome may miss.
LONG, MISS = 0.001, 0.0001
#: Samples drawn for a source until one misses its words by at most ``MISS``; else the nearest of them.
DRAWS = 64

STATE = "row_id bigint, doc_id bigint, source_no int, size bigint, base int, pi double, words double, block bigint, copies int"


def targets(sizes: list[int], weights: list[float], total: float, cap: float = MAX_REPEAT) -> list[float]:
    """Shares of ``total`` by weight; what exceeds cap * size is shared anew by weight."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / weight > cap * sizes[i]] if weight > 0 else list(open_)
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / weight
            break
        for i in over:
            out[i] = cap * sizes[i]
            open_.discard(i)
        rest = float(total) - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def source_targets(sized: DataFrame, weights=None) -> list[tuple]:
    """(source, source_size, target) in the order of the sources.

    One row for each source comes to the driver: the list of sources is the
    mix's own configuration, like its weights.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    weights = weights or [1.0 + i % 3 for i in range(len(rows))]
    sizes = [int(r["size"] or 0) for r in rows]
    return [(r["source"], n, t) for r, n, t in zip(rows, sizes, targets(sizes, weights, sum(sizes)), strict=True)]


def _flight(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator, leave: int) -> np.ndarray:
    """Move ``pi`` until at most ``leave`` entries (2 or more) are fractional."""
    pi, eps = pi.copy(), 1e-9
    waiting = [i for i in range(len(pi)) if eps < pi[i] < 1 - eps]
    left, hand, draws = len(waiting), [], iter(())
    waiting.reverse()
    sizes, probs = size.astype(float).tolist(), pi.tolist()
    while left > leave:
        while len(hand) < 3:
            hand.append(waiting.pop())
        a, b, c = hand
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for i, x in zip(hand, u, strict=True):
            if x > 0:
                up, down = min(up, (1 - probs[i]) / x), min(down, probs[i] / x)
            elif x < 0:
                up, down = min(up, probs[i] / -x), min(down, (1 - probs[i]) / -x)
        draw = next(draws, None)
        if draw is None:
            draws = iter(rng.random(4096).tolist())
            draw = next(draws)
        step = up if draw * (up + down) < down else -down
        still = []
        for i, x in zip(hand, u, strict=True):
            p = probs[i] + step * x
            if p < eps:
                probs[i] = 0.0
            elif p > 1 - eps:
                probs[i] = 1.0
            else:
                probs[i] = p
                still.append(i)
        left -= 3 - len(still)
        hand = still
    return np.array(probs) if len(probs) else pi


def _spread(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move the long documents of ``size`` (descending) to 0 or 1; smaller ones make up for each."""
    pi, eps = pi.copy(), 1e-9
    s = size.astype(float)
    least = LONG * s.sum()
    for k in range(len(s)):
        if s[k] < least:
            break
        while eps < pi[k] < 1 - eps:
            rest = k + 1 + np.flatnonzero((pi[k + 1 :] > eps) & (pi[k + 1 :] < 1 - eps))
            if len(rest) < LANDING:
                return pi
            # One up needs one document and s[k] words less of the rest; who is near 0 or 1 gives little.
            w, x = pi[rest] * (1 - pi[rest]), s[rest]
            m0, m1, m2 = w.sum(), w @ x, w @ (x * x)
            det = m0 * m2 - m1 * m1
            if det <= 1e-9 * m0 * m2:
                move = -s[k] * w / m1 if m1 > 0 else None
            else:
                move = -w * ((m2 - s[k] * m1) + (s[k] * m0 - m1) * x) / det
            if move is None:
                break
            at, u = np.concatenate([[k], rest]), np.concatenate([[1.0], move])
            up = down = math.inf
            more, less = u > 1e-15, u < -1e-15
            up = min(((1 - pi[at[more]]) / u[more]).min(initial=math.inf), (pi[at[less]] / -u[less]).min(initial=math.inf))
            down = min((pi[at[more]] / u[more]).min(initial=math.inf), ((1 - pi[at[less]]) / -u[less]).min(initial=math.inf))
            step = up if rng.random() * (up + down) < down else -down
            moved = pi[at] + step * u
            pi[at] = np.where(moved < eps, 0.0, np.where(moved > 1 - eps, 1.0, moved))
            if up + down < 1e-12:
                break
    return pi


def _land(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator, words: float) -> np.ndarray:
    """0/1 for each entry: one of the outcomes that miss the word total by ``MISS`` of ``words`` at most, else a nearest one."""
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    if not len(open_):
        return pi
    p = pi[open_]
    bits = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    miss = np.abs(bits @ size[open_] - size[open_] @ p)
    near = miss <= max(miss.min() + 1e-6, MISS * words)
    docs = np.abs(bits.sum(axis=1) - p.sum())
    near &= docs <= max(1.0, docs[near].min() + 1e-9)
    chance = np.exp(bits[near] @ np.log(p) + (1 - bits[near]) @ np.log1p(-p))
    out = pi.copy()
    out[open_] = bits[np.flatnonzero(near)[rng.choice(len(chance), p=chance / chance.sum())]]
    return out


def _block(rows: pd.DataFrame, last: bool) -> pd.DataFrame:
    rows = rows.sort_values(["source_no", "size", "row_id", "doc_id"], ascending=[True, False, True, True], kind="stable").reset_index(drop=True)
    pi = rows["pi"].to_numpy(float).copy()
    size = rows["size"].to_numpy(np.int64)
    for source, at in rows.groupby("source_no", sort=True).indices.items():
        words, best = float(rows["words"].iloc[at[0]]), math.inf
        for draw in range(DRAWS if last else 1):
            rng = np.random.default_rng([int(source), int(rows["block"].iloc[0]) & (2**63 - 1), len(at), draw])
            moved = pi[at]
            if ((moved > 0) & (moved < 1)).sum() > LANDING:
                moved = _flight(size[at], _spread(size[at], moved, rng), rng, LANDING)
            if not last:
                found = moved
                break
            landed = _land(size[at], moved, rng, words)
            miss = abs(size[at] @ landed - size[at] @ pi[at])
            if miss < best:
                best, found = miss, landed
            if best <= MISS * words:
                break
        pi[at] = found
    rows["pi"] = pi
    decided = (pi == 0) | (pi == 1)
    rows["copies"] = np.where(decided, rows["base"] + pi, -1).astype(int)
    return rows


def _open_block(rows: pd.DataFrame) -> pd.DataFrame:
    return _block(rows, False)


def _last_block(rows: pd.DataFrame) -> pd.DataFrame:
    return _block(rows, True)


def mix(docs: DataFrame, weights=None, text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, copies."""
    spark = docs.sparkSession
    said = text_or_empty(text)
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(said, F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64("doc_id", said).alias("row_id"))
    sized = cut(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    plan = source_targets(sized, weights)
    schema = "source string, source_no int, source_size bigint, target double, base int, pi0 double"
    rows = []
    for no, (source, size, target) in enumerate(plan):
        ratio = target / size if size else 1.0
        base = min(int(MAX_REPEAT), math.floor(ratio + 1e-9))
        rows.append((source, no, size, target, base, min(1.0, max(0.0, ratio - base)) if ratio - base > 1e-9 else 0.0))
    table = spark.createDataFrame(rows, schema)
    n = sized.count()
    blocks = max(1, math.ceil(n / BLOCK_ROWS))
    units = sized.join(F.broadcast(table) if len(rows) <= 10_000 else table, sized["source"].eqNullSafe(table["source"])).select("row_id", "row", "doc_id", "source_no", "size", "base", F.col("pi0").alias("pi"), F.col("target").alias("words"))
    # Equal rows have one hash: where they would crowd a block, their numbers deal them on.
    many = cut(sized.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(1, BLOCK_ROWS // 8)).select("row_id"), "repeated")
    if blocks > 1 and not many.isEmpty():
        # At most one in BLOCK_ROWS / 8 rows names one of these.
        units = units.join(many.withColumn("many", F.lit(True)), "row_id", "left").withColumn("row_id", F.when(F.col("many"), F.xxhash64("row_id", "row")).otherwise(F.col("row_id")))
    units = units.select("row_id", "doc_id", "source_no", "size", "base", "pi", "words", F.pmod(F.col("row_id"), F.lit(blocks)).alias("block"), F.lit(-1).alias("copies"))
    parts = []
    while True:
        last = blocks == 1
        step = _last_block if last else _open_block
        done = cut(units.groupBy("block", *(["source_no"] if parts else [])).applyInPandas(step, STATE), "flight")
        parts.append(done.filter("copies >= 0"))
        if last:
            break
        blocks = math.ceil(blocks / FAN_IN)
        units = done.filter("copies < 0").withColumn("block", F.floor(F.col("block") / FAN_IN) if blocks > 1 else F.lit(0).cast("bigint"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.join(F.broadcast(table.drop("base", "pi0")) if len(rows) <= 10_000 else table.drop("base", "pi0"), "source_no").select("doc_id", "source", "size", "source_size", "target", "copies", "source_no")


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` takes them.

    Rows are matched by doc_id. Where ids repeat, rows that share id, source
    and size are told apart by number, so each gets a decision of its own.
    """
    decided = cut(mixed.select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("source").alias("__src"), "copies"), "decided")
    left = docs.withColumn("__id", F.col("doc_id").cast("bigint"))
    if decided.groupBy("__id").count().filter("count > 1 or __id is null").isEmpty():
        met = left.join(decided.filter("copies > 0").select("__id", "copies").hint("merge"), "__id")
    else:
        same = Window.partitionBy("__id", "__size", "__src")
        left = left.withColumn("__size", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint")).withColumn("__src", F.col("source").cast("string"))
        left = left.withColumn("__turn", F.row_number().over(same.orderBy(F.xxhash64("text"))))
        right = decided.withColumn("__turn", F.row_number().over(same.orderBy("copies"))).filter("copies > 0")
        met = left.join(right, left["__id"].eqNullSafe(right["__id"]) & (left["__size"] == right["__size"]) & left["__src"].eqNullSafe(right["__src"]) & (left["__turn"] == right["__turn"]))
    met = met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return met.select(*[left[c] for c in docs.columns])
