"""Operator 7: SimHash near-dedup by a binary-trie self-join.

Fingerprints are computed once for each text and joined once for each
distinct fingerprint. The self-join looks for all pairs within ``budget``
differing bits: node pairs of a binary trie are traversed together, differing
bits add up, and a pair is pruned when the sum exceeds the budget.

To distribute the trie, the 64 bits are cut into ``m`` blocks; two
fingerprints within the budget agree on at least m - budget blocks, so for
every choice of m - budget blocks the fingerprints that agree there share one
sub-trie (pigeonhole; nothing is lost). m grows with the number of distinct
fingerprints, which keeps sub-tries small. A sub-trie that is still large
(close copies of one text) is dealt again by the bits that are not fixed yet.

A sub-trie's links are reported as a spanning forest, so its output is never
larger than its input, and node pairs that are known to be connected are not
traversed. The forests are joined by distributed connected components.

Defined results. Null and empty texts have fingerprint zero and link like any
other. Repeated rows share a fingerprint and a component. Rows with a null
doc_id are returned with the component of their fingerprint and do not name
it, unless all are null. An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, text_or_empty
from .components import connected_components

SHINGLE = 4
BUDGET = 4
SEED = 42
#: Fingerprints in a sub-trie, on average, above which m grows.
TRIE_KEYS = 48
#: Fingerprints in a sub-trie above which it is dealt again.
LARGE_TRIE = 200_000
#: Fingerprints in a sub-trie up to which all its near pairs are reported in any case.
PAIRS_TRIE = 24
#: Near pairs for each text of a bucket, and texts of a bucket, up to which they are all verified at once.
DENSE_PAIRS, DENSE_KEYS = 8, 8192
#: Bits in which the members of a dense bucket's close sets differ from the next one.
CLOSE_BITS = 8
#: Pairs of fingerprints that are compared at once.
PAIRS_AT_ONCE = 1 << 19
#: Pairs of sketches that are compared at once.
SKETCHES_AT_ONCE = 1 << 15
#: Node pairs that are expanded at once.
FRONTIER = 1 << 16


def _hashes(text: str, width: int) -> list[int]:
    """XXH64 of each shingle of a text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: len(words) - width]]).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)]


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the hashes, by column: (n,) or (n, words) to (words,)."""
    rows = hashes.reshape(len(hashes), hashes.shape[1] if hashes.ndim > 1 else 1)
    n, words = rows.shape
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, n, 255):
        # Bits as bytes, added eight at a time; 255 of them fit a byte.
        bits = np.unpackbits(rows[i : i + 255].view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits.view(np.uint64), axis=0).view(np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    return int(_majority(np.array(_hashes(text, width), dtype="<u8"))[0])


def sketch(text: str, width: int, words: int) -> tuple[np.ndarray, int]:
    """Fingerprints of the distinct shingles under ``words`` hashes, and how many shingles these are."""
    h = np.unique(np.array(_hashes(text, width), dtype="<u8"))
    salt = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (h ^ (h >> np.uint64(29)))[:, None] * (np.uint64(0xBF58476D1CE4E5B9) + salt * np.uint64(2))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return _majority(x ^ (x >> np.uint64(29))), len(h)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed bigint) of each row."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


#: 64-bit words of the sketch that near-dedup decides candidates by, and how many of them the first pass
#: carries; the first word is the one that is sampled.
WORDS, FIRST_WORDS = 16, 8
PRINTS = [f"fp{i}" for i in range(WORDS)]


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """node, fp0, fp1, ..., size (distinct shingles) of each row (node, text)."""

    def run(batches):
        for batch in batches:
            found = [sketch(t, width, WORDS) for t in batch.column("text").to_pylist()]
            words = np.array([f[0] for f in found], dtype=np.uint64).reshape(len(found), WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(np.ascontiguousarray(c)) for c in words.T), pa.array([f[1] for f in found], pa.int64())], ["node", *PRINTS, "size"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, " + ", ".join(f"{c} bigint" for c in PRINTS) + ", size bigint")


def blocks_for(n: int, budget: int = BUDGET) -> int:
    """The number of blocks for n distinct fingerprints."""
    m = budget + 1
    while m < budget + 6 and n / 2 ** (64 * (m - budget) // m) > TRIE_KEYS:
        m += 1
    return m


def masks(m: int, budget: int, free: int = 0) -> list[int]:
    """Masks that fix m - budget of m blocks of the bits outside ``free``'s complement.

    ``free`` has the bits that are already fixed; the masks keep them.
    """
    bits = [b for b in range(64) if not free >> b & 1]
    cuts = [round(i * len(bits) / m) for i in range(m + 1)]
    blocks = [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]
    return [free | sum(c) for c in combinations(blocks, m - budget)]


def sampled_masks(n: int, bits: int | dict[int, float], recall: float, keys: int = TRIE_KEYS, seed: int = 11) -> list[int]:
    """Masks of some random bits each, so many that two of n fingerprints that
    differ in ``bits`` bits agree under one of them with probability ``recall``.

    ``bits`` may be a distribution; what it lacks to one counts as not found.
    """
    share = bits if isinstance(bits, dict) else {bits: 1.0}
    k = min(64 - max(share) - 8, max(0, math.ceil(math.log2(max(1, n / keys)))))
    same = np.array([math.comb(64 - b, k) / math.comb(64, k) for b in share])
    part, number = np.array(list(share.values())), 1
    if recall >= part.sum() and k:
        raise ValueError(f"no number of masks has a recall of {recall}")
    while k and part @ (1 - (1 - same) ** number) < recall:
        number += 1
    rng = np.random.default_rng([seed, k])
    return [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in range(number)]


def near_bits(similarity: float, budget: int) -> dict[int, float]:
    """How often fingerprints of equally large sets of this similarity differ in so many bits, both fingerprints within ``budget``."""
    apart = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    share = {b: math.comb(64, b) * apart**b * (1 - apart) ** (64 - b) for b in range(budget + 1)}
    within = sum(share.values())
    return {b: x * within for b, x in share.items()}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Forest:
    """Connected sets of positions; ``label`` is the smallest position of each."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._changes()

    def _changes(self):
        self.change = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else np.zeros(0, np.int64)

    def whole(self, lo1, hi1, lo2, hi2):
        """Whether both ranges lie in one set, for each pair of ranges."""
        return (self.change[hi1 - 1] == self.change[lo1]) & (self.change[hi2 - 1] == self.change[lo2]) & (self.label[lo1] == self.label[lo2])

    def link(self, a, b):
        a, b = self.label[a], self.label[b]
        live = a != b
        a, b = a[live], b[live]
        if not len(a):
            return
        to = np.arange(len(self.label))
        while True:
            x, y = to[a], to[b]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(to, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while True:
                up = to[to]
                if (up == to).all():
                    break
                to = up
        self.label = to[self.label]
        self._changes()


def _pair_chunks(after: np.ndarray):
    """(first row, end) of rows that are compared together with all from ``after`` of the first on."""
    n, i = len(after), 0
    while i < n and after[i] < n:
        j = min(n, i + max(1, PAIRS_AT_ONCE // (n - int(after[i]))))
        yield i, j
        i = j


def _alike(words: np.ndarray, size: np.ndarray, row: np.ndarray, column: np.ndarray, budget: int):
    """(which pairs are within ``budget`` in the second word and within ``sketch_budget``, bits of these)."""
    near = np.flatnonzero(np.bitwise_count(words[row, 1] ^ words[column, 1]) <= budget)
    kept, far = [near[:0]], [near[:0]]
    for i in range(0, len(near), SKETCHES_AT_ONCE):
        some = near[i : i + SKETCHES_AT_ONCE]
        bits = np.bitwise_count(words[row[some]] ^ words[column[some]]).sum(axis=1, dtype=np.int64)
        close = bits <= sketch_budget(np.minimum(size[row[some]], size[column[some]]), words.shape[1])
        kept.append(some[close])
        far.append(bits[close])
    return np.concatenate(kept), np.concatenate(far)


def _near(words: np.ndarray, size: np.ndarray, budget: int, most: float):
    """All candidate pairs of positions; None if there are more than ``most``."""
    found, number, after, keys = [], 0, np.arange(1, len(words) + 1), np.ascontiguousarray(words[:, 0])
    for i, j in _pair_chunks(after):
        row, column = np.nonzero(np.bitwise_count(keys[i:j, None] ^ keys[None, i + 1 :]) <= budget)
        row, column = row + i, column + i + 1
        row, column = row[column > row], column[column > row]
        near, _ = _alike(words, size, row, column, budget)
        found.append((row[near], column[near]))
        number += len(near)
        if number > most:
            return None
    return np.concatenate([x[0] for x in found] or [after[:0]]), np.concatenate([x[1] for x in found] or [after[:0]])


def close_pairs(rows: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of a bucket between different labels, with their distance.

    ``rows``: sketch (``WORDS`` columns), node, size, label, block. A pair is a
    candidate if its first two words are within ``budget`` and the whole
    sketch is within ``sketch_budget`` bits. Where rows have blocks, only pairs
    of the block pair this bucket stands for are looked at.
    """
    order = np.argsort(rows[:, WORDS + 2], kind="stable")
    rows = rows[order]
    words, size, label, block = np.ascontiguousarray(rows[:, :WORDS]).view(np.uint64), rows[:, WORDS + 1], rows[:, WORDS + 2], rows[:, WORDS + 3]
    keys = np.ascontiguousarray(words[:, 0])
    # Where the next label begins: what lies before it needs no comparison.
    after = np.searchsorted(label, label, "right")
    apart = block.min() != block.max()
    a, b, far = [order[:0]], [order[:0]], [order[:0]]
    for i, j in _pair_chunks(after):
        start = int(after[i])
        row, column = np.nonzero(np.bitwise_count(keys[i:j, None] ^ keys[None, start:]) <= budget)
        row, column = row + i, column + start
        near = column >= after[row]
        if apart:
            near &= block[row] != block[column]
        row, column = row[near], column[near]
        near, bits = _alike(words, size, row, column, budget)
        a.append(order[row[near]])
        b.append(order[column[near]])
        far.append(bits)
    return np.concatenate(a), np.concatenate(b), np.concatenate(far)


def sketch_budget(size: np.ndarray, words: int) -> np.ndarray:
    """Bits in which sketches of similar sets may differ: the mean at just ``NEAR_SIMILARITY`` and 2.5 deviations.

    In sets of few shingles majorities are often ties, which adds to the mean.
    """
    p = np.minimum(0.5, math.acos(2 * NEAR_SIMILARITY / (1 + NEAR_SIMILARITY)) / math.pi + 0.2 / np.maximum(size, 1))
    bits = 64 * words
    return bits * p + 2.5 * np.sqrt(bits * p * (1 - p))


def nearest_first(a: np.ndarray, b: np.ndarray, far: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether a pair is among the ``keep`` nearest of an end, positions that have further ones)."""
    ends, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((pair, far[pair], ends))
    e = ends[order]
    first = np.concatenate([[True], e[1:] != e[:-1]]) if len(e) else np.zeros(0, bool)
    rank = np.arange(len(e)) - np.maximum.accumulate(np.where(first, np.arange(len(e)), 0))
    chosen = np.zeros(len(a), bool)
    chosen[pair[order[rank < keep]]] = True
    return chosen, np.unique(np.concatenate([a[~chosen], b[~chosen]]))


def first_links(words: np.ndarray, size: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Candidate pairs of positions of a bucket, and whether these are all.

    A bucket with very many near pairs gives links to the medoids of its close
    sets in their place; its members are not done.
    """
    pairs = _near(words, size, budget, DENSE_PAIRS * max(len(words), PAIRS_TRIE)) if len(words) <= DENSE_KEYS else None
    if pairs is not None:
        return *pairs, True
    keys, second = np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])
    one, of = np.unique(keys, return_index=True, return_inverse=True)[1:]
    child, parent = trie_links(keys[one], np.zeros(len(one), np.int64), CLOSE_BITS)
    up = np.arange(len(one))
    up[child] = parent
    root, everyone = one[up[of]], np.arange(len(keys))
    lower = root != everyone
    return *_to_medoids(keys, second, everyone[lower], root[lower]), False


def _to_medoids(keys: np.ndarray, second: np.ndarray, child: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In place of links to any member of a group: links to its medoid.

    Copies that were changed in different places are nearer to what they were
    copied from than to one another; that text's fingerprint is the one
    nearest to the majority of the group's bits.
    """
    order = np.argsort(parent, kind="stable")
    child, parent = child[order], parent[order]
    first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(child) else child[:0]
    a, b = [child[:0]], [child[:0]]
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(child)]):
        members = np.concatenate([parent[lo : lo + 1], child[lo:hi]])
        away = np.zeros(len(members), np.int64)
        for prints in (keys[members], second[members]):
            bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1)
            away += (bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(members))).sum(axis=1)
        medoid = members[away.argmin()]
        others = members[members != medoid]
        a.append(others)
        b.append(np.full(len(others), medoid))
    return np.concatenate(a), np.concatenate(b)


def trie_links(keys: np.ndarray, groups: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within ``budget`` bits, group by group.

    ``keys`` (uint64) are distinct and sorted inside each group of the sorted
    ``groups``. Returns positions (child, parent). A node of a trie is a range
    of positions. Cross pairs are taken from the deepest nodes upwards, so
    close keys are connected before the wide comparisons above them, which
    skip what is connected by then.
    """
    forest = _Forest(len(keys))
    _traverse(keys, groups, budget, forest)
    child = np.flatnonzero(forest.label != np.arange(len(keys)))
    return child, forest.label[child]


def _traverse(keys: np.ndarray, groups: np.ndarray, budget: int, forest) -> None:
    n = len(keys)
    ones = np.empty((64, n + 1), np.int32)
    for b in range(64):
        ones[b, 0] = 0
        np.cumsum((keys >> np.uint64(b)) & np.uint64(1), out=ones[b, 1:])
    edge = np.flatnonzero(np.diff(groups)) + 1
    lo, hi = np.concatenate([[0], edge]).astype(np.int32), np.concatenate([edge, [n]]).astype(np.int32)
    born = []
    for b in range(63, -1, -1):
        wide = hi - lo > 1
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            break
        mid = hi - (ones[b, hi] - ones[b, lo])
        both = (mid > lo) & (mid < hi)
        born.append((b, lo[both], mid[both], hi[both]))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        full = hi > lo
        lo, hi = lo[full], hi[full]
    for b, lo, mid, hi in reversed(born):
        for i in range(0, len(lo), FRONTIER):
            s = slice(i, i + FRONTIER)
            _cross(keys, ones, forest, budget, b - 1, lo[s], mid[s], mid[s], hi[s], np.ones(len(lo[s]), np.int8))


def _cross(keys, ones, forest, budget, bit, lo1, hi1, lo2, hi2, err):
    """Traverse node pairs whose sub-tries still differ in bits ``bit`` and below."""
    todo = [(bit, lo1, hi1, lo2, hi2, err)]
    while todo:
        bit, lo1, hi1, lo2, hi2, err = todo.pop()
        live = ~forest.whole(lo1, hi1, lo2, hi2)
        # All that is left fits the budget: the whole pair of sub-tries is linked.
        done = live & (err + bit + 1 <= budget)
        single = live & ~done & (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        a, b = lo1[single], lo2[single]
        near = np.bitwise_count(keys[a] ^ keys[b]) <= budget
        ends = [(a[near], b[near])]
        for x1, y1, x2, y2 in zip(lo1[done], hi1[done], lo2[done], hi2[done]):
            everyone = np.concatenate([np.arange(x1, y1), np.arange(x2, y2)])
            ends.append((everyone, np.full(len(everyone), x1)))
        forest.link(np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
        live &= ~done & ~single
        if bit < 0 or not live.any():
            continue
        lo1, hi1, lo2, hi2, err = (x[live] for x in (lo1, hi1, lo2, hi2, err))
        m1, m2 = hi1 - (ones[bit, hi1] - ones[bit, lo1]), hi2 - (ones[bit, hi2] - ones[bit, lo2])
        quads = [(lo1, m1, lo2, m2, err), (m1, hi1, m2, hi2, err), (lo1, m1, m2, hi2, err + 1), (m1, hi1, lo2, m2, err + 1)]
        n1, n2, k1, k2, e = (np.concatenate(x) for x in zip(*quads))
        keep = (n2 > n1) & (k2 > k1) & (e <= budget)
        n1, n2, k1, k2, e = (x[keep] for x in (n1, n2, k1, k2, e))
        for i in range(0, len(n1), FRONTIER):
            s = slice(i, i + FRONTIER)
            todo.append((bit - 1, n1[s], n2[s], k1[s], k2[s], e[s]))


def _in_groups(batches, links, at_once: int = 100_000):
    """Rows sorted by their leading (mask, value) columns to ``links`` of whole groups, some groups at a time."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([batch.column(i).to_numpy() for i in range(batch.num_columns)], axis=1))
        size += batch.num_rows
        if size >= at_once:
            rows = np.concatenate(held)
            last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
            cut_at = int(last[-1]) + 1 if len(last) else 0
            if cut_at:
                yield from _edges(links(rows[:cut_at]))
            held, size = [rows[cut_at:]], len(rows) - cut_at
            at_once = max(at_once, 2 * size)
    if held:
        yield from _edges(links(np.concatenate(held)))


def _edges(pairs):
    a, b = pairs
    for i in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["a", "b"])


def _edge_list(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1, [len(rows)]])


def _trie_rows(budget: int):
    """Rows (mask, value, fp) to links of fingerprints."""

    def links(rows: np.ndarray):
        groups = np.repeat(np.arange(len(_edge_list(rows)) - 1), np.diff(_edge_list(rows)))
        keys = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        order = np.lexsort((keys, groups))
        keys = keys[order]
        child, parent = trie_links(keys, groups[order], budget)
        return keys.view(np.int64)[child], keys.view(np.int64)[parent]

    return links


def _first_rows(budget: int):
    """Rows (mask, value, sketch, node, size) to links of nodes; a link of a node with itself marks it as not done."""

    def links(rows: np.ndarray):
        edge, a, b = _edge_list(rows), [rows[:0, 0]], [rows[:0, 0]]
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if y - x < 2:
                continue
            mine = rows[x:y, 2:]
            words = np.ascontiguousarray(mine[:, :FIRST_WORDS]).view(np.uint64)
            order = np.argsort(words[:, 0], kind="stable")
            child, parent, done = first_links(words[order], mine[order, FIRST_WORDS + 1], budget)
            node = mine[order, FIRST_WORDS]
            a.append(node[child])
            b.append(node[parent])
            if not done:
                a.append(node)
                b.append(node)
        return np.concatenate(a), np.concatenate(b)

    return links


def _close_rows(budget: int, keep: int | None):
    """Rows (mask, value, sketch, node, size, label, block) to links of nodes; a link of a node with itself marks that it has further candidates."""

    def links(rows: np.ndarray):
        edge, none = _edge_list(rows), rows[:0, 0]
        a, b = [none], [none]
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            mine = rows[x:y, 2:]
            node = mine[:, WORDS]
            p, q, far = close_pairs(mine, budget)
            if keep is not None:
                chosen, more = nearest_first(p, q, far, keep)
                p, q = p[chosen], q[chosen]
                a.append(node[more])
                b.append(node[more])
            a.append(node[p])
            b.append(node[q])
        return np.concatenate(a), np.concatenate(b)

    return links


def _deal(rows: DataFrame, choices: list[int]) -> DataFrame:
    """Rows (mask, value, fp, ...): one for each mask."""
    columns = [c for c in rows.columns if c not in ("mask", "value")]
    return rows.select(*columns, F.explode(F.array(*[F.lit(_signed(x)) for x in choices])).alias("mask")).select("mask", F.expr("fp & mask").alias("value"), *columns)


def _free_bits(mask: int) -> int:
    return 64 - (mask & (2**64 - 1)).bit_count()


def _buckets(rows: DataFrame, choices: list[int], columns: list[str], links, blocks: DataFrame | None = None, across: bool = False) -> DataFrame:
    """Links (a, b) between nodes, of rows (fp0, ...), in the buckets of these masks.

    ``blocks`` (mask, value, n) names crowded buckets: their rows are dealt to
    n blocks; ``across`` also to each pair of blocks. Distinct, a <= b.
    """
    dealt = rows.select(*columns, F.explode(F.array(*[F.lit(_signed(x)) for x in choices])).alias("mask")).withColumn("value", F.expr("fp0 & mask"))
    part = F.lit(0)
    if blocks is not None:
        # Checked by the caller to be a short list of crowded buckets.
        dealt = dealt.join(F.broadcast(blocks), ["mask", "value"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
        if across:
            dealt = dealt.withColumn("block", own).withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda c: F.least(c, F.col("block")) * F.col("n") + F.greatest(c, F.col("block")))))
        else:
            dealt = dealt.withColumn("part", own)
        part = F.xxhash64("value", "part")
        dealt = dealt.withColumn("value", F.when(F.col("n") > 1, part).otherwise(F.col("value")))
    if across:
        dealt = dealt.withColumn("block", (F.col("block") if blocks is not None else F.lit(0)).cast("bigint"))
        columns = [*columns, "block"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = dealt.select("mask", "value", *columns).repartition(parts, "mask", "value").sortWithinPartitions("mask", "value")
    return ready.mapInArrow(lambda batches: _in_groups(batches, links), "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mask_values(rows: DataFrame, choices: list[int]) -> DataFrame:
    return rows.select("node", "fp0", F.explode(F.array(*[F.lit(_signed(x)) for x in choices])).alias("mask")).select("node", "mask", F.expr("fp0 & mask").alias("value"))


def _crowded(rows: DataFrame, choices: list[int], most: int) -> DataFrame | None:
    """(mask, value, n): buckets of more than ``most`` rows and the blocks they are dealt to; None if there is none."""
    counts = _mask_values(rows, choices).groupBy("mask", "value").agg(F.count(F.lit(1)).alias("c"))
    found = cut(counts.filter(F.col("c") > most).select("mask", "value", F.ceil(F.col("c") / most).cast("int").alias("n")), "crowded")
    return None if found.isEmpty() else found


def near_pairs(distinct: DataFrame, budget: int = BUDGET, large: int = LARGE_TRIE) -> DataFrame:
    """Links (a, b) between fingerprints (fp, distinct) that connect all pairs within ``budget`` bits."""
    dealt = _deal(distinct, masks(blocks_for(distinct.count(), budget), budget))
    parts, found = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), None
    while True:
        counts = cut(dealt.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large), "crowded")
        # With few free bits a sub-trie is bounded by its own depth.
        crowded = [m for m in (r[0] for r in counts.select("mask").distinct().collect()) if _free_bits(m) > 20]  # at most the masks of this level
        again = counts.filter(F.col("mask").isin(crowded)).select("mask", "value")
        ready = dealt.join(again, ["mask", "value"], "left_anti") if crowded else dealt
        links = cut(ready.repartition(parts, "mask", "value").sortWithinPartitions("mask", "value").mapInArrow(lambda b: _in_groups(b, _trie_rows(budget)), "a bigint, b bigint"), "links")
        found = links if found is None else found.unionByName(links)
        if not crowded:
            return found
        rest, finer = dealt.join(again, ["mask", "value"], "left_semi"), None
        for mask in crowded:
            part = _deal(rest.filter(F.col("mask") == mask), masks(budget + 1, budget, mask & (2**64 - 1)))
            finer = part if finer is None else finer.unionByName(part)
        dealt = cut(finer.distinct(), "finer")


def simhash_components(docs: DataFrame, width: int = SHINGLE, budget: int = BUDGET, large: int = LARGE_TRIE) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs``."""
    fps = cut(fingerprints(docs, width), "fingerprints")
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(near_pairs(distinct.select("fp"), budget, large))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = cut(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


#: Of the verified near-dedup: words in a shingle and least Jaccard similarity.
NEAR_WIDTH, NEAR_SIMILARITY = 5, 0.8
#: Texts of that similarity differ in 10 bits on average; in 0.2 % of them it is more than 18.
NEAR_BUDGET, NEAR_RECALL = 18, 0.97
#: Texts in a bucket on average, and in a bucket or block of one at most.
NEAR_KEYS, NEAR_MOST = 8192, 1 << 16
#: Nearest candidates of each text that are verified in one round, where candidates are dense; at last all.
NEAREST = (16, 256, None)


def shingle_sets(docs: DataFrame, width: int = NEAR_WIDTH) -> DataFrame:
    """node, shingles: the distinct shingles of each text, as 32 bits of their hashes."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(np.array(_hashes(text, width), dtype="<u8") >> np.uint64(32)).astype(np.uint32).view(np.int32) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int32()))], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node bigint, shingles array<int>")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, digest, node of each row: equal texts are one node, named by 60 bits of their digest."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn("digest", F.sha2("text", 256))
    return texts.withColumn("node", F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint"))


def _sets(ids: DataFrame, texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The shingle sets of some nodes; texts are shuffled for them once."""
    firsts = nodes.join(ids.distinct(), "node", "left_semi").select(F.col("node").alias("end"), "first")
    asked = texts.join(firsts.hint("merge"), (F.col("node") == F.col("end")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    return cut(shingle_sets(asked, width).dropDuplicates(["node"]), "shingles")


def _similar(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) between nodes whose shingle sets are similar."""
    met = edges.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "t"), "b")
    both = F.size(F.array_intersect("s", "t"))
    return cut(met.filter(both >= F.lit(similarity) * (F.size("s") + F.size("t") - both)).select("a", "b"), "alike")


def _near_groups(texts: DataFrame, width: int = NEAR_WIDTH, similarity: float = NEAR_SIMILARITY, budget: int = NEAR_BUDGET, nearest=NEAREST, most: int = NEAR_MOST) -> DataFrame:
    """node, first (its smallest doc_id), n (rows with both), root: groups of texts whose shingle sets are similar.

    Pairs within ``budget`` bits in both of two fingerprints and near in a
    sketch of 512 bits are candidates; the Jaccard similarity of the shingle
    sets decides each. The budget is too wide for the pigeonhole, so buckets
    come from sampled bits, as many as the recall at just ``similarity`` asks
    for at any number of texts.

    Where candidates are dense, links to medoids are decided first. What these
    did not connect is compared again, by sketches of 1024 bits: first the
    nearest candidates of each text, then further ones, at last all. Only
    candidates between texts that are not connected yet are left each time.
    """
    rows = texts.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min_by("n", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), "nodes")
    if not nodes.filter("low != high").isEmpty():
        raise RuntimeError("two texts agree in 60 bits of their digests")
    nodes = nodes.select("node", "first", "n")
    prints = cut(sketches(texts, width).dropDuplicates(["node"]), "sketches")
    choices = sampled_masks(prints.count(), near_bits(similarity, budget), NEAR_RECALL, NEAR_KEYS)
    crowded = _crowded(prints, choices, most)
    links = cut(_buckets(prints, choices, [*PRINTS[:FIRST_WORDS], "node", "size"], _first_rows(budget), crowded), "links")
    edges = links.filter("a != b")
    dense = links.filter("a = b").select(F.col("a").alias("node"))
    if crowded is not None:
        # Rows of different blocks have not met yet.
        dense = dense.unionByName(_mask_values(prints, choices).join(F.broadcast(crowded), ["mask", "value"]).select("node")).distinct()
    dense = cut(dense, "dense")
    sets = _sets(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).unionByName(dense), texts, nodes, width)
    alike = _similar(edges, sets, similarity)
    roots = connected_components(alike)
    if not dense.isEmpty():
        some = cut(prints.join(dense, "node", "left_semi"), "some")
        crowded = _crowded(some, choices, most) if crowded is not None else None
        columns = [*PRINTS, "node", "size", "label"]
        for keep in nearest:
            labels = some.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
            found = cut(_buckets(labels, choices, columns, _close_rows(budget, keep), crowded, across=True), "close")
            rest = cut(found.filter("a != b").join(edges, ["a", "b"], "left_anti"), "rest")
            if not rest.isEmpty():
                more = _similar(rest, sets, similarity)
                edges, alike = edges.unionByName(rest), alike.unionByName(more)
                if not more.isEmpty():
                    roots = connected_components(alike)
            if found.filter("a = b").isEmpty():
                break
    drop_cut(sets)
    return cut(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "groups")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, component_id (the group's smallest doc_id) of each row; see ``_near_groups``.

    The component of texts without any doc_id has none.
    """
    texts = _keyed(docs)
    groups = _near_groups(texts, **options)
    least = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    return texts.select("doc_id", "node").join(groups.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group a row with the smallest doc_id stays.

    Different texts under one doc_id are decided each by itself. A row without
    a doc_id stays if no row of its group has one, and one such row does. Of
    equal rows one stays.
    """
    groups = _near_groups(_keyed(docs), **options)
    stay = cut(groups.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node", "n")).alias("s")).select(F.col("s.node").alias("_stays"), F.col("s.first").alias("_first"), F.col("s.n").alias("_n")), "stay")
    node = F.conv(F.substring(F.sha2(text_or_empty(), 256), 1, 15), 16, 10).cast("bigint")
    kept = docs.withColumn("_node", node).join(stay.hint("merge"), (F.col("_node") == F.col("_stays")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("_first")), "left_semi")
    if not stay.filter("_n > 1").isEmpty():
        kept = kept.dropDuplicates(["_node"])
    return kept.select(docs.columns)


def hex_fingerprint(fp="fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
