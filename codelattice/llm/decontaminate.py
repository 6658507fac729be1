"""Operator 8: benchmark decontamination by CGK embedding and bit sampling.

An item is leaked where a run of a document's words is within ``ERRORS`` of
the item's words in edit distance. Words are runs of letters and digits, case
folded for ASCII and Latin-1; spaces and punctuation of any script part them,
and each character of a script that is written without spaces is a word.
Windows of an item's size start at every second word; the CGK random walk maps
a window to a string whose Hamming distance follows the edit distance: at step
j it writes the word it stands on and moves on or stays by a random bit of
that word. Keys of a few sampled steps, repeated for several walks, meet the
items' keys; the number of walks is planned by simulation for each range of
item lengths, so that items with as many edits as allowed, half of them seen
from one word too early, are found with the target recall. What meets is
verified by exact edit distance (bit-parallel), so nothing false is reported.

Windows that cannot match are skipped first, by the q-gram lemma: a run
within t edits of n words keeps n - q + 1 - q * t of the item's q-grams, so
windows that hold fewer q-grams of items of n words need no embedding. This
loses nothing. Equal windows of a chunk are embedded once.

The items are a stated query set; they travel to the tasks in blocks of a
bounded number of words, each block one pass over the documents. Documents
stream through and are never shuffled.

Defined results. Null and empty texts have no words and no leaks; an item
without words is never leaked. Items of fewer than ``MIN_WORDS`` words are
leaked where their words stand in a row, without edits. Repeated rows give
repeated hits; items with equal words are reported each. Of an item's leaks in
a document the nearest counts, then the first. Very long texts are searched
whole; windows are embedded some at a time, whatever their length. Empty
tables give no rows. Extra columns are not read by ``leaks`` and stay as they
are in ``clean``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import text_or_empty

#: Edits allowed for each word of an item.
ERRORS = 0.2
MIN_WORDS = 8
GRAM = 3
#: Windows start at each word whose number in its document is divisible by this.
STRIDE = 2
#: Steps in a key, and keys for each walk.
SAMPLED, KEYS = 3, 8
RECALL = 0.98
#: Simulated leaks that the number of walks is planned by, for each range of lengths (fewer for items of
#: thousands of words, by words, with a wider margin); a plan beyond ``MOST_WALKS`` is refused.
TRIALS, LEAST_TRIALS, TRIAL_WORDS, MOST_WALKS = 1024, 128, 1 << 19, 1024
#: Words of items that travel together.
BLOCK_WORDS = 2_000_000
#: Bytes of text that are looked at together.
CHUNK = 4 << 20
#: Words of windows that are embedded together.
WINDOW_WORDS = 1 << 19

_U = np.uint64
_M = 0x9E3779B97F4A7C15
_LOWER = np.zeros(256, np.uint8)
for _i in range(256):
    _c = chr(_i)
    if _i >= 128 or _c.isalnum():
        _LOWER[_i] = ord(_c.lower()) if _i < 128 else _i
_TABLE = np.random.default_rng(8).integers(1, 2**64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

#: Ranges of code points that part words (spaces, punctuation, symbols)
#: and of scripts without spaces, each of whose characters is a word.
PARTING = ((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2190, 0x2BFF), (0x2E00, 0x2E7F), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x303F), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFEFF, 0xFEFF), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
SINGLE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x302F), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, (1 << 19) + 1)
        up, down = np.full(size, _M, np.uint64), np.full(size, pow(_M, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _within(code: np.ndarray, ranges) -> np.ndarray:
    edges = np.array(ranges, np.int64)
    near = np.searchsorted(edges[:, 0], code, "right") - 1
    return (near >= 0) & (code <= edges[np.maximum(near, 0), 1])


def _other_words(data: np.ndarray):
    """(first byte, bytes, whether it is a word by itself) of characters beyond ASCII that part words or are one."""
    lead = np.flatnonzero(data >= 0xC2)
    size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
    whole = lead + size <= len(data)
    lead, size = lead[whole], size[whole]
    code = data[lead].astype(np.int64) & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | (data[lead[more] + k] & 0x3F)
    single = _within(code, SINGLE)
    some = single | _within(code, PARTING)
    return lead[some], size[some], single[some]


def words_of(data: np.ndarray, starts: np.ndarray):
    """(hash, first byte, end) of each word; ``starts`` are the documents' first bytes.

    No word spans two documents.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    low = _LOWER[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[latin] += 0x20
    at, size, single = _other_words(data)
    for k in range(4):
        part = at[~single & (size > k)] + k
        low[part] = 0
    word = low != 0
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    at, size = at[single], size[single]
    begin[at] = end[at + size - 1] = True
    before, after = at[at > 0] - 1, (at + size)[at + size < len(data)]
    end[before] = word[before]
    begin[after] = word[after]
    s = starts[starts < len(data)]
    begin[s] = word[s]
    e = s[s > 0] - 1
    end[e] = word[e]
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[low] * up[: len(data)], out=total[1:])
    at, to = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return _mix((total[to] - total[at]) * down[at]), at, to


def words_of_text(text: str) -> np.ndarray:
    return words_of(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), np.zeros(1, np.int64))[0]


def _grams(h: np.ndarray) -> np.ndarray:
    n = max(0, len(h) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = out * _U(_M) + h[i : i + n]
    return _mix(out)


def allowed(n: int) -> int:
    """Edits allowed in an item of n words."""
    return int(ERRORS * n) if n >= MIN_WORDS else 0


class Walks:
    """CGK walks over windows of n words, and the sampled keys."""

    def __init__(self, n: int, walks: int, seed: int = 7):
        rng = np.random.default_rng([seed, n])
        self.n, self.steps = n, 3 * n
        self.odd = rng.integers(0, 2**63, (walks, self.steps), dtype=np.uint64) * _U(2) + _U(1)
        self.at = np.stack([[rng.choice(self.steps, SAMPLED, replace=False) for _ in range(KEYS)] for _ in range(walks)])

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(windows, walks * KEYS) sampled keys of the rows of ``windows``."""
        rows, out = np.arange(len(windows)), []
        padded = np.concatenate([windows, np.zeros((len(windows), 1), np.uint64)], axis=1)
        for odd, at in zip(self.odd, self.at):
            wanted = set(at.ravel().tolist())
            i, seen = np.zeros(len(windows), np.int64), {}
            for j in range(max(wanted) + 1):
                here = padded[rows, i]
                if j in wanted:
                    seen[j] = here
                i = np.minimum(i + ((here * odd[j]) >> _U(63)).astype(np.int64), self.n)
            for k, steps in enumerate(at):
                key = np.full(len(windows), k + 1, np.uint64)
                for j in steps.tolist():
                    key = _mix(key * _U(_M) + seen[j])
                out.append(key)
        return np.stack(out, axis=1)


def _mutate(words: np.ndarray, edits: int, rng) -> np.ndarray:
    out = list(words)
    for _ in range(edits):
        i, kind = int(rng.integers(0, len(out))), int(rng.integers(0, 3))
        new = rng.integers(0, 2**63, dtype=np.uint64)
        if kind == 0:
            out[i] = new
        elif kind == 1:
            out.insert(i, new)
        elif len(out) > 1:
            del out[i]
    if rng.integers(0, STRIDE):
        out.insert(0, rng.integers(0, 2**63, dtype=np.uint64))
    out = out[: len(words)] + [_U(0)] * (len(words) - len(out))
    return np.array(out, np.uint64)


def _bin(n: int) -> int:
    """Lengths that are planned together: those within a quarter of one another."""
    return int(math.log(n) / math.log(1.25))


def plan_walks(items: list[np.ndarray], recall: float = RECALL, trials: int = TRIALS) -> dict[int, int]:
    """Walks for each item length with which items that bear all allowed edits are met with ``recall``."""
    by_bin: dict[int, list[np.ndarray]] = {}
    for words in items:
        if len(words) >= MIN_WORDS:
            by_bin.setdefault(_bin(len(words)), []).append(words)
    plan = {}
    for number, known in sorted(by_bin.items()):
        rng = np.random.default_rng([3, number])
        picked: dict[int, list[np.ndarray]] = {}
        draws = max(LEAST_TRIALS, min(trials, TRIAL_WORDS // max(map(len, known))))
        for k in rng.integers(0, len(known), draws).tolist():
            picked.setdefault(len(known[k]), []).append(known[k])
        # Two deviations above, so that the draws do not flatter the plan.
        wanted, walks = min(1.0, recall + 2 * math.sqrt(recall * (1 - recall) / draws)), 4
        while True:
            first = []
            for n, words in picked.items():
                walk = Walks(n, walks)
                whole, worn = walk.keys(np.stack(words)), walk.keys(np.stack([_mutate(w, allowed(n), rng) for w in words]))
                met = (whole == worn).reshape(len(words), walks, KEYS).any(axis=2)
                first += np.where(met.any(axis=1), met.argmax(axis=1) + 1, walks + 1).tolist()
            need = sorted(first)[math.ceil(wanted * len(first)) - 1]
            if need <= walks:
                break
            walks *= 2
            if walks > MOST_WALKS:
                raise ValueError(f"no plan of {MOST_WALKS} walks has a recall of {recall}")
        plan |= {len(w): need for w in known}
    return plan


def nearest(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, end) of the run of ``text`` that is nearest to ``pattern``; the first of the nearest."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        hp, hn = minus | (full & ~(d0 | plus)), plus & d0
        score += bool(hp & top) - bool(hn & top)
        hp = hp << 1 & full
        minus, plus = hp & d0, (hn << 1 & full) | (full & ~(hp | d0))
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """A block of items: their words, q-grams and keys."""

    def __init__(self, items: list[tuple[int, np.ndarray]], plan: dict[int, int]):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        long = [w for w in self.words if len(w) >= MIN_WORDS]
        empty = np.zeros(0, np.uint64)
        self.vocabulary = np.unique(np.concatenate([empty, *long]))
        self.word_bits = self._bits(self.vocabulary)
        self.groups, self.short, grams, bits = [], [], [empty], [empty]
        for number, n in enumerate(sorted({len(w) for w in self.words})):
            mine = [k for k, w in enumerate(self.words) if len(w) == n]
            rows = np.stack([self.words[k] for k in mine])
            if n < MIN_WORDS:
                keys = self._runs(rows.ravel(), n)[::n]
                order = np.argsort(keys, kind="stable")
                self.short.append((n, keys[order], np.array(mine)[order]))
                continue
            walk = Walks(n, plan[n])
            keys = walk.keys(rows)
            tagged = (keys ^ self._tags(keys.shape[1])).ravel()
            order = np.argsort(tagged)
            self.groups.append((n, max(1, n - GRAM + 1 - GRAM * allowed(n)), walk, tagged[order], np.repeat(mine, keys.shape[1])[order], number % 64))
            for k in mine:
                grams.append(_grams(self.words[k]))
                bits.append(np.full(len(grams[-1]), 1 << (number % 64), np.uint64))
        # Each q-gram with the lengths (mod 64) of the items that hold it.
        self.grams, at = np.unique(np.concatenate(grams), return_inverse=True)
        self.lengths = np.zeros(len(self.grams), np.uint64)
        np.bitwise_or.at(self.lengths, at, np.concatenate(bits))
        self.gram_bits = self._bits(self.grams)
        self.reach = max((g[0] + allowed(g[0]) for g in self.groups), default=0) + STRIDE - 1
        self.least = min((g[1] for g in self.groups), default=0)

    @staticmethod
    def _runs(h: np.ndarray, n: int) -> np.ndarray:
        """A hash of each n words in a row."""
        out = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for i in range(n):
            out = out * _U(_M) + h[i : i + len(out)]
        return _mix(out)

    @staticmethod
    def _tags(columns: int) -> np.ndarray:
        """Makes equal keys of different samples differ."""
        return _mix(np.arange(1, columns + 1, dtype=np.uint64))

    @staticmethod
    def _bits(held: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[(held >> _U(44)).astype(np.int64)] = True
        return out

    @staticmethod
    def _among(asked: np.ndarray, held: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``asked`` are in the sorted ``held``, where these are there); ``bits`` knows most strangers."""
        at = np.flatnonzero(bits[(asked >> _U(44)).astype(np.int64)])
        if not len(held):
            return at[:0], at[:0]
        near = np.minimum(np.searchsorted(held, asked[at]), len(held) - 1)
        same = held[near] == asked[at]
        return at[same], near[same]

    def meet_short(self, h: np.ndarray, doc: np.ndarray):
        """(start word, item) pairs of short items whose words stand there."""
        for n, keys, item_of in self.short:
            if len(h) < n:
                continue
            runs = self._runs(h, n)
            lo, hi = np.searchsorted(keys, runs, "left"), np.searchsorted(keys, runs, "right")
            for s in np.flatnonzero((hi > lo) & (doc[: len(runs)] == doc[n - 1 :])).tolist():
                for k in item_of[lo[s] : hi[s]].tolist():
                    if (h[s : s + n] == self.words[k]).all():
                        yield s, k

    def meet(self, h: np.ndarray, doc: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray):
        """(start word, item) pairs whose windows meet an item's key.

        ``doc`` is each word's document, ``doc_start`` and ``doc_end`` its
        first word and end.
        """
        none = np.zeros(0, np.int64)
        n_grams = max(0, len(h) - GRAM + 1)
        if not n_grams or not self.groups:
            return none, none
        at, which = self._among(_grams(h), self.grams, self.gram_bits)
        inside = doc[at] == doc[at + GRAM - 1]
        at, lengths = at[inside], self.lengths[which[inside]]
        hit = np.zeros(len(h) + 1, np.int32)
        hit[at + 1] = 1
        count = np.cumsum(hit)
        ahead = np.minimum(np.arange(len(h)) + self.reach, doc_end)
        starts = np.flatnonzero(count[ahead] - count[:-1] >= self.least)
        starts = starts[(starts - doc_start[starts]) % STRIDE == 0]
        if not len(starts):
            return none, none
        common = np.zeros(len(h) + 1, np.int32)
        common[self._among(h, self.vocabulary, self.word_bits)[0] + 1] = 1
        common = np.cumsum(common)
        padded = np.concatenate([h, np.zeros(self.reach + 1, np.uint64)])
        found = []
        for n, least, walk, table, item_of, number in self.groups:
            slack = allowed(n)
            to = np.minimum(starts + n + slack + STRIDE - 1, doc_end[starts])
            s = np.flatnonzero((count[to] - count[starts] >= least) & (common[to] - common[starts] >= n - slack))
            # Of the q-grams only those count that an item of this length holds.
            own = at[(lengths >> _U(number)) & _U(1) == 1]
            s = starts[s[np.searchsorted(own, to[s]) - np.searchsorted(own, starts[s]) >= least]]
            step = max(64, WINDOW_WORDS // n)
            for i in range(0, len(s), step):
                found += self._meet_group(s[i : i + step], n, walk, table, item_of, padded, doc_end)
        if not found:
            return none, none
        code = np.unique(np.concatenate(found))
        return code & np.int64(0xFFFFFFFF), code >> np.int64(32)

    def _meet_group(self, part, n, walk, table, item_of, padded, doc_end):
        """Codes (item << 32 | start) of the windows of n words at ``part`` that meet an item."""
        at = part[:, None] + np.arange(n + allowed(n) + STRIDE - 1)
        wide = np.where(at < doc_end[part][:, None], padded[at], _U(0))
        windows = wide[:, :n]
        digest = np.zeros(len(part), np.uint64)
        for c in range(wide.shape[1]):
            digest = digest * _U(_M) + wide[:, c]
        _, one, back = np.unique(digest, return_index=True, return_inverse=True)
        keys = walk.keys(windows[one])
        columns = keys.shape[1]
        keys = (keys ^ self._tags(columns)).ravel()
        lo = np.searchsorted(table, keys, "left")
        live = np.flatnonzero(table[np.minimum(lo, len(table) - 1)] == keys)
        if not len(live):
            return []
        many = np.searchsorted(table, keys[live], "right") - lo[live]
        of = np.repeat(live // columns, many)
        step = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        met = np.unique(of * len(self.words) + item_of[np.repeat(lo[live], many) + step])
        of, item = met // len(self.words), met % len(self.words)
        # A match holds n - t of the item's words; what does not goes without a verification.
        near = np.zeros(len(of), bool)
        for k in np.unique(item).tolist():
            rows = np.flatnonzero(item == k)
            near[rows] = np.isin(wide[one[of[rows]]], self.words[k]).sum(axis=1) >= n - allowed(n)
        of, item = of[near], item[near]
        if not len(of):
            return []
        # All windows with this content, not only the embedded one.
        by = np.argsort(back, kind="stable")
        a, z = np.searchsorted(back[by], of, "left"), np.searchsorted(back[by], of, "right")
        which = np.repeat(a, z - a) + np.arange(int((z - a).sum())) - np.repeat(np.cumsum(z - a) - (z - a), z - a)
        return [(np.repeat(item, z - a).astype(np.int64) << np.int64(32)) | part[by[which]]]


def _chunks(column: pa.Array, size: int = CHUNK):
    """(bytes, documents' first bytes, number of the first document) for a column of texts.

    A chunk has at most ``size`` bytes or one document.
    """
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, len(column))
        yield data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], i
        i = j


HITS = "doc_id bigint, item_id bigint, distance int, item_words int, first_char bigint, last_char bigint"


def _search(items: Items):
    sizes = np.array([len(w) for w in items.words], np.int64)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = []
            for data, starts, base in _chunks(batch.column("text")):
                h, at, to = words_of(data, starts)
                if not len(h):
                    continue
                doc = np.searchsorted(starts, at, "right") - 1
                edge = np.searchsorted(doc, np.arange(len(starts) + 1))
                best: dict[tuple[int, int], tuple] = {}
                for first, k in items.meet_short(h, doc):
                    best.setdefault((int(doc[first]), k), (0, first, first + len(items.words[k]) - 1))
                found, item = items.meet(h, doc, edge[doc], edge[doc + 1])
                # Meetings of one item in one document, near each other, are one place.
                n = sizes[item]
                place = np.ones(len(found), bool)
                place[1:] = (item[1:] != item[:-1]) | (doc[found[1:]] != doc[found[:-1]]) | (found[1:] - found[:-1] > n[1:])
                firsts = np.flatnonzero(place)
                for a, z in zip(firsts.tolist(), [*firsts[1:].tolist(), len(found)]):
                    k, d = int(item[a]), int(doc[found[a]])
                    pattern = items.words[k].tolist()
                    slack = allowed(len(pattern))
                    x = max(int(edge[d]), int(found[a]) - slack)
                    y = min(int(edge[d + 1]), int(found[z - 1]) + len(pattern) + slack + STRIDE - 1)
                    distance, end = nearest(pattern, h[x:y].tolist())
                    if distance > slack:
                        continue
                    back = nearest(pattern[::-1], h[x : x + end][::-1].tolist()[: len(pattern) + slack])
                    first, last = x + end - back[1], x + end - 1
                    known = best.get((d, k))
                    if known is None or distance < known[0]:
                        best[d, k] = (distance, first, last)
                for (d, k), (distance, first, last) in sorted(best.items()):
                    begin, upto = int(starts[d]), [int(at[first]), int(to[last])]
                    chars = [int(np.count_nonzero((data[begin:b] & 0xC0) != 0x80)) for b in upto]
                    out.append((ids[base + d], items.ids[k], distance, len(items.words[k]), *chars))
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                names = ["doc_id", "item_id", "distance", "item_words", "first_char", "last_char"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    return run


def item_blocks(benchmark: DataFrame):
    """Blocks of (item_id, words) of at most ``BLOCK_WORDS`` words or one item."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("bigint"), text_or_empty()).toLocalIterator():
        words = words_of_text(row[1])
        if not len(words):
            continue
        if size and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row for each document and item that it leaks.

    ``first_char`` and ``last_char`` (end) bound the place, in code points.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    found = None
    for block in item_blocks(benchmark):
        items = Items(block, plan_walks([w for _, w in block], recall))
        hits = texts.mapInArrow(_search(items), HITS)
        found = hits if found is None else found.unionByName(hits)
    return docs.sparkSession.createDataFrame([], HITS) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that leak no item, in one pass for each block of items."""
    place = docs.columns.index("text")
    fields = StructType([StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    for block in item_blocks(benchmark):
        search = _search(Items(block, plan_walks([w for _, w in block], recall)))

        def run(batches, search=search):
            for batch in batches:
                texts = batch.column(place).fill_null("")
                asked = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts], ["doc_id", "text"])
                keep = np.ones(len(texts), bool)
                for hits in search([asked]):
                    keep[hits.column("doc_id").to_numpy()] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, fields)
    return docs
