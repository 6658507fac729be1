"""Operator 6: repeated passages, by a logarithmic family of suffix arrays.

Every byte that a string of ``MATCH`` bytes covers which also starts in a
document of a smaller doc_id is removed. Documents are dealt to batches of
consecutive ids and bounded size. Strings are indexed in shards; in a shard
the batches arrive in order, each gets the sorted array of its suffixes, is
merge-scanned against the levels that earlier batches left, and becomes a
level itself; levels of like size are merged, so there are logarithmically
many. Suffixes are cut to the depth of a match and ordered by a fingerprint of
these bytes, which sorts as a number; what a scan finds equal is compared byte
by byte, and a range in which a fingerprint deceives is redone in the order of
the bytes themselves. All this is done for one range of fingerprints after
another, as equal strings have equal ones, so a task holds a shard's bytes,
fingerprints and answers, but the sorted arrays of a part of its strings only.

Indexing every position would shuffle each byte many times over. A string of
50 bytes has one minimizer among its 31 grams of 20 bytes, and equal strings
have equal minimizers, so

1. each batch announces its minimizers' hashes, and the hash shards answer
   which of them any other batch has too (one bit each);
2. only neighbourhoods of shared minimizers go to the suffix-array shards,
   once for each distinct neighbourhood of a batch, with bytes, so matches
   are compared byte by byte;
3. the shards answer for each string whether an earlier batch has it, or
   which document of the same batch is the first to, and the batches remove
   what is covered.

A passage that a third of all documents share is one neighbourhood for each
batch; nothing is enumerated in pairs. Batches are ranges of ids with bounded
bytes however the ids are spread; rows of one id (or of none) that are more
than a batch are dealt to several, which do not remove from one another.

``RepeatIndex`` keeps the family on shared storage for batches that come
later: then all neighbourhoods are indexed, a new batch is merge-scanned
against the stored levels, what is on no level becomes a new one, and levels
of like size are merged, from their sorted arrays, into one. Documents of
earlier calls come before those of later ones, whatever their ids.

Defined results. Null text is empty. Rows that share a doc_id do not remove
from one another. Null doc_ids come after all others. Texts of fewer than 50
bytes lose nothing. Very long texts are hashed piece by piece. Extra columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_by, delete, drop_cut, release_shuffles, text_or_empty, trimmed

MATCH = 50
GRAM = 20
#: Bytes of text in a batch, unless one row holds more.
BATCH_BYTES = 8 << 20
#: Batches at most: the driver plans them. Beyond, they are larger.
MAX_BATCHES = 1 << 20
#: Bytes of text for each shard.
SHARD_BYTES = 3 << 20
#: Bytes whose grams are hashed at once.
CHUNK = 256 << 10
#: Bytes of one document whose minimizers are found together; positions in a piece have 28 bits.
PIECE = 64 << 20
#: Parts that an id range of more than a batch is cut to, in each look.
FAN = 64
#: Strings of a shard, about, that are sorted and scanned together: those of a range of fingerprints.
PART = 1 << 19
#: New arrays for each shard, about: batches arrive together up to this part of it.
SCANS = 8
HASH_BITS = 46

_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_POS = np.uint64((1 << 28) - 1)


def _pair(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of grams that join those of ``a`` and those of ``b``."""
    return a[: len(b)] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) | 1) % 2**64) + b


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 20-byte gram."""
    one = _TABLE[data]
    two = _pair(one, one[1:], 1)
    four = _pair(two, two[2:], 2)
    eight = _pair(four, four[4:], 4)
    sixteen = _pair(eight, eight[8:], 8)
    h = _pair(sixteen, four[16:], 16)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def minimizer_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(first, last, hash) of runs of consecutive strings with one minimizer.

    ``data`` holds documents at [starts, ends). A string is named by where it
    starts. The hash is cut to ``HASH_BITS``.
    """
    none = np.zeros(0, np.int64)
    if len(data) < MATCH:
        return none, none, none.view(np.uint64)
    h = gram_hashes(data)
    m = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    for step in (1, 2, 4, 8):
        m = np.minimum(m[:-step], m[step:])
    m = np.minimum(m[:-15], m[15:])
    valid = np.ones(len(m), bool)
    for a, z in zip(np.maximum(starts, ends - MATCH + 1).tolist(), ends.tolist()):
        valid[a:z] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none.view(np.uint64)
    anchor = (m[at] & _POS).astype(np.int64)
    new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first, last = at[np.concatenate([[0], new])], at[np.concatenate([new - 1, [len(at) - 1]])]
    # Minimizers are small; mixed again their hashes spread over all shards.
    own = h[anchor[np.concatenate([[0], new])]] * np.uint64(0x9FB21C651E98DF25)
    own = (own ^ (own >> np.uint64(35))) * np.uint64(0xD6E8FEB86659FD93)
    return first, last, (own ^ (own >> np.uint64(32))) >> np.uint64(64 - HASH_BITS)


class _Batch:
    """The documents of a batch in order, and their minimizer runs."""

    def __init__(self, docs: pd.DataFrame):
        self.docs = docs.sort_values(["doc_id", "data"], na_position="last", kind="stable").reset_index(drop=True)
        ids = self.docs["doc_id"]
        fresh = (ids != ids.shift()) & ~(ids.isna() & ids.isna().shift(fill_value=False))
        self.rank = (fresh.cumsum() - 1).to_numpy(np.int64)
        self.texts = self.docs["data"].tolist()
        self.length = np.array([len(t) for t in self.texts], np.int64)

    def runs(self):
        """For each chunk of documents: its bytes, then first, last, hash and document of each run, and the documents' starts."""
        i, n = 0, len(self.texts)
        while i < n:
            j, size = i, 0
            while j < n and (j == i or size + self.length[j] <= CHUNK):
                size += self.length[j]
                j += 1
            if self.length[i] > PIECE:
                # Strings that start in a piece, with the bytes that the last one needs.
                for p in range(0, int(self.length[i]) - MATCH + 1, PIECE):
                    data = np.frombuffer(self.texts[i], np.uint8, min(PIECE + MATCH - 1, int(self.length[i]) - p), p)
                    first, last, h = minimizer_runs(data, np.zeros(1, np.int64), np.array([len(data)]))
                    yield data, first, last, h, np.full(len(first), i), np.full(len(first), -p)
                i = j
                continue
            data = np.frombuffer(b"".join(self.texts[i:j]), np.uint8)
            ends = np.cumsum(self.length[i:j])
            starts = ends - self.length[i:j]
            first, last, h = minimizer_runs(data, starts, ends)
            at = np.searchsorted(ends, first, "right")
            yield data, first, last, h, at + i, starts[at]
            i = j

    def hashes(self):
        """All distinct hashes, sorted, whether two documents here have it, and the runs' chunks."""
        chunks = list(self.runs())
        h = np.concatenate([c[3] for c in chunks]) if chunks else np.zeros(0, np.uint64)
        rank = self.rank[np.concatenate([c[4] for c in chunks])] if chunks else np.zeros(0, np.int64)
        if not len(h):
            return h, np.zeros(0, bool), np.zeros(0, np.int64), chunks
        order = np.argsort(h, kind="stable")
        hs, rs = h[order], rank[order]
        edge = np.concatenate([[0], np.flatnonzero(hs[1:] != hs[:-1]) + 1])
        many = np.maximum.reduceat(rs, edge) != np.minimum.reduceat(rs, edge)
        where = np.empty(len(h), np.int64)
        where[order] = np.repeat(np.arange(len(edge)), np.diff(np.concatenate([edge, [len(h)]])))
        return hs[edge], many, where, chunks


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes."""
    return ((h >> np.uint64(HASH_BITS - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pack(h: np.ndarray) -> bytes:
    """Sorted hashes as differences of 4 bytes, or of 8 where one needs it."""
    gaps = np.diff(h, prepend=np.uint64(0))
    first, rest = gaps[:1], gaps[1:]
    small = not len(rest) or int(rest.max()) < 2**32
    return (b"\x04" if small else b"\x08") + first.tobytes() + (rest.astype(np.uint32) if small else rest).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    first = np.frombuffer(blob, np.uint64, 1, 1)
    rest = np.frombuffer(blob, np.uint32 if blob[0] == 4 else np.uint64, -1, 9)
    return np.cumsum(np.concatenate([first, rest.astype(np.uint64)]), dtype=np.uint64)


HASHES = "shard int, batch int, payload binary"


def _announce(shards: int):
    def run(docs: pd.DataFrame) -> pd.DataFrame:
        batch = int(docs["batch"].iloc[0])
        h, _, _, _ = _Batch(docs).hashes()
        edges = np.searchsorted(_shard_of(h, shards), np.arange(shards + 1))
        at = [s for s in range(shards) if edges[s] < edges[s + 1]]
        return pd.DataFrame({"shard": np.array(at, np.int32), "batch": np.full(len(at), batch, np.int32), "payload": pd.Series([_pack(h[edges[s] : edges[s + 1]]) for s in at], dtype=object)})

    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """For each batch's hashes in this shard: a bit where another batch has it."""
    lists = [_unpack(x) for x in rows["payload"]]
    h = np.concatenate(lists)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    flag = np.zeros(len(h), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    return pd.DataFrame({"shard": rows["shard"], "batch": rows["batch"], "payload": [np.packbits(x).tobytes() for x in np.split(flag, cuts)]})


SPANS = "kind string, shard int, batch int, slot int, lengths binary, first_rank binary, payload binary"


def _neighbourhoods(shards: int, hash_shards: int):
    """Neighbourhoods of the minimizers that ``flags`` tell (of all, without flags), by shard, and where they were seen."""

    def run(docs: pd.DataFrame, flags: pd.DataFrame | None = None) -> pd.DataFrame:
        columns = ["kind", "shard", "batch", "slot", "lengths", "first_rank", "payload"]
        if not len(docs):
            return pd.DataFrame(columns=columns)
        number, slot = int(docs["batch"].iloc[0]), int(docs["slot"].iloc[0])
        batch = _Batch(docs)
        h, many, where, chunks = batch.hashes()
        edges = np.searchsorted(_shard_of(h, hash_shards), np.arange(hash_shards + 1))
        live = many.copy() if flags is not None else np.ones(len(h), bool)
        for s, bits in zip(flags["shard"], flags["payload"], strict=True) if flags is not None else ():
            n = edges[s + 1] - edges[s]
            live[edges[s] : edges[s + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8))[:n].astype(bool)
        shard = _shard_of(h, shards)
        spans: dict[bytes, int] = {}
        of_shard, first_rank, span_no, doc_row, doc_at = [], [], [], [], []
        done = 0
        for data, first, last, hs, row, start in chunks:
            mine = where[done : done + len(hs)]
            done += len(hs)
            pick = np.flatnonzero(live[mine])
            raw = data.tobytes()
            at, rank = shard[mine[pick]].tolist(), batch.rank[row[pick]].tolist()
            numbers = []
            for a, z, s, r in zip(first[pick].tolist(), (last[pick] + MATCH).tolist(), at, rank):
                no = spans.setdefault(raw[a:z], len(of_shard))
                if no == len(of_shard):
                    of_shard.append(s)
                    first_rank.append(r)
                elif r < first_rank[no]:
                    first_rank[no] = r
                numbers.append(no)
            span_no.append(np.array(numbers, np.int64))
            doc_row.append(row[pick])
            doc_at.append(first[pick] - start[pick])
        if not of_shard:
            return pd.DataFrame(columns=columns)
        of_shard, first_rank, texts = np.array(of_shard), np.array(first_rank, np.uint32), list(spans)
        order = np.argsort(of_shard, kind="stable")
        lengths = np.array([len(t) for t in texts], np.uint8)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        span_no, doc_row, doc_at = place[np.concatenate(span_no)], np.concatenate(doc_row), np.concatenate(doc_at)
        by_span = np.argsort(span_no, kind="stable")
        span_no, doc_row, doc_at = span_no[by_span], doc_row[by_span], doc_at[by_span]
        cuts = np.searchsorted(of_shard[order], np.arange(shards + 1))
        out = []
        for s in np.unique(of_shard).tolist():
            mine = order[cuts[s] : cuts[s + 1]]
            n = lengths[mine].tobytes()
            out.append(("span", s, number, slot, n, first_rank[mine].tobytes(), zlib.compress(b"".join(texts[i] for i in mine.tolist()), 1)))
            a, z = np.searchsorted(span_no, [cuts[s], cuts[s + 1]])
            seen = np.stack([span_no[a:z] - cuts[s], doc_row[a:z], doc_at[a:z]]).astype(np.uint32)
            out.append(("seen", s, number, slot, n, b"", zlib.compress(seen.tobytes(), 1)))
        return pd.DataFrame(out, columns=columns)

    return run


class SuffixLevels:
    """A logarithmic family of sorted arrays of distinct strings.

    A level is (keys, places): sorted keys of strings, and where each is.
    """

    def __init__(self, differ):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        #: Whether any of the strings at two arrays of places differ.
        self.differ = differ

    def scan(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which of the sorted, distinct ``keys`` are on a level."""
        found = np.zeros(len(keys), bool)
        for held, at in self.levels:
            near = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            same = np.flatnonzero(held[near] == keys)
            if self.differ(at[near[same]], places[same]):
                raise _Deceived
            found[same] = True
        return found

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Sorted strings on no level become a level; like-sized levels merge."""
        if len(keys):
            self.levels.append((keys, places))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (b, y), (a, x) = self.levels.pop(), self.levels.pop()
            self.levels.append(merged(a, x, b, y))


def merged(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted arrays as one, with what belongs to their keys; neither is sorted again."""
    at = np.searchsorted(a, b, "right") + np.arange(len(b))
    own = np.ones(len(a) + len(b), bool)
    own[at] = False
    keys, places = np.empty(len(own), a.dtype), np.empty(len(own), x.dtype)
    keys[at], places[at], keys[own], places[own] = b, y, a, x
    return keys, places


class _Deceived(Exception):
    """Two strings that differ have one fingerprint."""


def string_keys(data: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of the MATCH bytes at each place."""
    one = _TABLE[data]
    two = _pair(one, one[1:], 21)
    four = _pair(two, two[2:], 22)
    eight = _pair(four, four[4:], 23)
    sixteen = _pair(eight, eight[8:], 24)
    thirty_two = _pair(sixteen, sixteen[16:], 25)
    h = _pair(_pair(thirty_two, sixteen[32:], 26), two[48:], 27)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _places(lengths: np.ndarray) -> np.ndarray:
    """Where the strings of neighbourhoods of these lengths start, laid end to end."""
    n = lengths - MATCH + 1
    at = np.arange(int(n.sum()))
    return at + np.repeat((np.cumsum(lengths) - lengths) - (np.cumsum(n) - n), n)


def _all_keys(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprints of all strings of neighbourhoods laid end to end, found for about ``CHUNK`` bytes at once."""
    ends = np.cumsum(lengths)
    out, done = np.empty(len(data) - (MATCH - 1) * len(lengths), np.uint64), 0
    cuts = np.unique(np.searchsorted(ends, np.arange(CHUNK, len(data), CHUNK), "right").tolist() + [0, len(ends)])
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        at = _places(lengths[i:j])
        out[done : done + len(at)] = string_keys(data[ends[i] - lengths[i] : ends[j - 1]])[at]
        done += len(at)
    return out


def _answers(data: np.ndarray, place: np.ndarray, key: np.ndarray, first_key: np.ndarray, cuts: np.ndarray, held=()) -> tuple[np.ndarray, np.ndarray]:
    """For each string: -1 if a held level or an earlier scan has it, else the least ``first_key`` of its scan; and which strings are new to the family.

    ``held`` are the (keys, places) of levels from earlier calls.
    """
    windows = np.lib.stride_tricks.sliding_window_view(data, MATCH)

    def differ(a, b):
        return any((windows[a[i : i + 65536]] != windows[b[i : i + 65536]]).any() for i in range(0, len(a), 65536))

    family, out, fresh = SuffixLevels(differ), np.empty(len(place), np.int64), np.zeros(len(place), bool)
    family.levels += held
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        suffixes = np.argsort(key[a:z], kind="stable")
        ordered, at = key[a:z][suffixes], place[a:z][suffixes]
        new = np.ones(z - a, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        edge = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        twice = np.flatnonzero(~new)
        if differ(at[twice], at[edge[group[twice]]]):
            raise _Deceived
        first = np.minimum.reduceat(first_key[a:z][suffixes], edge)
        known = family.scan(ordered[edge], at[edge])
        family.add(ordered[edge][~known], at[edge][~known])
        fresh[a + suffixes[edge[~known]]] = True
        first[known] = -1
        out[a:z][suffixes] = first[group]
    return out, fresh


def _texts(rows: pd.DataFrame, column: str = "payload") -> tuple[np.ndarray, list[np.ndarray]]:
    """The neighbourhoods of some rows end to end, and the lengths of each row's."""
    return np.frombuffer(b"".join(zlib.decompress(x) for x in rows[column]), np.uint8), [np.frombuffer(x, np.uint8).astype(np.int64) for x in rows["lengths"]]


LEVEL = "shard int, strings bigint, lengths binary, payload binary, keys binary, places binary"


def _packed(shard: int, lengths: np.ndarray, data: np.ndarray, keys: np.ndarray, places: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "strings": [len(keys)], "lengths": [lengths.astype(np.uint8).tobytes()], "payload": [zlib.compress(data.tobytes(), 1)], "keys": [keys.tobytes()], "places": [zlib.compress(places.astype(np.int64).tobytes(), 1)]})


def _unpacked(rows: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lengths, data, keys, places) of each level, the largest first."""
    out = []
    for _, r in rows.sort_values("strings", ascending=False, kind="stable").iterrows():
        out.append((np.frombuffer(r["lengths"], np.uint8).astype(np.int64), np.frombuffer(zlib.decompress(r["payload"]), np.uint8), np.frombuffer(r["keys"], np.uint64), np.frombuffer(zlib.decompress(r["places"]), np.int64)))
    return out


def _merge_levels(rows: pd.DataFrame) -> pd.DataFrame:
    """One level of a shard's levels, whose strings are distinct."""
    levels = _unpacked(rows)
    lengths, data, keys, places = levels[0]
    for more, text, b, y in levels[1:]:
        keys, places = merged(keys, places, b, y + len(data))
        lengths, data = np.concatenate([lengths, more]), np.concatenate([data, text])
    return _packed(int(rows["shard"].iloc[0]), lengths, data, keys, places)


def _part(whole: np.ndarray, place: np.ndarray, key: np.ndarray, first_key: np.ndarray, cuts: np.ndarray, held: list, new_level: bool) -> tuple[np.ndarray, np.ndarray]:
    """``_answers``; where a fingerprint deceives, in the order of the bytes."""
    try:
        return _answers(whole, place, key, first_key, cuts, held)
    except _Deceived:
        if new_level:
            raise RuntimeError("two strings of the index have one fingerprint") from None
    # What the levels hold takes part.
    windows = np.lib.stride_tricks.sliding_window_view(whole, MATCH)
    every = np.concatenate([place, *(p for _, p in held)])
    exact = np.unique(np.ascontiguousarray(windows[every]).view(f"S{MATCH}").reshape(-1), return_inverse=True)[1].reshape(-1).astype(np.uint64)
    parts = np.split(exact, np.cumsum([len(place), *(len(p) for _, p in held)])[:-1])
    ordered = [(np.sort(k), p[np.argsort(k, kind="stable")]) for k, (_, p) in zip(parts[1:], held)]
    return _answers(whole, place, parts[0], first_key, cuts, ordered)


def _index(new_level: bool):
    """Merge-scan the batches of a shard in order, and after the levels of earlier calls; answer for each string.

    0: an earlier batch or a level has it. Else 1 + the rank of the first
    document of its own batch that has it. With ``new_level`` the result is the
    level of the strings that the family did not have.
    """

    def run(rows: pd.DataFrame, levels: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[f.split()[0] for f in (LEVEL if new_level else SPANS).split(", ")])
        rows = rows.sort_values(["slot", "batch"]).reset_index(drop=True)
        data, lengths = _texts(rows)
        count = np.array([int(x.sum()) - (MATCH - 1) * len(x) for x in lengths])
        many = np.array([len(x) for x in lengths])
        all_lengths = np.concatenate(lengths)
        key = _all_keys(data, all_lengths)
        of = np.repeat(np.arange(len(all_lengths), dtype=np.int32), all_lengths - MATCH + 1)
        rank = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["first_rank"]]).astype(np.int64)
        span_key = (np.repeat(rows["slot"].to_numpy(np.int64), many) << 32) | rank
        # Scans end where an id range does: batches of one id arrive together.
        cuts, share, slot = [0], count.sum() / SCANS, rows["slot"].tolist()
        for k, upto in enumerate(np.cumsum(count).tolist()):
            if upto == len(key) or (upto - cuts[-1] >= share and slot[k + 1] != slot[k]):
                cuts.append(upto)
        held, text, at = [], [data], len(data)
        for _, old, keys, places in _unpacked(levels) if levels is not None and len(levels) else ():
            held.append((keys, places + at))
            text.append(old)
            at += len(old)
        whole = np.concatenate(text) if len(text) > 1 else data
        answer, fresh = np.zeros(len(key), np.uint32), np.zeros(len(key), bool)
        # Equal strings have one fingerprint, so its ranges are answered one after another.
        parts = max(1, math.ceil(len(key) / PART))
        bounds = [(i << 64) // parts for i in range(parts + 1)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            pick = np.flatnonzero((key >= np.uint64(lo)) & (key <= np.uint64(hi - 1)))
            if not len(pick):
                continue
            place, first_key = pick + (MATCH - 1) * of[pick].astype(np.int64), span_key[of[pick]]
            scans = np.unique(np.searchsorted(pick, cuts))
            mine = [(k[a:z], p[a:z]) for k, p in held if (a := np.searchsorted(k, np.uint64(lo))) < (z := np.searchsorted(k, np.uint64(hi - 1), "right"))]
            first, fresh[pick] = _part(whole, place, key[pick], first_key, scans, mine, new_level)
            answer[pick] = np.where((first >= 0) & (first >> 32 == first_key >> 32), (first & 0xFFFFFFFF) + 1, 0)
        if new_level:
            # The neighbourhoods that hold a new string, and the new strings in order.
            stay = np.zeros(len(all_lengths), bool)
            stay[of[fresh]] = True
            begin = np.cumsum(all_lengths) - all_lengths
            moved = np.cumsum(np.where(stay, all_lengths, 0)) - np.where(stay, all_lengths, 0)
            kept = data[np.repeat(stay, all_lengths)]
            new = np.flatnonzero(fresh)
            places = new + (MATCH - 1) * of[new].astype(np.int64) - begin[of[new]] + moved[of[new]]
            keys = key[new]
            order = np.argsort(keys, kind="stable")
            return _packed(int(rows["shard"].iloc[0]), all_lengths[stay], kept, keys[order], places[order])
        answers = [zlib.compress(x.tobytes(), 1) for x in np.split(answer, np.cumsum(count)[:-1])]
        return pd.DataFrame({"kind": "hit", "shard": rows["shard"], "batch": rows["batch"], "slot": rows["slot"], "lengths": b"", "first_rank": b"", "payload": answers})

    return run


DONE = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _remove(with_kept: bool):
    def run(docs: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        batch = _Batch(docs)
        begin = np.cumsum(batch.length) - batch.length
        hit = np.zeros(int(batch.length.sum()), bool)
        answers = {s: p for k, s, p in zip(facts["kind"], facts["shard"], facts["payload"]) if k == "hit"}
        for kind, s, n, payload in zip(facts["kind"], facts["shard"], facts["lengths"], facts["payload"]):
            if kind != "seen":
                continue
            n = np.frombuffer(n, np.uint8).astype(np.int64) - MATCH + 1
            answer = np.frombuffer(zlib.decompress(answers[s]), np.uint32).astype(np.int64)
            span, row, at = np.frombuffer(zlib.decompress(payload), np.uint32).reshape(3, -1).astype(np.int64)
            many = n[span]
            of = np.repeat(np.arange(len(span)), many)
            step = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            got = answer[(np.cumsum(n) - n)[span[of]] + step]
            gone = (got == 0) | (got - 1 < batch.rank[row[of]])
            hit[(begin[row] + at)[of[gone]] + step[gone]] = True
        hits = np.flatnonzero(hit)
        doc = np.searchsorted(begin + batch.length, hits, "right")
        new = np.ones(len(hits), bool)
        new[1:] = (hits[1:] - hits[:-1] > MATCH) | (doc[1:] != doc[:-1])
        first, last = hits[new], hits[np.concatenate([new[1:], [True]])] + MATCH if len(hits) else hits
        of = doc[new]
        cuts = np.searchsorted(of, np.arange(len(batch.texts) + 1))
        out = []
        for i, (doc_id, text) in enumerate(zip(batch.docs["doc_id"], batch.texts)):
            a, z = cuts[i], cuts[i + 1]
            kept = text
            if a < z:
                lo, hi = (first[a:z] - begin[i]).tolist(), (last[a:z] - begin[i]).tolist()
                kept = b"".join(text[x:y] for x, y in zip([0, *hi], [*lo, len(text)]))
            out.append((doc_id, len(text), len(text) - len(kept), z - a, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        return frame.astype({"doc_id": "Int64"})

    return run


def _slot_of(bounds: list[int]):
    """The number of the id range, of those that start at ``bounds``; null ids are in one after all others."""
    held = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def slot(ids: pd.Series) -> pd.Series:
        out = np.full(len(ids), len(held), np.int32)
        known = ids.notna().to_numpy()
        out[known] = np.searchsorted(held, ids[known].astype(np.int64), "right") - 1
        return pd.Series(out)

    return slot


def batched(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, data, slot, batch) of each row, and the bytes of all.

    Slots are ranges of ids in order. Ranges of more than ``batch_bytes`` are
    cut again until they fit or hold one id; neighbours that fit together are
    one. A slot of one id that is still too large has several batches. The
    driver sees a number for each range of about a batch.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().cast("binary").alias("data"), F.monotonically_increasing_id().alias("row"))
    sizes = cut(rows.select("doc_id", F.length("data").cast("bigint").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")), "sizes")
    low, high, total = sizes.agg(F.min("doc_id"), F.max("doc_id"), F.sum("n")).first()
    total, bounds = total or 0, []
    batch_bytes = max(batch_bytes, total // MAX_BATCHES)
    if low is not None:
        fan = min(high - low + 1, FAN * max(1, math.ceil(total / batch_bytes / FAN)))
        bounds = sorted({low + (high - low + 1) * i // fan for i in range(fan)})
    while True:
        sums = dict(sizes.groupBy(_slot_of(bounds)("doc_id").alias("slot")).agg(F.sum("n")).collect())
        more = []
        for i, lo in enumerate(bounds):
            hi = bounds[i + 1] if i + 1 < len(bounds) else high + 1
            if (sums.get(i) or 0) > batch_bytes and hi - lo > 1:
                fan = min(FAN, hi - lo)
                more += [lo + (hi - lo) * k // fan for k in range(1, fan)]
        if not more:
            break
        # Ranges that are empty beside others are not kept apart.
        bounds = sorted({*(lo for i, lo in enumerate(bounds) if i == 0 or sums.get(i) or sums.get(i - 1)), *more})
    starts, size, crowded = [], 0, []
    for i, lo in enumerate(bounds):
        n = sums.get(i) or 0
        if not starts or size + n > batch_bytes:
            starts.append(lo)
            crowded.append(0)
            size = 0
        size += n
        crowded[-1] = size
    crowded.append(sums.get(len(bounds)) or 0)
    parts = [max(1, math.ceil(n / batch_bytes)) for n in crowded]
    first = np.cumsum([0, *parts]).tolist()
    rows = rows.withColumn("slot", _slot_of(starts)("doc_id"))
    table = docs.sparkSession.createDataFrame([(i, first[i], parts[i]) for i in range(len(parts))], "slot int, first int, parts int")
    rows = rows.join(F.broadcast(table) if len(parts) <= 1 << 20 else table, "slot")
    # Rows of a slot of one id are alike to the index: any deal will do that each look repeats.
    own = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(0)
    return rows.select("doc_id", "data", "slot", (F.col("first") + own).cast("int").alias("batch")), total


class RepeatIndex:
    """The family of levels in a folder on shared storage."""

    def __init__(self, spark, path: str, shards: int | None = None):
        """Open the index at ``path``; a new one has ``shards`` shards for good."""
        self.spark, self.path = spark, path.rstrip("/")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/family")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            newest = max(spark.read.json(f"{self.path}/family").collect(), key=lambda r: r["turn"])
            self.turn, self.shards, self.levels = newest["turn"], newest["shards"], [(x["name"], x["strings"]) for x in json.loads(newest["levels"])]
        else:
            self.turn, self.shards, self.levels = 0, shards or 64, []

    def table(self) -> DataFrame:
        """All levels, a row for each and shard."""
        out = self.spark.createDataFrame([], LEVEL)
        for name, _ in self.levels:
            out = out.unionByName(self.spark.read.schema(LEVEL).parquet(f"{self.path}/{name}"))
        return out

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        name = f"level-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name, self.spark.read.schema(LEVEL).parquet(f"{self.path}/{name}").agg(F.coalesce(F.sum("strings"), F.lit(0))).first()[0]

    def add(self, level: DataFrame) -> None:
        """Write a new level; while the last two are of like size, merge them. Then the family is what it is from now on."""
        old = [name for name, _ in self.levels]
        fresh = self._write(level)
        self.levels += [fresh] if fresh[1] else []
        while len(self.levels) > 1 and self.levels[-2][1] < 2 * self.levels[-1][1]:
            two = [self.spark.read.schema(LEVEL).parquet(f"{self.path}/{name}") for name, _ in self.levels[-2:]]
            one = self._write(two[0].unionByName(two[1]).groupBy("shard").applyInPandas(_merge_levels, LEVEL))
            gone = [name for name, _ in self.levels[-2:] if name not in old]
            self.levels[-2:] = [one]
            for name in gone:
                delete(self.spark, f"{self.path}/{name}")
        self.turn += 1
        state = [(self.turn, self.shards, json.dumps([{"name": n, "strings": k} for n, k in self.levels]))]
        self.spark.createDataFrame(state, "turn long, shards long, levels string").coalesce(1).write.mode("append").json(f"{self.path}/family")
        live = {name for name, _ in self.levels}
        for name in old:
            if name not in live:
                delete(self.spark, f"{self.path}/{name}")


def _alone(run):
    """``run`` over a group."""
    return lambda rows: trimmed(run(rows))


def _paired(run):
    """``run`` over a group of each of two tables."""
    return lambda rows, others: trimmed(run(rows, others))


def remove_repeats(docs: DataFrame, with_kept: bool = True, batch_bytes: int = BATCH_BYTES, shard_bytes: int = SHARD_BYTES, index: RepeatIndex | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) for each row of ``docs``.

    With an ``index`` also what documents of earlier calls hold is removed,
    and ``docs`` are in it for later ones.
    """
    spark = docs.sparkSession
    rows, total = batched(docs, batch_bytes)
    shards = index.shards if index is not None else max(1, math.ceil(total / shard_bytes))
    hash_shards = max(1, math.ceil(total / (4 * shard_bytes)))
    if index is None:
        said = rows.groupBy("batch").applyInPandas(_alone(_announce(hash_shards)), HASHES)
        flags = cut(said.groupBy("shard").applyInPandas(_alone(_shared), HASHES), "shared")
        release_shuffles(spark)
        near = rows.groupBy("batch").cogroup(flags.groupBy("batch")).applyInPandas(_paired(_neighbourhoods(shards, hash_shards)), SPANS)
    else:
        near = rows.groupBy("batch").applyInPandas(_alone(_neighbourhoods(shards, hash_shards)), SPANS)
    spans, seen = cut_by(near, "spans", "kind", ["span", "seen"])
    if index is None:
        drop_cut(flags)
    release_shuffles(spark)
    if index is None:
        hits = cut(spans.groupBy("shard").applyInPandas(_alone(_index(False)), SPANS), "hits")
    else:
        known = index.table()
        hits = cut(spans.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(_paired(_index(False)), SPANS), "hits")
        index.add(spans.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(_paired(_index(True)), LEVEL))
    drop_cut(spans)
    release_shuffles(spark)
    facts = seen.withColumn("kind", F.lit("seen")).unionByName(hits)
    return rows.groupBy("batch").cogroup(facts.groupBy("batch")).applyInPandas(_paired(_remove(with_kept)), DONE)
