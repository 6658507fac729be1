import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codelattice.llm import suffix_dedup as op


def brute(rows, m=op.MATCH):
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - m + 1):
            g = b[p : p + m]
            if g not in first or order(i) < first[g]:
                first[g] = order(i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - m + 1):
            if first[b[p : p + m]] < order(i):
                cover[p : p + m] = b"\1" * m
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((i, len(b), sum(cover), sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randrange(12, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(1, rng.choice(shared)[rng.randrange(9) :])
        rows.append((i * 7, "\n".join(parts)))
    rows += [(5000 + i, rows[3][1]) for i in range(5)] + [(6000, "ab" * 400), (6001, "ab" * 300), (6002, "z" * 49), (6003, "z" * 50), (6004, "z" * 51), (6005, None), (6006, ""), (6003, "z" * 50), (None, "z" * 60), (None, "q" * 80), (6007, "\0" * 120), (6008, "\0" * 70)]
    return rows


@pytest.mark.parametrize("sizes", [(op.BATCH_BYTES, op.SHARD_BYTES), (4000, 2000)])
def test_against_brute_force(spark, sizes):
    rows = corpus()
    got = op.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), batch_bytes=sizes[0], shard_bytes=sizes[1]).collect()
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got], key=str) == brute(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_deceiving_fingerprints_are_noticed(spark, monkeypatch):
    real = op.string_keys
    monkeypatch.setattr(op, "string_keys", lambda data: real(data) % np.uint64(5))
    texts = [b"".join(bytes([97 + (i * j) % 7]) for j in range(90)) for i in range(3)]
    data = np.frombuffer(b"".join(t for t in texts), np.uint8)
    place = op._places(np.array([90, 90, 90]))
    with pytest.raises(op._Deceived):
        op._answers(data, place, op.string_keys(data)[place], np.zeros(len(place), np.int64), np.array([0, len(place)]))


def test_levels_grow_geometrically():
    family = op.SuffixLevels(lambda a, b: False)
    for i in range(64):
        keys = np.arange(i * 10, i * 10 + 10).astype(np.uint64)
        assert not family.scan(keys, np.arange(10)).any()
        family.add(keys, np.arange(10))
    assert len(family.levels) <= 7 and family.scan(np.array([5], np.uint64), np.array([0])).all()


def test_empty_and_clashing_columns(spark):
    assert op.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    odd = spark.createDataFrame([(1, "x" * 60, 3, 4), (2, "x" * 60, 3, 4)], "doc_id bigint, text string, batch int, slot int")
    assert {(r["doc_id"], r["n_removed"]) for r in op.remove_repeats(odd).collect()} == {(1, 0), (2, 60)}


def facts(rows):
    return sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows], key=str)


def test_batches_are_bounded_however_ids_are_spread(spark):
    rng = random.Random(3)
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(30))
    copies = [text() for _ in range(5)]
    rows = [(i, rng.choice(copies) if rng.random() < 0.3 else text()) for i in range(200)] + [(1 << 62, copies[0]), (-(1 << 61), text())]
    rows += [(None, rng.choice([text(), copies[1], "same"])) for _ in range(120)] + [(77, rng.choice([text(), copies[2]])) for _ in range(90)]
    docs, limit = spark.createDataFrame(rows, "doc_id bigint, text string"), 3000
    dealt, total = op.batched(docs, limit)
    size = {r["batch"]: (r["n"], r["slots"]) for r in dealt.groupBy("batch").agg(F.sum(F.length("data")).alias("n"), F.countDistinct("slot").alias("slots")).collect()}
    assert total == sum(len(t) for _, t in rows) == sum(n for n, _ in size.values())
    assert max(n for n, _ in size.values()) <= 2.5 * limit and all(s == 1 for _, s in size.values())
    order = dealt.filter("doc_id is not null").groupBy("slot").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).orderBy("slot").collect()
    assert all(x["z"] < y["a"] for x, y in zip(order, order[1:]))
    assert facts(op.remove_repeats(docs, batch_bytes=limit, shard_bytes=2000).collect()) == brute(rows)


def test_a_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 500)
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    rows = [(1, long), (2, long[430:640]), (3, long[970:1060] + "x" + long[2000:5100]), (4, "y" * 700), (5, "y" * 1200)]
    assert facts(op.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == brute(rows)


def test_merging_keeps_order_and_places():
    rng = np.random.default_rng(1)
    a, b = np.sort(rng.integers(0, 10**6, 300)).astype(np.uint64), np.sort(rng.integers(0, 10**6, 50)).astype(np.uint64)
    keys, places = op.merged(a, np.arange(300), b, np.arange(1000, 1050))
    both = dict(zip(range(300), a.tolist())) | dict(zip(range(1000, 1050), b.tolist()))
    assert keys.tolist() == sorted(a.tolist() + b.tolist()) and [both[p] for p in places.tolist()] == keys.tolist() and len(set(places.tolist())) == 350


def test_later_batches_meet_the_stored_levels(spark, tmp_path):
    """Calls against one index remove what one call over all would, with earlier calls' documents first."""
    rows = [(i, t) for i, t in corpus(2, 90) if i is not None]
    rng = random.Random(5)
    rng.shuffle(rows)
    calls = [rows[:50], rows[50:60], rows[60:70], rows[70:75], rows[75:]]
    number = {id(r): k * 10**6 + r[0] for k, call in enumerate(calls) for r in call}
    want = brute([(number[id(r)], r[1]) for call in calls for r in call])
    got, levels = [], []
    for k, call in enumerate(calls):
        index = op.RepeatIndex(spark, str(tmp_path / "index"), shards=3)
        held = {n for n, _ in index.levels}
        out = op.remove_repeats(spark.createDataFrame(call, "doc_id bigint, text string"), batch_bytes=4000, index=index).collect()
        got += [(r["doc_id"] + k * 10**6, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out]
        levels.append((held, index.levels))
    assert sorted(got, key=str) == want
    # Levels stay as they are until one of like size comes, and each is twice the next at least.
    assert any(held & {n for n, _ in now} for held, now in levels[1:])
    for _, now in levels:
        assert all(x[1] >= 2 * y[1] for x, y in zip(now, now[1:]))
    stored = op.RepeatIndex(spark, str(tmp_path / "index"))
    strings = {t[p : p + op.MATCH] for t in ((t or "").encode() for _, t in rows) for p in range(len(t) - op.MATCH + 1)}
    assert sum(n for _, n in stored.levels) == len(strings) and stored.turn == 5
    assert {p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("level")} == {n for n, _ in stored.levels}


def shard(batches):
    """Rows of one shard: all neighbourhoods of these batches' texts."""
    find, first, out = op._neighbourhoods(1, 1), 0, []
    for k, texts in enumerate(batches):
        docs = pd.DataFrame({"doc_id": range(first, first + len(texts)), "data": texts}).assign(slot=k, batch=k)
        rows = find(docs)
        out.append(rows[rows["kind"] == "span"])
        first += len(texts)
    return pd.concat(out, ignore_index=True)


def answers(rows, levels=None):
    out = op._index(False)(rows, levels)
    return [zlib.decompress(x) for x in out["payload"]]


def batches(n, size=2000):
    rng = random.Random(6)
    made = [[rng.randbytes(size) for _ in range(n)] for _ in range(4)]
    return [texts + rng.sample(made[0], n // 3) for texts in made]


def test_a_shard_needs_little_memory_beside_its_strings(monkeypatch):
    monkeypatch.setattr(op, "PART", 20_000, raising=False)
    monkeypatch.setattr(op, "CHUNK", 1 << 15)
    rows = shard(batches(30))
    strings = sum(int((np.frombuffer(x, np.uint8).astype(int) - op.MATCH + 1).sum()) for x in rows["lengths"])
    tracemalloc.start()
    op._index(False)(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert strings > 200_000 and peak < 80 * strings


def test_ranges_of_fingerprints_answer_as_one(monkeypatch):
    rows = shard(batches(9))
    old, new = rows[rows["batch"] < 2].reset_index(drop=True), rows[rows["batch"] >= 2].reset_index(drop=True)
    levels = op._index(True)(old)
    want, later = answers(rows), answers(new, levels)
    zeros = [sum(not x for x in np.frombuffer(a, np.uint32)) for a in want]
    assert zeros[0] == 0 and min(zeros[1:]) > 3000 and later == want[2:]
    monkeypatch.setattr(op, "PART", 3000)
    monkeypatch.setattr(op, "CHUNK", 1 << 13)
    again = op._index(True)(old)
    assert answers(rows) == want and answers(new, levels) == later and again.equals(levels)
    # What deceives is ordered by its bytes, in each range.
    real = op.string_keys
    monkeypatch.setattr(op, "string_keys", lambda data: real(data) >> np.uint64(56) << np.uint64(56))
    assert answers(rows) == want
