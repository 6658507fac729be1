import hashlib
import random

import numpy as np
import pytest

from codelattice.llm import exact_dedup as op


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = {}
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        out[hashlib.sha256(t.encode()).hexdigest()] = (max(known) if known else None, len(ids))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_perfect_hash_is_minimal_and_perfect():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8)
    h = op.PerfectHash.build(digests)
    assert sorted(h.slots(digests).tolist()) == list(range(5000))
    strangers = np.frombuffer(hashlib.sha256(b"x").digest(), np.uint8)
    assert h.slots(strangers)[0] < 5000


def test_keys_that_never_settle_go_to_the_rest():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(50)), np.uint8)
    levels, op.MAX_LEVELS = op.MAX_LEVELS, 1
    try:
        h = op.PerfectHash.build(digests)
    finally:
        op.MAX_LEVELS = levels
    assert len(h.rest) and sorted(h.slots(digests).tolist()) == list(range(50))


@pytest.mark.parametrize("bucket", [50_000, 3])
def test_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(op, "BUCKET_KEYS", bucket)
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "a", "b" * 5000, f"t{rng.randrange(40)}", " a"])) for i in range(300)] + [(None, "a"), (None, "only null"), (7, "a"), (7, "a")]
    got = op.exact_dedup(frame(spark, rows[::2]), frame(spark, rows[1::2])).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert all((r["keep_id"], r["group_size"]) == want[r["text_sha256"]] for r in got)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(want)


def test_empty_and_clashing_columns(spark):
    empty = frame(spark, [])
    assert op.exact_dedup(empty, empty).count() == 0
    assert op.exact_dedup(empty, frame(spark, [(1, "x")])).first()["kept"]
    odd = spark.createDataFrame([(1, "x", 5, 6, "d")], "doc_id bigint, text string, n int, winner int, digest string")
    assert op.exact_dedup(odd, odd).filter("kept").count() == 1


BIG = (1 << 60) + 1


@pytest.mark.parametrize("old, new", [
    ([(None, "a"), (BIG, "a"), (BIG - 1, "a")], [(None, "b"), (None, "a")]),
    ([(None, "b")], [(None, "a"), (BIG, "a"), (BIG - 1, "a"), (None, "b")]),
    ([(None, "a")], [(BIG, "a"), (BIG + 2, "b"), (None, "b")]),
    ([], [(None, "a"), (BIG, "a"), (-BIG, "a")]),
    ([(-BIG, "a"), (None, "c")], [(None, "c")]),
])
def test_large_ids_beside_null_ids(spark, old, new):
    got = op.exact_dedup(frame(spark, old), frame(spark, new)).collect()
    want = brute(old + new)
    assert len(got) == len(old + new)
    assert all((r["keep_id"], r["group_size"]) == want[r["text_sha256"]] for r in got)
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted(want)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_an_index_that_is_saved_and_extended(spark, tmp_path, monkeypatch):
    """Three batches, each against the index that the one before left on disk; the last is far larger."""
    monkeypatch.setattr(op, "BUCKET_KEYS", 20)
    rng = random.Random(9)
    parts = [[(BIG + 10 * i + k, f"t{rng.randrange(300)}") for i in range(n)] + [(None, "t1")] for k, n in enumerate((30, 40, 400))]
    path, seen = str(tmp_path / "index"), []
    for k, rows in enumerate(parts):
        digests = op.digests_of(frame(spark, rows))
        if k == 0:
            op.save_index(op.index_of(digests), path)
            seen += rows
            continue
        groups = op.merge_batch(op.load_index(spark, path), digests).cache()
        known = {hashlib.sha256(t.encode()).hexdigest() for _, t in seen}
        assert {r["digest"].hex() for r in groups.filter("known").collect()} == known
        seen += rows
        want = brute(seen)
        got = op.decide(digests, groups).collect()
        assert len(got) == len(rows)
        assert all((r["keep_id"], r["group_size"]) == want[r["text_sha256"]] for r in got)
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
        stay = [r["text_sha256"] for r in got if r["kept"]]
        fresh = {i for i, _ in rows if i is not None}
        assert sorted(stay) == sorted(h for h, (i, _) in want.items() if i in fresh)
        path = str(tmp_path / f"index{k}")
        op.save_index(op.extend_index(groups), path)


def test_one_id_and_text_in_a_third_of_all_rows(spark):
    rows = [(5, "same")] * 400 + [(None, "same")] * 300 + [(i, f"t{i}") for i in range(100)]
    got = op.exact_dedup(frame(spark, rows[::3]), frame(spark, rows[1::3] + rows[2::3])).collect()
    assert len(got) == 800 and sum(r["kept"] for r in got) == 101
    assert {r["group_size"] for r in got if r["doc_id"] is None} == {700}
