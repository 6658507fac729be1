import hashlib
import random

import pytest

from codelattice.llm import sharding as op


def brute(rows, limit):
    keys = {}
    for i, t in rows:
        h = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
        keys.setdefault(h, []).append(len((t or "").encode()))
    out = {}

    def split(prefix, depth, mine):
        if sum(sum(keys[h]) for h in mine) <= limit or len(mine) == 1 or depth == 60:
            for h in mine:
                out[h] = format(prefix, f"0{depth}b") if depth else "-"
            return
        for bit in (0, 1):
            part = [h for h in mine if h >> (59 - depth) & 1 == bit]
            if part:
                split(prefix << 1 | bit, depth + 1, part)

    split(0, 0, list(keys))
    return out


@pytest.mark.parametrize("entries", [op.DIRECTORY_ENTRIES, 0])
@pytest.mark.parametrize("limit", [10**9, 4000, 300, 30])
def test_against_brute_force(spark, limit, entries):
    rng = random.Random(limit)
    rows = [(i, "x" * rng.choice([0, 5, 50, 200, 900])) for i in range(250)] + [(900, None), (None, "é" * 9)]
    got = op.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), limit, entries=entries).collect()
    want = brute(rows, limit)
    assert len(got) == len(rows)
    size = {}
    for r in got:
        h = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16)
        assert r["shard"] == want[h]
        size.setdefault(r["shard"], []).append(r["n_bytes"])
    assert all(sum(x) <= limit or len(x) == 1 for x in size.values())
    assert {r["shard"]: r["shard_bytes"] for r in got} == {k: sum(x) for k, x in size.items()}


def test_repeated_rows_overflow_to_pages(spark):
    rows = [(1, "x" * 40)] * 10 + [(2, "y")]
    got = op.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 100).collect()
    size = {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["n_bytes"]
    assert len(got) == 11 and max(size.values()) <= 100


def test_a_key_with_most_rows_and_a_very_long_text(spark):
    rows = [(None, "x" * (k % 40 + 1)) for k in range(600)] + [(1, "y" * 200_000), (2, None)] + [(i, "z" * 30) for i in range(3, 90)]
    got = op.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 100).collect()
    size = {}
    for r in got:
        size.setdefault(r["shard"], []).append(r["n_bytes"])
    assert len(got) == len(rows) and all(sum(x) <= 100 or len(x) == 1 for x in size.values())
    assert {r["shard"]: r["shard_bytes"] for r in got} == {k: sum(x) for k, x in size.items()}


def test_clashing_columns_and_empty(spark, tmp_path):
    odd = spark.createDataFrame([(1, "a", "s", 2, 3)], "doc_id bigint, text string, shard string, h int, entry int")
    out = op.shard_documents(odd)
    assert out.columns == ["doc_id", "text", "h", "entry", "shard", "depth", "n_bytes", "shard_bytes"] and out.first()["shard"] == "-"
    assert op.shard_documents(odd.limit(0)).count() == 0
    op.write_shards(op.shard_documents(spark.createDataFrame([(i, "x" * 50) for i in range(40)], "doc_id bigint, text string"), 200), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 40
