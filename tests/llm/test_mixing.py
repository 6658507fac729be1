import random
import re

import numpy as np
import pandas as pd
import pytest

from codelattice.llm import mixing as op


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def docs(spark, n=400, seed=1, sources=("a", "b", "c", None)):
    rng = random.Random(seed)
    return frame(spark, [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))), rng.choice(sources)) for i in range(n)])


def test_targets_stop_at_the_cap_and_share_the_rest():
    t = op.targets([10, 1000, 1000], [1, 1, 1], 2010)
    assert t[0] == 30 and t[1] == t[2] == 990 and abs(sum(t) - 2010) < 1e-9
    assert op.targets([0, 5], [1, 2], 5) == [0, 5]
    assert op.targets([], [], 0) == []


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    size, pi = rng.integers(1, 500, 1000), np.full(1000, 0.3)
    out = op._flight(size, pi, np.random.default_rng(1), 2)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs(size @ out - size @ pi) < 1e-3


def test_inclusion_is_fair():
    size, sums = np.arange(1, 11), np.zeros(10)
    for seed in range(600):
        sums += op._flight(size, np.full(10, 0.5), np.random.default_rng(seed), 2)
    assert abs(sums / 600 - 0.5).max() < 0.08


@pytest.mark.parametrize("block", [50_000, 30])
def test_totals_near_their_targets(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK_ROWS", block)
    monkeypatch.setattr(op, "FAN_IN", 3)
    rows = op.mix(docs(spark)).collect()
    assert len(rows) == 400
    by = {}
    for r in rows:
        taken, target, longest = by.get(r["source"], (0, r["target"], 0))
        by[r["source"]] = (taken + r["copies"] * r["size"], target, max(longest, r["size"]))
        assert 0 <= r["copies"] <= 3
    assert len(by) == 4 and all(abs(taken - target) <= max(1, 0.001 * target) for taken, target, longest in by.values())


def test_one_long_document_among_short_ones():
    """It is decided first, and the short ones make up for it."""
    rng = np.random.default_rng(3)
    size = np.concatenate([[20000], rng.integers(20, 200, 999)])
    ups = 0
    for seed in range(200):
        rows = pd.DataFrame({"row_id": range(1000), "doc_id": range(1000), "source_no": 0, "size": size, "base": 0, "pi": 0.5, "words": size.sum() / 2, "block": seed, "copies": -1})
        out = op._block(rows, True)
        assert abs((out["size"] * out["copies"]).sum() - size.sum() / 2) <= op.MISS * size.sum() / 2 + 1
        ups += int(out.loc[out["size"] == 20000, "copies"].iloc[0])
    assert 70 <= ups <= 130


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_every_source_near_its_target(spark, sf):
    """Sums of a brute-force count of words, against targets that were shared by hand."""
    path = f"/root/testdata/{sf}/documents.parquet"
    size = {r["doc_id"]: (len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"]) for r in spark.read.parquet(path).select("doc_id", "text", "source").collect()}
    whole, taken, goal = {}, {}, {}
    for n, source in size.values():
        whole[source] = whole.get(source, 0) + n
    for r in op.mix(spark.read.parquet(path)).collect():
        assert (r["size"], r["source"]) == size[r["doc_id"]] and r["source_size"] == whole[r["source"]] and 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        goal[r["source"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= 0.001 * goal[s] for s in whole)
    order = sorted(whole, key=lambda s: (s is None, s or ""))
    level = [goal[s] / (1 + i % 3) for i, s in enumerate(order) if goal[s] < 3 * whole[s] - 1e-6]
    assert max(level) - min(level) < 1e-6 * max(level)
    assert all(goal[s] <= 3 * whole[s] + 1e-6 for s in whole)


def test_repeated_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", 40)
    rows = [(None, "a b c", "x")] * 200 + [(i, "d " * (i % 9 + 1), "y") for i in range(200)]
    got = op.mix(frame(spark, rows)).collect()
    assert len(got) == 400
    for source in "xy":
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 4


def test_reruns_agree(spark):
    one, two = ({(r["doc_id"], r["copies"]) for r in op.mix(docs(spark).repartition(n)).collect()} for n in (1, 5))
    assert one == two


def test_take_repeats_rows(spark):
    d = docs(spark, 120)
    mixed = {r["doc_id"]: r["copies"] for r in op.mix(d).collect()}
    got = [r["doc_id"] for r in op.take(d, op.mix(d)).collect()]
    assert {i: got.count(i) for i in mixed} == mixed


def test_edge_rows(spark):
    assert op.mix(frame(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, None, "a", 1), (1, None, "a", 1), (2, "x " * 20000, None, 2), (None, "a b", "a", 3)], "doc_id bigint, text string, source string, size int")
    rows = op.mix(odd).collect()
    assert len(rows) == 4 and {r["size"] for r in rows} == {0, 20000, 2}
    assert op.take(odd, op.mix(odd)).columns == odd.columns
