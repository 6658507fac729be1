"""Operators against plain Python on small graphs."""

import itertools
import random
import time
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codelattice.functions import names
from codelattice.operators import graphs, knowledge, reports, resolve, scc, traverse
from codelattice.operators.durable import durable
from codelattice.options import Architecture, DeadCode, Resolution, depth, to_bool
from codelattice.plans import documents, queries
from codelattice.plans.index import CodeIndex
from codelattice.sinks import export
from codelattice.sources import extract, files, gitlog
from codelattice.streaming import refresh


def graph(spark, seed, n=14, m=24):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)} - {(i, i) for i in range(n)})
    symbols = spark.createDataFrame([(i, i, f"f{i}", f"f{i}", f"p{i % 3}/m{i % 5}.lua", f"p{i % 3}.m{i % 5}", f"p{i % 3}") for i in range(n)], "symbol_id bigint, sym_ord bigint, name string, short_name string, relpath string, module_id string, package_id string")
    return symbols, spark.createDataFrame(pairs, "src bigint, dst bigint"), pairs, n


def reach_of(pairs, n):
    after = defaultdict(set)
    for a, b in pairs:
        after[a].add(b)
    out = {}
    for s in range(n):
        seen, todo = set(), [s]
        while todo:
            for y in after[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out[s] = seen
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_both_ways(spark, seed):
    symbols, edges, pairs, n = graph(spark, seed)
    reach = reach_of(pairs, n)
    want = {i: min([j for j in range(n) if j in reach[i] and i in reach[j]] + [i]) for i in range(n)}
    for bound in (10**6, 0):
        assert {r[0]: r[1] for r in scc.strong_components(symbols, edges, bound).collect()} == want


def test_incoming_is_transposed(spark):
    _, edges, pairs, _ = graph(spark, 3)
    assert {(r[1], r[0]) for r in graphs.transpose(edges).collect()} == set(pairs)


def test_subgraph_multiset(spark):
    symbols, edges, pairs, _ = graph(spark, 4)
    root = pairs[0][0]
    level, met = {root}, defaultdict(set)
    for d in range(4):
        for x in level:
            met[x].add(d)
        level = {b for a, b in pairs if a in level}
    want = {(a, b): sum(d < 3 for d in met[a]) for a, b in pairs if any(d < 3 for d in met[a])}
    nodes, inner = traverse.subgraph(symbols, edges, root, 3)
    assert {(r["src"], r["dst"]): r["multiplicity"] for r in inner.collect()} == want
    assert {r["symbol_id"]: r["depth"] for r in nodes.collect()} == {x: min(d) for x, d in met.items() if d}


def test_callers_include_the_root_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "src bigint, dst bigint")
    assert {r[0]: r[1] for r in traverse.callers(edges, 1).collect()} == {3: 1, 9: 1, 2: 2, 1: 3}


def test_reach_is_monotone(spark):
    symbols, edges, _, _ = graph(spark, 5)
    at = [{r[0]: r[1] for r in traverse.reach_counts(symbols, edges, d).collect()} for d in (1, 3)]
    assert all(at[0][k] <= at[1][k] for k in at[0])


def test_hot_chain_stops_and_skips_visited(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (3, 4)], "src bigint, dst bigint")
    scores = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 7.0)], "symbol_id bigint, score double")
    got = traverse.hot_chains(edges, scores, spark.createDataFrame([(1,), (3,)], "root bigint"), 5).orderBy("root", "pos").collect()
    assert [(r["root"], r["symbol_id"], r["score"]) for r in got] == [(1, 1, 5.0), (1, 2, 9.0), (3, 3, 7.0), (3, 4, None)]


@pytest.mark.parametrize("text,want", [("f", ("function", None, "f")), ("a.b", ("member", "a", "b")), ("a::b.c", ("member", "a", "b")), ("x?.y", ("member", "x", "y")), ("s:go!", ("member", "s", "go")), ("a.b:c", ("member", "a.b", "c")), ("  a .  b ", ("member", "a ", " b"))])
def test_call_parse(spark, text, want):
    cols = names.parse_call(F.lit(text))
    row = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    assert (row["kind"], row["receiver"], row["call_name"]) == want


def test_names_match(spark):
    cases = {("f", "f"): True, ("f", "M.f"): True, ("f", "M:f"): True, ("M.f", "f"): True, ("f", "gf"): False, ("a_b", "axb"): False}
    for (a, b), want in cases.items():
        assert spark.range(1).select(names.names_match(F.lit(a), F.lit(b))).first()[0] is want


def test_paths_fold(spark):
    cases = {"a/./b": "a/b", "a/../b": "b", "./x/../../y": "../y", "a//b": "a/b"}
    for path, want in cases.items():
        assert spark.range(1).select(names.fold_path(F.lit(path))).first()[0] == want


def test_test_paths_need_a_slash(spark):
    flag = lambda rel, name="f": spark.range(1).select(names.is_test(F.lit(rel), F.lit(name))).first()[0]
    assert not flag("tests/x.lua") and flag("a/tests/x.lua") and flag("inspect.lua") and flag("a_test.go") and flag("x.lua", "testFoo")


def test_dead_code_options(spark):
    symbols, edges, _, _ = graph(spark, 6)
    both = graphs.dead_code(symbols, edges, DeadCode(ignore_prefixes=("p0/",)))
    assert all(not r["relpath"].startswith("p0/") for r in both.collect())


def test_suffix_candidates(spark):
    symbols = spark.createDataFrame([("a", 1, "A.b.c", "b.c", "A", "x.lua"), ("s", 2, "s", "s", None, "y.lua")], "symbol_id string, sym_ord bigint, name string, short_name string, container string, relpath string")
    calls = spark.createDataFrame([("s", 0, "c"), ("s", 1, "q.c"), ("s", 2, "c")], "src string, call_ord int, raw string")
    sites = resolve.call_sites(calls)
    assert sites.count() == 2
    got = resolve.candidates(symbols, sites, spark.createDataFrame([], "symbol_id string, var string, type string"))
    assert {(r["call_ord"], r["score"], r["reasons"][0]) for r in got.collect()} == {(0, 70, "suffix"), (1, 85, "suffix")}


def test_log_parse(spark):
    lines = ["@@@h1\t2024-01-02\tann\tfix: a\tb", "3\t1\tsrc/a.lua", "-\t-\timg.png", "", "@@@h2\t2024-01-01\tbob\tnone"]
    commits, files = gitlog.parse_log(spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string"))
    got = {r["hash"]: (r["subject"], r["files_count"], r["insertions"], r["deletions"]) for r in commits.collect()}
    assert got == {"h1": ("fix: a\tb", 2, 3, 1), "h2": ("none", 0, 0, 0)}
    assert {(r["path"], r["added"]) for r in files.collect()} == {("src/a.lua", 3), ("img.png", 0)}


def test_rules():
    rules = Architecture(rules={"domain": {"interface": True, "shared": False}}).allowed()
    assert rules["domain"] == {"domain", "interface"} and rules["test"] == {"*"}
    assert Architecture(rules={"a": {"b": True}}, rules_mode="replace").allowed() == {"a": {"b"}}


def test_options():
    assert to_bool("yes") and not to_bool("off", True) and to_bool("x", True) and depth("2.7") == 2 and depth(-3) == 0


def test_poll_sees_new_edited_and_removed_files(spark, tmp_path):
    src, state, seen = tmp_path / "src", str(tmp_path / "state"), []
    src.mkdir()
    look = lambda: refresh.poll(spark, str(src), state, lambda df, gone, n: seen.append((n, sorted((r["relpath"], r["content"]) for r in df.collect()), sorted(r[0] for r in gone.collect()))))
    (src / "a.lua").write_text("x")
    (src / "b.txt").write_text("y")
    assert look() and not look() and seen == [(0, [("a.lua", "x")], [])]
    (src / "a.lua").write_text("edited")
    (src / "c.py").write_text("z")
    assert look() and seen[-1] == (1, [("a.lua", "edited"), ("c.py", "z")], [])
    (src / "c.py").unlink()
    assert look() and seen[-1] == (2, [], ["c.py"]) and not look()
    old = spark.createDataFrame([("a.lua", "1"), ("c.lua", "2"), ("d.lua", "3")], "relpath string, content string")
    fresh, gone = spark.createDataFrame([("a.lua", "9")], "relpath string, content string"), spark.createDataFrame([("d.lua",)], "relpath string")
    assert {tuple(r) for r in refresh.changed(old, fresh, gone).collect()} == {("a.lua", "9"), ("c.lua", "2")}


def test_watch_rebuilds_the_index_when_a_file_is_edited(spark, tmp_path):
    src, names_seen = tmp_path / "src", []
    src.mkdir()
    (src / "a.lua").write_text("function one() end\n")
    index = CodeIndex.build(spark, str(src))
    query = index.watch(spark, str(tmp_path / "cp"), lambda i: names_seen.append(sorted(r["name"] for r in i.symbols.collect())), every="1 second")
    try:
        for text, want in (("function one() end\n", ["one"]), ("function one() end\nfunction two() end\n", ["one", "two"])):
            (src / "a.lua").write_text(text)
            until = time.time() + 60
            while want not in names_seen and time.time() < until and query.isActive:
                time.sleep(0.5)
            assert want in names_seen, query.exception()
    finally:
        query.stop()


def test_scan_opens_no_other_files(spark, tmp_path):
    (tmp_path / "a.lua").write_text("x")
    (tmp_path / "big.bin").write_bytes(b"0" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert [r["relpath"] for r in files.scan(spark, str(tmp_path)).collect()] == ["a.lua"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


@pytest.mark.parametrize("seed", range(3))
def test_likely_candidates_select_as_all_candidates_do(spark, seed):
    """Many definitions of few names, in few files and containers, and all kinds of receivers."""
    rng = random.Random(seed)
    boxes, paths = ["A", "B", "C", "self", None], ["p1", "p2", "p3"]
    rows = []
    for i in range(240):
        box, short = rng.choice(boxes), rng.choice(["f", "g", "<anonymous>"])
        rows.append((i, short if box is None else f"{box}.{short}", short, box, rng.choice(paths)))
    symbols = spark.createDataFrame(rows, "symbol_id int, name string, short_name string, container string, relpath string")
    calls = [(i, k, raw) for i in range(240) for k, raw in enumerate(rng.sample(["f", "g", "A.f", "B:g", "x.f", "this.g", "self:f", "y:g", "A::f", "<anonymous>", "q.A.f"], 4))]
    sites = resolve.call_sites(spark.createDataFrame(calls, "src int, call_ord int, raw string"))
    types = spark.createDataFrame([(i, v, rng.choice(["A", "B", "Z", "self", "cls"])) for i in range(0, 240, 2) for v in ("x", "self")], "symbol_id int, var string, type string")
    for options in (Resolution(), Resolution(max_targets=1), Resolution(max_targets=6, score_window=200, min_confidence="low")):
        pick = lambda c: {tuple(r) for r in resolve.targets(c, options).select("src", "call_ord", "target_ord", "cand_id", "score", "confidence").collect()}
        assert pick(resolve.likely_candidates(symbols, sites, types, options)) == pick(resolve.candidates(symbols, sites, types))


def test_a_long_cycle_in_the_distributed_way(spark):
    n = 10
    symbols = spark.range(n).withColumnRenamed("id", "symbol_id")
    edges = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src bigint, dst bigint")
    assert {r["scc_id"] for r in scc.strong_components(symbols, edges, one_task=0).collect()} == {0}


def test_colours_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(scc, "MAX_ROUNDS", 2)
    symbols = spark.range(30).withColumnRenamed("id", "symbol_id")
    edges = spark.createDataFrame([(i, (i + 1) % 30) for i in range(30)], "src bigint, dst bigint")
    with pytest.raises(RuntimeError):
        scc.strong_components(symbols, edges, one_task=0).collect()


def test_reach_in_blocks_of_roots(spark):
    _, edges, pairs, n = graph(spark, 3)
    after = defaultdict(set)
    for a, b in pairs:
        after[a].add(b)
    want = {}
    for s in after:
        front, seen = {s}, {s}
        for _ in range(3):
            front = {y for x in front for y in after[x]} - seen
            seen |= front
        want[s] = len(seen) - 1
    assert dict(traverse.counts_ahead(edges, 3, at_once=4).collect()) == want


def test_a_log_in_ranges(spark, monkeypatch):
    lines = []
    for c in range(30):
        lines.append(f"@@@h{c}\t2024-01-{c + 1:02d}\tme\tsubject\twith tab")
        lines += [f"{k}\t-\tf{k}.lua" for k in range(c % 7)]
    frame = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")
    rows = lambda: [sorted(map(tuple, t.collect())) for t in gitlog.parse_log(frame)]
    whole = rows()
    monkeypatch.setattr(gitlog, "RANGE", 4)
    assert rows() == whole and len(whole[0]) == 30 and len(whole[1]) == sum(c % 7 for c in range(30))


def test_call_hierarchy(spark):
    calls = spark.createDataFrame([("r", "a", "in/x", "in/r"), ("r", "b", "out/y", "in/r"), ("a", "c", "in/z", "in/x"), ("c", "a", "in/x", "in/z"), ("c", "d", "in/w", "in/z"), ("r", "a", "in/x", "in/r")], "src string, dst string, dst_path string, src_path string")
    inside = lambda p: p.startswith("in/")
    nodes, edges = traverse.call_hierarchy(calls, "r", 2, inside=inside)
    assert dict(nodes.collect()) == {"r": 0, "a": 1, "c": 2} and {tuple(r) for r in edges.collect()} == {("r", "a"), ("a", "c")}
    nodes, edges = traverse.call_hierarchy(calls, "r", 3, inside=inside, include_external=True)
    assert dict(nodes.collect()) == {"r": 0, "a": 1, "b": 1, "c": 2, "d": 3} and len(edges.collect()) == 5
    nodes, edges = traverse.call_hierarchy(calls, "a", 1, "incoming", inside)
    assert dict(nodes.collect()) == {"a": 0, "r": 1, "c": 1} and len(edges.collect()) == 2
    lines = documents.hierarchy(*traverse.call_hierarchy(calls, "r", 2, inside=inside), "r", {"r": "root"}, ascii_=True)
    assert lines[1] == "nodes: 3  edges: 2" and lines[3:] == ["root", "`- a", "   `- c"]


def test_python_with_a_broken_line():
    text = "class A:\n    def good(self):\n        return helper(1)\n\n    def bad(self:\n        pass\n\ndef last():\n    x = = 2\n    return other.call(\n        'é', 3)\n"
    got = {r["name"]: [c[0] for c in r["calls"]] for r in extract.extract("a.py", "python", text)}
    assert got["A.good"] == ["helper"] and got["last"] == ["other.call"]
    assert extract.extract("a.py", "python", ")))\n" * 3) == []


def test_script_fallback():
    text = "  export const go$2 = async (a) {\n  if (x) { y }\n}\nlet z = (1)\nconst w = 5\nvar q = (b) {\n"
    assert extract._fallback(text) == [("go$2", 0, 15, 2, 1), ("z", 3, 4, 6, 0), ("q", 5, 4, 6, 0)]


def test_documents_of_the_viewer_and_limits(spark, tmp_path):
    index = CodeIndex.build(spark, files=spark.createDataFrame([("a.lua", "lua", "function one()\n  two()\n  gone()\nend\nfunction two()\nend\n")], "relpath string, lang string, content string"))
    root = index.symbol_id("one")
    lines = documents.viewer(index, index.view(root, depth=2, search="o"), ascii_=True)
    assert "depth: 2" in lines and "nodes before filters: 2" in lines and lines[-2:] == ["one - a.lua", "`- two - a.lua"]
    assert documents.call_tree(index, root)[1] == "nodes: 2  edges: 1  unresolved: 1  polymorphic: 0"
    edges = spark.range(9).selectExpr("id as src", "id + 1 as dst")
    assert documents.dependency_tree(edges, limit=3)[0] == "Dependencies (first 3 of 9)"
    with pytest.raises(ValueError):
        export.write_report({"t": edges}, str(tmp_path / "x.json"), limit=5)


def test_symbol_at_prefers_the_innermost(spark):
    symbols = spark.createDataFrame([("out", 1, "a", 0, 0, 9, 3), ("in", 2, "a", 2, 2, 4, 5)], "symbol_id string, sym_ord int, relpath string, sr int, sc int, er int, ec int")
    points = spark.createDataFrame([("a", 3, 0), ("a", 8, 0), ("a", 9, 3)], "relpath string, row int, col int")
    assert {(r["row"], r["symbol_id"]) for r in graphs.symbol_at(symbols, points).collect()} == {(3, "in"), (8, "out")}


def test_tarjan_is_iterative():
    chain = [(i, i + 1) for i in range(20000)] + [(20000, 0)]
    assert [len(x) for x in scc.tarjan(chain)] == [20001]
    assert list(itertools.chain(*scc.tarjan([]))) == []


def test_the_least_id_of_a_component_is_found_once():
    class Id(int):
        met = 0

        def __lt__(self, other):
            Id.met += 1
            return int(self) < int(other)

    n = 500
    ids = [Id(i) for i in range(n)]
    out = scc._tarjan_group(pd.DataFrame({"src": ids, "dst": ids[1:] + ids[:1]}, dtype=object))
    assert set(out["scc_id"]) == {0} and len(out) == n
    # The search and the least id each compare a node a few times, not with all others for each of them.
    assert Id.met < 10 * n


def test_components_are_kept_for_scores_and_stats(spark):
    symbols, edges, _, _ = graph(spark, 7)
    for table in reports.complexity_scores(symbols, edges):
        assert "FlatMapGroupsInPandas" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_risk_scores_are_made_of_kept_tables(spark):
    symbols, edges, _, _ = graph(spark, 8)
    churn = spark.createDataFrame([("p0/m0.lua", 5, 1), ("p1/m1.lua", 9, 2)], "path string, churn bigint, touches bigint")
    plan = reports.risk_scores(symbols, edges, churn)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
    # The rows beside the greatest values; the churn of all symbols' files.
    assert sum(line.lstrip(" :+-").startswith("Join ") for line in plan.splitlines()) <= 3


def test_durable_tables_forget_the_estimate_of_their_plan(spark):
    """A table that is joined with itself in a loop; its estimate would double its digits each round."""
    t = durable(spark.range(40).select("id", ((F.col("id") * 7 + 3) % 40).alias("to")))
    least = t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    for _ in range(5):
        t = durable(t.join(t.toDF("to", "far"), "to").select("id", F.col("far").alias("to")))
        assert t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= least
    assert t.count() == 40 and t.schema.names == ["id", "to"]


def test_what_is_left_of_a_large_graph_goes_to_one_task(spark, monkeypatch):
    """A ring of 12 and, behind it, two of 3 and a pair: the first round settles the ring only."""
    rings, pairs, base = (12, 3, 3, 2), [], 0
    for n in rings:
        pairs += [(base + i, base + (i + 1) % n) for i in range(n)] + ([(base - 1, base)] if base else [])
        base += n
    want = {i: first for first, n in zip((0, 12, 15, 18), rings) for i in range(first, first + n)}
    sizes, done = [], scc._in_one_task
    monkeypatch.setattr(scc, "_in_one_task", lambda edges: sizes.append(edges.count()) or done(edges))
    symbols, edges = spark.range(base).withColumnRenamed("id", "symbol_id"), spark.createDataFrame([(b, a) for a, b in pairs] + [(a, a) for a in range(3)], "src bigint, dst bigint")
    assert {r[0]: r[1] for r in scc.strong_components(symbols, edges, 16).collect()} == want
    assert sizes and max(sizes) <= 16


@pytest.mark.parametrize("seed", range(1))
def test_likely_merged_selects_as_all_merged_candidates_do(spark, seed):
    """An outside source that raises some candidates, names the caller itself, and names what has no symbol."""
    rng = random.Random(seed)
    boxes, paths = ["A", "B", "self", None], ["p1", "p2", "p3"]
    rows = []
    for i in range(160):
        box, short = rng.choice(boxes), rng.choice(["f", "g", "<anonymous>"])
        rows.append((i, short if box is None else f"{box}.{short}", short, box, rng.choice(paths)))
    symbols = durable(spark.createDataFrame(rows, "symbol_id int, name string, short_name string, container string, relpath string"))
    calls = [(i, k, raw) for i in range(160) for k, raw in enumerate(rng.sample(["f", "g", "A.f", "B:g", "x.f", "this.g", "self:f", "y:g", "q.A.f"], 4))]
    sites = durable(resolve.call_sites(spark.createDataFrame(calls, "src int, call_ord int, raw string")))
    types = spark.createDataFrame([(i, "x", rng.choice(["A", "Z", "self"])) for i in range(0, 160, 2)], "symbol_id int, var string, type string")
    outside = spark.createDataFrame([(i, rng.choice(["f", "g", "A.f", " B.g", "q.A.f", "h"]), rng.choice([*paths, "vendor", None])) for i in range(0, 160, 3) for _ in range(2)], "src int, name string, path string")
    found = durable(resolve.external_candidates(symbols, outside))
    for options in (Resolution(), Resolution(max_targets=5, score_window=200, min_confidence="low")):
        pick = lambda c: sorted(map(str, resolve.targets(c, options).select("src", "call_ord", "target_ord", "cand_id", "cand_name", "cand_path", "source", "score", "confidence", "reasons").collect()))
        few = durable(resolve.likely_merged(symbols, sites, types, found, options))
        assert pick(few) == pick(resolve.merge_external(resolve.candidates(symbols, sites, types), found, sites))
        assert few.groupBy("src", "call_ord").count().filter(F.col("count") > 2 * options.max_targets).isEmpty()


def test_external_candidates_against_every_pair(spark):
    """Names that match in part, with blanks, and twice over, by the rule on each pair of a file."""
    symbols = spark.createDataFrame([(0, "A.f", "f", "A", "p"), (1, "f", "f", None, "p"), (2, "B:A.f", "A.f", "B", "p"), (3, "g  h", "h", None, "p"), (4, "f", "f", None, "q"), (5, "xf", "xf", None, "p")], "symbol_id int, name string, short_name string, container string, relpath string")
    asked = spark.createDataFrame([(0, n, p) for n in ("f", "A.f", "Z.A.f", "g h", "h", "", "f.", None) for p in ("p", "q", "v", None)], "src int, name string, path string")
    got = {(r["cand_id"], r["cand_path"], r["source"]) for r in resolve.external_candidates(symbols, asked).collect()}
    pairs = asked.join(symbols, asked["path"] == symbols["relpath"]).filter(names.names_match(asked["name"], symbols["name"]) | names.names_match(asked["name"], symbols["short_name"]))
    want = [(r["symbol_id"], r["path"]) for r in pairs.collect()]
    hits = [(r["cand_id"], r["cand_path"]) for r in resolve.external_candidates(symbols, asked).filter("cand_id is not null").collect()]
    assert sorted(hits) == sorted(want) and len(want) > 8
    assert (None, "v", "lsp") in got


def test_merged_candidates_of_the_queries_are_few(spark):
    from codelattice.fixtures import Fixture
    from codelattice.plans import queries

    _, merged = queries._merged(Fixture(spark, "/root/testdata/sf0.001"))
    assert merged.groupBy("src", "call_ord").count().agg(F.max("count")).first()[0] <= 2 * Resolution().max_targets


def _written_lua(n):
    return "".join(f"function Box{i % 7}.name_{i}(a)\n  -- end {{\n  return other.name_{i}(a, 'end')\nend\n" for i in range(n))


def test_scan_time_grows_with_the_text():
    def took(n):
        text, began = _written_lua(n), time.thread_time()
        assert len(extract.extract("a.lua", "lua", text)) == n
        return time.thread_time() - began

    took(100)
    assert took(1600) < 24 * min(took(200) for _ in range(3))


@pytest.mark.parametrize("text", ["function  \n a(", "xfunction a(", "function", "fn a(", " class\ta(", "end a(", "x = class(", "_fn a(", "a(", "  a("])
def test_names_after_a_definition_word(text):
    import re

    for at in range(len(text) + 1):
        assert extract._is_defined(text, at) == bool(re.search(r"\b(function|fn|func|class)$", text[:at].rstrip()))


def test_extracted_rows_leave_in_parts(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(extract, "ROWS_AT_ONCE", 4)
    batch = pd.DataFrame({"relpath": ["a.lua", "b.lua"], "lang": ["lua", "lua"], "content": [_written_lua(6), _written_lua(5)]})
    parts = list(extract._extract_batches([batch, batch]))
    assert max(map(len, parts)) == 4 and pd.concat(parts)["ord"].tolist() == 2 * [0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4]


def test_calls_are_resolved_when_they_are_first_read(spark, monkeypatch):
    done, likely = [], resolve.likely_candidates
    monkeypatch.setattr(resolve, "likely_candidates", lambda *a: done.append(1) or likely(*a))
    rows = spark.createDataFrame([("a.lua", "lua", "function f()\n  g()\nend\nfunction g()\nend\n")], "relpath string, lang string, content string")
    index = CodeIndex.build(spark, files=rows).refresh(spark).with_history(None, None)
    assert index.symbols.count() == 2 and "CodeIndex" in repr(index) and not done
    assert [tuple(r) for r in index.edges.select("src", "dst").collect()] == [("a.lua:1:1:f", "a.lua:4:1:g")]
    assert index.targets.count() == index.edges.count() == 1 and len(done) == 1


def test_outside_candidates_without_a_symbol_need_no_others(spark):
    """The rows that become outside nodes, also of calls with more indexed candidates than can be selected."""
    x = queries.Fixture(spark, "/root/testdata/sf0.001")
    symbols, sites, outside = queries._beside(x)
    columns = ["src", "call_ord", "cand_name", "cand_path", "call_name", "source", "score", "confidence"]
    rows = lambda df: sorted(tuple(r) for r in df.filter("cand_id is null").select(columns).collect())
    got = resolve.unindexed(outside, sites)
    assert rows(got) == rows(resolve.merge_external(resolve.candidates(x.symbols, sites, x.receiver_types), outside, sites)) and got.count()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    # Calls are resolved once, and not again for the outside nodes and edges.
    assert "row_number" not in plan(queries._knowledge(x)[0])
    assert plan(resolve.likely_merged(symbols, sites, x.receiver_types, outside)).count("RepartitionByExpression [src") == 1


def test_alike_definitions_of_a_file_are_not_all_merged(spark):
    """an outside name of a file met all definitions of that name, whose number grows with its square."""
    n = 60
    rows = [(i, "A.f" if i % 2 else "f", "f", "A" if i % 2 else None, "p") for i in range(n)]
    symbols = spark.createDataFrame(rows, "symbol_id int, name string, short_name string, container string, relpath string")
    calls = spark.createDataFrame([(i, k, raw) for i in range(n) for k, raw in enumerate(("f", "A.f", "x:f"))], "src int, call_ord int, raw string")
    external = spark.createDataFrame([(i, name, "p") for i in range(0, n, 5) for name in ("f", "A.f")] + [(0, "f", "vendor")], "src int, name string, path string")
    types = spark.createDataFrame([(i, "x", "A") for i in range(0, n, 3)], "symbol_id int, var string, type string")
    x = type("Tables", (), {"symbols": symbols, "calls": calls, "external": external, "receiver_types": types})
    symbols, sites, outside = queries._beside(x)
    hits = outside.filter("cand_id is not null").groupBy("src", "name").count()
    assert hits.agg(F.max("count")).first()[0] <= 2 * (Resolution().max_targets + 1) + 1
    pick = lambda c: sorted(map(str, resolve.targets(c).select("src", "call_ord", "target_ord", "cand_id", "cand_name", "cand_path", "source", "score", "confidence", "reasons").collect()))
    every = resolve.external_candidates(symbols, external)
    assert every.filter("cand_id is not null").count() > 12 * n
    assert pick(resolve.likely_merged(symbols, sites, types, outside)) == pick(resolve.merge_external(resolve.candidates(symbols, sites, types), every, sites))


def test_edges_of_targets_need_no_other_tables(spark, monkeypatch):
    """targets were kept, dealt again for each of resolutions, edges and facts, and joined."""
    x = queries.Fixture(spark, "/root/testdata/sf0.001")
    symbols, sites, outside = queries._beside(x)
    chosen = durable(resolve.targets(resolve.likely_merged(symbols, sites, x.receiver_types, outside)))
    resolved, edges = resolve.resolutions(sites, chosen), resolve.resolved_edges(symbols, chosen)
    rows = lambda graph: sorted(map(str, graph[1].collect()))
    assert rows(knowledge.build(symbols, None, chosen)) == rows(knowledge.build(symbols, edges, chosen, resolved))
    kept = []
    monkeypatch.setattr(queries, "durable", lambda df: kept.append(df.columns) or durable(df))
    _, _, records = queries._knowledge(x)
    assert kept and not any("target_ord" in columns for columns in kept)
    # Those that are dealt by caller for the choice of targets are dealt no more until they are edges.
    assert records._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [src") == 1


def test_both_ends_of_an_edge_are_checked(spark):
    nodes = spark.createDataFrame([("a", "function"), ("b", "function")], "id string, type string")
    edges = spark.createDataFrame([("a", "b"), ("a", "x"), ("y", "b"), ("x", "y"), (None, "a")], "source string, target string")
    got = sorted(map(tuple, knowledge.validate(nodes, edges).collect()), key=str)
    assert got == sorted([("dangling_target", "x"), ("dangling_source", "y"), ("dangling_source", "x"), ("dangling_target", "y"), ("dangling_source", None)], key=str)
