"""An index of source samples, held against facts known by reading them."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from codelattice.options import Architecture, Complexity, Evolution, HotPath, Layout
from codelattice.plans import documents
from codelattice.plans.index import CodeIndex
from codelattice.sinks import export
from codelattice.sources import extract, files

GREET = """local M = {}

local function decorate(name)
  return "<" .. name .. ">"
end

local function greet(name)
  return "hi " .. decorate(name)
end

function M.run(name)
  return greet(name)
end

return M
"""
ORDER = """local people = require("greet")

local M = {}

local function clean(code)
  return code:lower()
end

local function discount(order)
  return clean(order.code)
end

local function total(order)
  local t = discount(order)
  return t
end

function M.checkout(order)
  people.run(order.name)
  return total(order)
end

local function forgotten()
  return 1
end

return M
"""
SHAPES = """local Disc = {}
local Box = {}

function Disc.area(self)
  return 1
end

function Box.area(self)
  return 2
end

local function measure(shape)
  return shape:area()
end

local function exact()
  local shape = Disc.new()
  return shape:area()
end
"""
PY = '''class Audit:
    def subtotal(self, n):
        return n


class Checkout:
    def subtotal(self, n):
        return n + 1

    def pay(self, n):
        return self.subtotal(n)


def charge(service: Checkout, n):
    return service.subtotal(n)
'''
TS = """import { round } from './util';

export class Cart {
  total(n: number): number {
    return round(n);
  }
}

class Basket {
  total(n: number): number { return n; }
}

export function pay(n: number) {
  const cart = new Cart();
  return cart.total(n);
}

export const twice = (n: number) => {
  return pay(n) + pay(n);
};
"""
UTIL = "export function round(n: number) {\n  return n;\n}\n"
GO = """package main

type A struct{}
type B struct{}

func (a *A) Sum(n int) int { return n }
func (b *B) Sum(n int) int { return n }

func run(a *A) int {
\treturn a.Sum(1)
}
"""
RUST = """struct A;
trait T { fn go(&self); }
impl A {
    fn sum(&self) -> i32 { helper() }
}
impl T for A {
    fn go(&self) { println!("x"); }
}
fn helper() -> i32 { 1 }
"""
TREE = {"greet.lua": GREET, "order.lua": ORDER, "shapes.lua": SHAPES, "pay.py": PY, "shop/cart.ts": TS, "shop/util.ts": UTIL, "main.go": GO, "lib.rs": RUST, "notes.txt": "nothing"}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (base / name).parent.mkdir(exist_ok=True)
        (base / name).write_text(text)
    return base


@pytest.fixture(scope="module")
def index(spark, root):
    return CodeIndex.build(spark, str(root))


def targets(index, source, call):
    src = index.symbol_id(source)
    rows = index.targets.filter((F.col("src") == src) & (F.col("call_name") == call)).orderBy("target_ord").collect()
    return [(r["cand_name"], r["cand_path"], r["confidence"]) for r in rows]


def test_scan_keeps_known_languages(spark, root):
    got = {(r["relpath"], r["lang"]) for r in files.scan(spark, str(root)).collect()}
    assert ("shop/cart.ts", "typescript") in got and len(got) == 8


def test_functions(index):
    got = {(r["relpath"], r["name"], r["symbol_kind"]) for r in index.symbols.collect()}
    for want in [("greet.lua", "M.run", "Function"), ("greet.lua", "decorate", "Function"), ("pay.py", "Checkout.pay", "Function"), ("pay.py", "charge", "Function"), ("shop/cart.ts", "Cart.total", "Method"), ("shop/cart.ts", "twice", "Function"), ("main.go", "A.Sum", "Function"), ("lib.rs", "A.sum", "Function"), ("lib.rs", "T.go", "Function")]:
        assert want in got, want


def test_ids_hold_position(index):
    assert index.symbol_id("decorate") == "greet.lua:3:1:decorate"
    assert index.symbol_at("greet.lua", 3, 5) == "greet.lua:3:1:decorate"


def test_calls_cross_files(index):
    assert targets(index, "M.checkout", "run")[0][:2] == ("M.run", "greet.lua")
    assert targets(index, "greet", "decorate") == [("decorate", "greet.lua", "medium")]


def test_receiver_types_choose_the_container(index):
    assert targets(index, "exact", "area")[0] == ("Disc.area", "shapes.lua", "high")
    assert targets(index, "charge", "subtotal")[0] == ("Checkout.subtotal", "pay.py", "high")
    assert targets(index, "Checkout.pay", "subtotal")[0][0] == "Checkout.subtotal"
    rows = index.targets.filter(F.col("src").startswith("shop/cart.ts") & (F.col("call_name") == "total")).collect()
    assert {r["cand_name"] for r in rows} == {"Cart.total"}


def test_untyped_receiver_is_polymorphic(index):
    got = targets(index, "measure", "area")
    assert [g[0] for g in got] == ["Box.area", "Disc.area"] and {g[2] for g in got} == {"medium"}
    lines = documents.call_tree(index, index.symbol_id("measure"))
    assert any("[poly:2]" in x for x in lines) and any("[dynamic]" in x for x in lines) and any("alt ->" in x for x in lines)


def test_go_receivers_have_no_type(index):
    # ``a *A`` is matched by no pass, so both tie and order falls to the name.
    assert [t[0] for t in targets(index, "run", "Sum")] in ([], ["A.Sum", "B.Sum"])


def test_depth_limit(index):
    one = documents.call_tree(index, index.symbol_id("M.run"), depth=1)
    two = documents.call_tree(index, index.symbol_id("M.run"), depth=2, ascii_=True)
    assert not any("decorate" in x for x in one) and any("decorate" in x for x in two)


def test_dead_code(index):
    assert "forgotten" in {r["name"] for r in index.dead_code().collect()}


def test_impact(index):
    got = {r["name"] for r in index.impact(index.symbol_id("clean")).collect()}
    assert {"discount", "total", "M.checkout"} <= got
    assert any("Impacted modules" in x for x in documents.impact(index.impact(index.symbol_id("clean"))))


def test_imports(index):
    got = {(r["src"], r["dst"]) for r in index.import_graph().collect()}
    assert got == {("order.lua", "greet.lua"), ("shop/cart.ts", "shop/util.ts")}
    assert {(r["src"], r["dst"]) for r in index.import_graph("incoming").collect()} == {(b, a) for a, b in got}


def test_module_graph(index):
    assert ("order", "greet") in {(r["src"], r["dst"]) for r in index.module_graph().collect()}
    assert documents.dependency_tree(index.module_graph())[0] == "Dependencies"


def test_local_graph(index):
    got = {(r["src_name"], r["dst_name"]) for r in index.local_graph("greet.lua").collect()}
    assert {("M.run", "greet"), ("greet", "decorate")} <= got
    assert documents.expanded_tree(index.local_graph("greet.lua"), "M.run", {"M.run"}) == ["[-] M.run", "  [+] greet"]


def test_reports_render(index):
    hot, chains = index.hot_path(HotPath())
    assert documents.hot_path(hot, chains)[0] == "Hot paths"
    assert any("Suggestions" in x for x in documents.complexity(index.complexity(Complexity())))
    assert documents.architecture(index.architecture(Architecture(layer_by_path_prefix={"shop/": "interface"})))[0] == "Groups"
    risk = index.risk_map(baseline=hot.select("rank", "symbol_id", "score"))
    assert any("Trend" in x for x in documents.risk(risk))


def test_architecture_overrides(index):
    rows = index.architecture(Architecture(layer_by_path_prefix={"shop/": "interface"}, rules={"interface": {"application": False}}))["placed"].collect()
    assert {r["layer"] for r in rows if r["symbol_id"].startswith("shop/")} == {"interface"}


def test_knowledge(index):
    kg = index.knowledge()
    assert kg["problems"].count() == 0
    counts = {r["name"]: r["n"] for r in kg["counts"].collect()}
    assert counts["type_nodes"] > 0 and counts["function_nodes"] == index.symbols.count()


@pytest.mark.parametrize("kind,head", [("graphviz", "digraph CodeGraph {"), ("mermaid", "flowchart LR"), ("json", "{")])
def test_exports(index, tmp_path, kind, head):
    path = index.export(index.symbol_id("M.checkout"), kind, str(tmp_path / "out"))
    assert open(path).read().startswith(head)


def test_force_export_has_positions(index, tmp_path):
    path = index.export(index.symbol_id("M.checkout"), "dot", str(tmp_path / "out"), layout=Layout(algorithm="force"))
    assert "layout=neato" in open(path).read() and "pos=" in open(path).read()
    with pytest.raises(ValueError, match="unsupported"):
        export.export({}, "svg", "x")


def test_knowledge_lines(index, tmp_path):
    kg = index.knowledge()
    export.write_lines(export.knowledge_lines(kg["nodes"], kg["edges"], {"schema_version": "knowledge_graph.v1"}), str(tmp_path / "kg"))
    lines = [json.loads(x) for p in sorted((tmp_path / "kg").glob("part-*")) for x in p.read_text().splitlines()]
    kinds = [x["record"] for x in lines]
    assert kinds[0] == "meta" and kinds == sorted(kinds, key=["meta", "node", "edge"].index)


def test_external_calls_merge(spark, index):
    src = index.symbol_id("greet")
    outside = spark.createDataFrame([(src, "decorate", "greet.lua"), (src, "decorate", "vendor/x.lua")], "src string, name string, path string")
    merged = index.merge_external(outside)
    rows = {(r["cand_id"], r["source"]) for r in merged.candidates.filter(F.col("src") == src).collect()}
    assert (index.symbol_id("decorate"), "mixed(index+lsp)") in rows and (None, "lsp") in rows
    assert index.merge_external(spark.createDataFrame([(src, "nothing", "x.lua")], "src string, name string, path string")) is None


def test_viewer(index):
    root = index.symbol_id("M.checkout")
    session = index.view(root).focus(index.symbol_id("total"))
    assert session.pan(-1).root == root and session.pan(-1).pan(1).root == session.root
    assert session.pan(-1).focus(index.symbol_id("greet")).history == (root, index.symbol_id("greet"))
    nodes, _, counts = index.view(root, search="zzz").query(index.symbols, index.edges)
    assert [r["symbol_id"] for r in nodes.collect()] == [root] and counts.first()["hidden_nodes"] > 0
    assert session.neighbour(index.edges) == index.symbol_id("discount")


def test_save_and_load(spark, index, tmp_path):
    index.save(str(tmp_path / "ix"))
    again = CodeIndex.load(spark, str(tmp_path / "ix"))
    assert again.edges.count() == index.edges.count()


def test_fallback_has_no_calls():
    script = "export const f = (a) => a\nexport default async function main() {\n  go()\n}\n"
    # An `export default` is no line the fallback knows; a range ends with the first brace's pair.
    assert extract._fallback(script) == [("f", 0, 13, 3, 1)]


def test_masked_braces_do_not_count():
    text = 'function f() { const s = "}"; /* } */ return g(); }\nfunction h() { f(); }\n'
    got = {r["name"]: [c[0] for c in r["calls"]] for r in extract.extract("a.js", "javascript", text)}
    assert got == {"f": ["g"], "h": ["f"]}


def test_receiver_passes():
    assert extract.receiver_types("x: Foo", "lua") == {"x": "Foo"}
    assert extract.receiver_types("local s = Disc.new()", "lua")["s"] == "Disc"
    assert extract.receiver_types("service:apply(1)", "lua") == {"service": "apply"}
    assert extract.receiver_types("def f(self): pass", "python")["self"] == "self"


def test_history(spark, root, index):
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "one")
    (root / "greet.lua").write_text(GREET + "-- end\n")
    run("commit", "-qam", "two")
    known = index.read_history(spark)
    report = known.evolution(Evolution())
    assert report["totals"].first()["commits"] == 2
    assert {r["subject"] for r in report["timeline"].collect()} == {"one", "two"}
    assert report["files"].first()["path"] in TREE
    assert documents.evolution(report)[0] == "Timeline"
