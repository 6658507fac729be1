"""Every registered query against its SQL on the smallest tables."""

import math

import pytest

from codelattice import catalog
from codelattice.fixtures import Fixture
from codelattice.options import Layout
from codelattice.plans import queries

from compare import agree, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, con, name):
    agree(spark, con, SF, catalog.queries()[name], catalog.oracle_sql()[name])


#: An iterative layout, held by a plain loop below.
WITHOUT_SQL = {"layout_force", "export_dot_force"}


def test_every_other_query_has_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_the_rest_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_force_layout_against_plain_loops(spark):
    """Each step by its definition: repulsion of every pair, attraction along edges, damping, the frame."""
    x = Fixture(spark, SF)
    _, edges, _, nodes, inner = queries._around(x)
    ids = sorted(r["symbol_id"] for r in nodes.collect())
    links = sorted((ids.index(r["src"]), ids.index(r["dst"])) for r in inner.collect() if r["src"] in ids and r["dst"] in ids and r["src"] != r["dst"])
    o, n = Layout(), len(ids)
    w, h, k = o.width, o.height, math.sqrt(o.width * o.height / n)
    at = [[w / 2 + 0.35 * min(w, h) * math.cos(2 * math.pi * i / n), h / 2 + 0.35 * min(w, h) * math.sin(2 * math.pi * i / n)] for i in range(n)]
    speed = [[0.0, 0.0] for _ in ids]
    for _ in range(o.iterations):
        push = [[0.0, 0.0] for _ in ids]
        for i in range(n):
            for j in range(n):
                if i != j:
                    dx, dy = at[i][0] - at[j][0], at[i][1] - at[j][1]
                    d = max(0.01, math.hypot(dx, dy))
                    push[i][0] += dx / d * k * k / d
                    push[i][1] += dy / d * k * k / d
        for i, j in links:
            dx, dy = at[i][0] - at[j][0], at[i][1] - at[j][1]
            d = max(0.01, math.hypot(dx, dy))
            for end, sign in ((i, -1), (j, 1)):
                push[end][0] += sign * dx / d * d * d / k
                push[end][1] += sign * dy / d * d * d / k
        for i in range(n):
            for c, most in ((0, w), (1, h)):
                speed[i][c] = (speed[i][c] + 0.01 * push[i][c]) * 0.85
                at[i][c] = min(most, max(0, at[i][c] + speed[i][c]))
    got = {r["symbol_id"]: (r["x"], r["y"]) for r in catalog.queries()["layout_force"](spark, SF).collect()}
    assert len(got) == n and all(math.dist(got[i], at[p]) < 1e-6 for p, i in enumerate(ids))
