"""The driver's tables seen as a code graph.

Each view is one dialect-neutral SELECT, so Spark and an oracle start from
the same rows. ``{part}`` and the like stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names

SYMBOLS = """
SELECT p_partkey AS symbol_id, p_partkey AS sym_ord,
       concat(CASE p_type WHEN 'ECONOMY' THEN 'ui' WHEN 'STANDARD' THEN 'service' WHEN 'MEDIUM' THEN 'domain'
                          WHEN 'PROMO' THEN 'storage' WHEN 'SMALL' THEN 'lib' ELSE 'tests' END,
              '/', lower(replace(p_brand, '#', '')), '/m', p_size % 5, '.lua') AS relpath,
       CASE WHEN p_size % 3 = 0 THEN NULL ELSE replace(p_brand, '#', '') END AS container,
       replace(p_name, ' ', '_') AS short_name,
       CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '_')
            ELSE concat(replace(p_brand, '#', ''), '.', replace(p_name, ' ', '_')) END AS name,
       CASE WHEN p_size % 7 = 0 THEN 'Method' ELSE 'Function' END AS symbol_kind,
       'lua' AS lang, CAST((p_partkey * 7) % 500 AS INT) AS sr, 0 AS sc,
       CAST((p_partkey * 7) % 500 + p_size AS INT) AS er, 1 AS ec
FROM {part}
"""
EDGES = """
SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst
FROM {lineitem} a JOIN {lineitem} b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_quantity >= 46 AND a.l_partkey <> b.l_partkey
"""
CALLS = """
SELECT src, raw, row_number() OVER (PARTITION BY src ORDER BY raw) AS call_ord FROM (
SELECT DISTINCT a.l_partkey AS src,
       CASE a.l_linenumber % 4
            WHEN 0 THEN replace(p.p_name, ' ', '_')
            WHEN 1 THEN concat(replace(p.p_brand, '#', ''), '.', replace(p.p_name, ' ', '_'))
            WHEN 2 THEN concat('svc', a.l_suppkey % 3, ':', replace(p.p_name, ' ', '_'))
            ELSE concat(replace(p.p_brand, '#', ''), '::', replace(p.p_name, ' ', '_')) END AS raw
FROM {lineitem} a JOIN {part} p ON p.p_partkey = (a.l_partkey + a.l_suppkey) % (SELECT count(*) FROM {part})
WHERE a.l_quantity >= 46) x
"""
RECEIVER_TYPES = """
SELECT p_partkey AS symbol_id, concat('svc', p_partkey % 3) AS var, replace(p_brand, '#', '') AS type
FROM {part} WHERE p_size % 4 = 1
"""
COMMITS = """
SELECT o_orderkey AS hash, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date, o_custkey AS author,
       o_orderstatus = 'P' AS is_merge FROM {orders}
"""
FILES = """
SELECT l.l_orderkey AS hash, s.relpath AS path,
       CAST(sum(CASE WHEN l.l_tax = 0 THEN 0 ELSE l.l_quantity END) AS BIGINT) AS added,
       CAST(sum(round(l.l_discount * 100, 0)) AS BIGINT) AS deleted
FROM {lineitem} l JOIN {fx_symbols} s ON s.symbol_id = l.l_partkey GROUP BY l.l_orderkey, s.relpath
"""
EXTERNAL = """
SELECT DISTINCT l_partkey AS src, replace(p.p_name, ' ', '_') AS name,
       CASE WHEN l_linenumber % 2 = 0 THEN s.relpath ELSE 'vendor/kit.lua' END AS path
FROM {lineitem} l JOIN {part} p ON p.p_partkey = (l.l_partkey + l.l_suppkey) % (SELECT count(*) FROM {part})
JOIN {fx_symbols} s ON s.symbol_id = p.p_partkey
WHERE l.l_quantity >= 48
"""
SOURCES = """
SELECT concat('w', page_id, '/main.lua') AS relpath, 'lua' AS lang,
       replace(replace(html, 'href="/', 'require("'), '">', '")>') AS content FROM {pages}
UNION ALL
SELECT DISTINCT concat(replace(regexp_extract(html, 'href="/([^"]*)"', 1), '.', '/'), '.lua') AS relpath, 'lua' AS lang, '' AS content
FROM {pages} WHERE page_id % 2 = 0
"""
#: A history as text: a header line for each commit, then a line for each file.
LOG = """
SELECT hash * 1000 + row_number() OVER (PARTITION BY hash ORDER BY kind, path) AS line_no, line FROM (
SELECT hash, 0 AS kind, '' AS path, concat('@@@', CAST(hash AS STRING), chr(9), date, chr(9), CAST(author AS STRING), chr(9), 'change ', CAST(hash AS STRING)) AS line FROM {fx_commits}
UNION ALL
SELECT f.hash, 1 AS kind, path, concat(CASE WHEN added = 0 THEN '-' ELSE CAST(added AS STRING) END, chr(9), CAST(deleted AS STRING), chr(9), path) AS line FROM {fx_files} f JOIN {fx_commits} c ON c.hash = f.hash) x
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Fixture:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def _sql(self, text: str, **views) -> DataFrame:
        for name in ("part", "lineitem", "orders", "pages"):
            if "{" + name + "}" in text:
                views[name] = _table(self.spark, self.dir, name)
        return self.spark.sql(text, **views)

    @property
    def symbols(self) -> DataFrame:
        out = self._sql(SYMBOLS)
        return out.withColumn("module_id", names.module_id(F.col("relpath"))).withColumn("package_id", names.package_id(F.col("relpath"))).withColumn("path", F.col("relpath"))

    @property
    def edges(self) -> DataFrame:
        return self._sql(EDGES)

    @property
    def calls(self) -> DataFrame:
        return self._sql(CALLS)

    @property
    def receiver_types(self) -> DataFrame:
        return self._sql(RECEIVER_TYPES)

    @property
    def commits(self) -> DataFrame:
        return self._sql(COMMITS)

    @property
    def files(self) -> DataFrame:
        return self._sql(FILES, fx_symbols=self.symbols)

    @property
    def external(self) -> DataFrame:
        return self._sql(EXTERNAL, fx_symbols=self.symbols)

    @property
    def sources(self) -> DataFrame:
        return self._sql(SOURCES)

    @property
    def log(self) -> DataFrame:
        return self._sql(LOG, fx_commits=self.commits, fx_files=self.files)


def oracle_views() -> str:
    """The views as common table expressions for the oracle."""
    tables = {t: t for t in ("part", "lineitem", "orders", "pages", "fx_symbols")}
    base = SYMBOLS.format(**tables)
    symbols = f"""SELECT *, replace(regexp_replace(relpath, '[.][^.]+$', ''), '/', '.') AS module_id,
       coalesce(nullif(regexp_extract(relpath, '^([^/]+)/', 1), ''), '(root)') AS package_id,
       concat(name, ' - ', relpath) AS label,
       (contains(lower(relpath), '/test') OR contains(lower(relpath), 'spec') OR contains(lower(relpath), '_test.') OR starts_with(lower(name), 'test')) AS is_test,
       lower(name) IN ('main', 'init', 'setup', 'run', 'm.run') AS is_entry
FROM ({base}) b"""
    parts = {"fx_symbols": symbols, "fx_edges": EDGES.format(**tables), "fx_calls": CALLS.format(**tables), "fx_types": RECEIVER_TYPES.format(**tables), "fx_commits": COMMITS.format(**tables), "fx_files": FILES.format(**tables), "fx_external": EXTERNAL.format(**tables), "fx_sources": SOURCES.format(**tables)}
    return ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items())
