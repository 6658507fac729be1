"""Layer and domain of a symbol, and the severity of a forbidden dependency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import LAYER_WORDS, LEVELS, Architecture


def _by_prefix(value: Column, table: dict) -> Column:
    """The entry of the longest key that ``value`` starts with."""
    out = F.lit(None).cast("string")
    for key in sorted(table, key=lambda k: (-len(k), k), reverse=True):
        out = F.when(value.startswith(key), F.lit(str(table[key]))).otherwise(out)
    return out


def _by_key(value: Column, table: dict) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(str(x)) for pair in table.items() for x in pair]), value)


def layer(relpath: Column, module_id: Column, options: Architecture) -> Column:
    rel, mod = F.lower(relpath), F.lower(module_id)
    top = F.regexp_extract(rel, "^([^/]+)/", 1)
    test = rel.startswith("tests/") | rel.startswith("test/") | rel.startswith("spec/") | mod.rlike(r"\.tests?\.") | mod.rlike(r"\.spec\.")
    found = F.regexp_extract_all(F.concat(mod, F.lit(" "), rel), F.lit("([A-Za-z0-9_-]+)"), F.lit(1))
    words = F.lit("core")
    for name, own in reversed((LAYER_WORDS | options.layer_words).items()):
        words = F.when(F.arrays_overlap(found, F.array(*map(F.lit, own))), F.lit(name)).otherwise(words)
    return F.coalesce(_by_prefix(rel, options.layer_by_path_prefix), _by_prefix(mod, options.layer_by_module_prefix), _by_key(top, options.layer_by_top_dir), F.when(test, F.lit("test")), words)


def domain(relpath: Column, module_id: Column, options: Architecture) -> Column:
    rel = F.lower(relpath)
    top = F.regexp_extract(rel, "^([^/]+)/", 1)
    segments = F.filter(F.split(rel, "/"), lambda s: s != "")
    head = F.coalesce(F.nullif(F.regexp_extract(module_id, r"^[^.]+\.([^.]+)", 1), F.lit("")), F.nullif(F.regexp_extract(module_id, r"^([^.]+)", 1), F.lit("")))
    return F.coalesce(_by_prefix(rel, options.domain_by_path_prefix), _by_key(top, options.domain_by_top_dir), F.try_element_at(segments, F.lit(max(1, options.domain_segment))), F.try_element_at(segments, F.lit(1)), head, F.lit("(global)"))


def violation_score(count: Column, source: Column, target: Column, options: Architecture) -> Column:
    heights = LEVELS | options.levels
    height = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in heights.items() for x in pair]), c), F.lit(3))
    a, b = height(source), height(target)
    return (35 + 14 * F.abs(a - b) + 2 * F.least(F.lit(25), count) + F.when(a > b, 12).otherwise(0)).cast("double")
