"""The composite reports: impact, evolution, hot paths, complexity, architecture, risk.

Reports are DataFrames; only renderers and file sinks collect. Scores are
doubles and ties end in an id, so every order is total.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layers, names
from ..options import Architecture, Complexity, Evolution, HotPath, Risk
from . import graphs, scc, traverse
from .durable import durable


def _zero():
    return F.lit(0).cast("bigint")


def analyzed(symbols: DataFrame, include_tests: bool) -> DataFrame:
    return symbols if include_tests else symbols.filter(~names.is_test(F.col("relpath"), F.col("name")))


def ranked(rows: DataFrame, order: list, top: int | None = None) -> DataFrame:
    """``rows`` with rank; the top ones are found before they are numbered."""
    if top is not None:
        rows = rows.orderBy(*order).limit(max(1, top))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


# Impact.


def impact(symbols: DataFrame, edges: DataFrame, root, limit: int = 8) -> DataFrame:
    """Transitive callers with depth, direct, is_test."""
    met = traverse.callers(edges, root, limit)
    return symbols.join(met, "symbol_id").select("symbol_id", "name", "relpath", "module_id", "package_id", "depth", (F.col("depth") == 1).alias("direct"), names.is_test(F.col("relpath"), F.col("name")).alias("is_test"))


# History.


def latest(commits: DataFrame, limit: int, include_merges: bool = False, since: str | None = None) -> DataFrame:
    """The newest commits: top-k by date."""
    rows = commits if include_merges else commits.filter(~F.col("is_merge"))
    if since:
        rows = rows.filter(F.col("date") >= since)
    return rows.orderBy(F.col("date").desc(), F.col("hash").desc()).limit(max(1, int(limit)))


def file_churn(commits: DataFrame, files: DataFrame) -> DataFrame:
    """path, churn, touches over the given commits."""
    touched = files.join(commits.select("hash"), "hash", "left_semi")
    return touched.groupBy("path").agg(F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.count(F.lit(1)).alias("touches"))


def file_hotspots(churn: DataFrame, limit: int = 10) -> DataFrame:
    return ranked(churn, [F.col("churn").desc(), F.col("touches").desc(), F.col("path")], limit)


def commit_timeline(symbols: DataFrame, edges: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each commit: files, churn, touched symbols and edges, changed files."""
    files = files.join(commits.select("hash"), "hash", "left_semi")
    sums = files.groupBy("hash").agg(F.count(F.lit(1)).alias("files_count"), F.sum("added").alias("insertions"), F.sum("deleted").alias("deletions"), F.sort_array(F.collect_list("path")).alias("changed_files"))
    touched = touched_symbols(symbols, commits, files)
    n_symbols = touched.groupBy("hash").agg(F.count(F.lit(1)).alias("touched_symbols"))
    pairs = edges.select("src", "dst").distinct()
    by_src = touched.join(pairs, touched["symbol_id"] == pairs["src"]).select("hash", "src", "dst")
    by_dst = touched.join(pairs, touched["symbol_id"] == pairs["dst"]).select("hash", "src", "dst")
    n_edges = by_src.unionByName(by_dst).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("touched_edges"))
    out = commits.drop("files_count", "insertions", "deletions").join(sums, "hash", "left").join(n_symbols, "hash", "left").join(n_edges, "hash", "left")
    counts = ["files_count", "insertions", "deletions", "touched_symbols", "touched_edges"]
    out = out.withColumns({c: F.coalesce(c, _zero()) for c in counts})
    return out.withColumn("churn", F.col("insertions") + F.col("deletions")).withColumn("short_hash", F.substring(F.col("hash").cast("string"), 1, 8))


def touched_symbols(symbols: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (hash, symbol_id) of symbols whose file a commit changes."""
    files = files.join(commits.select("hash"), "hash", "left_semi")
    return files.select("hash", F.col("path").alias("relpath")).distinct().join(symbols.select("symbol_id", "relpath"), "relpath").select("hash", "symbol_id").distinct()


def symbol_hotspots(symbols: DataFrame, commits: DataFrame, files: DataFrame, limit: int = 10) -> DataFrame:
    """Symbols by commits that touch them; their churn is that of the whole commits."""
    files = files.join(commits.select("hash"), "hash", "left_semi")
    whole = files.groupBy("hash").agg(F.sum(F.col("added") + F.col("deleted")).alias("c"))
    sums = touched_symbols(symbols, commits, files).join(whole, "hash").groupBy("symbol_id").agg(F.count(F.lit(1)).alias("touches"), F.sum("c").alias("churn"))
    rows = sums.join(symbols.select("symbol_id", "name", "relpath"), "symbol_id")
    return ranked(rows, [F.col("touches").desc(), F.col("churn").desc(), F.col("name"), F.col("symbol_id")], limit)


def evolution_totals(commits: DataFrame, files: DataFrame) -> DataFrame:
    files = files.join(commits.select("hash"), "hash", "left_semi")
    sums = files.agg(F.coalesce(F.sum("added"), _zero()).alias("insertions"), F.coalesce(F.sum("deleted"), _zero()).alias("deletions"))
    return commits.agg(F.count(F.lit(1)).alias("commits")).crossJoin(sums).withColumn("churn", F.col("insertions") + F.col("deletions"))


def evolution(symbols: DataFrame, edges: DataFrame, commits: DataFrame, files: DataFrame, options: Evolution = Evolution()) -> dict[str, DataFrame]:
    if options.path:
        files = files.filter(F.col("path").startswith(options.path))
        commits = commits.join(files.select("hash"), "hash", "left_semi")
    recent = latest(commits, options.limit, options.include_merges, options.since)
    return {
        "timeline": commit_timeline(symbols, edges, recent, files), "totals": evolution_totals(recent, files),
        "files": file_hotspots(file_churn(recent, files), options.hotspot_limit), "symbols": symbol_hotspots(symbols, recent, files, options.hotspot_limit),
    }


# Hot paths.


def hot_scores(symbols: DataFrame, edges: DataFrame, churn: DataFrame, options: HotPath = HotPath()) -> DataFrame:
    """Score and parts of every analyzed symbol; degrees and reach count all symbols."""
    rows = analyzed(symbols, options.include_tests).select("symbol_id", "name", "relpath", "module_id", "package_id")
    rows = rows.join(graphs.degrees(symbols, edges), "symbol_id").join(traverse.reach_counts(symbols, edges, options.max_depth), "symbol_id")
    if options.include_churn:
        rows = rows.join(churn.select(F.col("path").alias("relpath"), "churn"), "relpath", "left").withColumn("churn", F.coalesce("churn", _zero()))
    else:
        rows = rows.withColumn("churn", _zero())
    balance, reach = F.least("in_degree", "out_degree"), F.col("out_reach") + F.col("in_reach")
    score = F.col("in_degree") * options.weight_in + F.col("out_degree") * options.weight_out + balance * options.weight_balance + reach * options.weight_reach + F.col("churn") * options.weight_churn
    return rows.withColumn("balance", balance).withColumn("reach", reach).withColumn("score", F.round(score.cast("double"), 9)).withColumn("label", names.label(F.col("name"), F.col("relpath")))


def hot_path(scores: DataFrame, options: HotPath = HotPath()) -> DataFrame:
    order = [F.col("score").desc(), F.col("reach").desc(), F.col("label"), F.col("symbol_id")]
    text = F.format_string("fan-in=%d fan-out=%d reach=%d balance=%d churn=%d", "in_degree", "out_degree", "reach", "balance", "churn")
    return ranked(scores, order, options.top_n).withColumn("rationale", text)


def hot_chains(edges: DataFrame, scores: DataFrame, hot: DataFrame, options: HotPath = HotPath()) -> DataFrame:
    """root, pos, symbol_id, score, bottleneck; walked ids without a score count 0 and are left out."""
    roots = hot.filter(F.col("rank") <= max(1, options.path_count)).select(F.col("symbol_id").alias("root"))
    chains = traverse.hot_chains(graphs.oriented(edges, options.direction), scores, roots, options.path_depth)
    least = F.min(F.coalesce("score", F.lit(0.0))).over(Window.partitionBy("root"))
    return chains.withColumn("bottleneck", least).filter("score is not null")


# Complexity.


def complexity_scores(symbols: DataFrame, edges: DataFrame, options: Complexity = Complexity()) -> tuple[DataFrame, DataFrame]:
    """Scores of analyzed symbols, and the stats of their components.

    Every symbol has its own component's size and cycle flag. Components and
    stats are kept, as both results are made of them.
    """
    rows = analyzed(symbols, options.include_tests).select("symbol_id", "name", "relpath", "module_id", "package_id")
    parts = durable(scc.strong_components(rows, edges))
    stats = durable(scc.component_stats(parts, edges))
    rows = rows.join(graphs.degrees(symbols, edges), "symbol_id").join(parts, "symbol_id").join(stats.select("scc_id", F.col("size").alias("scc_size"), F.col("has_cycle").alias("in_cycle")), "scc_id")
    bridge = F.least("in_degree", "out_degree")
    score = F.when(F.col("in_cycle"), options.cycle_weight).otherwise(0.0) + (F.col("in_degree") + F.col("out_degree")) * options.degree_weight + bridge * options.bridge_weight + (F.col("scc_size") - 1) * options.scc_size_weight
    return rows.withColumn("bridge", bridge).withColumn("score", F.round(score.cast("double"), 9)).withColumn("label", names.label(F.col("name"), F.col("relpath"))), stats


def complexity(scores: DataFrame, options: Complexity = Complexity()) -> DataFrame:
    text = F.format_string("deg=%d bridge=%d scc=%d cycle=%s", F.col("in_degree") + F.col("out_degree"), "bridge", "scc_size", F.col("in_cycle").cast("string"))
    return ranked(scores, [F.col("score").desc(), F.col("label"), F.col("symbol_id")], options.top_n).withColumn("severity", names.severity(F.col("score"), options.thresholds)).withColumn("rationale", text)


def top_components(scores: DataFrame, stats: DataFrame, limit: int = 10) -> DataFrame:
    """The largest components with the first four names."""
    order = [F.col("size").desc(), F.col("density").desc(), F.col("scc_id")]
    top = ranked(stats, order, limit)
    first = Window.partitionBy("scc_id").orderBy("symbol_id")
    some = scores.select("scc_id", "symbol_id", "name").join(top.select("scc_id"), "scc_id", "left_semi").withColumn("n", F.row_number().over(first)).filter("n <= 4")
    preview = some.groupBy("scc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ", ").alias("preview"))
    return top.join(preview, "scc_id", "left")


def module_clusters(symbols: DataFrame, edges: DataFrame, include_tests: bool = False) -> DataFrame:
    """Modules by density: edges from the module to any analyzed symbol over the most it could hold inside."""
    rows = analyzed(symbols, include_tests)
    size = rows.groupBy("module_id").agg(F.count(F.lit(1)).alias("symbols"))
    ids = rows.select("symbol_id", "module_id")
    out = edges.select("src", "dst").join(ids.toDF("src", "module_id"), "src").join(ids.select(F.col("symbol_id").alias("dst")), "dst", "left_semi").groupBy("module_id").agg(F.count(F.lit(1)).alias("edges"))
    both = size.join(out, "module_id", "left").withColumn("edges", F.coalesce("edges", _zero()))
    return both.withColumn("density", F.col("edges") / F.greatest(F.lit(1), F.col("symbols") * (F.col("symbols") - 1)))


def structural_score(scores: DataFrame, stats: DataFrame, clusters: DataFrame, options: Complexity = Complexity()) -> DataFrame:
    one = scores.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("average"))
    cyc = stats.agg(F.coalesce(F.sum(F.col("has_cycle").cast("bigint")), _zero()).alias("cyclic_sccs"), F.max(F.when(F.col("has_cycle"), F.col("size"))).alias("largest_cycle"))
    dense = clusters.agg(F.coalesce(F.max("density"), F.lit(0.0)).alias("max_density"))
    out = one.crossJoin(cyc).crossJoin(dense)  # one row each
    score = F.col("average") + 0.8 * F.col("cyclic_sccs") + 12 * F.col("max_density")
    return out.withColumn("structural_score", score).withColumn("severity", names.severity(score, options.thresholds))


def complexity_suggestions(structure: DataFrame, top: DataFrame, options: Complexity = Complexity()) -> DataFrame:
    """ord, suggestion."""
    bridges = top.agg(F.coalesce(F.sum((F.col("bridge") >= options.suggestion_top_bridge).cast("bigint")), _zero()).alias("bridges"))
    row = structure.crossJoin(bridges)
    large = F.format_string("Cycle of %d symbols: extract boundaries to break it.", "largest_cycle")
    texts = F.array_compact(F.array(
        F.when(F.col("cyclic_sccs") > 0, F.when(F.col("largest_cycle") >= options.suggestion_scc_size, large).otherwise("Small cycles exist: untangle their entry points first.")),
        F.when(F.col("max_density") >= options.suggestion_density, F.format_string("Dense module (max %.3f): split it or tighten its layering.", "max_density")),
        F.when(F.col("bridges") > 0, F.format_string("%d hotspot(s) are bridges: add regression tests before changing them.", "bridges")),
    ))
    texts = F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit("Complexity is within its thresholds.")))
    return row.select(F.posexplode(texts).alias("ord", "suggestion"))


# Architecture.


def layer_domain(symbols: DataFrame, options: Architecture = Architecture()) -> DataFrame:
    rel, mod = F.col("relpath"), F.col("module_id")
    out = symbols.select("symbol_id", "sym_ord", layers.layer(rel, mod, options).alias("layer"), layers.domain(rel, mod, options).alias("domain"))
    out = out.withColumn("group_id", F.concat_ws(":", "layer", "domain"))
    return out if options.include_tests else out.filter("layer != 'test'")


def arch_groups(placed: DataFrame) -> DataFrame:
    return placed.groupBy("group_id", "layer", "domain").agg(F.count(F.lit(1)).alias("symbol_count"), F.min_by("symbol_id", "sym_ord").alias("target"))


def arch_edges(placed: DataFrame, edges: DataFrame, options: Architecture = Architecture()) -> DataFrame:
    """Edges between groups: count, layers, and the first examples by id."""
    own = placed.select("symbol_id", "group_id", "layer")
    met = edges.select("src", "dst").join(own.toDF("src", "source_group", "source_layer"), "src").join(own.toDF("dst", "target_group", "target_layer"), "dst")
    pair = ["source_group", "target_group"]
    # A handful of pairs hold all edges: they are counted before the shuffle, and examples are limited before it.
    counts = met.groupBy(*pair, "source_layer", "target_layer").agg(F.count(F.lit(1)).alias("count"))
    first = met.withColumn("n", F.row_number().over(Window.partitionBy(*pair).orderBy("src", "dst"))).filter(F.col("n") <= max(1, options.max_examples))
    examples = first.groupBy(*pair).agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("examples"))
    return counts.join(examples, pair)


#: Orders of reports that are lists without a limit; each ends in an id.
DEAD_ORDER = ("relpath", "name", "symbol_id")
IMPACT_ORDER = ("relpath", "name", "symbol_id")
LABEL_ORDER = ("name", "relpath", "symbol_id")
TIMELINE_ORDER = ("date", "hash")


def cluster_order():
    return [F.col("density").desc(), F.col("symbols").desc(), F.col("module_id")]


def violation_order():
    return [F.col("severity_score").desc(), F.col("count").desc(), F.col("source_group"), F.col("target_group")]


def group_risk_order():
    return [F.round("avg_score", 9).desc(), F.round("score", 9).desc(), F.col("id")]


def arch_violations(group_edges: DataFrame, options: Architecture = Architecture()) -> DataFrame:
    """Group edges that no rule allows, with score and severity."""
    spark, rules = group_edges.sparkSession, options.allowed()
    # The rules are a small constant table.
    table = spark.createDataFrame([(k, sorted(v)) for k, v in rules.items()], "source_layer string, allowed array<string>")
    met = group_edges.join(F.broadcast(table), "source_layer", "left")
    known = F.array_contains("allowed", F.lit("*")) | F.array_contains("allowed", F.col("target_layer"))
    ok = (F.col("source_layer") == F.col("target_layer")) | F.when(F.col("allowed").isNull(), F.lit(options.unknown_layer_policy == "allow")).otherwise(known)
    score = layers.violation_score(F.col("count"), F.col("source_layer"), F.col("target_layer"), options)
    return met.filter(~ok).drop("allowed").withColumn("severity_score", score).withColumn("severity", names.severity(F.col("severity_score"), options.thresholds))


def severity_counts(rows: DataFrame) -> DataFrame:
    """severity, count of all four severities."""
    spark = rows.sparkSession
    all_four = spark.createDataFrame([("critical",), ("high",), ("medium",), ("low",)], "severity string")
    return F.broadcast(all_four).join(rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").select("severity", F.coalesce("n", _zero()).alias("count"))


def architecture(symbols: DataFrame, edges: DataFrame, options: Architecture = Architecture()) -> dict[str, DataFrame]:
    # Both ends of an edge are placed, by expressions that are dear.
    placed = durable(layer_domain(symbols, options))
    between = arch_edges(placed, edges, options)
    bad = arch_violations(between, options)
    return {"placed": placed, "groups": arch_groups(placed), "edges": between, "violations": bad, "severities": severity_counts(bad)}


# Risk.


def risk_scores(symbols: DataFrame, edges: DataFrame, churn: DataFrame, options: Risk = Risk()) -> DataFrame:
    """Hot path, complexity, violations and churn of each analyzed symbol in one score.

    The inner reports use their own default weights. What they read and their
    scores are kept, so that no plan holds all of them.
    """
    if not options.include_churn:
        churn = churn.limit(0)
    symbols, churn = durable(symbols.select("symbol_id", "sym_ord", "name", "relpath", "module_id", "package_id")), durable(churn.select("path", "churn"))
    hot = durable(hot_scores(symbols, edges, churn, replace(HotPath(), include_tests=options.include_tests)).select("symbol_id", F.col("score").alias("hot_score")))
    cx, _ = complexity_scores(symbols, edges, Complexity(include_tests=options.include_tests))
    cx = durable(cx.select("symbol_id", F.col("score").alias("complexity_score")))
    bad = architecture(symbols, edges, options.architecture)["violations"]
    seen = bad.select(F.explode("examples").alias("e")).select(F.explode(F.array("e.src", "e.dst")).alias("symbol_id"))
    hits = seen.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("architecture_hits"))
    lines = churn.select(F.col("path").alias("relpath"), "churn")
    rows = analyzed(symbols, options.include_tests).select("symbol_id", "name", "relpath", "module_id", "package_id")
    rows = rows.join(hot, "symbol_id", "left").join(cx, "symbol_id", "left").join(hits, "symbol_id", "left").join(lines, "relpath", "left")
    rows = durable(rows.fillna({"hot_score": 0.0, "complexity_score": 0.0, "architecture_hits": 0, "churn": 0}))
    most = rows.agg(F.max("hot_score").alias("max_hot"), F.max("complexity_score").alias("max_complexity"))
    # Churn is measured against all symbols' files, tests too.
    most_churn = symbols.select("relpath").join(lines, "relpath").agg(F.coalesce(F.max("churn"), _zero()).alias("max_churn"))
    rows = rows.crossJoin(F.broadcast(most.crossJoin(most_churn)))  # one row
    share = lambda x, m: F.when(F.col(m) > 0, F.col(x) / F.col(m)).otherwise(0.0)
    hot_n, cx_n, churn_n = share("hot_score", "max_hot"), share("complexity_score", "max_complexity"), share("churn", "max_churn")
    score = hot_n * options.weight_hot + cx_n * options.weight_complexity + F.col("architecture_hits") * options.weight_architecture + churn_n * options.weight_churn
    text = F.format_string("hot=%.2f complexity=%.2f arch_hits=%d churn=%d", hot_n, cx_n, "architecture_hits", "churn")
    return rows.withColumn("score", F.round(score, 9)).withColumn("rationale", text).withColumn("label", names.label(F.col("name"), F.col("relpath"))).drop("max_hot", "max_complexity", "max_churn")


def risk_map(scores: DataFrame, options: Risk = Risk()) -> DataFrame:
    return ranked(scores, [F.col("score").desc(), F.col("label"), F.col("symbol_id")], options.top_n).withColumn("severity", names.severity(F.col("score"), options.thresholds))


def group_risk(scores: DataFrame, level: str) -> DataFrame:
    return scores.groupBy(F.col(f"{level}_id").alias("id")).agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("count"), F.avg("score").alias("avg_score"))


def risk_suggestions(violations: DataFrame, top: DataFrame, options: Risk = Risk()) -> DataFrame:
    """ord, suggestion."""
    n = violations.agg(F.count(F.lit(1)).alias("violations"))
    t = top.agg(F.coalesce(F.sum((F.col("churn") >= options.heavy_churn).cast("bigint")), _zero()).alias("heavy"), F.coalesce(F.sum((F.col("architecture_hits") > 0).cast("bigint")), _zero()).alias("linked"))
    texts = F.array_compact(F.array(
        F.when(F.col("violations") > 0, F.format_string("%d architecture violation(s): resolve them first.", "violations")),
        F.when(F.col("heavy") > 0, F.format_string("%d top hotspot(s) change often: review them strictly.", "heavy")),
        F.when(F.col("linked") > 0, F.format_string("%d top hotspot(s) take part in violations: clean boundaries first.", "linked")),
    ))
    texts = F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit("No dominant risk driver; keep watching the trend.")))
    return n.crossJoin(t).select(F.posexplode(texts).alias("ord", "suggestion"))


def risk_trend(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: deltas of the averages and the first places, and the overlap.

    Both have rank, symbol_id, score.
    """
    sums = lambda df, p: df.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias(f"{p}_avg"), F.coalesce(F.min_by("score", "rank"), F.lit(0.0)).alias(f"{p}_first"), F.count(F.lit(1)).alias(f"{p}_n"))
    same = current.join(baseline.select("symbol_id").distinct(), "symbol_id", "left_semi").agg(F.count(F.lit(1)).alias("overlap"))
    row = sums(current, "now").crossJoin(sums(baseline, "old")).crossJoin(same)
    return row.select((F.col("now_avg") - F.col("old_avg")).alias("avg_top_score_delta"), (F.col("now_first") - F.col("old_first")).alias("top1_score_delta"), F.col("overlap").alias("top_overlap_count"), F.when(F.col("now_n") > 0, F.col("overlap") / F.col("now_n")).otherwise(0.0).alias("top_overlap_ratio"))
