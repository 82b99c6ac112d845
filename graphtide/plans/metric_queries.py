"""Queries over metric rows: statistics of full and incremental timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtide.operators import metrics as M
from graphtide.plans.adapters import METRICS_SQL, metrics
from graphtide.plans.catalog import query

PREPARED_SQL = METRICS_SQL + """,
p AS MATERIALIZED (SELECT *, CASE same WHEN 0 THEN 'Different' WHEN 1 THEN 'Same' END AS outcome, greatest(CAST(full_ms AS DOUBLE), 0.1) AS "full", greatest(CAST(incremental_ms AS DOUBLE), 0.1) AS incr,
  greatest(CAST(full_ms AS DOUBLE), 0.1) / greatest(CAST(incremental_ms AS DOUBLE), 0.1) AS speedup, regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1) AS extension, split_part(file_path, '/', 1) AS directory, split_part(file_path, '/', -1) AS file_name
  FROM metrics WHERE same IN (0, 1))
"""
W, WP = f"WITH {METRICS_SQL} ", f"WITH {PREPARED_SQL} "


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prepare(metrics(spark, sf_dir))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("prepare_rows", WP + "SELECT metric_id, outcome, \"full\", incr, round(speedup, 6) AS speedup, extension, directory, file_name FROM p")
def prepare_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_prepared(spark, sf_dir).select("metric_id", "outcome", "full", "incr", "speedup", "extension", "directory", "file_name"))


@query("mean_by_outcome", WP + "SELECT outcome, round(avg(\"full\"), 6) AS mean_full, round(avg(incr), 6) AS mean_incr FROM p GROUP BY 1")
def mean_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.mean_by(_prepared(spark, sf_dir), "outcome", "full", "incr"))


@query("describe_by_same", WP + "SELECT outcome, count(speedup) AS n, round(avg(speedup), 6) AS mean, round(stddev_samp(speedup), 6) AS sd, round(min(speedup), 6) AS min, round(quantile_cont(speedup, 0.25), 6) AS q25, round(quantile_cont(speedup, 0.5), 6) AS q50, round(quantile_cont(speedup, 0.75), 6) AS q75, round(max(speedup), 6) AS max FROM p GROUP BY 1")
def describe_by_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.describe_by(_prepared(spark, sf_dir), "outcome", "speedup"))


_BIN = "CASE " + " ".join(f"WHEN edits_count > {a} AND edits_count <= {b} THEN '({a},{b}]'" for a, b in zip(M.EDIT_BINS, M.EDIT_BINS[1:], strict=False)) + " END"


@query("binned_median", WP + f"SELECT bin, round(median(speedup), 6) AS median, count(*) AS n FROM (SELECT *, {_BIN} AS bin FROM p) WHERE bin IS NOT NULL GROUP BY bin")
def binned_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.binned_median(_prepared(spark, sf_dir)))


_Q = ", ".join(f"round(quantile_cont(v, {q}), 6) AS p{round(q * 100)}" for q in M.QUANTILES)


@query("speedup_summary", WP + ", u AS (SELECT 'speedup' AS metric, speedup AS v FROM p UNION ALL SELECT 'full', \"full\" FROM p UNION ALL SELECT 'incr', incr FROM p UNION ALL SELECT 'file_size', CAST(file_size AS DOUBLE) FROM p UNION ALL SELECT 'edits_count', CAST(edits_count AS DOUBLE) FROM p) " + f"SELECT metric, {_Q}, round(avg(v), 6) AS mean, round(stddev_samp(v), 4) AS sd FROM u GROUP BY 1")
def speedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.quantile_table(_prepared(spark, sf_dir), "speedup", "full", "incr", "file_size", "edits_count")
    return _rounded(out.withColumn("sd", F.round("sd", 4)))


@query("general_summary", WP + "SELECT count(*) AS n, round(avg(CAST(speedup > 1 AS INT)), 6) AS share_faster, round(corr(\"full\", file_size), 6) AS r_full, round(corr(incr, file_size), 6) AS r_incr FROM p")
def general_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_prepared(spark, sf_dir).agg(F.count("*").alias("n"), M.fraction(F.col("speedup") > 1).alias("share_faster"), F.corr("full", "file_size").alias("r_full"), F.corr("incr", "file_size").alias("r_incr")))


@query("corr_loglog", WP + "SELECT metric, round(corr(x, y), 6) AS r, round(corr(log10(x), log10(y)), 6) AS r_log FROM (SELECT 'full' AS metric, \"full\" AS y, CAST(file_size AS DOUBLE) AS x FROM p UNION ALL SELECT 'incr', incr, file_size FROM p UNION ALL SELECT 'edits_count', edits_count, file_size FROM p) GROUP BY 1")
def corr_loglog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.correlations(_prepared(spark, sf_dir), "file_size", "full", "incr", "edits_count"))


@query("ols_loglog", WP + "SELECT round(regr_slope(log10(\"full\"), log10(file_size)), 6) AS slope, round(regr_intercept(log10(\"full\"), log10(file_size)), 6) AS intercept, round(regr_r2(log10(\"full\"), log10(file_size)), 6) AS r2 FROM p")
def ols_loglog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.ols_loglog(_prepared(spark, sf_dir), "full", "file_size"))


@query("breusch_pagan", WP + ", l AS (SELECT regr_slope(incr, edits_count) AS b, regr_intercept(incr, edits_count) AS a FROM p) SELECT round(count(*) * regr_r2(e2, x), 4) AS statistic FROM (SELECT CAST(edits_count AS DOUBLE) AS x, pow(incr - a - b * edits_count, 2) AS e2 FROM p, l)")
def breusch_pagan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.breusch_pagan(_prepared(spark, sf_dir), "incr", "edits_count"), 4)


@query("variance_ratio", WP + ", o AS (SELECT incr, row_number() OVER (ORDER BY file_size, metric_id) AS r, count(*) OVER () AS n FROM p) SELECT round(var_pop(incr) FILTER (r > n - n // 4) / var_pop(incr) FILTER (r <= n // 4), 6) AS ratio FROM o")
def variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.variance_ratio(_prepared(spark, sf_dir), "incr", "file_size", "metric_id"))


@query("local_variance", WP + ", k AS (SELECT g, exp(-abs(log10(file_size) - g) / 0.5) AS w, incr AS y FROM p, (VALUES (CAST(4 AS DOUBLE)), (CAST(4.5 AS DOUBLE)), (CAST(5 AS DOUBLE)), (CAST(5.5 AS DOUBLE))) v(g)) SELECT g, round(sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2), 3) AS variance FROM k GROUP BY g")
def local_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _prepared(spark, sf_dir).withColumn("lx", F.log10("file_size"))
    return _rounded(M.local_variance(p, "lx", "incr", [4.0, 4.5, 5.0, 5.5]), 3)


@query("paired_tests", WP + ", d AS (SELECT \"full\" - incr AS d FROM p), s AS (SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM d), r AS (SELECT d, (min(i) OVER (PARTITION BY abs(d)) + max(i) OVER (PARTITION BY abs(d))) / 2 AS rk FROM (SELECT d, row_number() OVER (ORDER BY abs(d)) AS i FROM d WHERE d <> 0)) SELECT round(m / (sd / sqrt(n)), 6) AS t, round(m / sd, 6) AS d, CASE WHEN abs(m / sd) < 0.2 THEN 'negligible' WHEN abs(m / sd) < 0.5 THEN 'small' WHEN abs(m / sd) < 0.8 THEN 'medium' ELSE 'large' END AS effect, round((SELECT sum(rk) FILTER (d > 0) FROM r), 6) AS w_plus FROM s")
def paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.paired_tests(_prepared(spark, sf_dir), "full", "incr"))


@query("cumulative_by_dir", W + "SELECT metric_id, repo, CAST(sum(full_ms) OVER w AS BIGINT) AS cum_full_ms, CAST(sum(incremental_ms) OVER w AS BIGINT) AS cum_incremental_ms FROM metrics WINDOW w AS (PARTITION BY file_path ORDER BY step, metric_id ROWS UNBOUNDED PRECEDING)")
def cumulative_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cumulative(metrics(spark, sf_dir), "file_path", ["step", "metric_id"], "full_ms", "incremental_ms").select("metric_id", "repo", "cum_full_ms", "cum_incremental_ms")


@query("melt_means", WP + "SELECT repo, 'full' AS variant, round(avg(\"full\"), 6) AS mean FROM p GROUP BY 1 UNION ALL SELECT repo, 'incr', round(avg(incr), 6) FROM p GROUP BY 1")
def melt_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.melt_means(_prepared(spark, sf_dir), "repo", "full", "incr"))


@query("pivot_proportion", W + "SELECT op, round(count(*) FILTER (same = 0) / count(*), 6) AS share_0, round(count(*) FILTER (same = 1) / count(*), 6) AS share_1, round(count(*) FILTER (same = 2) / count(*), 6) AS share_2, round(count(*) FILTER (same = 3) / count(*), 6) AS share_3 FROM metrics GROUP BY 1")
def pivot_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.proportions(metrics(spark, sf_dir), "op", "same", [0, 1, 2, 3]))


@query("hist2d", WP + "SELECT CAST(floor(round(log10(file_size) / 0.2, 9)) AS BIGINT) AS bx, CAST(floor(round(log10(\"full\") / 0.2, 9)) AS BIGINT) AS by, count(*) AS n FROM p GROUP BY ALL")
def hist2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.histogram_2d(_prepared(spark, sf_dir), "file_size", "full")


@query("trend_by_step", WP + "SELECT repo, op, step, count(*) FILTER (outcome = 'Same') AS n_same, round(avg(\"full\"), 6) AS mean_full, round(avg(incr), 6) AS mean_incr, round(median(speedup), 6) AS median_speedup FROM p GROUP BY ALL")
def trend_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_prepared(spark, sf_dir).groupBy("repo", "op", "step").agg(F.count_if(F.col("outcome") == "Same").alias("n_same"), F.avg("full").alias("mean_full"), F.avg("incr").alias("mean_incr"), F.median("speedup").alias("median_speedup")))


@query("by_extension", WP + "SELECT extension, count(*) AS n, round(avg(speedup), 6) AS mean_speedup, CAST(sum(file_size) AS BIGINT) AS bytes FROM p GROUP BY 1")
def by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _prepared(spark, sf_dir).groupBy("extension").agg(F.count("*").alias("n"), F.avg("speedup").alias("mean_speedup"), F.sum("file_size").alias("bytes"))
    return _rounded(out.orderBy(F.desc("n")))


@query("equal_width_bins", WP + ", e AS (SELECT min(file_size) AS lo, max(file_size) AS hi FROM p) SELECT least(CAST(floor(5.0 * (file_size - lo) / (hi - lo)) AS BIGINT) + 1, 5) AS bin, round(avg(speedup), 6) AS mean, round(median(speedup), 6) AS median, count(*) AS n FROM p, e GROUP BY 1")
def equal_width_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.equal_width(_prepared(spark, sf_dir), "file_size", "speedup"))


@query("availability_matrix", "SELECT 'l_discount' AS metric, count(l_discount) AS present, count(*) FILTER (l_discount = 0) AS zero, count(*) FILTER (l_discount IS NULL) AS missing FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax), count(*) FILTER (l_tax = 0), count(*) FILTER (l_tax IS NULL) FROM lineitem UNION ALL SELECT 'odd', count(CASE WHEN l_partkey % 2 = 1 THEN l_partkey END), count(*) FILTER (l_partkey % 2 = 1 AND l_partkey = 0), count(*) FILTER (l_partkey % 2 = 0) FROM lineitem")
def availability_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_discount", "l_tax", F.when(F.col("l_partkey") % 2 == 1, F.col("l_partkey")).alias("odd"))
    return M.availability(li, "l_discount", "l_tax", "odd")


@query("sketch_quantiles", W + "SELECT repo, CAST(rank AS DOUBLE) AS rank, count(*) AS n, true AS within FROM metrics, (VALUES (0.1), (0.25), (0.5), (0.75), (0.9)) v(rank) GROUP BY ALL")
def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of full timings from sketches by step, merged by repository; each is checked against the exact ranks of its value."""
    m = metrics(spark, sf_dir).select("repo", "step", F.col("full_ms").cast("double").alias("x"))
    merged = M.merge_sketches(M.quantile_sketches(m, ["repo", "step"], "x"), ["repo"])
    q = M.sketch_quantiles(merged, ["repo"], [0.1, 0.25, 0.5, 0.75, 0.9])
    ranked = m.join(q, "repo").groupBy("repo", "rank", "n").agg(F.avg((F.col("x") < F.col("value")).cast("int")).alias("low"), F.avg((F.col("x") <= F.col("value")).cast("int")).alias("high"))
    return ranked.select("repo", "rank", "n", F.col("rank").between(F.col("low") - 0.01, F.col("high") + 0.01).alias("within"))


@query("kpis", W + "SELECT count(*) AS n, count(*) FILTER (same = 1) AS n_same, count(DISTINCT repo) AS n_repos, round(100 * avg(CAST(same = 1 AS INT)), 6) AS pct_same FROM metrics")
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("same") == 1
    return _rounded(metrics(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(s).alias("n_same"), F.countDistinct("repo").alias("n_repos"), (100 * M.fraction(s)).alias("pct_same")))


@query("size_bins", WP + "SELECT bin, count(*) AS n, round(quantile_cont(incr, 0.25), 6) AS q25, round(quantile_cont(incr, 0.5), 6) AS q50, round(quantile_cont(incr, 0.75), 6) AS q75 FROM (SELECT *, CASE WHEN lines_changed > -1 AND lines_changed <= 0 THEN 'None' WHEN lines_changed <= 5 THEN 'Small' WHEN lines_changed <= 50 THEN 'Medium' ELSE 'Large' END AS bin FROM p) GROUP BY bin")
def size_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("incr", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = _prepared(spark, sf_dir).withColumn("bin", M.size_bin(F.col("lines_changed"))).groupBy("bin").agg(F.count("*").alias("n"), q.alias("q"))
    return _rounded(out.select("bin", "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75")))


@query("speedup_by_patch_type", W + "SELECT op, round(quantile_cont(CAST(full_ms AS DOUBLE) / nullif(incremental_ms, 0), 0.25), 6) AS q25, round(quantile_cont(CAST(full_ms AS DOUBLE) / nullif(incremental_ms, 0), 0.5), 6) AS q50, round(quantile_cont(CAST(full_ms AS DOUBLE) / nullif(incremental_ms, 0), 0.75), 6) AS q75 FROM metrics GROUP BY op")
def speedup_by_patch_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.col("full_ms").cast("double") / F.nullif(F.col("incremental_ms"), F.lit(0).cast("long")).cast("double")
    out = metrics(spark, sf_dir).withColumn("ratio", ratio).groupBy("op").agg(F.percentile("ratio", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return _rounded(out.select("op", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75")))


@query("category_timings", WP + "SELECT CASE WHEN op = '5-LOW' THEN 'Refactor' ELSE 'Other' END AS category, variant, round(median(v), 6) AS median, count(*) AS n FROM (SELECT op, 'full' AS variant, \"full\" AS v FROM p UNION ALL SELECT op, 'incr', incr FROM p) GROUP BY ALL")
def category_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _prepared(spark, sf_dir).select(F.when(F.col("op") == "5-LOW", "Refactor").otherwise("Other").alias("category"), "full", "incr")
    return _rounded(p.unpivot("category", ["full", "incr"], "variant", "v").groupBy("category", "variant").agg(F.median("v").alias("median"), F.count("*").alias("n")))


@query("profile_top20", "SELECT p_type, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM (SELECT p_type, count(*) AS n FROM part WHERE contains(p_type, 'A') GROUP BY 1) ORDER BY n DESC, p_type LIMIT 20")
def profile_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares are of all that pass the filter, not of the twenty."""
    g = spark.read.parquet(f"{sf_dir}/part.parquet").filter(F.contains("p_type", F.lit("A"))).groupBy("p_type").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.orderBy(F.desc("n"), "p_type").limit(20).join(F.broadcast(total)).select("p_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))


@query("top_speedups", WP + "SELECT metric_id, round(speedup, 6) AS speedup FROM p ORDER BY p.speedup DESC, metric_id LIMIT 10")
def top_speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.top(_prepared(spark, sf_dir), 10, F.desc("speedup"), F.asc("metric_id")).select("metric_id", "speedup"))


@query("slow_small_edits", WP + "SELECT metric_id, edits_count, round(speedup, 6) AS speedup FROM p WHERE speedup < 1 AND edits_count < 5")
def slow_small_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_prepared(spark, sf_dir).filter("speedup < 1 AND edits_count < 5").select("metric_id", "edits_count", "speedup"))


@query("select_filter", W + "SELECT metric_id, repo, op FROM metrics WHERE repo IN ('repo1', 'repo3') AND op IN ('2-HIGH', '5-LOW') AND coalesce(contains(file_path, 'm3'), false)")
def select_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir)
    return m.filter(F.col("repo").isin("repo1", "repo3") & F.col("op").isin("2-HIGH", "5-LOW") & F.coalesce(F.contains("file_path", F.lit("m3")), F.lit(False))).select("metric_id", "repo", "op")


@query("drop_first_per_group", W + "SELECT metric_id, repo FROM metrics QUALIFY row_number() OVER (PARTITION BY repo, step ORDER BY metric_id) > 1")
def drop_first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the first row of each group: the groups' first rows are found by aggregation and taken away."""
    m = metrics(spark, sf_dir)
    first = m.groupBy("repo", "step").agg(F.min("metric_id").alias("metric_id"))
    return m.join(first, ["repo", "step", "metric_id"], "left_anti").select("metric_id", "repo")


@query("conditional_override", W + "SELECT metric_id, CASE WHEN incremental_ms > 400 THEN incremental_ms ELSE full_ms END AS used_ms, abs(full_ms - incremental_ms) AS gap_ms, round(file_size / 1024.0, 6) AS kb, lines_changed IS NOT NULL AS has_lines FROM metrics")
def conditional_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir)
    used = F.when(F.col("incremental_ms") > 400, F.col("incremental_ms")).otherwise(F.col("full_ms"))
    return m.select("metric_id", used.alias("used_ms"), F.abs(F.col("full_ms") - F.col("incremental_ms")).alias("gap_ms"), F.round(F.col("file_size") / 1024.0, 6).alias("kb"), F.col("lines_changed").isNotNull().alias("has_lines"))


@query("union_by_name", "SELECT 'customer' AS src, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("customer").alias("src"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("supplier").alias("src"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("previous_state", W + "SELECT metric_id, lag(full_ms) OVER w AS previous_full, full_ms - lag(full_ms) OVER w AS delta FROM metrics WINDOW w AS (PARTITION BY file_path ORDER BY step, metric_id)")
def previous_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("file_path").orderBy("step", "metric_id")
    return metrics(spark, sf_dir).select("metric_id", F.lag("full_ms").over(w).alias("previous_full"), (F.col("full_ms") - F.lag("full_ms").over(w)).alias("delta"))
