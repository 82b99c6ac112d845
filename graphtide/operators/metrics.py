"""Statistics over timing rows: full against incremental cost of the same change.

metrics: metric_id, repo, step, file_path, edits_count, full_ms, incremental_ms, same, file_size, lines_changed, op.
Percentiles are exact and interpolated linearly; floating results are rounded by the queries, not here.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtide.runtime import cut

#: Outcome codes of a comparison, and the edges of the edit-count bins.
SAME = {0: "Different", 1: "Same", 2: "New", 3: "Error"}
EDIT_BINS = (0, 1, 3, 10, 30, 100, 500)
SIZE_BINS = ((-1, 0, "None"), (0, 5, "Small"), (5, 50, "Medium"))
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
PATCH_TYPES = {"insert-decl": "Insert", "delete-stmt": "Delete", "modify-num-lit": "Modify", "rename-local": "Refactor", "add-comment": "Insert"}


def prepare(metrics: DataFrame) -> DataFrame:
    """Rows with outcome, clipped timings, speedup, extension and directory; outcomes New and Error are left out."""
    known = F.create_map(*[F.lit(x) for k, v in SAME.items() for x in (k, v)])
    clip = lambda c: F.greatest(F.coalesce(F.col(c).try_cast("double"), F.lit(0.1)), F.lit(0.1))
    out = metrics.withColumns({"outcome": F.coalesce(known[F.col("same")], F.lit("Unknown")), "full": clip("full_ms"), "incr": clip("incremental_ms")})
    parts = F.split("file_path", "/")
    return out.filter(F.col("outcome").isin("Same", "Different")).withColumns(
        {"speedup": F.col("full") / F.col("incr"), "extension": F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1), "directory": F.element_at(parts, 1), "file_name": F.element_at(parts, -1)}
    )


def mean_by(df: DataFrame, by: str, *columns: str) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def describe_by(df: DataFrame, by: str, column: str) -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.min(column).alias("min"), q.alias("q"), F.max(column).alias("max"))
    return out.select(by, "n", "mean", "sd", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def edit_bin(count: Column) -> Column:
    """Right-closed bins named (lo, hi]; null outside."""
    out = F
    for lo, hi in zip(EDIT_BINS, EDIT_BINS[1:], strict=False):
        out = out.when((count > lo) & (count <= hi), f"({lo},{hi}]")
    return out


def size_bin(lines: Column) -> Column:
    out = F
    for lo, hi, name in SIZE_BINS:
        out = out.when((lines > lo) & (lines <= hi), name)
    return out.when(lines > SIZE_BINS[-1][1], "Large")


def binned_median(df: DataFrame, column: str = "speedup") -> DataFrame:
    return df.withColumn("bin", edit_bin(F.col("edits_count"))).filter("bin IS NOT NULL").groupBy("bin").agg(F.median(column).alias("median"), F.count("*").alias("n"))


def quantile_table(df: DataFrame, *columns: str) -> DataFrame:
    """One row for each column: P10 to P90, mean and sample deviation."""
    agg = [F.struct(F.lit(c).alias("metric"), F.percentile(c, F.array(*map(F.lit, QUANTILES))).alias("q"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")) for c in columns]
    rows = df.agg(F.array(*agg).alias("a")).select(F.explode("a").alias("r"))
    return rows.select("r.metric", *[F.col("r.q")[i].alias(f"p{round(q * 100)}") for i, q in enumerate(QUANTILES)], "r.mean", "r.sd")


def fraction(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def correlations(df: DataFrame, x: str, *ys: str) -> DataFrame:
    """corr and log-log corr of each y with x, as rows."""
    ok = lambda y: (F.col(x) > 0) & (F.col(y) > 0)
    agg = [F.struct(F.lit(y).alias("metric"), F.corr(x, y).alias("r"), F.corr(F.when(ok(y), F.log10(x)), F.when(ok(y), F.log10(y))).alias("r_log")) for y in ys]
    return df.agg(F.array(*agg).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def ols_loglog(df: DataFrame, y: str, x: str) -> DataFrame:
    ok = df.filter((F.col(x) > 0) & (F.col(y) > 0)).select(F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    return ok.agg(F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"), F.regr_r2("ly", "lx").alias("r2"))


def breusch_pagan(df: DataFrame, y: str, x: str) -> DataFrame:
    """Statistic n * R2 of squared residuals on x. The two coefficients of the first pass are joined back as one row."""
    pts = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    line = pts.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    res = pts.join(F.broadcast(line)).select("x", F.pow(F.col("y") - F.col("a") - F.col("b") * F.col("x"), F.lit(2)).alias("e2"))
    return res.agg((F.count("*") * F.regr_r2("e2", "x")).alias("statistic"))


def chi2_tail_1(statistic: float) -> float:
    """P(chi-squared with one degree of freedom exceeds the statistic)."""
    return math.erfc(math.sqrt(max(statistic, 0.0) / 2))


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows before, in the order of the columns over the whole table.

    Rows are dealt in ranges of the order; the sums of whole ranges, one row for each, move the running sums inside them.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy("__range").agg(F.sum(value).alias(value))
    moved = sums.select("__range", before(Window.orderBy("__range")).alias("__before"))
    inside = ranged.withColumn(name, before(Window.partitionBy("__range").orderBy(*order)))
    return inside.join(F.broadcast(moved), "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with the number of each row, from 1, among the rows of its key in the order of the columns; no key is one task.

    Rows are dealt in ranges of key and order; a key's rows in the ranges before, one number for each range, move the numbers inside.
    """
    ranged = cut(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy(*by, "__range").agg(F.count("*").alias("__n")).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__of"), before.alias("__before"))
    inside = ranged.withColumn(name, F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order)))
    same = (F.col("__range") == F.col("__of")) & reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return inside.join(sizes, same).select(*df.columns, (F.col(name) + F.col("__before")).alias(name))


def consecutive(df: DataFrame, by: list[str], order: list[str], values: list[str], name: str = "step") -> DataFrame:
    """df with its number (name) and, as previous_<value>, the values of the row before of the same key: numbers meet, no window over a key."""
    rows = numbered(df, by, order, name)
    last = rows.select(*[F.col(c).alias(f"__{c}") for c in by], (F.col(name) + 1).alias("__next"), *[F.col(v).alias(f"previous_{v}") for v in values])
    same = (F.col(name) == F.col("__next")) & reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return rows.join(last, same, "left").select(*rows.columns, *[f"previous_{v}" for v in values])


def variance_ratio(df: DataFrame, value: str, order: str, key: str) -> DataFrame:
    """Population variance of the last quarter of the rows over that of the first, by exact ranks."""
    ranked = running_total(df.select(value, order, key, F.lit(1).alias("__one")), [order, key], "__one", "__rank")
    k = ranked.agg(F.greatest(F.floor(F.count("*") / 4), F.lit(1)).alias("__k"), F.count("*").alias("__n"))
    out = ranked.join(F.broadcast(k))
    first, last = F.col("__rank") < F.col("__k"), F.col("__rank") >= F.col("__n") - F.col("__k")
    return out.agg((F.var_pop(F.when(last, F.col(value))) / F.var_pop(F.when(first, F.col(value)))).alias("ratio"))


def local_variance(df: DataFrame, x: str, y: str, grid: list[float], width: float = 0.5) -> DataFrame:
    """Kernel-weighted variance of y around each grid point, weights exp(-|x - g| / width). Each row meets the few points once."""
    pts = df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.explode(F.array(*map(F.lit, grid))).alias("g")).withColumn("w", F.exp(-F.abs(F.col("x") - F.col("g")) / width))
    sums = pts.groupBy("g").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy"))
    mean = F.col("wy") / F.col("w")
    return sums.select("g", (F.col("wyy") / F.col("w") - mean * mean).alias("variance"))


def paired_tests(df: DataFrame, a: str, b: str) -> DataFrame:
    """t, Cohen's d with its label, and the rank sum W of positive differences (ties share their mean rank)."""
    d = df.select((F.col(a) - F.col(b)).cast("double").alias("d"))
    s = d.agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"))
    size = d.filter("d <> 0").groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("k"), F.count_if(F.col("d") > 0).alias("pos"))
    ranks = running_total(size, ["m"], "k", "before")
    w = ranks.select("pos", (F.col("before") + (F.col("k") + 1) / 2).alias("rank")).agg(F.sum(F.col("pos") * F.col("rank")).alias("w_plus"))
    dd = F.abs(F.col("m") / F.col("sd"))
    label = F.when(dd < 0.2, "negligible").when(dd < 0.5, "small").when(dd < 0.8, "medium").otherwise("large")
    return s.join(F.broadcast(w)).select((F.col("m") / (F.col("sd") / F.sqrt("n"))).alias("t"), (F.col("m") / F.col("sd")).alias("d"), label.alias("effect"), "w_plus")


def cumulative(df: DataFrame, by: str, order: list[str], *columns: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"cum_{c}": F.sum(c).over(w) for c in columns})


def melt_means(df: DataFrame, by: str, *columns: str) -> DataFrame:
    m = df.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])
    return m.unpivot(by, list(columns), "variant", "mean")


def proportions(df: DataFrame, by: str, pivot: str, values: list) -> DataFrame:
    """Shares of the pivot's values in each group; a missing one is 0."""
    c = df.groupBy(by).pivot(pivot, values).count().fillna(0)
    total = reduce(lambda a, b: a + b, [F.col(f"`{v}`") for v in values])
    return c.select(by, *[(F.col(f"`{v}`") / total).alias(f"share_{v}") for v in values])


def histogram_2d(df: DataFrame, x: str, y: str, width: float = 0.2) -> DataFrame:
    """Counts of log10 cells."""
    cell = lambda c: F.floor(F.round(F.log10(c) / width, 9)).cast("long")
    return df.filter((F.col(x) > 0) & (F.col(y) > 0)).groupBy(cell(x).alias("bx"), cell(y).alias("by")).agg(F.count("*").alias("n"))


def equal_width(df: DataFrame, column: str, value: str, bins: int = 5) -> DataFrame:
    edges = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    b = F.least(F.width_bucket(F.col(column).cast("double"), F.col("lo").cast("double"), F.col("hi").cast("double"), F.lit(bins)), F.lit(bins)).cast("long")
    return df.join(F.broadcast(edges)).groupBy(b.alias("bin")).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.count("*").alias("n"))


def availability(df: DataFrame, *columns: str) -> DataFrame:
    agg = [F.struct(F.lit(c).alias("metric"), F.count(c).alias("present"), F.count_if(F.col(c) == 0).alias("zero"), F.count_if(F.col(c).isNull()).alias("missing")) for c in columns]
    return df.agg(F.array(*agg).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


#: Size of a sketch: a rank is wrong by less than half a percent.
SKETCH_K = 800


def quantile_sketches(df: DataFrame, by: list[str], column: str, k: int = SKETCH_K) -> DataFrame:
    """(by, sketch): mergeable KLL sketches, built before the shuffle; nulls are left out. What is stored by day can be merged by month."""
    return df.filter(F.col(column).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str], k: int = SKETCH_K) -> DataFrame:
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, by: list[str], ranks: list[float]) -> DataFrame:
    """(by, n, rank, value)."""
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("rank"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("value")) for p in ranks]))
    return sketches.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), at.alias("q")).select(*by, "n", "q.rank", "q.value")
