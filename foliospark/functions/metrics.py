"""The metric library: formulas as expressions, and transforms of keyed series as DataFrame plans.

Each has a twin that writes the same definition as ANSI SQL where a registered
query needs one (``*_sql``). All divisions are guarded: ANSI mode would raise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- scalar formulas ---------------------------------------------------------


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def lift(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    some = (n_ab > 0) & (n_a > 0) & (n_b > 0) & (n > 0)
    return F.when(some, n_ab.cast("double") * n / (n_a.cast("double") * n_b)).otherwise(0.0)


def pmi(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    x = lift(n_ab, n_a, n_b, n)
    return F.when(x > 0, F.log2(x))


def npmi(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    p = safe_div(n_ab, n, None)
    return F.when((p > 0) & (p < 1), pmi(n_ab, n_a, n_b, n) / (-F.log2(p)))


def jaccard(n_ab: Column, n_a: Column, n_b: Column) -> Column:
    return safe_div(n_ab, n_a + n_b - n_ab)


def jaccard_sets(a: Column, b: Column) -> Column:
    return safe_div(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is (nearly) the zero vector."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na > 1e-12) & (nb > 1e-12), dot(a, b) / (na * nb)).otherwise(0.0)


def weighted_geometric_mean(parts: list[tuple[Column, float]], floor: float = 1e-6) -> Column:
    """Product of the parts, clipped to [floor, 1], by weight; null if no weight is left."""
    total = sum(w for _, w in parts)
    if total <= 0:
        return F.lit(None).cast("double")
    logs = [F.ln(F.greatest(F.least(F.coalesce(x, F.lit(0.0)), F.lit(1.0)), F.lit(floor))) * w for x, w in parts]
    return F.exp(reduce(lambda a, b: a + b, logs) / total)


def weighted_geometric_mean_sql(parts: list[tuple[str, float]], floor: float = 1e-6) -> str:
    total = sum(w for _, w in parts)
    return f"exp(({' + '.join(f'ln(greatest(least(coalesce({x}, 0.0), 1.0), {floor})) * {w}' for x, w in parts)}) / {total})"


# --- aggregates over keyed counts -------------------------------------------


def concentration(counts: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """``keys``, hhi, entropy (bits), entropy_norm, top1_share, k: over the positive values of each key, in two map-side combined steps."""
    positive = counts.where(F.col(value) > 0)
    s = F.sum(F.col(value).cast("double"))
    # sum p^2 = sum v^2 / S^2;  -sum p log p = log S - sum v log v / S
    agg = positive.groupBy(*keys).agg(
        s.alias("_s"), F.sum(F.col(value).cast("double") * F.col(value)).alias("_q"), F.sum(F.col(value) * F.log2(F.col(value).cast("double"))).alias("_l"), F.max(F.col(value).cast("double")).alias("_m"), F.count("*").alias("k")
    )
    h = F.greatest(F.lit(0.0), F.log2("_s") - F.col("_l") / F.col("_s"))
    return agg.select(*keys, (F.col("_q") / (F.col("_s") * F.col("_s"))).alias("hhi"), h.alias("entropy"), F.when(F.col("k") > 1, h / F.log2(F.col("k").cast("double"))).otherwise(0.0).alias("entropy_norm"), (F.col("_m") / F.col("_s")).alias("top1_share"), "k")


def concentration_sql(source: str, keys: str, value: str = "n") -> str:
    return f"""SELECT {keys}, sum({value} * {value}::DOUBLE) / (sum({value}) * sum({value})::DOUBLE) AS hhi,
  greatest(0.0, log2(sum({value})::DOUBLE) - sum({value} * log2({value}::DOUBLE)) / sum({value})) AS entropy,
  CASE WHEN count(*) > 1 THEN greatest(0.0, log2(sum({value})::DOUBLE) - sum({value} * log2({value}::DOUBLE)) / sum({value})) / log2(count(*)::DOUBLE) ELSE 0.0 END AS entropy_norm,
  max({value})::DOUBLE / sum({value}) AS top1_share, count(*) AS k
FROM {source} WHERE {value} > 0 GROUP BY {keys}"""


def entropy_global(counts: DataFrame, keys: list[str], kinds: int | Column, value: str = "n") -> DataFrame:
    """Entropy in nats over ln of a global number of kinds; null if that is under 2."""
    k = F.lit(kinds) if isinstance(kinds, int) else kinds
    return concentration(counts, keys, value).select(*keys, F.when(k >= 2, F.col("entropy") * F.ln(F.lit(2.0)) / F.ln(k.cast("double"))).alias("entropy_global"))


# --- yearly series -----------------------------------------------------------


def _dense(counts: DataFrame, keys: list[str], value: str, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
    """keys, _lo, _hi, year, value: zero-filled from _lo to _hi. One aggregation by the keys, which later ones by them reuse; ``counts`` is read once."""
    lo = F.lit(year_min) if year_min is not None else F.min("year")
    hi = F.lit(year_max) if year_max is not None else F.max("year")
    by_year = counts.groupBy(*keys, "year").agg(F.sum(value).alias(value))
    some = F.map_from_entries(F.collect_list(F.when(F.col("year").isNotNull(), F.struct("year", value))))  # as many as there are years
    spans = by_year.groupBy(*keys).agg(lo.alias("_lo"), hi.alias("_hi"), some.alias("_by_year")).where("_lo <= _hi")
    d = spans.select(*keys, "_lo", "_hi", "_by_year", F.explode(F.sequence("_lo", "_hi")).alias("year"))
    return d.select(*keys, "_lo", "_hi", "year", F.coalesce(F.try_element_at("_by_year", "year"), F.lit(0)).alias(value))


def dense_years(counts: DataFrame, keys: list[str], value: str = "n", year_min: int | None = None, year_max: int | None = None) -> DataFrame:
    """keys, year, value: zero-filled from each key's first year (or year_min) to its last (or year_max)."""
    return _dense(counts, keys, value, year_min, year_max).drop("_lo", "_hi")


def growth_ladder(counts: DataFrame, keys: list[str], recent: int = 3, year_max: int | None = None, value: str = "n") -> DataFrame:
    """keys, growth, method: the first rung that can be computed on the dense series.

    cagr of the recent years; their slope over their mean; the last N years
    against the N before; exp(slope of log1p) - 1; slope of log1p over all.
    One aggregation: each rung is a sum or a regression over flagged rows.
    """
    d = _dense(counts, keys, value, year_max=year_max).withColumnsRenamed({"_lo": "_a", "_hi": "_z"}).withColumn("_i", F.col("_z") - F.col("year"))
    r, y = F.col("_i") < recent, F.col(value).cast("double")
    k = F.least(F.max(F.col("_z") - F.col("_a")) + 1, F.lit(recent))
    a = d.groupBy(*keys).agg(
        (F.max(F.col("_z") - F.col("_a")) + 1).alias("_g_len"), k.alias("_g_k"),
        F.sum(F.when(F.col("_i") == F.least(F.col("_z") - F.col("_a"), F.lit(recent - 1)), y)).alias("_g_first"), F.sum(F.when(F.col("_i") == 0, y)).alias("_g_last"),
        F.regr_slope(F.when(r, y), F.when(r, -F.col("_i").cast("double"))).alias("_g_slope"), F.avg(F.when(r, y)).alias("_g_mean"), F.sum(F.when(r, y)).alias("_g_cur"),
        F.sum(F.when((F.col("_i") >= recent) & (F.col("_i") < 2 * recent), y)).alias("_g_prev"),
        F.regr_slope(F.when(r, F.log1p(y)), F.when(r, -F.col("_i").cast("double"))).alias("_g_log_slope"), F.regr_slope(F.log1p(y), -F.col("_i").cast("double")).alias("_g_log_all"),
    )
    c = lambda name: F.col(f"_g_{name}")
    rungs = [
        ("cagr", (c("k") >= 2) & (c("first") > 0) & (c("last") > 0), F.pow(F.try_divide(c("last"), c("first")), F.try_divide(F.lit(1.0), c("k") - 1)) - 1),
        ("linreg_slope_ratio", (c("k") >= 2) & c("slope").isNotNull() & (c("mean") > 0), F.try_divide(c("slope"), c("mean"))),
        ("period_over_period", (c("len") >= 2 * recent) & (c("prev") > 0), F.try_divide(c("cur") - c("prev"), c("prev"))),
        ("period_over_period_newzero", (c("len") >= 2 * recent) & (c("cur") > 0), F.lit(1.0)),
        ("poisson_trend_approx", (c("k") >= 2) & c("log_slope").isNotNull(), F.exp(c("log_slope")) - 1),
        ("log1p_slope", (c("len") >= 2) & c("log_all").isNotNull(), c("log_all")),
    ]
    growth = reduce(lambda acc, x: acc.when(x[1], x[2]), rungs[1:], F.when(rungs[0][1], rungs[0][2]))
    method = reduce(lambda acc, x: acc.when(x[1], x[0]), rungs[1:], F.when(rungs[0][1], rungs[0][0])).otherwise("insufficient")
    return a.select(*keys, growth.alias("growth"), method.alias("method"))


def growth_sql(source: str, keys: str, recent: int = 3, year_max: str = "NULL", value: str = "n", name: str = "g") -> str:
    """CTEs that end in ``name`` (keys, growth, method); ``source`` is a CTE of (keys, year, value)."""
    on = " AND ".join(f"s.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_span AS (SELECT {keys}, min(year) AS y0_, coalesce({year_max}, max(year)) AS y1_ FROM {source} GROUP BY {keys}),
{name}_years AS (SELECT {keys}, y0_, y1_, unnest(range(y0_, y1_ + 1)) AS year FROM {name}_span WHERE y0_ <= y1_),
{name}_dense AS (SELECT {', '.join('d.' + k.strip() for k in keys.split(','))}, d.y1_ - d.y0_ + 1 AS len, d.y1_ - d.year AS i, coalesce(s.v, 0)::DOUBLE AS y FROM {name}_years d LEFT JOIN (SELECT {keys}, year, sum({value}) AS v FROM {source} GROUP BY {keys}, year) s ON {on} AND s.year = d.year),
{name}_agg AS (SELECT {keys}, max(len) AS len, least(max(len), {recent}) AS k, sum(y) FILTER (i = least(len, {recent}) - 1) AS first, sum(y) FILTER (i = 0) AS last,
  regr_slope(y, -i) FILTER (i < {recent}) AS slope, avg(y) FILTER (i < {recent}) AS mean, sum(y) FILTER (i < {recent}) AS cur, sum(y) FILTER (i >= {recent} AND i < 2 * {recent}) AS prev,
  regr_slope(ln(1 + y), -i) FILTER (i < {recent}) AS log_slope, regr_slope(ln(1 + y), -i) AS log_all FROM {name}_dense GROUP BY {keys}),
{name} AS (SELECT {keys},
  CASE WHEN k >= 2 AND first > 0 AND last > 0 THEN pow(last / first, 1.0 / (k - 1)) - 1 WHEN k >= 2 AND slope IS NOT NULL AND mean > 0 THEN slope / mean
    WHEN len >= 2 * {recent} AND prev > 0 THEN (cur - prev) / prev WHEN len >= 2 * {recent} AND cur > 0 THEN 1.0 WHEN k >= 2 AND log_slope IS NOT NULL THEN exp(log_slope) - 1 WHEN len >= 2 AND log_all IS NOT NULL THEN log_all END AS growth,
  CASE WHEN k >= 2 AND first > 0 AND last > 0 THEN 'cagr' WHEN k >= 2 AND slope IS NOT NULL AND mean > 0 THEN 'linreg_slope_ratio'
    WHEN len >= 2 * {recent} AND prev > 0 THEN 'period_over_period' WHEN len >= 2 * {recent} AND cur > 0 THEN 'period_over_period_newzero' WHEN k >= 2 AND log_slope IS NOT NULL THEN 'poisson_trend_approx' WHEN len >= 2 AND log_all IS NOT NULL THEN 'log1p_slope' ELSE 'insufficient' END AS method
  FROM {name}_agg)"""


# --- normalisation -----------------------------------------------------------


def normalize(df: DataFrame, columns: dict[str, bool], pct: float = 0.02) -> DataFrame:
    """Adds norm_<c>: null to 0, log1p where asked (shifted if negative), winsorised, min-max; 0.5 if constant.

    The statistics are one row, made by aggregations and broadcast.
    """
    low = df.agg(*[F.min(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_min_{c}") for c in columns])
    shifted = df.join(F.broadcast(low))
    for c, log in columns.items():
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        shifted = shifted.withColumn(f"_v_{c}", F.log1p(v - F.least(F.col(f"_min_{c}"), F.lit(0.0))) if log else v)
    bounds = shifted.agg(*[F.percentile(f"_v_{c}", F.lit(p)).alias(f"_{side}_{c}") for c in columns for side, p in (("lo", pct), ("hi", 1 - pct))])
    out = shifted.join(F.broadcast(bounds))
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        clipped = F.greatest(F.least(F.col(f"_v_{c}"), hi), lo)
        out = out.withColumn(f"norm_{c}", F.when(hi - lo > 1e-12, F.try_divide(clipped - lo, hi - lo)).otherwise(0.5))
    return out.drop(*[f"_{p}_{c}" for c in columns for p in ("min", "v", "lo", "hi")])


def normalize_sql(source: str, columns: dict[str, bool], name: str = "nz", pct: float = 0.02) -> str:
    """CTEs that end in ``name``: ``source`` with norm_<c> columns."""
    mins = ", ".join(f"min(coalesce({c}::DOUBLE, 0.0)) AS min_{c}" for c in columns)
    vs = ", ".join(f"{f'ln(1 + coalesce(s.{c}::DOUBLE, 0.0) - least(m.min_{c}, 0.0))' if log else f'coalesce(s.{c}::DOUBLE, 0.0)'} AS v_{c}" for c, log in columns.items())
    qs = ", ".join(f"quantile_cont(v_{c}, {pct}) AS lo_{c}, quantile_cont(v_{c}, {1 - pct}) AS hi_{c}" for c in columns)
    ns = ", ".join(f"CASE WHEN hi_{c} - lo_{c} > 1e-12 THEN (greatest(least(v_{c}, hi_{c}), lo_{c}) - lo_{c}) / (hi_{c} - lo_{c}) ELSE 0.5 END AS norm_{c}" for c in columns)
    return f"""
{name}_m AS (SELECT {mins} FROM {source}),
{name}_v AS (SELECT s.*, {vs} FROM {source} s, {name}_m m),
{name}_q AS (SELECT {qs} FROM {name}_v),
{name} AS (SELECT v.*, {ns} FROM {name}_v v, {name}_q q)"""


def ratio_to_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column over its largest value, negatives as 0; all 0 if none is positive."""
    top = df.agg(*[F.max(F.col(c).cast("double")).alias(f"_top_{c}") for c in columns])
    out = df.join(F.broadcast(top))
    for c in columns:
        v = F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        out = out.withColumn(c, F.when(F.col(f"_top_{c}") > 0, F.try_divide(v, F.col(f"_top_{c}"))).otherwise(0.0))
    return out.drop(*[f"_top_{c}" for c in columns])


# --- correlation by lag, survival -------------------------------------------


def lagged_correlation(pairs: DataFrame, keys: list[str], min_overlap: int = 4) -> DataFrame:
    """keys, lag, corr, n of rows (keys, lag, x, y): the lag with the largest absolute correlation, the smallest of equal ones.

    Written with sums, since corr() of a constant series raises in ANSI mode.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    s = pairs.groupBy(*keys, "lag").agg(F.count("*").alias("n"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_c"))
    ok = s.where((F.col("n") >= min_overlap) & (F.col("_vx") > 1e-24) & (F.col("_vy") > 1e-24)).withColumn("corr", F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy")))
    best = F.max_by(F.struct("lag", "corr", "n"), F.struct(F.round(F.abs("corr"), 12), (-F.col("lag"))))
    return ok.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.lag", "_b.corr", "_b.n")


def kaplan_meier(df: DataFrame, keys: list[str], duration: str = "duration", event: str = "event") -> DataFrame:
    """keys, t, at_risk, events, survival: the product-limit curve at each event time."""
    from pyspark.sql import Window

    by_time = df.groupBy(*keys, F.col(duration).alias("t")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    down = Window.partitionBy(*keys).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    risk = by_time.withColumn("at_risk", F.sum("n").over(down))
    factor = 1 - F.col("events") / F.col("at_risk")
    logs = F.sum(F.when(factor > 0, F.ln(factor)).otherwise(0.0)).over(up)
    gone = F.max((factor <= 0).cast("int")).over(up)
    return risk.withColumn("survival", F.when(gone == 1, 0.0).otherwise(F.exp(logs))).where("events > 0").select(*keys, "t", "at_risk", "events", "survival")
