"""Portfolio analyses, part one: totals, combinations, life cycle, opportunity, networks, trees, the chart engine.

Every function takes the standard frame and returns a tidy table. "Y" is the
latest base year of the frame unless ``year_max`` is given; recent years are the
``recent`` last ones up to Y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import metrics as M
from ..plans.stored import stored
from .expand import applicants_of, combo_counts, core_combinations, explode_applicants, explode_dimension, explode_pairs, explode_tech
from .filters import applicant_mask


def latest_year(docs: DataFrame) -> int:
    """One small aggregate; most plans need it as a number (the anchor of growth and of "recent")."""
    return docs.agg(F.max("base_year")).first()[0] or 0


def tech_year(docs: DataFrame, mode: str = "duplicate", labels: str = "tech_list") -> DataFrame:
    """tech, year, w."""
    return explode_tech(docs, mode, labels).where("base_year is not null").groupBy("tech", F.col("base_year").alias("year")).agg(F.round(F.sum("weight"), 9).alias("w"))


def company_shares(docs: DataFrame, mode: str = "all", by_year: bool = False) -> DataFrame:
    """company, [year,] tech, w, share of the company's (year's) total."""
    keys = ["company", *(["year"] if by_year else [])]
    w = explode_applicants(explode_tech(docs), mode).withColumn("year", F.col("base_year")).groupBy(*keys, "tech").agg(F.sum("weight").alias("w"))
    return w.withColumn("share", F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy(*keys))))


def overview_kpis(docs: DataFrame) -> DataFrame:
    """One row: documents, families, applicants, countries, active share of known, first and last year."""
    people = docs.select(F.explode(applicants_of()).alias("c")).agg(F.count_distinct("c").alias("n_applicants"))
    own = docs.agg(
        F.count("*").alias("n_docs"), F.count_distinct("family_id").alias("n_families"), F.count_distinct("country").alias("n_countries"), F.avg(F.col("active_flag").cast("int")).alias("active_share"), F.min("base_year").alias("year_min"), F.max("base_year").alias("year_max")
    )
    return own.join(F.broadcast(people))


def tech_growth(docs: DataFrame, recent: int = 3, min_weight: float = 3, mode: str = "duplicate") -> DataFrame:
    """tech, total, growth, method of classes with a weight of ``min_weight`` or more."""
    ty = tech_year(docs, mode)
    totals = ty.groupBy("tech").agg(F.sum("w").alias("total")).where(F.col("total") >= min_weight)
    return totals.join(M.growth_ladder(ty, ["tech"], recent, value="w"), "tech")


def new_combinations(docs: DataFrame, recent: int = 3, min_docs: int = 3, year_max: int | None = None, labels: str = "tech_list") -> DataFrame:
    """a, b, n_ab, first_year of pairs of labels first seen in the recent years."""
    y = year_max or latest_year(docs)
    return combo_counts(docs, y - recent + 1, labels).where((F.col("first_year") >= y - recent + 1) & (F.col("n_ab") >= min_docs)).select("a", "b", "n_ab", "first_year")


def strategy_change(docs: DataFrame, recent: int = 3, min_docs: int = 3, year_max: int | None = None) -> DataFrame:
    """company, change = 1 - cosine of its class shares in the recent and the previous years, and the class that gained most."""
    y = year_max or latest_year(docs)
    rows = explode_applicants(explode_tech(docs)).where((F.col("base_year") > y - 2 * recent) & (F.col("base_year") <= y))
    now = F.col("base_year") > y - recent
    n = explode_applicants(docs).where((F.col("base_year") > y - 2 * recent) & (F.col("base_year") <= y)).groupBy("company").agg(F.sum(now.cast("long")).alias("n_now"), F.sum((~now).cast("long")).alias("n_before"))
    w = rows.groupBy("company", "tech").agg(F.sum(now.cast("double")).alias("x"), F.sum((~now).cast("double")).alias("y"))
    per = Window.partitionBy("company")
    s = w.withColumn("sx", F.try_divide("x", F.sum("x").over(per))).withColumn("sy", F.try_divide("y", F.sum("y").over(per))).withColumn("gain", F.round(F.col("sx") - F.col("sy"), 9))
    cos = s.groupBy("company").agg(
        (1 - F.try_divide(F.sum(F.col("sx") * F.col("sy")), F.sqrt(F.sum(F.col("sx") * F.col("sx")) * F.sum(F.col("sy") * F.col("sy"))))).alias("change"), F.min_by("tech", F.struct(-F.col("gain"), "tech")).alias("top_gaining"), F.max("gain").alias("top_gain")
    )
    return cos.join(n, "company").where((F.col("n_now") >= min_docs) & (F.col("n_before") >= min_docs)).select("company", "change", "top_gaining", "top_gain", "n_now", "n_before")


def top_share(docs: DataFrame, k: int = 3, mode: str = "all") -> DataFrame:
    """tech, n, cr: the share of a class's documents that one of its ``k`` largest applicants takes part in."""
    rows = explode_tech(docs.select("doc_id", "tech_list", applicants_of(mode).alias("companies")))
    n = rows.groupBy("tech").agg(F.count_distinct("doc_id").alias("n"))
    by = rows.select("tech", "doc_id", F.explode("companies").alias("company"))
    rank = by.groupBy("tech", "company").agg(F.count("*").alias("c")).withColumn("r", F.row_number().over(Window.partitionBy("tech").orderBy(F.desc("c"), "company"))).where(F.col("r") <= k).select("tech", "company")
    covered = by.join(rank, ["tech", "company"]).groupBy("tech").agg(F.count_distinct("doc_id").alias("covered"))
    return n.join(covered, "tech", "left").select("tech", "n", F.try_divide(F.coalesce("covered", F.lit(0)), F.col("n")).alias("cr"))


def barrier_whitespace(docs: DataFrame, recent: int = 3, min_docs: int = 3) -> DataFrame:
    """tech, barrier = share of active grants * CR3 * ln(1 + grants), white = growth (1 - CR3) / ln(grants + 2) where it grows and CR3 < .6."""
    grants = explode_tech(docs).groupBy("tech").agg(F.sum((F.col("active_flag").eqNullSafe(True) & F.col("is_granted").eqNullSafe(True)).cast("long")).alias("ag"))
    x = top_share(docs).where(F.col("n") >= min_docs).join(grants, "tech").join(M.growth_ladder(tech_year(docs), ["tech"], recent, value="w"), "tech")
    white = F.when((F.col("growth") > 0) & (F.col("cr") < 0.6), F.col("growth") * (1 - F.col("cr")) / F.ln(F.col("ag") + 2))
    return x.select("tech", "n", "ag", F.col("cr").alias("cr3"), "growth", (F.col("ag") / F.col("n") * F.col("cr") * F.log1p("ag")).alias("barrier"), white.alias("white"))


def alerts(docs: DataFrame, as_of: str, years: int = 3, top: int = 10) -> DataFrame:
    """kind, name, value: most cited documents, applicants by citations, documents that expire within ``years``."""
    cited = docs.select(F.lit("cited").alias("kind"), F.col("doc_id").cast("string").alias("name"), F.col("cites_forward").alias("value"), "doc_id").orderBy(F.desc("value"), "doc_id").limit(top).drop("doc_id")
    companies = explode_applicants(docs).groupBy("company").agg(F.sum("cites_forward").alias("value")).orderBy(F.desc("value"), "company").limit(top).select(F.lit("company").alias("kind"), F.col("company").alias("name"), "value")
    today = F.lit(as_of).cast("date")
    soon = docs.where((F.col("expiry_date") >= today) & (F.col("expiry_date") <= F.add_months(today, 12 * years))).agg(F.count("*").cast("double").alias("value")).select(F.lit("expiring").alias("kind"), F.lit("").alias("name"), "value")
    return cited.unionByName(companies).unionByName(soon)


def network_edges(docs: DataFrame, recent: int = 3, min_docs: int = 3, max_edges: int | None = None, scope_company: str | None = None, scope: str = "any", market_excl: bool = False, settings: Settings | None = None) -> DataFrame:
    """a, b, n_ab, jaccard, lift, pmi, npmi, growth, n_new_applicants of the strongest pairs."""
    if scope_company:
        mask = applicant_mask(scope_company, scope)
        docs = docs.where(~mask if market_excl else mask)
    edges = (settings or Settings()).limit("network_max_edges") if max_edges is None else max_edges
    y = latest_year(docs)
    n_docs = docs.where(F.size("tech_list") > 0).agg(F.count("*").alias("n_docs"))
    counts = explode_tech(docs).groupBy("tech").agg(F.count("*").alias("n"))
    top = combo_counts(docs, y - recent + 1).where(F.col("n_ab") >= min_docs).orderBy(F.desc("n_ab"), "a", "b").limit(edges)
    series = explode_pairs(docs.select("base_year", "tech_list")).groupBy("a", "b", F.col("base_year").alias("year")).agg(F.count("*").alias("n"))
    series = series.join(F.broadcast(top.select("a", "b")), ["a", "b"], "left_semi")
    e = top.join(counts.select(F.col("tech").alias("a"), F.col("n").alias("n_a")), "a").join(counts.select(F.col("tech").alias("b"), F.col("n").alias("n_b")), "b").join(F.broadcast(n_docs)).join(M.growth_ladder(series, ["a", "b"], recent), ["a", "b"])
    args = [F.col(c) for c in ("n_ab", "n_a", "n_b")]
    return e.select("a", "b", "n_ab", M.jaccard(*args).alias("jaccard"), M.lift(*args, F.col("n_docs")).alias("lift"), M.pmi(*args, F.col("n_docs")).alias("pmi"), M.npmi(*args, F.col("n_docs")).alias("npmi"), "growth", "n_new_applicants")


def network_nodes(docs: DataFrame, edges: DataFrame, max_nodes: int = 80, recent: int = 3) -> DataFrame:
    """tech, n, growth, l1: the largest ends of the edges, with the most frequent first-level class beside each."""
    ends = edges.select(F.col("a").alias("tech")).union(edges.select("b")).distinct()
    rows = explode_tech(docs).join(F.broadcast(ends), "tech", "left_semi")
    n = rows.groupBy("tech").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tech").limit(max_nodes)
    l1 = rows.select("tech", F.explode("tech_l1_list").alias("l1")).groupBy("tech", "l1").agg(F.count("*").alias("c")).groupBy("tech").agg(F.min_by("l1", F.struct(-F.col("c"), "l1")).alias("l1"))
    return n.join(l1, "tech", "left").join(M.growth_ladder(tech_year(docs), ["tech"], recent, value="w"), "tech").select("tech", "n", "growth", "l1")


def emerging_combinations(docs: DataFrame, settings: Settings | None = None, year_max: int | None = None) -> DataFrame:
    """a, b, n_ab, growth (series up to Y), lift, new applicants, diversity, active ratio and the score of all, strongest first."""
    s = settings or Settings()
    recent, w = int(s.threshold("recent_years")), s.weights("emerging")
    y = year_max or latest_year(docs)
    n_docs = docs.where(F.size("tech_list") > 0).agg(F.count("*").alias("n_docs"))
    counts = explode_tech(docs).groupBy("tech").agg(F.count("*").alias("n"))
    pairs = combo_counts(docs, y - recent + 1).where(F.col("n_ab") >= s.threshold("min_combo_patents"))
    series = explode_pairs(docs.select("base_year", "tech_list")).groupBy("a", "b", F.col("base_year").alias("year")).agg(F.count("*").alias("n"))
    first = explode_tech(docs).select("tech", F.explode("tech_l1_list").alias("l1")).groupBy("tech", "l1").agg(F.count("*").alias("c")).groupBy("tech").agg(F.min_by("l1", F.struct(-F.col("c"), "l1")).alias("l1"))
    ends = counts.join(first, "tech", "left")
    x = (
        pairs.join(ends.select(F.col("tech").alias("a"), F.col("n").alias("n_a"), F.col("l1").alias("l1_a")), "a")
        .join(ends.select(F.col("tech").alias("b"), F.col("n").alias("n_b"), F.col("l1").alias("l1_b")), "b")
        .join(M.growth_ladder(series, ["a", "b"], recent, year_max=y), ["a", "b"])
        .join(F.broadcast(n_docs))
    )
    x = x.select("a", "b", "n_ab", "growth", F.greatest(F.coalesce("growth", F.lit(0.0)), F.lit(0.0)).alias("g"), M.lift(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n_docs")).alias("lift"), "n_new_applicants", F.when(F.col("l1_a") != F.col("l1_b"), 1.0).otherwise(0.5).alias("diversity"), "active_ratio")
    z = M.normalize(stored(x), {"g": False, "lift": True, "n_new_applicants": True}, s.threshold("winsor_pct"))
    score = M.weighted_geometric_mean([(F.col("norm_g"), w["growth"]), (F.col("norm_lift"), w["lift"]), (F.col("norm_n_new_applicants"), w["new_entrants"]), (F.col("diversity"), w["diversity"])])
    return z.select("a", "b", "n_ab", "growth", "lift", "n_new_applicants", "diversity", "active_ratio", score.alias("score"))


def combination_growth(combos: DataFrame, recent_from: int) -> DataFrame:
    """tech, combo_growth, adjacency: combinations first seen in recent years against older ones, and how many there are."""
    new = (F.col("first_year") >= recent_from).cast("long")
    ends = combos.select(F.col("a").alias("tech"), new.alias("new")).unionAll(combos.select("b", new))
    x = ends.groupBy("tech").agg(F.sum("new").alias("new"), F.count("*").alias("adjacency"))
    old = F.col("adjacency") - F.col("new")
    return x.select("tech", F.when(old > 0, F.try_divide((F.col("new") - old).cast("double"), old)).otherwise(F.when(F.col("new") > 0, 1.0).otherwise(0.0)).alias("combo_growth"), "adjacency")


def lifecycle(docs: DataFrame, settings: Settings | None = None, year_max: int | None = None, combos: DataFrame | None = None) -> DataFrame:
    """tech, n, growth, age, hhi, new_entrants, active_ratio, combo_growth, avg_cites, maturity, momentum, phase.

    ``combos``: ``combo_counts`` of the recent years, if they are known already.
    What is used more than once (a row for each class and company, or each class) is written.
    """
    s = settings or Settings()
    recent = int(s.threshold("recent_years"))
    y = year_max or latest_year(docs)
    rows = explode_tech(docs)
    base = rows.groupBy("tech").agg(F.count("*").alias("n"), F.min("base_year").alias("first_year"), F.avg(F.col("active_flag").cast("int")).alias("active_ratio"), F.avg("cites_forward").alias("avg_cites"))
    base = base.where(F.col("n") >= s.threshold("min_class_patents"))
    by_company = stored(rows.select("tech", "base_year", F.explode(applicants_of()).alias("company")).groupBy("tech", "company").agg(F.count("*").alias("n"), F.min("base_year").alias("lo")))
    entrants = by_company.groupBy("tech").agg(F.sum((F.col("lo") > y - recent).cast("long")).alias("new_entrants"))
    hhi = M.concentration(by_company, ["tech"]).select("tech", "hhi")
    combos = combination_growth(stored(combo_counts(docs, y - recent + 1)) if combos is None else combos, y - recent + 1).select("tech", "combo_growth")
    series = stored(tech_year(docs))
    dense = M.dense_years(series, ["tech"], "w", year_max=y)
    past = int(s.threshold("reemerging_decline_years"))
    before = F.lag("w").over(Window.partitionBy("tech").orderBy("year"))
    steps = dense.withColumn("_i", F.lit(y) - F.col("year")).withColumn("_d", F.col("w") - before)
    drop = steps.groupBy("tech").agg(
        F.regr_slope(F.when((F.col("_i") >= recent) & (F.col("_i") < recent + past), F.col("w")), F.col("year").cast("double")).alias("past_slope"),
        F.bool_and(F.when(F.col("_i") < recent - 1, F.col("_d") > 0)).alias("rises"), F.count("*").alias("years"),
    )
    x = base.join(entrants, "tech", "left").join(hhi, "tech", "left").join(combos, "tech", "left").join(M.growth_ladder(series, ["tech"], recent, year_max=y, value="w"), "tech", "left").join(drop, "tech", "left")
    x = x.withColumn("age", F.lit(y) - F.col("first_year")).withColumn("new_entrants", F.coalesce("new_entrants", F.lit(0))).withColumn("combo_growth", F.coalesce("combo_growth", F.lit(0.0)))
    z = M.normalize(stored(x.withColumn("total", F.col("n"))), {"age": False, "total": True, "growth": False, "new_entrants": True}, s.threshold("winsor_pct"))
    g = F.coalesce("growth", F.lit(0.0))
    again = F.coalesce((F.col("years") >= recent + past) & (F.col("past_slope") <= 1e-9) & F.col("rises") & (F.col("new_entrants") >= 1) & (F.col("combo_growth") > 0), F.lit(False))
    least = s.threshold("emerging_min_growth")
    phase = (
        F.when(again, "Re-emerging").when((F.col("age") <= 5) & (g >= least), "Emerging").when(g >= least, "Growing").when(g < -0.1, "Declining")
        .when((F.col("hhi") < 0.15) & (F.col("new_entrants") >= 1), "Competitive").otherwise("Mature")
    )
    return z.select("tech", "n", "growth", "age", "hhi", "new_entrants", "active_ratio", "combo_growth", "avg_cites", ((F.col("norm_age") + F.col("norm_total")) / 2).alias("maturity"), ((F.col("norm_growth") + F.col("norm_new_entrants")) / 2).alias("momentum"), phase.alias("phase"))


def basic_yearly(docs: DataFrame) -> DataFrame:
    """year, total, granted, active."""
    return docs.groupBy(F.col("base_year").alias("year")).agg(F.count("*").alias("total"), F.sum(F.col("is_granted").eqNullSafe(True).cast("long")).alias("granted"), F.sum(F.col("active_flag").eqNullSafe(True).cast("long")).alias("active"))


def crosstab(docs: DataFrame, a: Column, b: Column) -> DataFrame:
    return docs.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))


def applicant_year(docs: DataFrame, top: int = 10, mode: str = "all") -> DataFrame:
    """company, year, n of the largest applicants."""
    rows = explode_applicants(docs, mode)
    best = rows.groupBy("company").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "company").limit(top).select("company")
    return rows.join(F.broadcast(best), "company", "left_semi").groupBy("company", F.col("base_year").alias("year")).agg(F.count("*").alias("n"))


def tech_tree(docs: DataFrame, levels: list[str], least_share: float = 0.002, max_nodes: int = 400) -> DataFrame:
    """path, depth, n: documents by the first class of each level, down to the first that is empty; thin leaves are pruned."""
    firsts = [F.get(c, F.lit(0)) for c in levels]
    steps, path = [], None
    for f in firsts:
        said = f.isNotNull() & (F.trim(f) != "")
        path = F.when(said, f) if path is None else F.when(path.isNotNull() & said, F.concat_ws(" / ", path, f))
        steps.append(path)
    prefixes = F.array(*[F.struct(p.alias("path"), F.lit(i + 1).alias("depth")) for i, p in enumerate(steps)])
    nodes = docs.select(F.explode(F.filter(prefixes, lambda x: x["path"].isNotNull())).alias("p")).groupBy("p.path", "p.depth").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("total"))
    kept = nodes.join(F.broadcast(total)).where((F.col("depth") < len(levels)) | (F.col("n") >= F.greatest(F.lit(1), F.floor(F.lit(least_share) * F.col("total")))))
    return kept.orderBy("depth", F.desc("n"), "path").limit(max_nodes).select("path", "depth", "n")


def company_focus(docs: DataFrame, company: str, recent: int = 3, year_max: int | None = None) -> DataFrame:
    """tech, total, recent, prev, first_year, unknown, market share, rising, new_entry for one company."""
    y = year_max or latest_year(docs)
    year, mine = F.col("base_year"), applicant_mask(company)
    rows = explode_tech(docs.withColumn("_mine", mine))
    one = lambda c: F.sum((F.col("_mine") & c).cast("long"))
    x = rows.groupBy("tech").agg(
        one(F.lit(True)).alias("total"), one(year > y - recent).alias("recent"), one((year <= y - recent) & (year > y - 2 * recent)).alias("prev"), F.min(F.when(F.col("_mine"), year)).alias("first_year"), one(year.isNull()).alias("unknown"), F.count("*").alias("market")
    ).where("total > 0")
    mid = x.agg(F.percentile("total", F.lit(0.5)).alias("mid"))
    x = x.join(F.broadcast(mid))
    rising = (F.col("recent") >= 2) & (F.col("recent") / F.col("total") >= 0.5) & (F.col("recent") > F.col("prev")) & (F.col("total") <= F.col("mid"))
    return x.select("tech", "total", "recent", "prev", "first_year", "unknown", (F.col("total") / F.col("market")).alias("share"), F.coalesce(rising, F.lit(False)).alias("rising"), F.coalesce((F.col("first_year") > y - recent) & (F.col("unknown") == 0), F.lit(False)).alias("new_entry"))


def tech_year_bubble(docs: DataFrame, companies: list[str] | None = None, level: str = "tech_list") -> DataFrame:
    """company, tech, year, n; without companies those of the whole market ("*")."""
    if not companies:
        return explode_dimension(docs, F.col(level), "tech").groupBy(F.lit("*").alias("company"), "tech", F.col("base_year").alias("year")).agg(F.count("*").alias("n"))
    rows = explode_applicants(docs).where(F.col("company").isin(companies[:4]))
    return explode_dimension(rows, F.col(level), "tech").groupBy("company", "tech", F.col("base_year").alias("year")).agg(F.count("*").alias("n"))


def upset(docs: DataFrame, elements: int = 12, combos: int = 25) -> DataFrame:
    """combo (joined by " & "), n: documents by the exact set of their most frequent classes."""
    top = _top_labels(docs, elements)
    return core_combinations(docs, top).select(F.array_join("combo", " & ").alias("combo"), "n").orderBy(F.desc("n"), "combo").limit(combos)


def _top_labels(docs: DataFrame, k: int, labels: str = "tech_list") -> list[str]:
    return [r["tech"] for r in explode_tech(docs, labels=labels).groupBy("tech").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tech").limit(k).collect()]


def upset_gaps(docs: DataFrame, elements: int = 8, least_expected: float = 1.5, top: int = 15, labels: str = "tech_list") -> DataFrame:
    """combo, expected, actual, gap: sets of 2 or 3 labels that occur far less often than if labels were independent.

    All sets of at most ``elements`` labels are counted in one aggregation.
    """
    from itertools import combinations

    column, labels = labels, _top_labels(docs, elements, labels)
    sets = [c for k in (2, 3) for c in combinations(sorted(labels), k)]
    schema = "combo string, expected double, actual long, gap double"
    if not sets:
        return docs.sparkSession.createDataFrame([], schema)
    tracked = docs.where(F.arrays_overlap(column, F.array(*map(F.lit, labels))))
    has = {x: F.array_contains(column, x) for x in labels}
    both = [F.sum(F.expr(" AND ".join(f"h{labels.index(x)}" for x in s)).cast("long")).alias(f"s{i}") for i, s in enumerate(sets)]
    flags = tracked.select(*[has[x].alias(f"h{i}") for i, x in enumerate(labels)])
    row = flags.agg(F.count("*").alias("n"), *[F.sum(F.col(f"h{i}").cast("long")).alias(f"e{i}") for i in range(len(labels))], *both)
    parts = []
    for i, s in enumerate(sets):
        expected = F.col("n").cast("double")
        for x in s:
            expected = expected * F.try_divide(F.col(f"e{labels.index(x)}"), F.col("n"))
        parts.append(F.struct(F.lit(" & ".join(s)).alias("combo"), F.round(expected, 9).alias("expected"), F.col(f"s{i}").alias("actual")))
    x = row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    kept = x.where((F.col("expected") >= least_expected) & (F.col("actual") <= F.greatest(F.lit(1.0), 0.15 * F.col("expected"))))
    return kept.withColumn("gap", F.col("expected") - F.col("actual")).orderBy(F.desc("gap"), "combo").limit(top)


# --- the chart engine ---------------------------------------------------------

def dimension(name: str) -> Column:
    """An expression (scalar or array) for each dimension name of the chart engine."""
    table = {
        "year": lambda: F.col("base_year"), "reg_year": lambda: F.year("reg_date"), "applicant": applicants_of, "owner": lambda: F.col("owner"), "country": lambda: F.upper(F.trim("country")), "status": lambda: F.col("legal_status"),
        "tech": lambda: F.col("tech_list"), "tech_l1": lambda: F.col("tech_l1_list"), "tech_l2": lambda: F.col("tech_l2_list"), "tech_l3": lambda: F.col("tech_l3_list"), "axis_b": lambda: F.col("tech_b_list"), "axis_c": lambda: F.col("tech_c_list"),
        "inventor": lambda: F.col("inventors"), "agent": lambda: F.col("agents"), "ipc": lambda: F.col("ipc_list"), "granted": lambda: F.when(F.col("is_granted"), "yes").when(~F.col("is_granted"), "no"), "active": lambda: F.when(F.col("active_flag"), "yes").when(~F.col("active_flag"), "no"), "first_country": lambda: F.upper("first_filing_country"),
    }
    return table[name]()


MEASURES = {
    "count": lambda: F.count("*").cast("double"), "families": lambda: F.count_distinct("family_id").cast("double"), 
    "avg_cites": lambda: F.avg("cites_forward"), "sum_cites": lambda: F.sum("cites_forward"), "avg_claims": lambda: F.avg("claims_count"), "sum_claims": lambda: F.sum("claims_count"), "avg_family_size": lambda: F.avg("family_size"),
    "grant_rate": lambda: F.avg(F.col("is_granted").cast("int")), "active_rate": lambda: F.avg(F.col("active_flag").cast("int")), "joint_rate": lambda: F.avg((F.size("co_applicants") >= 2).cast("int")), "avg_confidence": lambda: F.avg("class_confidence"),
}


#: Measures that count the distinct members of a list column.
LISTED = {"applicants": "co_applicants", "inventors": "inventors", "techs": "tech_list"}


def _measured(rows: DataFrame, names: list[str], measures: list[str]) -> DataFrame:
    """``names`` and the measures; members of lists are exploded and counted in two steps, never gathered."""
    out = rows.groupBy(*names).agg(F.count("*").alias("_n"), *[MEASURES[m]().alias(m) for m in measures if m not in LISTED])
    for m in measures:
        if m in LISTED:
            members = rows.select(*names, F.explode(LISTED[m]).alias("_x")).groupBy(*names).agg(F.count_distinct("_x").cast("double").alias(m))
            out = out.join(members, names, "left").na.fill(0.0, [m])
    return out.select(*names, *measures)


def custom_chart(docs: DataFrame, dims: list[str], measures: list[str], top: int = 20) -> DataFrame:
    """The generic group-by: one or two dimensions, any measures over the distinct documents of each group.

    The ``top`` (2 to 40) values of each dimension by the first measure are kept; years are all kept.
    """
    top = max(2, min(40, top))
    rows, names = docs, []
    for i, d in enumerate(dims):
        rows = explode_dimension(rows, dimension(d), name := f"dim{i + 1}")
        names.append(name)
    for d, name in zip(dims, names, strict=True):
        if not d.endswith("year"):
            best = _measured(rows, [name], measures[:1]).select(name, F.round(measures[0], 9).alias("_m")).orderBy(F.desc("_m"), name).limit(top).select(name)
            rows = rows.join(F.broadcast(best), name, "left_semi")
    return _measured(rows, names, measures)


# --- two axes, advanced statistics, quality, options ---------------------------


def axis_matrix(docs: DataFrame, a: str = "tech_b_list", b: str = "tech_c_list", top: int = 15) -> DataFrame:
    """a, b, n of the largest values of two axes."""
    rows = explode_dimension(explode_dimension(docs, F.col(a), "a"), F.col(b), "b")
    for c in "ab":
        best = rows.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(top).select(c)
        rows = rows.join(F.broadcast(best), c, "left_semi")
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"))


def axis_entropy(matrix: DataFrame, least: int = 5) -> DataFrame:
    """a, total, entropy_norm: of rows with ``least`` documents or more, in nats over ln of the number of columns."""
    columns = matrix.agg(F.count_distinct("b").alias("k"))
    totals = matrix.groupBy("a").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    e = M.concentration(matrix, ["a"]).select("a", "entropy").join(F.broadcast(columns))
    return totals.join(e, "a").select("a", "total", F.when(F.col("k") >= 2, F.col("entropy") / F.log2(F.col("k").cast("double"))).alias("entropy_norm"))


def axis_triples(docs: DataFrame, top: int = 120) -> DataFrame:
    rows = explode_dimension(explode_dimension(explode_dimension(docs, F.col("tech_l1_list"), "a"), F.col("tech_b_list"), "b"), F.col("tech_c_list"), "c")
    return rows.groupBy("a", "b", "c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b", "c").limit(top)


def problem_solution(docs: DataFrame, rows: int = 40, columns: int = 40, recent: int = 3, top: int = 3) -> DataFrame:
    """problem, solution, n, growth, active_ratio, top applicants of each cell of the C x B matrix."""
    cells = explode_dimension(explode_dimension(docs, F.col("tech_c_list"), "problem"), F.col("tech_b_list"), "solution")
    for c, k in (("problem", rows), ("solution", columns)):
        best = cells.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(k).select(c)
        cells = cells.join(F.broadcast(best), c, "left_semi")
    key = ["problem", "solution"]
    base = cells.groupBy(*key).agg(F.count("*").alias("n"), F.avg(F.col("active_flag").cast("int")).alias("active_ratio"))
    series = cells.groupBy(*key, F.col("base_year").alias("year")).agg(F.count("*").alias("n"))
    who = cells.select(*key, F.explode(applicants_of()).alias("company")).groupBy(*key, "company").agg(F.count("*").alias("c"))
    ranked = who.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("c"), "company"))).where(F.col("r") <= top)
    names = ranked.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "company"))), lambda x: x["company"]), ", ").alias("top_applicants"))
    return base.join(M.growth_ladder(series, key, recent), key).join(names, key).select(*key, "n", "growth", "active_ratio", "top_applicants")


def cell_detail(docs: DataFrame, problem: str, solution: str, recent: int = 3) -> DataFrame:
    """One row: n, growth, active_ratio, opportunity of one cell."""
    d = docs.where(F.array_contains("tech_c_list", problem) & F.array_contains("tech_b_list", solution)).withColumn("cell", F.lit(f"{problem} / {solution}"))
    g = M.growth_ladder(d.groupBy("cell", F.col("base_year").alias("year")).agg(F.count("*").alias("n")), ["cell"], recent)
    x = d.groupBy("cell").agg(F.count("*").alias("n"), F.avg(F.col("active_flag").cast("int")).alias("active_ratio")).join(g, "cell")
    up = F.greatest(F.coalesce("growth", F.lit(0.0)), F.lit(0.0))
    return x.select("cell", "n", "growth", "active_ratio", (up / (1 + up) * (1 - F.coalesce("active_ratio", F.lit(0.0)))).alias("opportunity"))


def cell_view(docs: DataFrame, problem: str, solution: str, top: int = 5, claim: str = "indep_claim", most: int = 600) -> DataFrame:
    """part, name, n: a cell's documents by year, its ``top`` applicants, and the first claim by doc_id (``most`` characters, n null) where the frame has claims."""
    d = docs.where(F.array_contains("tech_c_list", problem) & F.array_contains("tech_b_list", solution))
    years = d.where("base_year is not null").groupBy("base_year").agg(F.count("*").alias("n")).select(F.lit("year").alias("part"), F.col("base_year").cast("string").alias("name"), "n")
    people = explode_applicants(d).groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(top).select(F.lit("applicant").alias("part"), F.col("company").alias("name"), "n")
    out = years.unionByName(people)
    if claim not in docs.columns:
        return out
    said = d.where(F.trim(claim) != "").agg(F.min_by(F.substring(claim, 1, most), "doc_id").alias("name")).where("name is not null")
    return out.unionByName(said.select(F.lit("claim").alias("part"), "name", F.lit(None).cast("long").alias("n")))


def own_capability(docs: DataFrame, own: Column) -> DataFrame:
    """tech, n_own, capability: 1 where documents under ``own`` have the class, 0.5 where it stands beside one of their classes, else 0; null without own documents.

    The own classes are one broadcast list; a class's neighbours are those it shares a document with.
    """
    mine = F.coalesce(own, F.lit(False))
    known = docs.where(mine).select(F.explode("tech_list").alias("t")).agg(F.collect_set("t").alias("_own"))
    marked = docs.withColumn("_mine", mine).select("tech_list", "_mine").join(F.broadcast(known)).withColumn("_near", F.arrays_overlap("tech_list", "_own"))
    x = marked.select(F.explode("tech_list").alias("tech"), "_mine", "_near", (F.size("_own") > 0).alias("_any"))
    per = x.groupBy("tech").agg(F.count_if("_mine").alias("n_own"), F.max("_near").alias("near"), F.max("_any").alias("any"))
    return per.select("tech", "n_own", F.when(F.col("any"), F.when(F.col("n_own") > 0, 1.0).when(F.col("near"), 0.5).otherwise(0.0)).alias("capability"))


def months_to_grant(docs: DataFrame, key: Column) -> DataFrame:
    """key, n, avg_months of documents granted after 0 and within 240 months."""
    m = F.datediff("reg_date", "app_date") / 30.44
    return docs.withColumn("_m", m).where((F.col("_m") > 0) & (F.col("_m") <= 240)).groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.avg("_m").alias("avg_months"))


def claim_bins(docs: DataFrame, column: str = "claims_count", edges: tuple[int, ...] = (0, 5, 10, 15, 20, 30, 1000)) -> DataFrame:
    """bin, n, avg_cites: right-closed bins."""
    label = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        hit = (F.col(column) > lo) & (F.col(column) <= hi)
        label = F.when(hit, f"({lo}, {hi}]") if label is None else label.when(hit, f"({lo}, {hi}]")
    return docs.withColumn("bin", label).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("cites_forward").alias("avg_cites"))


def co_applicants(docs: DataFrame, top: int = 100) -> DataFrame:
    """a, b, n of applicants that file together."""
    return explode_pairs(docs.select("co_applicants"), "co_applicants").groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(top)


def expiry_by_year(docs: DataFrame) -> DataFrame:
    return docs.where("expiry_date is not null").groupBy(F.year("expiry_date").alias("year")).agg(F.count("*").alias("n"), F.sum(F.col("active_flag").eqNullSafe(True).cast("long")).alias("active"))


def quality_report(docs: DataFrame, as_of_year: int) -> DataFrame:
    """check, value, passed: the data checks, from one wide aggregation."""
    blank = lambda c: F.sum((F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("long"))
    x = docs.agg(
        F.count("*").alias("n"), F.count("base_year").alias("with_year"), F.sum((F.col("base_year") > as_of_year).cast("long")).alias("future"), blank("applicant").alias("no_applicant"), F.count_distinct("doc_id").alias("ids"),
        F.sum((F.col("reg_date") < F.col("app_date")).cast("long")).alias("reg_first"), F.sum(((F.size("tech_list") > 0) & (F.size("tech_l1_list") == 0)).cast("long")).alias("orphans"), F.sum((F.col("legal_status") != "Unknown").cast("long")).alias("with_status"), F.count("cites_forward").alias("with_cites"),
    )
    n = F.col("n")
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), n), F.lit(0.0))
    checks = [
        ("year_sum", F.col("with_year").cast("double"), F.col("with_year") <= n), ("year_coverage", ratio("with_year"), ratio("with_year") >= 0.9), ("future_years", F.col("future").cast("double"), F.col("future") == 0),
        ("applicant_coverage", 1 - ratio("no_applicant"), ratio("no_applicant") <= 0.1), ("duplicate_ids", (n - F.col("ids")).cast("double"), n == F.col("ids")), ("registered_before_filed", F.col("reg_first").cast("double"), F.col("reg_first") == 0),
        ("orphan_levels", F.col("orphans").cast("double"), F.col("orphans") == 0), ("status_coverage", ratio("with_status"), ratio("with_status") >= 0.8), ("citations", ratio("with_cites"), ratio("with_cites") > 0),
    ]
    return x.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("value"), F.coalesce(p, F.lit(False)).alias("passed")) for k, v, p in checks])).alias("c")).select("c.*")


def filter_options(docs: DataFrame, top: int = 50) -> DataFrame:
    """facet, value, n: the most frequent values of each filter."""
    from ..functions.parse import clean_options

    facets = {"applicant": applicants_of(), "country": F.array("country"), "legal_status": F.array("legal_status"), "tech": F.col("tech_list"), "tech_l1": F.col("tech_l1_list")}
    named = lambda k: lambda x: F.struct(F.lit(k).alias("facet"), x.alias("value"))
    rows = docs.select(F.explode(F.concat(*[F.transform(v, named(k)) for k, v in facets.items()])).alias("f")).select("f.*")
    counts = rows.where(F.col("value").isNotNull() & clean_options(F.col("value"))).groupBy("facet", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).where(F.col("_r") <= top).drop("_r")


def _said(docs: DataFrame, columns: list[str]) -> Column:
    """The parts of the texts ``columns`` between commas and semicolons."""
    texts = F.concat_ws(",", *[F.col(c) for c in columns if c in docs.columns]) if any(c in docs.columns for c in columns) else F.lit("")
    return F.array_distinct(F.array_remove(F.transform(F.split(texts, "[;,]"), lambda x: F.trim(x)), ""))


def opportunity(docs: DataFrame, settings: Settings | None = None, year_max: int | None = None, as_of: str | None = None, keywords: Column | None = None, problems: Column | None = None) -> DataFrame:
    """tech, attractiveness, barrier, entry and score, with their parts beside them so that other weights are a projection.

    ``keywords`` are the words of product and process, ``problems`` the one of
    problem, unless other list columns are given.
    """
    keywords = _said(docs, ["product", "process"]) if keywords is None else keywords
    if problems is None:
        problems = F.array(F.trim("problem")) if "problem" in docs.columns else F.array().cast("array<string>")
    docs = docs.withColumns({"_keywords": keywords, "_problems": F.filter(problems, lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "nan"))})
    s = settings or Settings()
    recent, w = int(s.threshold("recent_years")), s.weights("opportunity")
    y = year_max or latest_year(docs)
    rows = explode_tech(docs)
    found = stored(combo_counts(docs, y - recent + 1))
    life = lifecycle(docs, s, y, found).select("tech", "n", "growth", "new_entrants", "combo_growth")
    said = rows.select("tech", "doc_id", F.explode("_problems").alias("p"))
    problems = said.groupBy("tech").agg((1 - F.count_distinct("p") / F.count_distinct("doc_id")).alias("problem_recurrence"))
    late = (F.col("base_year") > y - recent).cast("int")
    words = rows.select("tech", late.alias("late"), F.explode("_keywords").alias("k")).groupBy("tech").agg(F.count_distinct(F.when(F.col("late") == 1, F.col("k"))).alias("now"), F.count_distinct(F.when(F.coalesce("late", F.lit(0)) == 0, F.col("k"))).alias("old"))
    words = words.select("tech", F.when(F.col("old") > 0, F.try_divide((F.col("now") - F.col("old")).cast("double"), F.col("old"))).otherwise(F.when(F.col("now") > 0, 1.0).otherwise(0.0)).alias("keyword_growth"))
    combos = found.where(F.col("n_ab") >= s.threshold("min_combo_patents"))
    degree = combination_growth(combos, y - recent + 1).select("tech", "adjacency")
    # The most cited tenth of a class, over its distinct counts of citations: as many rows as there are of those.
    per = Window.partitionBy("tech")
    cites = rows.groupBy("tech", "cites_forward").agg(F.count("*").alias("c")).withColumn("_n", F.sum("c").over(per))
    upto = F.sum("c").over(per.orderBy(F.desc_nulls_last("cites_forward")).rowsBetween(Window.unboundedPreceding, 0))
    taken = F.greatest(F.lit(0), F.least(F.col("c"), F.greatest(F.floor(F.col("_n") / 10), F.lit(1)) - (F.col("_upto") - F.col("c"))))
    cites = cites.withColumn("_upto", upto)
    core = cites.groupBy("tech").agg(F.coalesce(F.try_divide(F.sum(taken * F.col("cites_forward")), F.sum(F.col("c") * F.col("cites_forward"))), F.lit(0.0)).alias("core_share"))
    today = F.lit(as_of).cast("date") if as_of else F.make_date(F.lit(y), F.lit(12), F.lit(31))
    left = F.datediff("expiry_date", today) / 365.25
    rights = rows.groupBy("tech").agg(
        F.sum((F.col("active_flag").eqNullSafe(True) & F.col("is_granted").eqNullSafe(True)).cast("long")).alias("active_grants"), F.avg(F.size("family_countries").cast("double")).alias("family_countries"), F.coalesce(F.avg(F.when(left > 0, left)), F.lit(0.0)).alias("years_left")
    )
    x = life.join(problems, "tech", "left").join(words, "tech", "left").join(degree, "tech", "left").join(core, "tech", "left").join(rights, "tech", "left").join(top_share(docs).select("tech", F.col("cr").alias("cr3")), "tech", "left")
    x = x.withColumns({c: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)) for c, v in (("g", "growth"), ("combo_growth", "combo_growth"), ("keyword_growth", "keyword_growth"))}).withColumn("adjacency", F.coalesce("adjacency", F.lit(0)))
    parts = ["g", "new_entrants", "combo_growth", "keyword_growth", "problem_recurrence", "adjacency"]
    walls = ["active_grants", "cr3", "core_share", "family_countries", "years_left"]
    z = M.normalize(stored(x), {c: c in ("new_entrants", "adjacency", "active_grants", "family_countries", "years_left") for c in parts + walls}, s.threshold("winsor_pct"))
    names = ["growth", *parts[1:]]
    attr = M.weighted_geometric_mean([(F.col(f"norm_{c}"), w[n]) for c, n in zip(parts, names, strict=True)])
    barrier = sum((F.col(f"norm_{c}") for c in walls), F.lit(0.0)) / len(walls)
    z = z.withColumn("attractiveness", attr).withColumn("barrier", barrier).withColumn("entry", 1 - F.least(F.col("barrier") * w["barrier"], F.lit(1.0)))
    return z.select("tech", "n", *parts[1:], F.col("g").alias("growth"), *walls, "attractiveness", "barrier", "entry", (F.col("attractiveness") * F.greatest("entry", F.lit(1e-3))).alias("score"))
