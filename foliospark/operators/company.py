"""Portfolio analyses, part two: companies, transitions, lead and lag, value indices, ownership, executives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import metrics as M
from .core import company_shares, latest_year, tech_year
from .expand import applicants_of, explode_applicants, explode_pairs, explode_tech
from .filters import applicant_mask
from .ranking import ranked, with_ties

# Gross national income in trillion dollars, the weight of a country's market.
GNI = {
    "US": 27.5, "CN": 19.0, "DE": 4.6, "JP": 4.3, "IN": 3.6, "GB": 3.5, "FR": 3.2, "IT": 2.3, "CA": 2.2, "BR": 2.2, "RU": 2.0, "KR": 1.8, "AU": 1.7,
    "MX": 1.6, "ES": 1.6, "ID": 1.4, "NL": 1.1, "SA": 1.1, "TR": 1.1, "CH": 1.0, "PL": 0.85, "TW": 0.8, "SE": 0.66, "BE": 0.63, "AR": 0.6, "IE": 0.55,
    "TH": 0.53, "IL": 0.52, "AT": 0.52, "NO": 0.5, "SG": 0.5, "PH": 0.47, "BD": 0.46, "VN": 0.44, "MY": 0.43, "DK": 0.43, "AE": 0.5, "ZA": 0.4,
    "EG": 0.4, "HK": 0.4, "PK": 0.37, "RO": 0.35, "CZ": 0.33, "CL": 0.3, "FI": 0.3, "PT": 0.29, "NZ": 0.26, "GR": 0.24, "HU": 0.2, "SK": 0.13, "LU": 0.06,
    "EP": 11.3, "WO": 0.0,
}
GNI_OTHER = 0.1
# Country names that stand for codes.
COUNTRY_NAMES = {
    "한국": "KR", "대한민국": "KR", "미국": "US", "일본": "JP", "중국": "CN", "유럽": "EP", "독일": "DE", "프랑스": "FR", "영국": "GB", "대만": "TW", "인도": "IN",
    "캐나다": "CA", "호주": "AU", "러시아": "RU", "브라질": "BR", "스페인": "ES", "이탈리아": "IT", "네덜란드": "NL", "스위스": "CH", "스웨덴": "SE", "멕시코": "MX",
    "인도네시아": "ID", "터키": "TR", "싱가포르": "SG", "홍콩": "HK", "이스라엘": "IL", "베트남": "VN", "태국": "TH", "PCT": "WO", "국제": "WO", "기타": "XX",
}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def country_codes(items: Column) -> Column:
    """Distinct codes of list items such as ``한국-1``, ``US(2)`` or ``EP``; an item with a count of 0 is none."""
    count = lambda x: F.regexp_extract(x, r"[\s\-–—:(]+(\d+)\s*\)?\s*$", 1)
    bare = lambda x: F.trim(F.regexp_replace(x, r"[\s\-–—:(]+(\d+)\s*\)?\s*$", ""))
    named = lambda x: F.coalesce(*[F.when(F.contains(F.upper(x), F.lit(k)), v) for k, v in COUNTRY_NAMES.items()])  # noqa: E731  the first name that the item holds
    code = lambda x: F.coalesce(named(x), F.nullif(F.upper(F.regexp_extract(x, r"\b([A-Za-z]{2})\b", 1)), F.lit("")))
    some = F.filter(items, lambda x: (count(x) == "") | (count(x).try_cast("int") != 0))
    return F.array_distinct(F.filter(F.transform(some, lambda x: code(bare(x))), lambda x: x.isNotNull()))


def market_coverage(codes: Column) -> Column:
    """Income of the countries over that of the US; null without a country."""
    sums = F.aggregate(codes, F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(_map(GNI), x), F.lit(GNI_OTHER)))
    return F.when(F.size(codes) > 0, sums / GNI["US"])


def with_coverage(docs: DataFrame, known: float = 0.3) -> DataFrame:
    """``docs`` and mc: market coverage by income where the country lists of a share of ``known`` or more can be read, else countries (or family members) over their mean, else 1; times the status's weight."""
    names = set(docs.columns)
    has = lambda c: F.col(c).cast("double") if c in names else F.lit(None).cast("double")
    lists = country_codes(F.col("family_countries")) if "family_countries" in names else F.array().cast("array<string>")
    count = F.coalesce(has("family_country_count"), F.size("family_countries").cast("double") if "family_countries" in names else F.lit(None).cast("double"))
    x = docs.withColumns({"_gni": market_coverage(lists), "_count": count, "_size": has("family_size")})
    s = x.agg(
        F.avg(F.col("_gni").isNotNull().cast("double")).alias("_known"), F.percentile("_gni", F.lit(0.5)).alias("_median"), F.count("_count").alias("_counts"), F.count("_size").alias("_sizes"),
        F.avg(F.coalesce("_count", F.lit(0.0))).alias("_mean_count"), F.avg(F.coalesce("_size", F.lit(0.0))).alias("_mean_size"), F.max((F.col("legal_status") != "Unknown").cast("int")).alias("_told"),
    )
    over = lambda v, mean: F.coalesce(F.col(v), F.lit(0.0)) / F.when(F.col(mean) > 0, F.col(mean)).otherwise(1.0)
    cover = F.when(F.col("_known") >= known, F.coalesce("_gni", "_median")).when(F.col("_counts") > 0, over("_count", "_mean_count")).when(F.col("_sizes") > 0, over("_size", "_mean_size")).otherwise(1.0)
    # Weights of a right by its status; without any known status all count alike.
    status = F.when(F.col("_told") == 0, 1.0).when(F.col("legal_status") == "Granted-Active", 1.0).when(F.col("legal_status") == "Pending", 0.7).when(F.col("legal_status") == "Unknown", 1.0).otherwise(0.0)
    return x.join(F.broadcast(s)).withColumn("mc", cover * status).select(*docs.columns, "mc")


def technology_relevance(docs: DataFrame, cohort_class: Column, year: Column, least: int = 5) -> DataFrame:
    """``docs`` and tr: citations over the mean of the (year, class) cohort if it has ``least`` documents, else of the year's, else of all; a mean of 0 is passed over."""
    x = docs.withColumns({"_k": cohort_class, "_y": year, "cites_forward": F.coalesce("cites_forward", F.lit(0.0))})
    cells = x.groupBy("_y", "_k").agg(F.avg("cites_forward").alias("_mc"), F.count("cites_forward").alias("_nc"))
    years = x.groupBy("_y").agg(F.avg("cites_forward").alias("_my"))
    whole = x.agg(F.avg("cites_forward").alias("_m"))
    j = x.join(cells, (x["_y"].eqNullSafe(cells["_y"])) & x["_k"].eqNullSafe(cells["_k"]), "left").drop(cells["_y"]).drop(cells["_k"]).join(years, "_y", "left").join(F.broadcast(whole))
    mean = F.when((F.col("_nc") >= least) & (F.col("_mc") > 0), F.col("_mc")).when(F.col("_my") > 0, F.col("_my")).otherwise(F.col("_m"))
    return j.withColumn("tr", F.coalesce(F.try_divide("cites_forward", mean), F.lit(0.0))).drop("_k", "_y", "_mc", "_nc", "_my", "_m")


def portfolio_index(docs: DataFrame, companies: list[str] | None = None, settings: Settings | None = None) -> DataFrame:
    """company, scope, n, tr, mc and pai (the sum of tr * mc) over active documents, or granted ones if the data set has no active ones, or all.

    The scope is one for the data set; companies with fewer documents in it than
    a class needs are left out.
    """
    field = F.upper(F.substring(F.regexp_replace(F.get("ipc_list", F.lit(0)), " ", ""), 1, 4)) if "ipc_list" in docs.columns else F.lit(None)
    year = F.coalesce(F.year("pub_date"), "base_year") if "pub_date" in docs.columns else F.col("base_year")
    t = with_coverage(technology_relevance(docs, F.coalesce(field, F.get("tech_list", F.lit(0))), year))
    act, gr = F.col("active_flag").eqNullSafe(True), F.col("is_granted").eqNullSafe(True)
    scope = F.when(F.max(act.cast("int")) == 1, "active").when(F.max(gr.cast("int")) == 1, "granted").otherwise("all").alias("scope")
    t = t.join(F.broadcast(docs.agg(scope)))
    t = t.where((F.col("scope") == "all") | ((F.col("scope") == "active") & act) | ((F.col("scope") == "granted") & gr))
    rows = explode_applicants(t)
    if companies:
        rows = rows.where(F.col("company").isin(companies))
    s = rows.groupBy("company", "scope").agg(F.count("*").alias("n"), *[F.sum(F.round(v, 9)).alias(k) for k, v in (("_tr", F.col("tr")), ("_mc", F.col("mc")), ("pai", F.col("tr") * F.col("mc")))])
    return s.where(F.col("n") >= (settings or Settings()).threshold("min_class_patents")).select("company", "scope", "n", (F.col("_tr") / F.col("n")).alias("tr"), (F.col("_mc") / F.col("n")).alias("mc"), "pai")


def dna_metrics(docs: DataFrame, settings: Settings | None = None, year_max: int | None = None, companies: list[str] | None = None) -> DataFrame:
    """company, n and twelve measures of its portfolio."""
    s = settings or Settings()
    recent, y = int(s.threshold("recent_years")), year_max or latest_year(docs)
    rows = explode_applicants(docs)
    if companies:
        rows = rows.where(F.col("company").isin(companies))
    granted = F.col("is_granted").eqNullSafe(True)
    base = rows.groupBy("company").agg(
        F.count("*").alias("n"), F.avg(F.size("family_countries").cast("double")).alias("intl_scope"), F.avg("cites_forward").alias("avg_citations"), F.avg((F.size("co_applicants") >= 2).cast("int")).alias("co_apply_ratio"),
        F.try_divide(F.sum((granted & F.col("active_flag").eqNullSafe(True)).cast("double")), F.sum(granted.cast("double"))).alias("grant_keep_ratio"),
    )
    techs = explode_tech(rows).groupBy("company", "tech").agg(F.count("*").alias("n"), F.max((F.col("base_year") > y - recent).cast("int")).alias("now"), F.max((F.col("base_year") <= y - recent).cast("int")).alias("old"))
    conc = M.concentration(techs, ["company"]).select("company", F.col("hhi").alias("tech_concentration"), F.col("entropy_norm").alias("tech_diversity"))
    entry = techs.groupBy("company").agg(F.try_divide(F.sum(((F.col("now") == 1) & (F.col("old") == 0)).cast("double")), F.sum(F.greatest("now", "old"))).alias("new_class_entry"))
    combos = explode_pairs(rows.select("company", "tech_list")).groupBy("company", "a", "b").agg(F.lit(1).alias("x")).groupBy("company").agg(F.count("*").alias("combos"))
    inventors = rows.select("company", F.explode("inventors").alias("i")).groupBy("company", "i").agg(F.count("*").alias("n"))
    people = M.concentration(inventors, ["company"]).select("company", F.col("hhi").alias("inventor_concentration"))
    families = rows.groupBy("company", "family_id").agg(F.count("*").alias("c")).groupBy("company").agg(F.avg("c").alias("family_size"), F.avg((F.col("c") >= 2).cast("int")).alias("continuation_ratio"))
    growth = M.growth_ladder(rows.where("base_year is not null").groupBy("company", F.col("base_year").alias("year")).agg(F.count("*").alias("n")), ["company"], recent, year_max=y).select("company", F.col("growth").alias("recent_growth"))
    x = base
    for part in (conc, entry, combos, people, families, growth):
        x = x.join(part, "company", "left")
    return x.select("company", "n", "tech_concentration", "tech_diversity", "new_class_entry", (F.coalesce("combos", F.lit(0)) / F.col("n")).alias("combo_diversity"), "family_size", "intl_scope", "grant_keep_ratio", "avg_citations", "continuation_ratio", "co_apply_ratio", "inventor_concentration", "recent_growth")


DNA = ["tech_concentration", "tech_diversity", "new_class_entry", "combo_diversity", "family_size", "intl_scope", "grant_keep_ratio", "avg_citations", "continuation_ratio", "co_apply_ratio", "inventor_concentration", "recent_growth"]


# Company types in the order in which they are tried. A measure is "high" from the cutoff on, "low" up to 1 - cutoff,
# or at least a number; a group of measures in one condition needs one of them.
DNA_TYPES: list[tuple[str, list[tuple[tuple[str, ...], str | float]]]] = [
    ("선도 개척형", [(("new_class_entry",), "high"), (("recent_growth",), "high"), (("avg_citations",), 0.5)]),
    ("권리 장벽형", [(("grant_keep_ratio",), "high"), (("family_size", "intl_scope"), 0.5)]),
    ("집중 방어형", [(("tech_concentration",), "high"), (("tech_diversity",), "low")]),
    ("융합 확장형", [(("combo_diversity",), "high"), (("tech_diversity",), 0.5)]),
    ("추격 확장형", [(("recent_growth",), "high"), (("avg_citations",), "low")]),
    ("양적 출원형", [(("n_rank",), 0.7), (("avg_citations",), "low"), (("grant_keep_ratio",), "low")]),
]
DNA_OTHER = "균형형"


def dna_types(metrics: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """company, type and the measures over their largest value; the first of DNA_TYPES whose conditions hold names the type.

    n_rank is the share of companies with as many documents or fewer.
    """
    x = M.ratio_to_max(metrics, DNA)
    total = metrics.agg(F.count("*").alias("_k"))
    x = with_ties(x, [F.col("n").asc()], ["n"], "_upto", "max").join(F.broadcast(total)).withColumn("n_rank", F.col("_upto") / F.col("_k"))

    def holds(names: tuple[str, ...], level: str | float) -> Column:
        tests = [F.col(c) <= 1 - cutoff if level == "low" else F.col(c) >= (cutoff if level == "high" else level) for c in names]
        return reduce(Column.__or__, tests)

    kind = reduce(lambda out, rule: out.when(reduce(Column.__and__, [holds(*c) for c in rule[1]]), rule[0]), DNA_TYPES, F)
    return x.select("company", kind.otherwise(DNA_OTHER).alias("type"), "n_rank", *DNA)


def portfolio_overlap(docs: DataFrame, companies: list[str] | None = None) -> DataFrame:
    """a, b, cosine of class shares, jaccard of class sets, for a < b. A self-join on the class, never on all pairs of companies."""
    s = company_shares(docs)
    if companies:
        s = s.where(F.col("company").isin(companies))
    size = s.groupBy("company").agg(F.sqrt(F.sum(F.round(F.col("share") * F.col("share"), 15))).alias("norm"), F.count("*").alias("k"))
    l, r = s.select(F.col("company").alias("a"), "tech", F.col("share").alias("x")), s.select(F.col("company").alias("b"), "tech", F.col("share").alias("y"))
    both = l.join(r, "tech").where("a < b").groupBy("a", "b").agg(F.sum(F.round(F.col("x") * F.col("y"), 15)).alias("d"), F.count("*").alias("both"))
    j = both.join(size.select(F.col("company").alias("a"), F.col("norm").alias("na"), F.col("k").alias("ka")), "a").join(size.select(F.col("company").alias("b"), F.col("norm").alias("nb"), F.col("k").alias("kb")), "b")
    return j.select("a", "b", (F.col("d") / (F.col("na") * F.col("nb"))).alias("cosine"), (F.col("both") / (F.col("ka") + F.col("kb") - F.col("both"))).alias("jaccard"))


def transition(docs: DataFrame, mode: str = "cooccurrence", years: int = 3, top: int = 120) -> DataFrame:
    """source, target, weight between the last ``years`` years and those before.

    applicant and family (or continuation): a key's classes before and after,
    1 / (before * after) each; cooccurrence: how much more often two classes meet.
    """
    y = latest_year(docs)
    now, before = F.col("base_year") > y - years, (F.col("base_year") <= y - years) & (F.col("base_year") > y - 2 * years)
    if mode == "cooccurrence":
        p = explode_pairs(docs.select("base_year", "tech_list").where(now | before))
        x = p.groupBy("a", "b").agg((F.sum(now.cast("long")) - F.sum(before.cast("long"))).alias("d")).where("d > 0")
        out = x.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("d").cast("double").alias("weight"))
    else:
        if mode not in ("applicant", "family", "continuation"):
            raise ValueError(f"unknown transition mode {mode!r}")
        key = "applicant" if mode == "applicant" else "family_id"
        t = explode_tech(docs.where(now | before).where(F.col(key).isNotNull()))
        old = t.where(before).select(key, F.col("tech").alias("source")).distinct().withColumn("_s", F.count("*").over(Window.partitionBy(key)))
        new = t.where(now).select(key, F.col("tech").alias("target")).distinct().withColumn("_t", F.count("*").over(Window.partitionBy(key)))
        out = old.join(new, key).groupBy("source", "target").agg(F.sum(F.round(F.lit(1.0) / (F.col("_s") * F.col("_t")), 12)).alias("weight"))
    return out.withColumn("weight", F.round("weight", 9)).orderBy(F.desc("weight"), "source", "target").limit(top)


def net_inflow(links: DataFrame) -> DataFrame:
    """tech, inflow, outflow, net."""
    ends = links.select(F.col("target").alias("tech"), F.col("weight").alias("i"), F.lit(0.0).alias("o")).unionAll(links.select("source", F.lit(0.0), "weight"))
    return ends.groupBy("tech").agg(F.sum("i").alias("inflow"), F.sum("o").alias("outflow"), F.sum(F.col("i") - F.col("o")).alias("net"))


def lead_lag(docs: DataFrame, settings: Settings | None = None, min_repeat: int = 1) -> DataFrame:
    """leader, follower, n_obs, avg_lag, avg_corr, strength: class by class, pairs of companies whose yearly counts correlate best at a lag."""
    s = settings or Settings()
    max_lag, least = int(s.threshold("max_lag_years")), int(s.threshold("min_years_leadlag"))
    rows = explode_applicants(explode_tech(docs)).where("base_year is not null")
    top = explode_applicants(docs).groupBy("company").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "company").limit(s.limit("leadlag_max_companies")).select("company")
    w = rows.join(F.broadcast(top), "company", "left_semi").groupBy("tech", "company", F.col("base_year").alias("year")).agg(F.sum("weight").alias("w"))
    span = w.groupBy("tech").agg(F.min("year").alias("lo"), F.max("year").alias("hi"), F.count_distinct("year").alias("k")).where(F.col("k") >= least)
    able = w.groupBy("tech", "company").agg(F.sum("w").alias("total")).where(F.col("total") >= s.threshold("min_patents_leadlag"))
    grid = able.join(span, "tech").select("tech", "company", F.explode(F.sequence("lo", "hi")).alias("year"))
    dense = grid.join(w, ["tech", "company", "year"], "left").select("tech", "company", "year", F.coalesce("w", F.lit(0.0)).alias("w"))
    lagged = dense.select("tech", F.col("company").alias("b"), F.col("w").alias("y"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"), "year").withColumn("year", F.col("year") - F.col("lag"))
    pairs = dense.select("tech", F.col("company").alias("a"), F.col("w").alias("x"), "year").join(lagged, ["tech", "year"]).where("a < b")
    best = M.lagged_correlation(pairs, ["tech", "a", "b"], least).where((F.col("corr") >= s.threshold("leadlag_min_corr")) & (F.col("lag") != 0))
    obs = best.select("tech", F.when(F.col("lag") > 0, F.col("a")).otherwise(F.col("b")).alias("leader"), F.when(F.col("lag") > 0, F.col("b")).otherwise(F.col("a")).alias("follower"), F.abs("lag").alias("lag"), "corr")
    g = obs.groupBy("leader", "follower").agg(F.count("*").alias("n_obs"), F.avg("lag").alias("avg_lag"), (F.sum(F.round("corr", 9)) / F.count("*")).alias("avg_corr"))
    return g.where(F.col("n_obs") >= min_repeat).select("leader", "follower", "n_obs", "avg_lag", "avg_corr", (F.col("avg_corr") * F.col("n_obs")).alias("strength"))


def trajectory_shares(docs: DataFrame, weighting: str = "share", least_docs: int = 3, least_years: int = 2) -> DataFrame:
    """company, year, tech, value: yearly share vectors, on demand times ln((K + 1) / (p + 1)) + 1 of the class's spread over companies."""
    sh = company_shares(docs, by_year=True)
    n = explode_applicants(docs).groupBy("company", F.col("base_year").alias("year")).agg(F.count("*").alias("c")).where(F.col("c") >= least_docs)
    n = n.withColumn("_y", F.count("*").over(Window.partitionBy("company"))).where(F.col("_y") >= least_years).select("company", "year")
    x = sh.join(n, ["company", "year"])
    if weighting == "share":
        return x.select("company", "year", "tech", F.col("share").alias("value"))
    k = x.agg(F.count_distinct("company").alias("K"))
    p = x.groupBy("tech").agg(F.count_distinct("company").alias("p"))
    return x.join(p, "tech").join(F.broadcast(k)).select("company", "year", "tech", (F.col("share") * (F.ln((F.col("K") + 1) / (F.col("p") + 1)) + 1)).alias("value"))


def path_lengths(shares: DataFrame) -> DataFrame:
    """company, steps, length: how far a company's vector moves from one of its years to the next, in all dimensions."""
    years = shares.select("company", "year").distinct().withColumn("prev", F.lag("year").over(Window.partitionBy("company").orderBy("year"))).where("prev is not null")
    now = years.join(shares, ["company", "year"]).select("company", "year", "tech", F.col("value").alias("d"))
    then = years.join(shares.withColumnRenamed("year", "prev"), ["company", "prev"]).select("company", "year", "tech", (-F.col("value")).alias("d"))
    step = now.unionByName(then).groupBy("company", "year", "tech").agg(F.sum("d").alias("d")).groupBy("company", "year").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("step"))
    return step.groupBy("company").agg(F.count("*").alias("steps"), F.sum("step").alias("length"))


def scope_entropy(docs: DataFrame, dims: dict[str, Column] | None = None, companies: int = 6) -> DataFrame:
    """company, dimension, entropy over the number of kinds in all the data, top1_share."""
    dims = dims or {"tech": F.col("tech_list"), "axis_b": F.col("tech_b_list"), "axis_c": F.col("tech_c_list"), "country": F.col("family_countries"), "inventor": F.col("inventors")}
    rows = explode_applicants(docs)
    top = rows.groupBy("company").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "company").limit(companies).select("company")
    named = lambda k: lambda x: F.struct(F.lit(k).alias("dimension"), x.cast("string").alias("value"))
    long = rows.select("company", F.explode(F.concat(*[F.transform(v, named(k)) for k, v in dims.items()])).alias("d")).select("company", "d.*")
    counts = long.groupBy("company", "dimension", "value").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("dimension").agg(F.count_distinct("value").alias("kinds"))
    c = M.concentration(counts.join(F.broadcast(top), "company", "left_semi"), ["company", "dimension"]).join(F.broadcast(kinds), "dimension")
    return c.select("company", "dimension", F.when(F.col("kinds") >= 2, F.col("entropy") / F.log2(F.col("kinds").cast("double"))).alias("entropy"), "top1_share")


def yearly_entropy(docs: DataFrame, least: int = 3) -> DataFrame:
    """company, year, entropy of its classes over the number of classes in all the data, of years with ``least`` documents."""
    rows = explode_applicants(docs).withColumnRenamed("base_year", "year")
    n = rows.groupBy("company", "year").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    counts = explode_tech(rows).groupBy("company", "year", "tech").agg(F.count("*").alias("n"))
    kinds = counts.agg(F.count_distinct("tech").alias("kinds"))
    e = M.concentration(counts, ["company", "year"]).join(n, ["company", "year"]).join(F.broadcast(kinds))
    return e.select("company", "year", F.when(F.col("kinds") >= 2, F.col("entropy") / F.log2(F.col("kinds").cast("double"))).alias("entropy"))


def scope_strategy(entropies: DataFrame, eps: float = 0.03) -> DataFrame:
    """company, last3, prior3, peak_year, strategy: whether a company's classes widen, narrow or stay."""
    w = Window.partitionBy("company").orderBy(F.desc("year"))
    x = entropies.withColumn("_r", F.row_number().over(w))
    g = x.groupBy("company").agg(F.avg(F.when(F.col("_r") <= 3, F.col("entropy"))).alias("last3"), F.avg(F.when((F.col("_r") > 3) & (F.col("_r") <= 6), F.col("entropy"))).alias("prior3"), F.min_by("year", F.struct(-F.round("entropy", 9), "year")).alias("peak_year"))
    d = F.col("last3") - F.col("prior3")
    return g.select("company", "last3", "prior3", "peak_year", F.when(d.isNull(), "unknown").when(d > eps, "widening").when(d < -eps, "narrowing").otherwise("steady").alias("strategy"))


def ownership_edges(docs: DataFrame) -> DataFrame:
    """source (applicant), target (owner), n of documents whose owner isn't their lead applicant."""
    return docs.where((F.col("owner") != F.col("applicant")) & (F.trim("owner") != "")).groupBy(F.col("applicant").alias("source"), F.col("owner").alias("target")).agg(F.count("*").alias("n"))


def ownership_balance(docs: DataFrame) -> DataFrame:
    """company, acquired, divested, net: a full outer join written as one union and aggregation."""
    e = ownership_edges(docs)
    both = e.select(F.col("target").alias("company"), F.col("n").alias("acquired"), F.lit(0).cast("long").alias("divested")).unionAll(e.select("source", F.lit(0).cast("long"), "n"))
    return both.groupBy("company").agg(F.sum("acquired").alias("acquired"), F.sum("divested").alias("divested"), F.sum(F.col("acquired") - F.col("divested")).alias("net"))


def ownership_quality(docs: DataFrame, least: int = 5) -> DataFrame:
    """transferred, n, avg_cites, active_rate of groups with ``least`` documents."""
    moved = F.coalesce((F.col("owner") != F.col("applicant")) & (F.trim("owner") != ""), F.lit(False))
    return docs.groupBy(moved.alias("transferred")).agg(F.count("*").alias("n"), F.avg("cites_forward").alias("avg_cites"), F.avg(F.col("active_flag").cast("int")).alias("active_rate")).where(F.col("n") >= least)


def ownership_by_tech(docs: DataFrame) -> DataFrame:
    """tech, n, transferred, rate."""
    moved = F.coalesce((F.col("owner") != F.col("applicant")) & (F.trim("owner") != ""), F.lit(False)).cast("long")
    return explode_tech(docs).groupBy("tech").agg(F.count("*").alias("n"), F.sum(moved).alias("transferred"), F.avg(moved).alias("rate"))


# --- executives ----------------------------------------------------------------


def pick_focal(docs: DataFrame) -> str | None:
    r = explode_applicants(docs).groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").first()
    return r["company"] if r else None


def company_ranks(docs: DataFrame, recent: int = 3, year_max: int | None = None) -> DataFrame:
    """company, n, rank, share of documents, growth up to Y."""
    y = year_max or latest_year(docs)
    rows = explode_applicants(docs)
    n = rows.groupBy("company").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("total"))
    g = M.growth_ladder(rows.where("base_year is not null").groupBy("company", F.col("base_year").alias("year")).agg(F.count("*").alias("n")), ["company"], recent, year_max=y).select("company", "growth")
    # By a distributed sort of one row for each company.
    return ranked(n, [F.desc("n"), F.asc("company")]).join(F.broadcast(total)).join(g, "company", "left").select("company", "n", "rank", (F.col("n") / F.col("total")).alias("share"), "growth")


def bcg(docs: DataFrame, company: str, recent: int = 3, year_max: int | None = None) -> DataFrame:
    """tech, n, rel_share (own documents over the largest rival's, .02 at least, 2 without a rival), growth, quadrant by the median growth."""
    y = year_max or latest_year(docs)
    rows = explode_applicants(explode_tech(docs))
    c = rows.groupBy("tech", "company").agg(F.count("*").alias("n"))
    x = c.groupBy("tech").agg(F.coalesce(F.max(F.when(F.col("company") == company, F.col("n"))), F.lit(0)).alias("n"), F.max(F.when(F.col("company") != company, F.col("n"))).alias("rival")).where("n > 0")
    g = M.growth_ladder(tech_year(docs), ["tech"], recent, year_max=y, value="w").select("tech", F.coalesce("growth", F.lit(0.0)).alias("growth"))
    x = x.join(g, "tech").withColumn("rel_share", F.when(F.col("rival").isNull() | (F.col("rival") == 0), 2.0).otherwise(F.greatest(F.try_divide(F.col("n"), F.col("rival")), F.lit(0.02))))
    mid = x.agg(F.percentile("growth", F.lit(0.5)).alias("mid"))
    up, big = F.round("growth", 9) >= F.round("mid", 9), F.col("rel_share") >= 1
    return x.join(F.broadcast(mid)).select("tech", "n", "rel_share", "growth", F.when(up & big, "star").when(up, "question").when(big, "cash_cow").otherwise("dog").alias("quadrant"))


def expiry_cliff(docs: DataFrame, as_of: str, years: int = 10) -> DataFrame:
    """company, year, n of rights that end within ``years``: by the expiry date, else 20 years from filing, else 20 from grant."""
    end = F.coalesce("expiry_date", F.add_months("app_date", 240), F.add_months("reg_date", 240))
    today = F.lit(as_of).cast("date")
    d = docs.withColumn("_end", end).where((F.col("_end") >= today) & (F.col("_end") < F.add_months(today, 12 * years)) & ~F.col("active_flag").eqNullSafe(False))
    return explode_applicants(d).groupBy("company", F.year("_end").alias("year")).agg(F.count("*").alias("n"))


def rnd_efficiency(docs: DataFrame, least: int = 5, most: int = 12, recent: int = 3) -> DataFrame:
    """company, n, recent_n, cites, family, active, quality (mean of their standard scores), quadrant by the medians of n and quality, of the ``most`` largest."""
    rows = explode_applicants(docs)
    family = F.avg("family_size") if "family_size" in docs.columns else F.lit(None).cast("double")
    last = docs.agg(F.max("base_year").alias("_y"))
    x = rows.join(F.broadcast(last)).groupBy("company").agg(
        F.count("*").alias("n"), F.sum((F.col("base_year") > F.col("_y") - recent).cast("long")).alias("recent_n"), F.coalesce(F.avg("cites_forward"), F.lit(0.0)).alias("cites"), F.coalesce(family, F.lit(0.0)).alias("family"), F.avg(F.col("active_flag").cast("int")).alias("active")
    ).where(F.col("n") >= least).orderBy(F.desc("n"), "company").limit(most)
    parts = ["cites", "family", "active"]
    s = x.agg(*[f(c).alias(f"{k}_{c}") for c in parts for k, f in (("m", F.avg), ("s", F.stddev_pop))], F.percentile("n", F.lit(0.5)).alias("mid_n"))
    # A constant part has deviation 1; one that no company has isn't used.
    used = sum((F.col(f"m_{c}").isNotNull().cast("int") for c in parts), F.lit(0))
    score = sum((F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}")).otherwise(1.0), F.lit(0.0)) for c in parts), F.lit(0.0))
    z = x.join(F.broadcast(s)).withColumn("quality", F.round(score / F.greatest(used, F.lit(1)), 3))
    mid = z.agg(F.percentile("quality", F.lit(0.5)).alias("mid_z"))
    big, good = F.col("n") >= F.col("mid_n"), F.col("quality") >= F.col("mid_z")
    # Names of the quadrants.
    quadrant = F.when(big & good, "양·질 겸비").when(big, "다작·저임팩트").when(good, "소작·정예").otherwise("양·질 모두 부족")
    return z.join(F.broadcast(mid)).select("company", "n", "recent_n", *parts, "quality", quadrant.alias("quadrant"))


def key_people(docs: DataFrame, idle_years: int = 2, year_max: int | None = None, least: int = 5) -> DataFrame:
    """company, inventors, docs, top_share, hhi, idle (inventors without a document for ``idle_years``); sole filings of companies with ``least`` inventors.

    top_share: the share of documents with an inventor of the first tenth
    (rounded up, ties by name) among those that name any.
    """
    y = year_max or latest_year(docs)
    names = F.array_distinct(F.filter(F.transform("inventors", lambda x: F.trim(x)), lambda x: x != ""))
    rows = docs.where(F.size("co_applicants") <= 1).select("doc_id", F.col("applicant").alias("company"), "base_year", F.explode(names).alias("i"))
    c = rows.groupBy("company", "i").agg(F.count("*").alias("n"), F.max("base_year").alias("last"))
    w = Window.partitionBy("company")
    r = c.withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "i"))).withColumn("_k", F.count("*").over(w)).where(F.col("_k") >= least)
    g = r.groupBy("company").agg(F.count("*").alias("inventors"), F.sum((F.col("last") <= y - idle_years).cast("long")).alias("idle"))
    top = r.where(F.col("_r") <= F.ceil(F.col("_k") / 10)).select("company", "i", F.lit(1).alias("_t"))
    covered = rows.join(top, ["company", "i"], "left").groupBy("company", "doc_id").agg(F.max("_t").alias("_t")).groupBy("company").agg(F.count("*").alias("docs"), F.count("_t").alias("_hit"))
    return g.join(covered, "company").join(M.concentration(c, ["company"]).select("company", "hhi"), "company").select("company", "inventors", "docs", (F.col("_hit") / F.col("docs")).alias("top_share"), "hhi", "idle")


def catch_up(docs: DataFrame, company: str, recent: int = 3, year_max: int | None = None) -> DataFrame:
    """tech, leader, gap, own and leading speed (documents a year), years until the company draws level (null: never)."""
    y = year_max or latest_year(docs)
    c = explode_applicants(explode_tech(docs)).groupBy("tech", "company").agg(F.count("*").alias("n"), (F.sum((F.col("base_year") > y - recent).cast("long")) / recent).alias("v"))
    lead = c.groupBy("tech").agg(F.min_by(F.struct("company", "n", "v"), F.struct(-F.col("n"), "company")).alias("l"))
    x = c.where(F.col("company") == company).join(lead, "tech").where(F.col("l.company") != company)
    gap = F.col("l.n") - F.col("n")
    return x.select("tech", F.col("l.company").alias("leader"), gap.alias("gap"), F.col("v").alias("own_speed"), F.col("l.v").alias("lead_speed"), F.when(F.col("v") > F.col("l.v"), F.try_divide(gap, F.col("v") - F.col("l.v"))).alias("years"))


def threats(docs: DataFrame, company: str, recent: int = 3, year_max: int | None = None, classes: int = 5, top: int = 15) -> DataFrame:
    """company, tech, n, entry, cites (mean), score = .5 n/n_max + .3 (1 - (Y - entry)/3) + .2 cites/cites_max.

    Of companies with two documents or more, the first in the ``recent`` last
    years, in one of the ``classes`` main classes of the company's own filings.
    """
    y = year_max or latest_year(docs)
    mine = explode_tech(docs.where(F.col("applicant") == company)).groupBy("tech").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "tech").limit(classes).select("tech")
    rows = explode_applicants(explode_tech(docs).join(F.broadcast(mine), "tech", "left_semi")).where(F.col("company") != company)
    c = rows.groupBy("company", "tech").agg(F.count("*").alias("n"), F.min("base_year").alias("entry"), F.avg("cites_forward").alias("cites")).where((F.col("entry") > y - recent) & (F.col("n") >= 2))
    best = c.agg(F.max("n").alias("_n"), F.max("cites").alias("_c"))
    score = 0.5 * F.col("n") / F.col("_n") + 0.3 * (1 - (F.lit(y) - F.col("entry")) / 3.0) + 0.2 * F.coalesce(F.try_divide("cites", "_c"), F.lit(0.0))
    return c.join(F.broadcast(best)).select("company", "tech", "n", "entry", "cites", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "company", "tech").limit(top)


def pruning(docs: DataFrame, company: str, as_of: str, least: int = 10) -> DataFrame:
    """doc_id, age (years since grant): active granted rights of a company, five years old or more, never cited, in one country, with none of its three main classes.

    Criteria that no right has a value for are passed over; under ``least``
    rights there are no proposals.
    """
    rights = docs.where(applicant_mask(company) & F.col("reg_date").isNotNull())
    count = F.coalesce(F.col("family_country_count").cast("double"), F.lit(1.0)) if "family_country_count" in docs.columns else F.greatest(F.size("family_countries"), F.lit(1)).cast("double")
    told = rights.agg(F.count("active_flag").alias("_told"))
    x = rights.join(F.broadcast(told)).where((F.col("_told") == 0) | F.col("active_flag").eqNullSafe(True))
    facts = x.agg(F.count("*").alias("_n"), F.count("cites_forward").alias("_cited"))
    main = explode_tech(x).groupBy("tech").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tech").limit(3).agg(F.collect_list("tech").alias("main"))
    x = x.join(F.broadcast(facts)).join(F.broadcast(main)).withColumn("age", F.datediff(F.lit(as_of).cast("date"), "reg_date") / 365.25)
    quiet = (F.col("_cited") == 0) | (F.coalesce("cites_forward", F.lit(0.0)) <= 0)
    return x.where((F.col("_n") >= least) & (F.col("age") >= 5) & quiet & (count <= 1) & ~F.arrays_overlap("main", "tech_list")).select("doc_id", "age")


def applicant_list(docs: DataFrame) -> DataFrame:
    """company, n, as_lead: the listing for name rules."""
    rows = docs.select("applicant", F.explode(applicants_of()).alias("company"))
    return rows.groupBy("company").agg(F.count("*").alias("n"), F.sum((F.col("applicant") == F.col("company")).cast("long")).alias("as_lead"))
