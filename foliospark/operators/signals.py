"""Portfolio analyses, part three: citations, inventors, survival, procedure and rights."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import metrics as M
from ..functions.parse import document_number
from .core import latest_year
from .expand import explode_applicants, explode_tech
from .filters import applicant_mask
from .sampling import ends



def primary_tech() -> Column:
    return F.get("tech_list", F.lit(0))


# --- citations ---------------------------------------------------------------


def influence(docs: DataFrame, settings: Settings | None = None, as_of: str | None = None, company: str | None = None) -> DataFrame:
    """doc_id, the six normalised parts and their weighted mean, strongest first, top_n_default rows."""
    s = settings or Settings()
    w = s.weights("influence")
    x = docs.where("cites_forward is not null")
    lead = explode_tech(x).groupBy("tech", "applicant").agg(F.count("*").alias("c"))
    ratio = lead.withColumn("other", 1 - F.col("c") / F.sum("c").over(Window.partitionBy("tech"))).select("tech", "applicant", "other")
    cross = explode_tech(x.select("doc_id", "applicant", "tech_list")).join(ratio, ["tech", "applicant"]).groupBy("doc_id").agg((F.sum(F.round("other", 12)) / F.count("*")).alias("other"))
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    left = F.coalesce(F.greatest(F.datediff("expiry_date", today) / 365.25, F.lit(0.0)), F.lit(0.0))
    cites = F.col("cites_forward")
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in docs.columns else F.lit(0.0)
    countries = known("family_country_count") if "family_country_count" in docs.columns else F.size("family_countries").cast("double")
    p = x.join(cross, "doc_id", "left").select(
        "doc_id", "applicant", "co_applicants", cites.alias("direct_citations"), (cites * F.log1p(known("cites_backward"))).alias("indirect_citations"), F.size(F.array_distinct("tech_list")).cast("double").alias("cross_class"),
        (F.coalesce("other", F.lit(0.0)) * cites).alias("cross_company"), known("family_size").alias("family_expansion"),
        (F.col("active_flag").eqNullSafe(True).cast("double") * F.log1p(countries) + left / 20).alias("legal_strength"),
    )
    z = M.normalize(p, {"direct_citations": True, "indirect_citations": True, "cross_class": False, "cross_company": True, "family_expansion": True, "legal_strength": False}, s.threshold("winsor_pct"))
    total = sum(max(v, 0.0) for v in w.values()) or 1.0
    score = sum((F.col(f"norm_{k}") * max(v, 0.0) for k, v in w.items()), F.lit(0.0)) / total
    pool = z.where(applicant_mask(company)) if company else z
    return pool.select("doc_id", *[F.col(f"norm_{k}").alias(k) for k in w], F.round(score, 9).alias("influence")).orderBy(F.desc("influence"), "doc_id").limit(s.limit("top_n_default"))


def self_other_citations(docs: DataFrame, self_count: Column, other_count: Column, top: int = 12) -> DataFrame:
    """company, self, other, self_rate of the applicants with the most forward citations."""
    x = explode_applicants(docs.withColumn("_s", self_count.cast("double")).withColumn("_o", other_count.cast("double"))).groupBy("company").agg(F.sum("_s").alias("self"), F.sum("_o").alias("other"))
    return x.select("company", "self", "other", M.safe_div(F.col("self"), F.col("self") + F.col("other")).alias("self_rate")).orderBy(F.desc(F.col("self") + F.col("other")), "company").limit(top)


def citation_pairs(docs: DataFrame, numbers: list[str], references: str) -> DataFrame:
    """citing, cited, source, target: references that name a document of the set, exactly or without the kind code.

    The exact number wins over the stripped one, the smallest doc_id among equals; no document cites itself.
    """
    keys = docs.select("doc_id", "applicant", F.explode(F.array(*[F.struct(document_number(F.col(c)).alias("k"), F.lit(0).alias("loose")) for c in numbers], *[F.struct(document_number(F.col(c), True).alias("k"), F.lit(1).alias("loose")) for c in numbers])).alias("x"))
    table = keys.select("doc_id", "applicant", "x.k", "x.loose").where("k <> ''").groupBy("k").agg(F.min(F.struct("loose", "doc_id", "applicant")).alias("hit"))
    refs = docs.select(F.col("doc_id").alias("citing"), F.col("applicant").alias("source"), F.explode(F.array_distinct(references)).alias("ref"))
    tries = refs.select("citing", "source", "ref", F.explode(F.array(F.struct(F.lit(0).alias("t"), document_number(F.col("ref")).alias("k")), F.struct(F.lit(1).alias("t"), document_number(F.col("ref"), True).alias("k")))).alias("y"))
    found = tries.select("citing", "source", "ref", "y.t", "y.k").join(table, "k").groupBy("citing", "source", "ref").agg(F.min(F.struct("t", F.col("hit.loose"), F.col("hit.doc_id"), F.col("hit.applicant"))).alias("m"))
    return found.select("citing", F.col("m.doc_id").alias("cited"), "source", F.col("m.applicant").alias("target")).where("citing <> cited").distinct()


def citation_network(pairs: DataFrame) -> DataFrame:
    """source, target, n between different applicants."""
    return pairs.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


# --- inventors ----------------------------------------------------------------


def inventor_moves(docs: DataFrame, settings: Settings | None = None, include_uncertain: bool = True) -> DataFrame:
    """inventor, source, target, year, confidence, uncertain: consecutive documents of a name whose applicants have nobody in common."""
    s = settings or Settings()
    base = docs.where("base_year is not null").select("doc_id", "base_year", "applicant", F.when(F.size("co_applicants") > 0, F.col("co_applicants")).otherwise(F.array("applicant")).alias("apps"), "tech_list", "inventors", "country")
    rows = base.withColumn("inventor", F.explode(F.array_distinct("inventors"))).where(F.trim("inventor") != "")
    w = Window.partitionBy("inventor").orderBy("base_year", "doc_id")
    cur = F.struct("base_year", "applicant", "apps", "tech_list", "inventors", "country")
    seq = rows.select("inventor", "doc_id", cur.alias("cur"), F.lag(cur).over(w).alias("prev"))
    docs_of = rows.groupBy("inventor").agg(F.count("*").alias("n"))
    most = docs_of.agg(F.max("n").alias("most"))
    moved = seq.where((F.col("prev.applicant") != F.col("cur.applicant")) & ~F.arrays_overlap("prev.apps", "cur.apps"))
    first = moved.groupBy("inventor", F.col("prev.applicant").alias("source"), F.col("cur.applicant").alias("target")).agg(F.min_by(F.struct("prev", "cur"), F.struct("cur.base_year", "doc_id")).alias("m"))
    p, c = (lambda f: F.col(f"m.prev.{f}")), (lambda f: F.col(f"m.cur.{f}"))
    me = F.col("inventor")
    gap = c("base_year") - p("base_year")
    time = F.when(gap <= 3, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 0.1 * (gap - 3)))
    rare = 1 - (F.col("n") - 1) / F.greatest(F.col("most") - 1, F.lit(1))
    conf = 0.35 * M.jaccard_sets(F.array_remove(p("inventors"), me), F.array_remove(c("inventors"), me)) + 0.25 * M.jaccard_sets(p("tech_list"), c("tech_list")) + 0.2 * time + 0.1 * (p("country") == c("country")).cast("double") + 0.1 * rare
    x = first.join(docs_of, "inventor").join(F.broadcast(most)).select("inventor", "source", "target", c("base_year").alias("year"), F.round(F.coalesce(conf, F.lit(0.0)), 9).alias("confidence"))
    x = x.withColumn("uncertain", F.col("confidence") < s.threshold("inventor_match_confidence"))
    return x if include_uncertain else x.where("not uncertain")


def mobility_edges(moves: DataFrame) -> DataFrame:
    return moves.groupBy("source", "target").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))


# --- survival, entry, procedure -------------------------------------------------


# Statuses of rights that have ended.
ENDED = ["Lapsed", "Abandoned", "Granted-Expired"]


def durations(docs: DataFrame, as_of: str, lapse: str = "lapse_date", most: float = 25.0) -> DataFrame:
    """``docs`` with duration (years from grant to the end, or to ``as_of``) and event, where 0 < duration <= ``most``.

    A right ends on its lapse date. If no document of the data set has one, ended
    rights end on their expiry date, where that has passed; without that too, none has ended.
    """
    today, never = F.lit(as_of).cast("date"), F.lit(None).cast("date")
    granted = docs.where("reg_date is not null")
    lapsed = F.col(lapse) if lapse in docs.columns else never
    expired = F.when(F.col("legal_status").isin(ENDED) & (F.col("expiry_date") <= today), F.col("expiry_date")) if {"legal_status", "expiry_date"} <= set(docs.columns) else never
    if lapse in docs.columns:
        told = granted.agg((F.count(lapse) > 0).alias("_told"))
        granted = granted.join(F.broadcast(told)).withColumn("_end", F.when(F.col("_told"), lapsed).otherwise(expired)).drop("_told")
    else:
        granted = granted.withColumn("_end", expired)
    lived = granted.withColumn("duration", F.datediff(F.coalesce("_end", today), "reg_date") / 365.25).withColumn("event", F.col("_end").isNotNull().cast("int")).drop("_end")
    return lived.where((F.col("duration") > 0) & (F.col("duration") <= most))


def survival(rows: DataFrame, key: Column, least: int = 10, at: tuple[float, ...] = (5.0, 10.0, 18.0)) -> DataFrame:
    """key, n, survival at each year and the median (first time with half or less), of groups with ``least`` rows."""
    x = rows.withColumn("key", key).where("key is not null")
    n = x.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    km = M.kaplan_meier(x, ["key"])
    s = km.groupBy("key").agg(*[F.min(F.when(F.col("t") <= t, F.col("survival"))).alias(f"s{t:g}") for t in at], F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("t"))).alias("median"))
    return n.join(s, "key", "left").select("key", "n", *[F.coalesce(f"s{t:g}", F.lit(1.0)).alias(f"s{t:g}") for t in at], "median")


def market_entry(docs: DataFrame, least: int = 3) -> DataFrame:
    """company, country, n, months: mean lag of a country behind the family's first filing, 0 to 120 months, families in two countries or more."""
    x = docs.where("family_id is not null and app_date is not null and country is not null")
    fam = x.groupBy("family_id").agg(F.min("app_date").alias("t0"))
    x = x.join(fam, "family_id").withColumn("lag", F.datediff("app_date", "t0") / 30.44).where((F.col("lag") >= 0) & (F.col("lag") <= 120))
    wide = x.groupBy("family_id").agg(F.count_distinct("country").alias("k")).where("k >= 2").select("family_id")
    return explode_applicants(x.join(wide, "family_id", "left_semi")).groupBy("company", "country").agg(F.count("*").alias("n"), F.avg("lag").alias("months")).where(F.col("n") >= least)


def first_entries(docs: DataFrame) -> DataFrame:
    """country, n, share of families by the country of their first document."""
    first = docs.where("family_id is not null and app_date is not null").groupBy("family_id").agg(F.min_by("country", F.struct("app_date", "doc_id")).alias("country"))
    total = first.agg(F.count("*").alias("total"))
    return first.groupBy("country").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("country", "n", (F.col("n") / F.col("total")).alias("share"))


def new_agents(docs: DataFrame, least: int = 3, signal: float = 0.25) -> DataFrame:
    """company, year, n, new_share of agents first seen with the company in that year, signal where earlier ones exist."""
    rows = explode_applicants(docs).where("base_year is not null")
    a = rows.select("company", F.col("base_year").alias("year"), F.explode("agents").alias("agent")).distinct()
    f = a.withColumn("first", F.min("year").over(Window.partitionBy("company", "agent"))).withColumn("start", F.min("year").over(Window.partitionBy("company")))
    g = f.groupBy("company", "year").agg(F.avg((F.col("first") == F.col("year")).cast("int")).alias("new_share"), F.min("start").alias("start"))
    n = rows.groupBy("company", F.col("base_year").alias("year")).agg(F.count("*").alias("n"))
    return g.join(n, ["company", "year"]).select("company", "year", "n", "new_share", ((F.col("year") > F.col("start")) & (F.col("n") >= least) & (F.col("new_share") >= signal)).alias("signal"))


def examiner_eye(docs: DataFrame, examiner: Column, applicant: Column) -> DataFrame:
    """tech, n, avg_examiner, avg_applicant, risky: examiners cite far more than applicants."""
    x = explode_tech(docs.withColumn("_e", examiner.cast("double")).withColumn("_a", applicant.cast("double"))).groupBy("tech").agg(F.count("*").alias("n"), F.avg("_e").alias("avg_examiner"), F.avg("_a").alias("avg_applicant"))
    return x.withColumn("risky", F.coalesce((F.col("avg_examiner") > 1.8 * F.col("avg_applicant")) & (F.col("avg_examiner") >= 2), F.lit(False)))


def flag_rate(docs: DataFrame, flag: Column, keys: dict[str, Column], least: int = 2) -> DataFrame:
    """keys, n (known), rate of a tri-state flag in groups with ``least`` documents: expedited, requested, divisional, government programmes."""
    x = docs.withColumn("_f", flag.cast("int")).withColumns(keys)
    return x.groupBy(*keys).agg(F.count("_f").alias("n"), F.avg("_f").alias("rate")).where(F.col("n") >= least)


def surge(docs: DataFrame, flag: Column, key: Column, recent: int = 3, least: int = 5, year_max: int | None = None) -> DataFrame:
    """key, recent_rate, prior_rate, surge, where both have ``least`` documents."""
    y = year_max or latest_year(docs)
    now = F.col("base_year") > y - recent
    x = docs.withColumn("_f", flag.cast("int")).withColumn("key", key).groupBy("key").agg(F.avg(F.when(now, F.col("_f"))).alias("recent_rate"), F.avg(F.when(~now, F.col("_f"))).alias("prior_rate"), F.count(F.when(now, F.col("_f"))).alias("_n"), F.count(F.when(~now, F.col("_f"))).alias("_p"))
    return x.where((F.col("_n") >= least) & (F.col("_p") >= least)).select("key", "recent_rate", "prior_rate", (F.col("recent_rate") - F.col("prior_rate")).alias("surge"))


def bursts(rows: DataFrame, key: str, day: str, days: int = 180, least: int = 3) -> DataFrame:
    """key, start, end, n: greedy windows of ``days`` anchored at their first event, with ``least`` events.

    Each window starts at the first event after the one before, so it is
    sequential. Days are counted before they are grouped: a key's group has a
    row for each day, whatever the number of its events.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, i = pdf.sort_values("_d"), [], 0
        days_, n = pdf["_d"].tolist(), pdf["_n"].tolist()
        while i < len(days_):
            j, total = i, 0
            while j < len(days_) and days_[j] - days_[i] <= days:
                total += n[j]
                j += 1
            if total >= least:
                out.append((pdf["key"].iloc[0], days_[i], days_[j - 1], total))
                i = j
            else:
                i += 1
        return pd.DataFrame(out, columns=["key", "_s", "_e", "n"])

    daily = rows.where(F.col(day).isNotNull()).groupBy(F.col(key).cast("string").alias("key"), F.unix_date(F.to_date(day)).alias("_d")).agg(F.count("*").alias("_n"))
    out = daily.groupBy("key").applyInPandas(walk, "key string, _s int, _e int, n long")
    return out.select("key", F.date_from_unix_date("_s").alias("start"), F.date_from_unix_date("_e").alias("end"), "n")


def mad_outliers(docs: DataFrame, value: Column, key: Column, least: int = 8, cut: float = 2.5) -> DataFrame:
    """doc_id, key, value, z: modified z scores beyond ``cut`` in groups with ``least`` values; MAD 0 counts as 1."""
    x = docs.select("doc_id", key.alias("key"), F.round(value, 9).alias("value")).where("value is not null and key is not null")
    med = x.groupBy("key").agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("med")).where(F.col("n") >= least)
    y = x.join(med, "key").withColumn("_d", F.abs(F.col("value") - F.col("med")))
    mad = y.groupBy("key").agg(F.percentile("_d", F.lit(0.5)).alias("mad"))
    z = y.join(mad, "key").withColumn("z", 0.6745 * (F.col("value") - F.col("med")) / F.when(F.col("mad") > 0, F.col("mad")).otherwise(1.0))
    return z.where(F.abs("z") > cut).select("doc_id", "key", "value", "z")


def disclosure(docs: DataFrame, value: Column, least: int = 3, companies: int = 8, techs: int = 8) -> DataFrame:
    """company, tech, n, z = (company mean - class mean) / the class's sample deviation, by primary class, of the largest companies and classes."""
    x = docs.withColumn("_v", value.cast("double")).withColumn("tech", primary_tech()).where("_v is not null and tech is not null and applicant <> ''")
    cls = x.groupBy("tech").agg(F.count("*").alias("_n"), F.avg("_v").alias("m"), F.stddev_samp("_v").alias("s")).orderBy(F.desc("_n"), "tech").limit(techs)
    rows = explode_applicants(x)
    top = rows.groupBy("company").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "company").limit(companies).select("company")
    c = rows.join(F.broadcast(top), "company", "left_semi").groupBy("company", "tech").agg(F.count("*").alias("n"), F.avg("_v").alias("mc")).where(F.col("n") >= least)
    return c.join(F.broadcast(cls), "tech").select("company", "tech", "n", ((F.col("mc") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("z"))


def disputes(docs: DataFrame, disputed: Column) -> DataFrame:
    """tech, n, disputed, avg_cites_disputed, avg_cites_other."""
    x = explode_tech(docs.withColumn("_d", F.coalesce(disputed, F.lit(False))))
    return x.groupBy("tech").agg(F.count("*").alias("n"), F.sum(F.col("_d").cast("long")).alias("disputed"), F.avg(F.when(F.col("_d"), F.col("cites_forward"))).alias("avg_cites_disputed"), F.avg(F.when(~F.col("_d"), F.col("cites_forward"))).alias("avg_cites_other"))


def dispute_edges(docs: DataFrame, claimant: Column) -> DataFrame:
    """claimant, owner, n."""
    return docs.where(claimant.isNotNull() & (F.trim(claimant) != "")).groupBy(claimant.alias("claimant"), F.coalesce("owner", "applicant").alias("owner")).agg(F.count("*").alias("n"))


def quality_split(docs: DataFrame, flag: Column, least: int = 1) -> DataFrame:
    """flag, n, avg_cites, grant_rate, active_rate: linked or licensed documents against the others."""
    return docs.groupBy(F.coalesce(flag, F.lit(False)).alias("flag")).agg(F.count("*").alias("n"), F.avg("cites_forward").alias("avg_cites"), F.avg(F.col("is_granted").cast("int")).alias("grant_rate"), F.avg(F.col("active_flag").cast("int")).alias("active_rate")).where(F.col("n") >= least)


# Classes of rejection reasons; a reason may be in several.
REJECTIONS = {
    "진보성": ["진보성", "inventive step", "obvious"], "신규성": ["신규성", "novelty"], "기재불비": ["기재불비", "기재 불비", "명세서 기재", "clarity", "112"],
    "산업상 이용가능성": ["산업상", "industrial applicability"], "발명의 성립성": ["성립성", "eligible", "101"], "선출원/중복": ["선출원", "확대된 선원", "double patenting"],
}


def rejection_reasons(docs: DataFrame, reason: str = "rejection_reason") -> DataFrame:
    """reason, n: rows by class; rows of no class are 기타, counted as such."""
    low = F.lower(F.col(reason))
    hit = lambda words: F.forall(F.array(*map(F.lit, words)), lambda w: ~low.contains(w)) == F.lit(False)
    names = F.filter(F.array(*[F.when(hit(w), k) for k, w in REJECTIONS.items()]), lambda x: x.isNotNull())
    rows = docs.where(F.trim(F.col(reason)) != "").select(F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("기타")))).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def science_link(docs: DataFrame, least: int = 3) -> DataFrame:
    """tech, n, npl_rate, avg_npl, avg_cites_npl, avg_cites_other."""
    npl = F.coalesce("npl_count", F.lit(0.0))
    x = explode_tech(docs).groupBy("tech").agg(F.count("*").alias("n"), F.avg((npl > 0).cast("int")).alias("npl_rate"), F.avg(npl).alias("avg_npl"), F.avg(F.when(npl > 0, F.col("cites_forward"))).alias("avg_cites_npl"), F.avg(F.when(npl == 0, F.col("cites_forward"))).alias("avg_cites_other"))
    return x.where(F.col("n") >= least)


def assignments(docs: DataFrame, assignor: str, assignee: str, day: str) -> DataFrame:
    """year, source, target, n of recorded assignments."""
    return docs.where((F.trim(F.col(assignee)) != "")).groupBy(F.year(day).alias("year"), F.col(assignor).alias("source"), F.col(assignee).alias("target")).agg(F.count("*").alias("n"))


def examiners(docs: DataFrame, examiner: Column, least: int = 3) -> DataFrame:
    """examiner, n, grant_rate, avg_actions, avg_months."""
    m = F.datediff("reg_date", "app_date") / 30.44
    return docs.groupBy(examiner.alias("examiner")).agg(F.count("*").alias("n"), F.avg(F.col("is_granted").cast("int")).alias("grant_rate"), F.avg("oa_count").alias("avg_actions"), F.avg(F.when((m > 0) & (m <= 240), m)).alias("avg_months")).where(F.col("n") >= least)


def state_maintenance(docs: DataFrame, valid: str, lapsed: str) -> DataFrame:
    """company, valid, lapsed, keep = valid / (valid + lapsed)."""
    x = explode_applicants(docs).groupBy("company").agg(F.sum(F.size(valid)).alias("valid"), F.sum(F.size(lapsed)).alias("lapsed"))
    return x.select("company", "valid", "lapsed", M.safe_div(F.col("valid"), F.col("valid") + F.col("lapsed"), None).alias("keep"))


def licences(docs: DataFrame, flag: Column) -> DataFrame:
    """company, n, licensed, rate."""
    x = explode_applicants(docs.withColumn("_f", F.coalesce(flag, F.lit(False)).cast("long"))).groupBy("company").agg(F.count("*").alias("n"), F.sum("_f").alias("licensed"), F.avg("_f").alias("rate"))
    return x.where("licensed > 0")


def standards(docs: DataFrame, org: str = "sep_org") -> DataFrame:
    """org, company, n of declared documents."""
    return explode_applicants(docs.where(F.trim(F.col(org)) != "")).groupBy(F.col(org).alias("org"), "company").agg(F.count("*").alias("n"))


def divisional(flag: str = "divisional_flag", parent: str = "parent_app_number") -> Column:
    """Whether a document is divided from another: by the flag, or by the number of a parent."""
    said = ~F.lower(F.trim(F.col(parent).cast("string"))).isin("", "nan", "none")
    return F.coalesce(F.col(flag), F.lit(False)) | F.coalesce(said, F.lit(False))


def grant_speed(docs: DataFrame, least: int = 3, each: int = 6) -> DataFrame:
    """company, n, days, end (top: slowest, bottom: fastest): mean days from filing to grant of companies with ``least`` grants, ``each`` of either end."""
    both = explode_applicants(docs.where("reg_date is not null and app_date is not null"))
    x = both.groupBy("company").agg(F.count("*").alias("n"), F.avg(F.datediff("reg_date", "app_date")).alias("days")).where(F.col("n") >= least)
    return ends(x, "days", each, "company")
