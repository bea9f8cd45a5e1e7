"""Row expansion: documents to document x class, x applicant, x pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MULTICLASS_MODES


def explode_tech(docs: DataFrame, mode: str = "duplicate", labels: str = "tech_list") -> DataFrame:
    """All columns, tech and weight. Modes: duplicate (1 each), fractional (1/n), primary (the first), level_separate (the list of the level named by ``labels``). Documents without a class go."""
    if mode not in MULTICLASS_MODES:
        raise ValueError(f"mode is one of {MULTICLASS_MODES}, not {mode!r}")
    if mode == "primary":
        return docs.withColumn("tech", F.get(labels, F.lit(0))).where("tech is not null").withColumn("weight", F.lit(1.0))
    weight = F.try_divide(F.lit(1.0), F.size(labels)) if mode == "fractional" else F.lit(1.0)
    return docs.withColumn("weight", weight).withColumn("tech", F.explode(labels))


def applicants_of(mode: str = "all", exclude: list[str] | None = None) -> Column:
    """The applicant names that a document counts for."""
    names = F.when(F.size("co_applicants") > 0, F.col("co_applicants")).otherwise(F.array("applicant")) if mode == "all" else F.array("applicant")
    names = F.filter(names, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.array_except(names, F.array(*map(F.lit, exclude))) if exclude else F.array_distinct(names)


def explode_applicants(docs: DataFrame, mode: str = "all", exclude: list[str] | None = None) -> DataFrame:
    """All columns and company, a row for each applicant (mode all) or the first (mode first)."""
    return docs.withColumn("company", F.explode(applicants_of(mode, exclude)))


def explode_pairs(docs: DataFrame, labels: str = "tech_list") -> DataFrame:
    """All columns, a and b: the unordered pairs of a document's distinct labels, a < b."""
    s = F.array_sort(F.array_distinct(labels))
    pairs = F.flatten(F.transform(s, lambda x, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return docs.withColumn("_p", F.explode(pairs)).select(*docs.columns, "_p.a", "_p.b")


def combo_counts(docs: DataFrame, recent_from: int, labels: str = "tech_list") -> DataFrame:
    """a, b, n_ab, n_recent, first_year, last_year, n_applicants, n_recent_applicants, n_new_applicants.

    New applicants of a pair are those whose first year with it is recent: one
    minimum by (pair, applicant) instead of an anti-join.
    """
    base = docs.select("doc_id", "base_year", "active_flag", applicants_of().alias("companies"), labels)
    pairs = explode_pairs(base, labels)
    recent = F.col("base_year") >= recent_from
    docs_of = pairs.groupBy("a", "b").agg(
        F.count("*").alias("n_ab"), F.sum(recent.cast("long")).alias("n_recent"), F.min("base_year").alias("first_year"), F.max("base_year").alias("last_year"), F.avg(F.col("active_flag").cast("int")).alias("active_ratio")
    )
    by_company = pairs.select("a", "b", "base_year", F.explode("companies").alias("company")).groupBy("a", "b", "company").agg(F.min("base_year").alias("lo"), F.max("base_year").alias("hi"))
    companies = by_company.groupBy("a", "b").agg(
        F.count("*").alias("n_applicants"), F.sum((F.col("hi") >= recent_from).cast("long")).alias("n_recent_applicants"), F.sum((F.col("lo") >= recent_from).cast("long")).alias("n_new_applicants")
    )
    return docs_of.join(companies, ["a", "b"], "left").na.fill(0, ["n_applicants", "n_recent_applicants", "n_new_applicants"])


def explode_dimension(docs: DataFrame, dim: Column, name: str = "dim") -> DataFrame:
    """A row for each document and distinct non-empty value of ``dim``, which may be a scalar or an array."""
    kind = docs.select(dim.alias("x")).schema["x"].dataType.typeName()
    values = dim if kind == "array" else F.array(dim)
    return docs.withColumn(name, F.explode(F.array_distinct(F.filter(F.transform(values, lambda x: x.cast("string")), lambda x: x.isNotNull() & (x != "")))))


def core_combinations(docs: DataFrame, top: list[str], labels: str = "tech_list") -> DataFrame:
    """combo array<string>, n: documents by the exact set of their labels that are in ``top``."""
    inside = F.array_sort(F.array_intersect(labels, F.array(*map(F.lit, top))))
    return docs.select(inside.alias("combo")).where(F.size("combo") > 0).groupBy("combo").agg(F.count("*").alias("n"))
