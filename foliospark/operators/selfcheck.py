"""Checks that an engine makes on its own results: what the data's columns allow, and whether charts and their drill-downs agree."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expand import explode_applicants, explode_pairs, explode_tech
from .filters import drill_predicate

#: Cells of one chart that are checked, as many as a chart shows.
MOST = 40


class Check(NamedTuple):
    """``good``: a condition on the sums ``value`` and ``of``; ``needs``: columns without which it can't be told."""

    name: str
    needs: list[str]
    value: Column
    of: Column
    good: Column


def _n(test: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(test, F.lit(False)).cast("long")), F.lit(0))


def self_check(docs: DataFrame, this_year: int, number: str = "doc_id") -> DataFrame:
    """name, status (passed, attention, unknown), value, of: one aggregation over the frame.

    Years add up and are known, none lies ahead; applicants are known; numbers are
    unique; grants don't precede filings; a deep class has a top class; states and
    citation counts are known. A check whose columns are missing, or have no
    value, is unknown.
    """
    all_, known = F.count("*"), F.count("base_year")
    value, of = F.col("value"), F.col("of")
    share = lambda least: value >= least * of
    said = F.count(number)
    has = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    checks = [
        Check("years add up", ["base_year"], known + _n(F.col("base_year").isNull()), all_, value == of),
        Check("years known", ["base_year"], known, all_, share(0.9)),
        Check("years ahead", ["base_year"], _n(F.col("base_year") > this_year), known, value == 0),
        Check("applicants known", ["applicant"], _n(F.trim("applicant") != ""), all_, share(0.9)),
        Check("numbers repeated", [number], said - F.count_distinct(number), said, value == 0),
        Check("granted before filed", ["reg_date", "app_date"], _n(F.col("reg_date") < F.col("app_date")), _n(F.col("reg_date").isNotNull() & F.col("app_date").isNotNull()), value == 0),
        Check("deep class without top class", ["tech_l3_list", "tech_l1_list"], _n(has(F.col("tech_l3_list")) & ~has(F.col("tech_l1_list"))), _n(has(F.col("tech_l3_list"))), value == 0),
        Check("states known", ["active_flag"], F.count("active_flag"), all_, share(0.8)),
        Check("citations known", ["cites_forward"], F.count("cites_forward"), all_, F.lit(True)),
    ]
    told = [c for c in checks if set(c.needs) <= set(docs.columns)]
    one = docs.agg(*[x.cast("long").alias(f"{k}{i}") for i, c in enumerate(told) for k, x in (("v", c.value), ("o", c.of))])
    blank = {"states known", "citations known"}  # checks of columns that may be there without a value
    none = F.lit(None).cast("long")
    rows = [F.struct(F.lit(c.name).alias("name"), F.lit(c.name in blank).alias("blank"), *([F.col(f"v{told.index(c)}").alias("value"), F.col(f"o{told.index(c)}").alias("of")] if c in told else [none.alias("value"), none.alias("of")])) for c in checks]
    x = one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    good = F.coalesce(*[F.when(F.col("name") == c.name, c.good) for c in checks])
    unknown = of.isNull() | (F.col("blank") & (value == 0)) | (F.col("name").isin("deep class without top class", "granted before filed") & (of == 0))
    return x.select("name", F.when(unknown, "unknown").when(good, "passed").otherwise("attention").alias("status"), "value", "of")


class Cell(NamedTuple):
    """A chart's cell: what it shows, and the drill-down behind it."""

    chart: str
    label: str
    n: int
    drill: dict[str, Any]


def chart_cells(docs: DataFrame, most: int = MOST) -> list[Cell]:
    """The ``most`` largest cells of the common charts, counted as the charts count them: classes, years, classes by year, pairs of classes, applicants."""
    tech, pairs = explode_tech(docs.select("tech_list", "base_year")), explode_pairs(docs.select("tech_list"))

    def top(df: DataFrame, *by: str) -> list[tuple]:
        return [tuple(r) for r in df.dropna(subset=[*by]).groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(most).collect()]

    return [
        *[Cell("class", t, n, {"tech": t}) for t, n in top(tech, "tech")],
        *[Cell("year", str(y), n, {"year": y}) for y, n in top(docs, "base_year")],
        *[Cell("class and year", f"{t} {y}", n, {"tech": t, "year": y}) for t, y, n in top(tech, "tech", "base_year")],
        *[Cell("pair", f"{a} {b}", n, {"combo": [a, b]}) for a, b, n in top(pairs, "a", "b")],
        *[Cell("applicant", c, n, {"applicant": c}) for c, n in top(explode_applicants(docs.select("co_applicants", "applicant")), "company")],
        *[Cell("state", s, n, {"legal_status": s}) for s, n in top(docs, "legal_status")],
    ]


def reconcile(docs: DataFrame, cells: list[Cell], each: int = 50) -> DataFrame:
    """chart, label, n, drilled, agrees: the documents that each cell's drill-down selects against what the cell shows.

    One pass over the frame for all cells: a document lists the cells whose
    predicate it fulfils, and these are counted; ``cells`` are bounded by what
    charts show.
    """
    schema = "chart string, label string, n long, cell int"
    listed = docs.sparkSession.createDataFrame([(c.chart, c.label, c.n, i) for i, c in enumerate(cells)], schema)
    if not cells:
        return listed.select("chart", "label", "n", F.col("n").alias("drilled"), F.lit(True).alias("agrees"))
    inside = [F.array(*[F.when(drill_predicate(c.drill), F.lit(i)) for i, c in enumerate(cells) if i // each == k]) for k in range(-(-len(cells) // each))]
    hits = docs.select(F.explode(F.filter(F.concat(*inside), lambda x: x.isNotNull())).alias("cell")).groupBy("cell").agg(F.count("*").alias("drilled"))
    x = listed.join(F.broadcast(hits), "cell", "left").withColumn("drilled", F.coalesce("drilled", F.lit(0)))
    return x.select("chart", "label", "n", "drilled", (F.col("n") == F.col("drilled")).alias("agrees"))
