"""Shared filters and drill-downs, as predicates over the standard frame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _any(column: str, values: list) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(str(v)) for v in values]))


#: filter name -> (columns it needs, predicate)
_FILTERS: dict[str, tuple[list[str], Callable[[Any], Column]]] = {
    "year_from": (["base_year"], lambda v: F.col("base_year") >= int(v)),
    "year_to": (["base_year"], lambda v: F.col("base_year") <= int(v)),
    "applicants": (["applicant", "co_applicants"], lambda v: F.col("applicant").isin(v) | F.coalesce(_any("co_applicants", v), F.lit(False))),
    "countries": (["country"], lambda v: F.upper(F.trim("country")).isin([str(x).strip().upper() for x in v])),
    "legal_statuses": (["legal_status"], lambda v: F.col("legal_status").isin(v)),
    "tech_l1": (["tech_l1_list"], lambda v: _any("tech_l1_list", v)),
    "tech_l2": (["tech_l2_list"], lambda v: _any("tech_l2_list", v)),
    "tech_l3": (["tech_l3_list"], lambda v: _any("tech_l3_list", v)),
    "tech": (["tech_list"], lambda v: _any("tech_list", v)),
    "active_only": (["active_flag"], lambda v: F.col("active_flag").eqNullSafe(True)),
}


def filter_predicate(columns: list[str], spec: dict[str, Any] | None) -> Column:
    """All given filters joined by AND; those that are empty, unknown, or on columns that aren't there are passed over."""
    parts = [make(v) for k, v in (spec or {}).items() if v not in (None, "", [], False) and k in _FILTERS for needs, make in [_FILTERS[k]] if set(needs) & set(columns) == set(needs)]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply_filters(docs: DataFrame, spec: dict[str, Any] | None) -> DataFrame:
    return docs.where(filter_predicate(docs.columns, spec))


def applicant_mask(name: str, scope: str = "any") -> Column:
    """scope display: the lead applicant; any: one of all."""
    lead = F.col("applicant") == name
    return lead if scope == "display" else F.coalesce(lead | F.array_contains("co_applicants", name), F.lit(False))


def _first_or_any(column: str, value: str, primary: bool) -> Column:
    return F.get(F.col(column), F.lit(0)) == value if primary else F.array_contains(column, value)


def _said(column: str) -> Column:
    return F.coalesce(~F.lower(F.trim(F.col(column).cast("string"))).isin("", "nan", "none", "-"), F.lit(False))


def drill_predicate(drill: dict[str, Any]) -> Column:
    """The predicate that selects exactly the documents behind an aggregate; keys that aren't known select all."""
    d, parts = drill, []
    axis = {"a": "tech_list", "b": "tech_b_list", "c": "tech_c_list"}
    if d.get("tech"):
        parts.append(_first_or_any("tech_list", d["tech"], bool(d.get("tech_primary"))))
    if d.get("combo"):
        parts += [F.array_contains("tech_list", x) for x in d["combo"]]
    if d.get("transition"):
        parts.append(reduce(lambda a, b: a | b, [F.array_contains("tech_list", x) for x in d["transition"]]))
    if d.get("applicant"):
        parts.append(applicant_mask(d["applicant"], d.get("applicant_scope", "any")))
    if d.get("co_applicant"):
        parts.append(applicant_mask(d["co_applicant"]))
    if d.get("joint_only"):
        parts.append(F.size("co_applicants") >= 2)
    if d.get("ipc_main"):
        parts.append(F.exists("ipc_list", lambda x: F.startswith(x, F.lit(d["ipc_main"]))))
    if d.get("owner"):
        parts.append(F.col("owner") == d["owner"])
    if "transferred" in d:
        moved = (F.col("owner") != F.col("applicant")) & _said("owner") & _said("applicant")
        parts.append(moved if d["transferred"] else ~moved)
    if d.get("year") is not None:
        parts.append(F.col("base_year") == int(d["year"]))
    for key, column in (("cell", None), ("axis_cell", None)):
        for name, value in (d.get(key) or {}).items() if isinstance(d.get(key), dict) else (d.get(key) or []):
            parts.append(F.array_contains({"problem": "tech_c_list", "solution": "tech_b_list"}.get(name) or axis[name], value))
    for side, column in (("problems", "problem"), ("solutions", "solution")):
        if (d.get("cell_group") or {}).get(side):
            parts.append(F.col(column).isin(d["cell_group"][side]))
    for level in ("tech_l1", "tech_l2", "tech_l3"):
        if d.get(level):
            parts.append(_first_or_any(f"{level}_list", d[level], bool(d.get("tech_levels_primary"))))
    if d.get("tech_path_next_empty"):
        first = F.get(F.col(f"{d['tech_path_next_empty']}_list"), F.lit(0))
        parts.append(first.isNull() | F.lower(F.trim(first)).isin("", "nan", "none", "-"))
    for key, flag in (("licensed", "license_flag"), ("exam_requested", "exam_request_flag"), ("divisional", "divisional_flag")):
        if key in d:
            parts.append(F.col(flag).eqNullSafe(bool(d[key])))
    if "npl_cited" in d:
        parts.append((F.coalesce("npl_count", F.lit(0.0)) > 0) == bool(d["npl_cited"]))
    if "sep" in d:
        parts.append((_said("sep_org") | _said("sep_number")) == bool(d["sep"]))
    if d.get("gov_program"):
        parts.append(F.col("gov_program") == d["gov_program"])
    if "gov_linked" in d:
        parts.append(_said("gov_program") == bool(d["gov_linked"]))
    if d.get("inventor"):
        parts.append(F.array_contains("inventors", str(d["inventor"])))
    if d.get("first_country"):
        parts.append(F.upper(F.trim("first_filing_country")) == str(d["first_country"]).upper())
    if d.get("ids"):
        parts.append(F.col("doc_id").cast("string").isin([str(x) for x in d["ids"]]))
    for key in ("legal_status", "country"):
        if d.get(key):
            parts.append(F.col(key) == d[key])
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), parts, F.lit(True))


def select_documents(docs: DataFrame, drill: dict[str, Any]) -> DataFrame:
    return docs.where(drill_predicate(drill))


def page(docs: DataFrame, number: int = 1, size: int = 25, most: int = 200) -> DataFrame:
    """Rows of a 1-based page in the order of doc_id; sizes over ``most`` are cut to it."""
    size = max(1, min(size, most))
    # The global order is a sort and offset, not a window, so that only the page's rows meet in one task.
    return docs.orderBy("doc_id").offset((max(1, number) - 1) * size).limit(size)


def family_representatives(docs: DataFrame) -> DataFrame:
    """One document of each family: representative match, active and granted, earliest date, most complete, country rank, publication number.

    Documents without a family stay. Ties end in doc_id.
    """
    from ..config import COUNTRY_PRIORITY

    has = lambda c: c in docs.columns
    col = lambda c, d: F.col(c) if has(c) else F.lit(d)
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COUNTRY_PRIORITY.items() for x in kv]), F.upper(F.trim(F.coalesce(col("country", ""), F.lit(""))))), F.lit(9))
    complete = sum((F.least(F.length(F.coalesce(F.col(c), F.lit(""))), F.lit(2000)) for c in ("title", "abstract", "indep_claim", "claims") if has(c)), F.lit(0))
    dates = [F.col(c) for c in ("priority_date", "app_date") if has(c)]
    order = [
        F.when(F.trim(col("family_rep", "").cast("string")) == F.trim(col("pub_number", None).cast("string")), 0).otherwise(1),
        F.when(F.col("active_flag"), 0).otherwise(1) + F.when(F.col("is_granted"), 0).otherwise(1),
        F.coalesce(*dates, F.lit("2262-01-01").cast("date")),
        -complete,
        rank,
        F.coalesce(col("pub_number", "").cast("string"), F.lit("")),
        F.col("doc_id"),
    ]
    named = F.coalesce(~F.trim(F.col("family_id").cast("string")).isin("", "nan", "None"), F.lit(False))
    # Documents without a family are their own group, spread by their id.
    key = F.when(named, F.struct(F.lit(0).alias("k"), F.trim(F.col("family_id").cast("string")).alias("v"))).otherwise(F.struct(F.lit(1).alias("k"), F.col("doc_id").cast("string").alias("v")))
    return docs.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def analysis_unit(docs: DataFrame, unit: str = "family") -> DataFrame:
    if unit == "family":
        return family_representatives(docs)
    return docs.where(F.col("is_granted").eqNullSafe(True)) if unit == "registration" else docs
