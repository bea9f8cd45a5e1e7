"""The standard frame: an untidy raw table and a mapping to typed columns that every analysis reads.

The schema is fixed: a concept that isn't mapped is a typed null (or an empty
list), so analyses need no test for columns, and Catalyst prunes what a query
doesn't use. The few decisions that depend on all the data (which class level is
filled, whether the country column holds countries, whether a citation column is
counts or lists, whether dates exist) come from one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GRANTED_STATUSES, UNCLASSIFIED
from ..functions import parse as P
from .mapping import KINDS, LABELS
from .names import canonical_owner, name_table, rename_list
from .stored import stored


@dataclass
class Documents:
    """The frame, and the concepts that are mapped."""

    df: DataFrame
    present: set[str]


MULTI = ["family_countries", "tech_l1", "tech_l2", "tech_l3", "tech_b_l1", "tech_b_l2", "tech_b_l3", "tech_c_l1", "tech_c_l2", "tech_c_l3", "tech_multi", "agent", "cites_backward_nums", "epc_valid_states", "epc_lapsed_states"]


_LEVELS = ("l1", "l2", "l3")
#: The typed columns that derived ones are made of; any other column is its own.
SOURCES = {
    "base_year": ["app_date", "priority_date", "pub_date", "_any_year"], "is_granted": ["is_granted", "_number", "legal_status"], "active_flag": ["is_active", "legal_status"],
    "tech_l1_list": ["tech_l1", "ipc_sections"], "tech_l2_list": ["tech_l2", "ipc_classes"], "tech_l3_list": ["tech_l3", "ipc_list"], "tech_list": ["tech_multi", "tech_l1", "tech_l2", "tech_l3", "ipc_list"],
    "tech_b_list": [f"tech_b_{x}" for x in _LEVELS], "tech_c_list": [f"tech_c_{x}" for x in _LEVELS], "agents": ["agent"],
    "co_applicants": ["_names"], "applicant_raw": ["_names"], "applicant": ["_names"], "owner": ["_names", "assignee"],
} | {f"{k}_year": [k] for k in KINDS["date"]}
_TECH_FACTS = ["has_tech_multi", *[f"has_tech_{x}" for x in _LEVELS]]
_COUNTRY_FACTS = ["country_code", "country_short", "prefix_pub_number", "prefix_app_number", "prefix_reg_number"]
#: What has to be known of all rows for a column.
FACTS = {
    **{f"tech_{x}_list": _TECH_FACTS for x in _LEVELS}, "tech_list": _TECH_FACTS, "tech_b_list": [f"has_tech_b_{x}" for x in _LEVELS], "tech_c_list": [f"has_tech_c_{x}" for x in _LEVELS],
    "country": _COUNTRY_FACTS, "country_raw": _COUNTRY_FACTS, **{k: [f"numeric_{k}"] for k in KINDS["count_or_list"]}, "is_granted": ["granted_known"], "base_year": ["dated"],
}


def concepts_of(columns: list[str]) -> set[str]:
    """The concepts that ``columns`` of a frame, and its doc_id, may be read from."""
    deeper = {"_names": ["applicant", "applicant_std"], "_number": ["reg_number"], "_any_year": ["app_number", "pub_number"], "ipc_list": ["ipc"], "ipc_sections": ["ipc"], "ipc_classes": ["ipc"], "legal_status_raw": ["legal_status"], "country_raw": ["country"]}
    typed = [x for c in columns for x in [c, *SOURCES.get(c, []), *[f.partition("_")[2] for f in FACTS.get(c, [])]]]
    return {"pub_number", "app_number", "reg_number"} | {y for x in typed for y in deeper.get(x, [x]) if y in LABELS}


def _empty() -> Column:
    return F.array().cast("array<string>")


def _concepts(raw: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Every concept as a string column; doc_id from the publication, application or registration number, else a hash of the row."""
    cols = {c: (F.col(f"`{mapping[c]}`").cast("string") if mapping.get(c) in raw.columns else F.lit(None).cast("string")) for c in LABELS}
    return raw.select(*[v.alias(k) for k, v in cols.items()])


def _ids() -> list[Column]:
    return [F.nullif(F.trim(F.col(k)), F.lit("")) for k in ("pub_number", "app_number", "reg_number")]


def _share(test: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(F.sum((of & test).cast("double")), F.sum(of.cast("double"))), F.lit(0.0))


def _facts(c: DataFrame, wanted: set[str] | None = None) -> dict[str, Any]:
    """What depends on all rows (of it what is ``wanted``), in one aggregation; whether there is any date, in a look for the first."""
    said = lambda k: P.present(F.col(k))
    prefix = lambda k: F.avg(F.coalesce(F.col(k), F.lit("")).rlike(r"^\s*[A-Za-z]{2}").cast("int"))
    country = F.trim("country")
    exprs: dict[str, Callable[[], Column]] = {
        **{f"has_{k}": lambda k=k: F.max(F.coalesce(said(k), F.lit(False)).cast("int")) for k in ("tech_multi", "tech_l1", "tech_l2", "tech_l3", "tech_b_l1", "tech_b_l2", "tech_b_l3", "tech_c_l1", "tech_c_l2", "tech_c_l3", "is_granted", "reg_number")},
        "country_code": lambda: _share(country.rlike("^[A-Za-z]{2,3}$"), said("country")),
        "country_short": lambda: _share((F.length(country) <= 8) & ~country.rlike(r"^[+-]?\d+(\.\d+)?$") & ~country.rlike(r"\d{4}"), said("country")),
        **{f"prefix_{k}": partial(prefix, k) for k in ("pub_number", "app_number", "reg_number")},
        **{f"numeric_{k}": lambda k=k: _share(F.trim(k).rlike(r"^[+-]?[\d,]+(\.\d+)?$"), said(k)) for k in KINDS["count_or_list"]},
        # Rows without a number of their own.
        "unnumbered": lambda: F.count(F.when(F.coalesce(*_ids()).isNull(), 1)),
        "granted_known": lambda: F.count(P.parse_bool(F.col("is_granted"))),
    }
    found = c.agg(*[v().alias(k) for k, v in exprs.items() if wanted is None or k in wanted]).first().asDict()
    if wanted is None or "dated" in wanted:  # ends at the first row with a date
        found["dated"] = not c.where(F.coalesce(*[P.parse_date(F.col(k)) for k in ("app_date", "priority_date", "pub_date")]).isNotNull()).isEmpty()
    return found


def _levels(axis: str, facts: dict[str, Any]) -> Column:
    """The deepest class level that any document has."""
    for level in ("l3", "l2", "l1"):
        if facts.get(f"has_{axis}{level}"):
            return F.col(f"{axis}{level}")
    return _empty()


def build_frame(raw: DataFrame, mapping: dict[str, str], applicant_rules: dict[str, dict[str, str]] | None = None, tech_rules: dict[str, Any] | None = None, columns: list[str] | None = None) -> Documents:
    """Typed, derived and standardised columns; see ``registered`` for queries over them.

    With ``columns``, of all rows only these and doc_id are made, of the concepts
    that they need (``concepts_of``), and what needs no names isn't written.

    ``applicant_rules``: {"map": {name: name}, "groups": {name: name}};
    ``tech_rules``: {"mapping": {label: label}, "noise": [labels]}.
    """
    present = {c for c, col in mapping.items() if col in raw.columns}
    c = _concepts(raw, mapping)
    known = None if columns is None else {"doc_id", *columns} | {x for k in columns for x in SOURCES.get(k, [])}
    facts = _facts(c, None if columns is None else {"unnumbered"} | {x for k in columns for x in FACTS.get(k, [])})
    asked = lambda k: columns is None or k in columns
    chosen = lambda of: {k: v for k, v in of.items() if asked(k)}
    col = F.col
    # Parsers are built for mapped concepts and asked columns only: a plan of a hundred parsers of nothing takes long to make.
    of = lambda k, parse, kind: parse(col(k)) if k in present else F.lit(None).cast(kind)
    typed: dict[str, Callable[[], Column]] = {k: partial(of, k, P.parse_date, "date") for k in KINDS["date"]}
    typed |= {k: partial(of, k, P.parse_numeric, "double") for k in KINDS["number"]}
    typed |= {k: partial(of, k, P.parse_bool, "boolean") for k in KINDS["bool"]}
    counted = lambda k: P.parse_numeric if facts.get(f"numeric_{k}", 1) >= 0.5 else lambda c: F.when(P.present(c), P.list_length(c)).cast("double")
    typed |= {k: partial(of, k, counted(k), "double") for k in KINDS["count_or_list"]}
    typed |= {k: lambda k=k: P.parse_multi(col(k)) if k in present else _empty() for k in MULTI}
    typed |= {k: lambda k=k: P.clean_statement(col(k)) for k in ("problem", "solution")} | {"embedding": lambda: P.parse_vector(col("embedding"))}
    typed |= {k: partial(P.ipc_codes, col("ipc"), n) for k, n in (("ipc_list", 4), ("ipc_sections", 1), ("ipc_classes", 3))}
    typed |= {"inventors": lambda: P.split_names(col("inventors")), "_names": lambda: P.split_names(F.when(P.present(col("applicant")), col("applicant")).otherwise(col("applicant_std"))), "legal_status_raw": lambda: col("legal_status"), "legal_status": lambda: P.legal_status(col("legal_status"))}
    if (asked("country") or asked("country_raw")) and max(facts["country_code"], facts["country_short"]) < 0.3:
        source = next((k for k in ("pub_number", "app_number", "reg_number") if (facts[f"prefix_{k}"] or 0) >= 0.3), None)
        typed |= {"country_raw": lambda: col("country")} | ({"country": lambda: F.nullif(F.upper(F.regexp_extract(F.coalesce(col(source), F.lit("")), r"^\s*([A-Za-z]{2})", 1)), F.lit(""))} if source else {})
    text = [k for k in LABELS if k not in typed]
    typed |= {k: lambda k=k: F.coalesce(col(k), F.lit("")) for k in text}
    # Where every row has a number, none reads all columns for a hash.
    typed["doc_id"] = lambda: F.coalesce(*_ids(), *([F.concat(F.lit("row-"), F.hex(F.xxhash64(*list(LABELS))))] if facts["unnumbered"] else []))
    typed["_number"] = lambda: P.present(col("reg_number"))
    typed["_any_year"] = lambda: F.regexp_extract(F.concat_ws(" ", *[col(k) for k in ("app_date", "priority_date", "pub_date", "app_number", "pub_number")]), r"(?<!\d)((?:19|20)\d{2})", 1).try_cast("int")
    d = c.select(F.monotonically_increasing_id().alias("_row"), *[v().alias(k) for k, v in typed.items() if known is None or k in known])
    named = columns is None or "_names" in known
    if named:  # parsed and numbered once, whatever is asked of the frame later
        d = stored(d)

    year = F.coalesce(*[F.year(k) for k in ("app_date", "priority_date", "pub_date")])
    granted = col("is_granted") if facts.get("granted_known") else F.when(col("_number"), True).otherwise(F.when(col("legal_status") != "Unknown", col("legal_status").isin(GRANTED_STATUSES)))
    d = d.withColumns(chosen({f"{k}_year": F.year(k) for k in KINDS["date"]} | {"base_year": year if facts.get("dated") else col("_any_year"), "is_granted": granted, "active_flag": P.active_flag(col("is_active"), col("legal_status"))}))

    rules = tech_rules or {}
    ruled = lambda x: P.apply_label_rules(x, rules.get("mapping", {}), rules.get("noise", []))
    any_class = any(facts.get(k) for k in _TECH_FACTS)
    main = col("tech_multi") if facts.get("has_tech_multi") else _levels("tech_", facts)
    levels = {"tech_l1_list": col("tech_l1"), "tech_l2_list": col("tech_l2"), "tech_l3_list": col("tech_l3"), "tech_list": main}
    if not any_class:
        levels = {"tech_l1_list": col("ipc_sections"), "tech_l2_list": col("ipc_classes"), "tech_l3_list": col("ipc_list"), "tech_list": col("ipc_list")}
    d = d.withColumns({k: ruled(v) for k, v in chosen(levels).items()} | chosen({"tech_b_list": _levels("tech_b_", facts), "tech_c_list": _levels("tech_c_", facts), "agents": col("agent")}))
    if not named:
        return Documents(d.select(*dict.fromkeys(["doc_id", *columns])), present)

    given = applicant_rules or {}
    names = stored(name_table(d.select(F.explode("_names")), given.get("map"), given.get("groups")))
    d = rename_list(d, names, "_names", "co_applicants")
    d = d.withColumns({"applicant_raw": F.coalesce(F.get("_names", F.lit(0)), F.lit("")), "applicant": F.coalesce(F.get("co_applicants", F.lit(0)), F.lit(""))})
    if asked("owner"):
        d = canonical_owner(d, names) if "assignee" in present else d.withColumn("owner", F.lit(None).cast("string"))
    if columns is not None:
        return Documents(d.select(*dict.fromkeys(["doc_id", *columns])), present)
    return Documents(stored(d.drop("_row", "_names", "_number", "_any_year")), present)


def l1_lookup(docs: DataFrame) -> DataFrame:
    """label, l1: the first-level class that stands beside a deeper label, the third level before the second, the most frequent first."""
    deep = docs.select(F.explode(F.concat(F.transform("tech_l3_list", lambda x: F.struct(F.lit(0).alias("o"), x.alias("label"))), F.transform("tech_l2_list", lambda x: F.struct(F.lit(1).alias("o"), x.alias("label"))))).alias("x"), F.get("tech_l1_list", F.lit(0)).alias("l1")).where("l1 is not null")
    n = deep.groupBy("x.label", "x.o", "l1").agg(F.count("*").alias("n"))
    return n.groupBy("label").agg(F.min_by("l1", F.struct("o", -F.col("n"), "l1")).alias("l1"))


def suggest_merges(labels: list[str], ratio: float = 0.88, most: int = 120) -> list[list[str]]:
    """Groups of at most ``most`` labels that are spelt nearly alike (a bounded list, on the driver)."""
    from difflib import SequenceMatcher

    chosen = [x for x in labels if x != UNCLASSIFIED][:most]
    root = {x: x for x in chosen}

    def find(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(chosen):
        for b in chosen[i + 1 :]:
            if SequenceMatcher(None, a.lower(), b.lower()).ratio() >= ratio:
                root[find(b)] = find(a)
    groups: dict[str, list[str]] = {}
    for x in chosen:
        groups.setdefault(find(x), []).append(x)
    return [g for g in groups.values() if len(g) > 1]
