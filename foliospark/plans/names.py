"""Company names: several spellings to one. The rule is a loop, so it runs once for each distinct name."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What is dropped from names.
MARKERS = ["(주)", "㈜", "（주）", "주식회사", "(유)", "(재)", "(사)", "(학)"]
SUFFIXES = [
    "co., ltd.", "co.,ltd.", "co., ltd", "co.,ltd", "co. ltd", "co ltd", "company limited", "corporation", "incorporated", "corp.", "corp", "inc.", "inc", "ltd.", "ltd", "llc",
    "l.l.c.", "gmbh & co. kg", "gmbh", "ag", "s.a.", "sa", "s.p.a.", "spa", "b.v.", "bv", "n.v.", "nv", "k.k.", "kk", "kabushiki kaisha", "co", "company", "limited", "plc",
]
KOREAN_SUFFIXES = ["주식회사", "(주)", "㈜", "유한회사", "유한책임회사", "합자회사", "재단법인", "사단법인", "학교법인", "국립대학법인", "주)", "유한공사", "고분유한공사"]
SPELT_SUFFIXES = [
    "인코포레이티드", "인코퍼레이티드", "아이엔씨", "인크", "리미티드", "리미테드", "엘티디", "엘엘씨", "엘엘피", "피엘씨", "코퍼레이션", "코포레이션", "코오포레이션", "컴퍼니", "캄파니", "게엠베하", "아게",
    "에스에이", "에스피에이", "에스알엘", "비브이", "엔브이", "카게", "피티이", "가부시키가이샤", "가부시끼가이샤", "카부시키가이샤", "카부시키카이샤", "유겐가이샤", "유겐카이샤",
]
PREFIXES = ["주식회사 ", "(주)", "㈜", "유한회사 ", "가부시키가이샤 ", "가부시끼가이샤 ", "카부시키가이샤 ", "카부시키카이샤 ", "유겐가이샤 ", "유겐카이샤 "]
_EDGE = " ,.;·-"
#: A legal form at the end: of its own word, or (Korean ones) attached.
_TAIL = re.compile(r"(?i)(?:(?<= )(?:" + "|".join(re.escape(s) for s in sorted(SUFFIXES + SPELT_SUFFIXES, key=len, reverse=True)) + r")|(?:" + "|".join(re.escape(s) for s in sorted(KOREAN_SUFFIXES, key=len, reverse=True)) + r"))$")
_HEAD = re.compile(r"(?i)^(?:" + "|".join(re.escape(p) for p in PREFIXES) + r")")


def standard_name(name: str | None) -> str:
    """Without brackets, special characters and legal forms, however many; ASCII names in upper case. Never empty where the name isn't."""
    original = (name or "").strip()
    if original.lower() in ("", "nan", "none"):
        return ""
    s = original
    for m in MARKERS:
        s = s.replace(m, " ")
    s = " ".join(re.sub(r"[()\[\]{}（）\"'`!@#$%^*+=~?<>]", " ", s).split())
    while True:
        before = s
        s = s.strip(_EDGE) or s
        for pattern in (_TAIL, _HEAD):
            s = pattern.sub("", s).strip(_EDGE) or s
        if s == before:
            break
    s = " ".join(s.split()) or original
    return s.upper() if s.isascii() else s


@F.pandas_udf(StringType())
def _standard(names: pd.Series) -> pd.Series:
    return names.map(standard_name)


def name_table(names: DataFrame, rules: dict[str, str] | None = None, groups: dict[str, str] | None = None) -> DataFrame:
    """raw, auto, display of each distinct name in the one column of ``names``.

    A rule for the raw or the automatic name wins over the automatic name, and
    is followed once more; groups come last.
    """
    raw = names.toDF("raw").where("raw is not null and trim(raw) <> ''").distinct()
    t = raw.withColumn("auto", _standard("raw"))

    def lookup(c: Column, table: dict[str, str] | None) -> Column:
        pairs = [F.lit(x) for kv in (table or {}).items() for x in kv]
        return F.try_element_at(F.create_map(*pairs), c) if pairs else F.lit(None).cast("string")

    chosen = F.coalesce(lookup(F.col("raw"), rules), lookup(F.col("auto"), rules), F.col("auto"))
    again = F.coalesce(lookup(chosen, rules), chosen)
    return t.withColumn("display", F.coalesce(lookup(again, groups), again))


#: Names of a table that rows look up themselves; more are joined.
LOOKED_UP = 256


def rename_list(df: DataFrame, names: DataFrame, column: str, out: str, row: str = "_row") -> DataFrame:
    """``df`` with ``out``: the display names of the list in ``column``, distinct, in order.

    Up to LOOKED_UP names go to the rows as a map. Beyond that the list is spread,
    joined and gathered by the number of its row, so no task holds the whole name
    table, and rows with one doc_id keep their own names.
    """
    if names.limit(LOOKED_UP + 1).count() <= LOOKED_UP:
        table = names.where("display is not null").agg(F.map_from_entries(F.collect_list(F.struct("raw", "display"))).alias("_map"))
        shown = F.transform(column, lambda x: F.coalesce(F.try_element_at("_map", x), x))
        return df.crossJoin(F.broadcast(table)).withColumn(out, F.array_distinct(F.coalesce(shown, F.array().cast("array<string>")))).drop("_map")
    long = df.select(row, F.posexplode(column).alias("_p", "raw")).join(names.select("raw", "display"), "raw", "left")
    lists = long.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("display", "raw").alias("d")))).alias("_l"))
    return df.join(lists, row, "left").withColumn(out, F.array_distinct(F.coalesce(F.transform("_l", lambda x: x["d"]), F.array().cast("array<string>")))).drop("_l")


def canonical_owner(df: DataFrame, names: DataFrame) -> DataFrame:
    """``df``, of lists _names, with owner: the assignee under the spelling that is most frequent among applicants of the same standard name.

    An applicant is the first of a list under its display name. Names are counted as they stand and then shown, each once instead of row by row.
    """
    first = df.groupBy(F.get("_names", F.lit(0)).alias("raw")).agg(F.count("*").alias("n")).join(names.select("raw", "display"), "raw", "left")
    counted = first.groupBy(F.coalesce("display", "raw", F.lit("")).alias("applicant")).agg(F.sum("n").alias("n"))
    spelt = counted.join(names.select(F.col("display").alias("applicant"), "auto").distinct(), "applicant").groupBy("auto").agg(F.min_by("applicant", F.struct(-F.col("n"), "applicant")).alias("_spelling"))
    owners = df.select(F.col("assignee").alias("raw")).where("trim(raw) <> ''").distinct().withColumn("auto", _standard("raw")).join(spelt, "auto", "left").select(F.col("raw").alias("assignee"), F.coalesce("_spelling", F.nullif(F.col("auto"), F.lit(""))).alias("owner"))
    return df.join(owners, "assignee", "left")
