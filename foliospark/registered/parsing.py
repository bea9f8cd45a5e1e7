"""Queries on the parsers: untidy strings made from the tables' keys, parsed, against the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..plans.binding import table
from . import Registry

REG = Registry()


def _cases(values: list[str | None], key: F.Column, n: int | None = None):
    """The value whose turn it is by ``key``."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(n or len(values))).cast("int"))


def _list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


def _simple(name: str, values: list[str | None], parser, expected: list, kind: str) -> None:
    """A parser over cases dealt to the customers; in SQL the expected result of each case is looked up."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = table(spark, sf_dir, "customer")
        return c.select("c_custkey", parser(_cases(values, F.col("c_custkey"))).alias("parsed"))

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return _list(v)
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper()

    REG.add(name, run, f"SELECT c_custkey, CAST([{', '.join(lit(v) for v in expected)}][(c_custkey % {len(values)} + 1)::INT] AS {kind}) AS parsed FROM customer")


_simple("parse_bool", ["Y", " no ", "TRUE", "0", "유", "무", "2.0", "maybe", "", None, "존속", "inactive"], P.parse_bool, [True, False, True, False, True, False, True, None, None, None, True, False], "BOOLEAN")
_simple("parse_dates", ["2020-01-02", "2020.1.2", "2020/12/31", "20200102", "10-2020-0123456 (2020-01-02)", "2020년 3월 4일", "2021", "2021.0", "43831", "Jan 2 2020", "none", "2020-13-45", None, "KR 20190304 A", "12345678"],
        P.parse_date, ["2020-01-02", "2020-01-02", "2020-12-31", "2020-01-02", "2020-01-02", "2020-03-04", "2021-01-01", "2021-01-01", "2020-01-01", "2020-01-02", None, None, None, "2019-03-04", None], "DATE")
_simple("parse_multiclass", ['["A", "B", "A"]', "A|B; C", "A; B ;;A", "A, B,nan", "one", "", None, "[broken, x", "nan"], P.parse_multi, [["A", "B"], ["A", "B; C"], ["A", "B"], ["A", "B"], ["one"], [], [], ["[broken", "x"], []], "VARCHAR[]")
_simple("split_names", ["Kim; Lee", "SAMSUNG CO., LTD.", "Kim, Lee", "A, Bob", "x|y", "", None, "마이크론 테크놀로지, 인크", "one"], P.split_names, [["Kim", "Lee"], ["SAMSUNG CO., LTD."], ["Kim", "Lee"], ["A, Bob"], ["x", "y"], [], [], ["마이크론 테크놀로지, 인크"], ["one"]], "VARCHAR[]")
_simple("legal_status", ["등록", "존속기간만료", "Pending", "공개", "거절결정", "lapsed (non-payment)", "취하", "", None, "xyz", "Granted-Active", "expired"], P.legal_status, ["Granted-Active", "Granted-Expired", "Pending", "Pending", "Rejected", "Lapsed", "Withdrawn", "Unknown", "Unknown", "Unknown", "Granted-Active", "Granted-Expired"], "VARCHAR")
_simple("label_rules", ["A;B", "본딩;123;-", "B;A;b1", "N/A;C"], lambda c: P.apply_label_rules(P.parse_multi(c), {"B": "A", "b1": "B"}, ["C"]), [["A"], ["본딩", "미분류"], ["A"], ["미분류"]], "VARCHAR[]")
_simple("ipc_codes", ["H01L 23/28; H01L 25/065", "h04l9/00", "none", "B60K|X99Z", None], P.ipc_codes, [["H01L"], ["H04L"], [], ["B60K"], []], "VARCHAR[]")
_simple("clean_statement", ["본 발명은 휨 저감을 제공하는 것이다", "상기 본 고안의 방열", "plain text", "", None], P.clean_statement, ["휨 저감", "방열", "plain text", "", None], "VARCHAR")
_simple("claim_kind", ["... 제조 방법", "a system", "필름", "수지 조성물", "nothing", None], P.claim_kind, ["제조방법", "시스템", "필름·적층체", "조성물·재료", "기타", "기타"], "VARCHAR")
_simple("parse_vector", ["[1, 2.5]", "1 2,3", "1 x", "", None], lambda c: F.to_json(P.parse_vector(c)), ["[1.0,2.5]", "[1.0,2.0,3.0]", None, None, None], "VARCHAR")
_simple("document_number", ["KR10-2020-0001234A", "us 9,123 b2", "", None], lambda c: P.document_number(c, True), ["KR1020200001234", "US9123", "", ""], "VARCHAR")

REG.add(
    "parse_numeric",
    lambda s, d: table(s, d, "customer").select("c_custkey", P.parse_numeric(F.concat(F.lit("약 "), F.format_number("c_custkey", 0), _cases(["건", " 회", "", ".5 x"], F.col("c_custkey")))).alias("parsed")),
    "SELECT c_custkey, c_custkey::DOUBLE + CASE WHEN c_custkey % 4 = 3 THEN 0.5 ELSE 0 END AS parsed FROM customer",
)
REG.add("json_props", lambda s, d: table(s, d, "events").select("event_id", P.json_field(F.col("props"), "$.k").cast("int").alias("k")), "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
REG.add("priority_number", lambda s, d: table(s, d, "orders").groupBy(P.parse_numeric(F.col("o_orderpriority")).alias("priority")).agg(F.count("*").alias("n")), "SELECT left(o_orderpriority, 1)::DOUBLE AS priority, count(*) AS n FROM orders GROUP BY 1")
REG.add(
    "keyword_top",
    lambda s, d: table(s, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")).where("n >= 20"),
    "SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents) GROUP BY ALL HAVING count(*) >= 20",
)
