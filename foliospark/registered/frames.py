"""Queries on the standard frame that is built from untidy text: the tables' documents, written as exports write them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import expand as X
from ..operators import filters as W
from ..plans import frame, mapping
from ..plans.binding import documents, sql
from ..plans.stored import document_frame, once, stored
from . import Registry

REG = Registry()
IPC = ["H01L 23/28; H01L 25/065", "h05k1/18", "C08L 63/00|H01L 21/56"]


def _turn(options: list[Column], by: Column) -> Column:
    turn = F.pmod(by, F.lit(len(options)))
    return F.coalesce(*[F.when(turn == i, x) for i, x in enumerate(options)])  # of the options one is computed


def _headed() -> dict[str, tuple[str, Callable[[], Column]]]:
    """By the header of a text column the columns of a document that it is made of, and how."""
    c = F.col
    day = lambda d: _turn([F.date_format(d, f) for f in ("yyyy-MM-dd", "yyyy.M.d", "yyyy/MM/dd", "yyyyMMdd")] + [F.concat(F.lit("10-2020-0123456 ("), F.date_format(d, "yyyy-MM-dd"), F.lit(")")), F.concat(F.year(d), F.lit("년 "), F.month(d), F.lit("월 "), F.day(d), F.lit("일"))], c("doc_id"))
    dressed = lambda x, i: _turn([F.concat(x, F.lit(" Co., Ltd.")), F.concat(F.lit("(주)"), x), F.concat(F.lower(x), F.lit(" corp")), x], c("doc_id") + i)
    lists = lambda x: _turn([F.to_json(F.concat(x, F.slice(x, 1, 1))), F.concat_ws("|", x), F.concat(F.concat_ws("; ", x), F.lit("; nan"))], c("doc_id"))
    return {
        "공개번호": ("doc_id base_year", lambda: F.concat(F.lit("KR10-"), "base_year", F.lit("-"), F.lpad(c("doc_id").cast("string"), 9, "0"), F.lit("A"))), "출원일": ("doc_id app_date", lambda: day(c("app_date"))), "등록일": ("doc_id reg_date", lambda: day(c("reg_date"))),
        "출원인": ("doc_id co_applicants", lambda: F.array_join(F.transform("co_applicants", dressed), "; ")), "현재 권리자": ("owner", lambda: F.concat("owner", F.lit(" Inc."))), "발명자": ("inventors", lambda: F.array_join("inventors", "; ")),
        "다중 기술분류": ("doc_id tech_list", lambda: lists(c("tech_list"))), "기술 대분류": ("tech_l1_list", lambda: F.array_join("tech_l1_list", "; ")), "기술 중분류": ("tech_list tech_b_list", lambda: F.when(F.size("tech_list") > 2, F.get("tech_b_list", F.lit(0))).otherwise("")),
        "법적상태": ("legal_status", lambda: F.when(c("legal_status") == "Granted-Active", "등록").when(c("legal_status") == "Pending", "공개").otherwise("")), "등록 여부": ("is_granted", lambda: F.when(c("is_granted"), "Y").when(~c("is_granted"), " no ").otherwise("")),
        "피인용 수": ("cites_forward", lambda: F.concat(c("cites_forward").cast("long").cast("string"), F.lit("건"))), "청구항 수": ("claims_count", lambda: F.format_number(c("claims_count") * 100, 0)), "분류 신뢰도": ("class_confidence", lambda: c("class_confidence").cast("string")), "국가": ("country", lambda: F.substring("country", 1, 2)),
        "해결과제": ("agents", lambda: F.concat(F.lit("본 발명은 "), F.get("agents", F.lit(0)), F.lit("을 제공하는 것이다"))), "해결수단": ("tech_c_list", lambda: F.get("tech_c_list", F.lit(0))), "IPC/CPC 분류": ("doc_id", lambda: _turn([F.lit(x) for x in IPC], c("doc_id"))),
        "심사청구 여부": ("tech_list", lambda: F.when(F.size("tech_list") >= 3, "예").when(F.size("tech_list") == 2, "무").otherwise("")), "분할출원 여부": ("oa_count", lambda: F.when(c("oa_count") > 2, "Y").otherwise("")), "최우선출원국가": ("country", lambda: F.lower(F.substring("country", 1, 2))),
    }


def untidy(docs: DataFrame, headers: list[str] | None = None) -> DataFrame:
    """Text columns (all, or those with the ``headers``) of an export: dates in six layouts, names with legal forms, classes in three kinds of lists."""
    return docs.select(*[made().alias(k) for k, (_, made) in _headed().items() if headers is None or k in headers])


def built(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The frame of the untidy table, its columns found by their headers and checked by their values: the whole, or for all rows some of its columns."""

    def make(raw: DataFrame, found: dict[str, dict]) -> DataFrame:
        found = mapping.validate_mapping(raw, found)
        return frame.build_frame(raw, {k: v["column"] for k, v in found.items()}, columns=columns).df

    if columns is None:
        raw = untidy(document_frame(spark, sf_dir))
        return once(spark, sf_dir, "built", lambda: make(raw, mapping.suggest_mapping(raw.columns)))
    # Of the documents only what the columns need is gathered, and written once for the passes over it.
    headed, needed = _headed(), frame.concepts_of(columns)
    found = {k: v for k, v in mapping.suggest_mapping(list(headed)).items() if k in needed}
    headers = [v["column"] for v in found.values()]
    return make(stored(untidy(documents(spark, sf_dir, {x for h in headers for x in headed[h][0].split()}), headers)), found)


def _add(name: str, columns: str, f, text: str) -> None:  # noqa: ANN001
    """``f`` over the named columns of the frame."""
    REG.add(name, lambda s, d: f(built(s, d, columns.split())), sql(text, "ud AS (SELECT *, 'KR10-' || base_year || '-' || lpad(doc_id::VARCHAR, 9, '0') || 'A' AS num FROM docs)"))


_add("frame_dates", "app_date reg_date base_year", lambda d: d, "SELECT num AS doc_id, app_date, reg_date, base_year FROM ud")
_add("frame_names", "applicant co_applicants inventors", lambda d: d, "SELECT num AS doc_id, applicant, co_applicants, inventors FROM ud")
_add("frame_owner", "owner", lambda d: d, "SELECT num AS doc_id, owner FROM ud")
_add("frame_classes", "tech_list tech_l1_list ipc_list", lambda d: d, "SELECT num AS doc_id, tech_list, tech_l1_list, CASE doc_id % 3 WHEN 0 THEN ['H01L'] WHEN 1 THEN ['H05K'] ELSE ['C08L', 'H01L'] END AS ipc_list FROM ud")
_add("frame_states", "legal_status is_granted country", lambda d: d, "SELECT num AS doc_id, legal_status, is_granted, country[:2] AS country FROM ud")
_add("frame_numbers", "cites_forward claims_count class_confidence", lambda d: d, "SELECT num AS doc_id, cites_forward, claims_count * 100 AS claims_count, class_confidence FROM ud")
_add("frame_statements", "problem solution", lambda d: d, "SELECT num AS doc_id, agents[1] AS problem, tech_c_list[1] AS solution FROM ud")
ID = "SELECT num AS doc_id FROM ud WHERE "
_drill = lambda name, columns, drill, where: _add(name, columns, lambda d: W.select_documents(d, drill).select("doc_id"), ID + where)
_drill("drill_ipc", "ipc_list", {"ipc_main": "C08"}, "doc_id % 3 = 2")
_drill("drill_cell_group", "problem solution", {"cell_group": {"problems": ["BUILDING", "MACHINERY"], "solutions": ["1-URGENT", "5-LOW"]}}, "agents[1] IN ('BUILDING', 'MACHINERY') AND tech_c_list[1] IN ('1-URGENT', '5-LOW')")
_drill("drill_level", "tech_l1_list", {"tech_l1": "ECONOMY", "tech_levels_primary": True}, "tech_l1_list[1] = 'ECONOMY'")
_drill("drill_path_empty", "tech_l2_list", {"tech_path_next_empty": "tech_l2"}, "len(tech_list) <= 2")
_drill("drill_flags", "exam_request_flag divisional_flag", {"exam_requested": True, "divisional": True}, "len(tech_list) >= 3 AND oa_count > 2")
_drill("drill_not_requested", "exam_request_flag", {"exam_requested": False}, "len(tech_list) = 2")
_drill("drill_first_country", "first_filing_country legal_status", {"first_country": "as", "legal_status": "Pending"}, "country = 'ASIA' AND legal_status = 'Pending'")
_add("applicants_without", "applicant co_applicants", lambda d: X.explode_applicants(d, exclude=["NATION_6", "NATION_18"]).groupBy("company").agg(F.count("*").alias("n")), "SELECT company, count(*) AS n FROM (SELECT unnest(co_applicants) AS company FROM ud) WHERE company NOT IN ('NATION_6', 'NATION_18') GROUP BY company")
