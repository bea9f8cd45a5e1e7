"""Queries on the engine's own checks, on samples and on both ends of lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as A
from ..operators import selfcheck as Q
from ..operators import signals as S
from ..plans.binding import sql
from . import Registry
from .core import PAIRS, TECH

REG = Registry()

COUNTS = """s AS (SELECT count(*) AS n, count(base_year) AS y, count(*) FILTER (base_year > 1997) AS ahead, count(*) FILTER (trim(applicant) <> '') AS a, count(doc_id) AS d, count(DISTINCT doc_id) AS u,
count(*) FILTER (reg_date < app_date) AS bad, count(*) FILTER (reg_date IS NOT NULL AND app_date IS NOT NULL) AS dated, count(active_flag) AS act, count(cites_forward) AS c FROM docs)"""
REG.docs(
    "self_check", lambda d: Q.self_check(d, 1997),
    sql("""SELECT 'years add up' AS name, 'passed' AS status, n AS value, n AS "of" FROM s UNION ALL SELECT 'years known', CASE WHEN y >= 0.9 * n THEN 'passed' ELSE 'attention' END, y, n FROM s
UNION ALL SELECT 'years ahead', CASE WHEN ahead = 0 THEN 'passed' ELSE 'attention' END, ahead, y FROM s UNION ALL SELECT 'applicants known', CASE WHEN a >= 0.9 * n THEN 'passed' ELSE 'attention' END, a, n FROM s
UNION ALL SELECT 'numbers repeated', CASE WHEN d = u THEN 'passed' ELSE 'attention' END, d - u, d FROM s UNION ALL SELECT 'granted before filed', CASE WHEN bad = 0 THEN 'passed' ELSE 'attention' END, bad, dated FROM s
UNION ALL SELECT 'deep class without top class', 'unknown', NULL, NULL UNION ALL SELECT 'states known', CASE WHEN act >= 0.8 * n THEN 'passed' ELSE 'attention' END, act, n FROM s UNION ALL SELECT 'citations known', 'passed', c, n FROM s""", COUNTS),
)


def _top(chart: str, label: str, source: str, by: str) -> str:
    return f"(SELECT '{chart}' AS chart, {label} AS label, count(*) AS n FROM {source} GROUP BY {by} ORDER BY n DESC, {by} LIMIT 40)"


CELLS = " UNION ALL ".join([
    _top("class", "tech", "tech", "tech"), _top("year", "base_year::VARCHAR", "docs", "base_year"), _top("class and year", "tech || ' ' || base_year", "tech", "tech, base_year"),
    _top("pair", "a || ' ' || b", "pairs", "a, b"), _top("applicant", "company", "(SELECT unnest(co_applicants) AS company FROM docs)", "company"), _top("state", "legal_status", "docs", "legal_status"),
])
REG.docs("self_reconcile", lambda d: Q.reconcile(d, Q.chart_cells(d)), sql(f"SELECT chart, label, n, n AS drilled, TRUE AS agrees FROM ({CELLS})", TECH, PAIRS))
REG.docs(
    "seeded_sample", lambda d: A.seeded_sample(d.select("doc_id", "applicant", "base_year"), 600, ["doc_id"]),
    sql("SELECT doc_id, applicant, base_year FROM docs QUALIFY row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || doc_id), 1, 15))::BIGINT) <= 600"),
)
REG.docs(
    "grant_speed", lambda d: S.grant_speed(d).withColumn("days", F.round("days", 6)),
    sql("""SELECT company, n, round(days, 6) AS days, CASE WHEN t <= 6 THEN 'top' ELSE 'bottom' END AS "end" FROM (SELECT *, row_number() OVER (ORDER BY days DESC, company) AS t, row_number() OVER (ORDER BY days, company DESC) AS b FROM
(SELECT company, count(*) AS n, avg(date_diff('day', app_date, reg_date)) AS days FROM (SELECT unnest(co_applicants) AS company, app_date, reg_date FROM docs WHERE reg_date IS NOT NULL) GROUP BY company HAVING count(*) >= 3)) WHERE t <= 6 OR b <= 6"""),
)
REG.docs(
    "divisional_by_parent",
    lambda d: S.flag_rate(d.select("applicant", F.when(F.size("tech_list") > 2, F.size("tech_list") >= 5).alias("divisional_flag"), F.when(F.col("legal_status") == "Pending", F.col("owner")).alias("parent_app_number")), S.divisional(), {"company": F.col("applicant")}, 8).withColumn("rate", F.round("rate", 9)),
    sql("SELECT applicant AS company, count(*) AS n, round(avg((len(tech_list) >= 5 OR (legal_status = 'Pending' AND owner IS NOT NULL))::INT), 9) AS rate FROM docs GROUP BY applicant HAVING count(*) >= 8"),
)
