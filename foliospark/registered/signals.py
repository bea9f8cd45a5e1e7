"""Queries on citations, inventors, survival, procedure and rights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import signals as S
from ..plans.binding import sql, table
from . import Registry
from .company import rounded
from .core import COMPANY, TECH, Y

REG = Registry()
WEIGHTS = {"direct_citations": 1.0, "indirect_citations": 0.7, "cross_class": 0.8, "cross_company": 0.8, "family_expansion": 0.6, "legal_strength": 0.6}
INF = """orat AS (SELECT tech, applicant, 1 - count(*) / sum(count(*)) OVER (PARTITION BY tech) AS other FROM tech GROUP BY tech, applicant),
xo AS (SELECT t.doc_id, avg(other) AS other FROM tech t JOIN orat o ON o.tech = t.tech AND o.applicant = t.applicant GROUP BY t.doc_id),
inf AS (SELECT d.doc_id, cites_forward AS direct_citations, cites_forward * ln(1 + cites_backward) AS indirect_citations, len(tech_list)::DOUBLE AS cross_class, coalesce(other, 0) * cites_forward AS cross_company, family_size AS family_expansion,
  coalesce(active_flag, FALSE)::INT * ln(1 + len(family_countries)) + greatest(date_diff('day', DATE '2010-01-01', expiry_date) / 365.25, 0.0) / 20 AS legal_strength FROM docs d LEFT JOIN xo ON xo.doc_id = d.doc_id)"""
REG.docs("influence", lambda d: S.influence(d, as_of="2010-01-01").select("doc_id", F.round("influence", 6).alias("influence")),
         sql(f"SELECT doc_id, round(s, 6) AS influence FROM (SELECT doc_id, round(({' + '.join(f'norm_{k} * {w}' for k, w in WEIGHTS.items())}) / {sum(WEIGHTS.values())}, 9) AS s FROM nz) ORDER BY s DESC, doc_id LIMIT 10", TECH, INF, M.normalize_sql("inf", {"direct_citations": True, "indirect_citations": True, "cross_class": False, "cross_company": True, "family_expansion": True, "legal_strength": False})))
REG.docs("self_other_citations", lambda d: S.self_other_citations(d, F.col("oa_count"), F.col("cites_forward") - F.col("oa_count")).withColumn("self_rate", F.round("self_rate", 9)), sql("SELECT company, sum(oa_count) AS self, sum(cites_forward - oa_count) AS other, round(sum(oa_count) / sum(cites_forward), 9) AS self_rate FROM comp GROUP BY company ORDER BY sum(cites_forward) DESC, company LIMIT 12", COMPANY))


def _refs(d: DataFrame) -> DataFrame:
    """Document numbers from ids, and references to the documents some ids before, one of them with another kind code."""
    n = lambda k: F.concat(F.lit("KR10-"), F.lpad((F.col("doc_id") - k).cast("string"), 8, "0"))
    return d.select("doc_id", "applicant", F.concat(n(0), F.lit("A")).alias("pub_number"), F.array(F.concat(n(7), F.lit("A")), F.concat(n(13), F.lit("B1")), n(0)).alias("refs"))


NO = "'KR10' || lpad((doc_id - {})::VARCHAR, 8, '0')"
REFS = f"""k AS (SELECT doc_id, applicant, {NO.format(0)} AS n FROM docs), r AS (SELECT doc_id, applicant, {NO.format(7)} AS n FROM docs UNION ALL SELECT doc_id, applicant, {NO.format(13)} FROM docs),
cp AS (SELECT DISTINCT r.doc_id AS citing, k.doc_id AS cited, r.applicant AS source, k.applicant AS target FROM r JOIN k ON k.n = r.n AND k.doc_id <> r.doc_id)"""
REG.docs("citation_pairs", lambda d: S.citation_pairs(_refs(d), ["pub_number"], "refs"), sql("SELECT * FROM cp", REFS))
REG.docs("citation_network", lambda d: S.citation_network(S.citation_pairs(_refs(d), ["pub_number"], "refs")), sql("SELECT source, target, count(*) AS n FROM cp WHERE source <> target GROUP BY 1, 2", REFS))


def _alone(d: DataFrame) -> DataFrame:
    """Each document with its lead applicant alone; a supplier's nation is an applicant of all its documents."""
    return d.withColumn("co_applicants", F.array("applicant"))


MV = """rw AS (SELECT * REPLACE ([applicant] AS co_applicants), unnest(inventors) AS inventor FROM docs), sq AS (SELECT inventor, doc_id, base_year, applicant, co_applicants, tech_list, inventors, country, lag(base_year) OVER w AS py, lag(applicant) OVER w AS pa, lag(co_applicants) OVER w AS pc, lag(tech_list) OVER w AS pt, lag(inventors) OVER w AS pi, lag(country) OVER w AS pk FROM rw WINDOW w AS (PARTITION BY inventor ORDER BY base_year, doc_id)),
mv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY inventor, pa, applicant ORDER BY base_year, doc_id) AS r FROM sq WHERE pa IS NOT NULL AND pa <> applicant AND NOT list_has_any(pc, co_applicants)) WHERE r = 1),
cn AS (SELECT inventor, count(*) AS n FROM rw GROUP BY inventor),
mo AS (SELECT m.inventor, pa AS source, applicant AS target, base_year AS year, round(0.35 * coalesce(len(list_intersect(list_filter(pi, lambda x: x <> m.inventor), list_filter(inventors, lambda x: x <> m.inventor)))::DOUBLE / nullif(len(list_distinct(list_concat(list_filter(pi, lambda x: x <> m.inventor), list_filter(inventors, lambda x: x <> m.inventor)))), 0), 0) + 0.25 * coalesce(len(list_intersect(pt, tech_list))::DOUBLE / nullif(len(list_distinct(list_concat(pt, tech_list))), 0), 0)
  + 0.2 * CASE WHEN base_year - py <= 3 THEN 1.0 ELSE greatest(0.0, 1 - 0.1 * (base_year - py - 3)) END + 0.1 * (pk = country)::INT + 0.1 * (1 - (cn.n - 1) / greatest((SELECT max(n) FROM cn) - 1, 1)), 9) AS confidence FROM mv m JOIN cn ON cn.inventor = m.inventor)"""
REG.docs("inventor_moves", lambda d: S.inventor_moves(_alone(d)).withColumn("confidence", F.round("confidence", 6)), sql("SELECT inventor, source, target, year, round(confidence, 6) AS confidence, confidence < 0.6 AS uncertain FROM mo", MV))
REG.docs("mobility_edges", lambda d: S.mobility_edges(S.inventor_moves(_alone(d))).withColumn("confidence", F.round("confidence", 6)), sql("SELECT source, target, count(*) AS n, round(avg(confidence), 6) AS confidence FROM mo GROUP BY 1, 2", MV))


def _lived(d: DataFrame) -> DataFrame:
    """Granted documents, lapsed after as many quarters as they have citations where their status is Unknown."""
    return S.durations(d.withColumn("lapse_date", F.when(F.col("legal_status") == "Unknown", F.date_add("reg_date", (F.col("cites_forward") * 400).cast("int")))), "2005-06-30")


KM = """lv AS (SELECT *, tech_list[1] AS key, date_diff('day', reg_date, coalesce(lapse, DATE '2005-06-30')) / 365.25 AS duration, (lapse IS NOT NULL)::INT AS event FROM (SELECT *, CASE WHEN legal_status = 'Unknown' THEN reg_date + (cites_forward * 400)::INT END AS lapse FROM docs)),
lo AS (SELECT * FROM lv WHERE duration > 0 AND duration <= 25), kt AS (SELECT key, duration AS t, count(*) AS n, sum(event) AS d FROM lo GROUP BY ALL), kr AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY t DESC) AS r FROM kt),
km AS (SELECT key, t, r AS at_risk, d AS events, exp(sum(CASE WHEN d < r THEN ln(1 - d / r) ELSE -1e9 END) OVER (PARTITION BY key ORDER BY t)) AS survival FROM kr)"""
REG.docs("km_curve", lambda d: M.kaplan_meier(_lived(d).withColumn("key", S.primary_tech()), ["key"]).select("key", F.round("t", 9).alias("t"), "at_risk", "events", F.round("survival", 9).alias("survival")), sql("SELECT key, round(t, 9) AS t, at_risk::BIGINT AS at_risk, events::BIGINT AS events, round(survival, 9) AS survival FROM km WHERE events > 0", KM))
REG.docs("km_survival", lambda d: S.survival(_lived(d), S.primary_tech()).select("key", "n", *rounded("s5 s10 s18 median")), sql("SELECT x.key, x.n, round(coalesce(s5, 1), 9)::DOUBLE AS s5, round(coalesce(s10, 1), 9)::DOUBLE AS s10, round(coalesce(s18, 1), 9)::DOUBLE AS s18, round(median, 9) AS median FROM (SELECT key, count(*) AS n FROM lo GROUP BY key HAVING count(*) >= 10) x LEFT JOIN (SELECT key, min(survival) FILTER (t <= 5) AS s5, min(survival) FILTER (t <= 10) AS s10, min(survival) FILTER (t <= 18) AS s18, min(t) FILTER (survival <= 0.5 + 1e-12) AS median FROM km WHERE events > 0 GROUP BY key) k ON k.key = x.key", KM))


def _ended(d: DataFrame) -> DataFrame:
    """Documents without lapse dates: those of Unknown status have lapsed, on an expiry date that the citations give."""
    ended = F.col("legal_status") == "Unknown"
    return S.durations(
        d.withColumns({"legal_status": F.when(ended, "Lapsed").otherwise(F.col("legal_status")), "expiry_date": F.when(ended, F.date_add("reg_date", (F.col("cites_forward") * 400).cast("int"))).otherwise(F.col("expiry_date"))}),
        "2000-06-30",
    )


KM_ENDED = KM.replace("2005-06-30", "2000-06-30").replace("WHEN legal_status = 'Unknown' THEN", "WHEN legal_status = 'Unknown' AND reg_date + (cites_forward * 400)::INT <= DATE '2000-06-30' THEN")
REG.docs(
    "km_survival_by_expiry", lambda d: S.survival(_ended(d), S.primary_tech()).select("key", "n", *rounded("s5 median")),
    sql("SELECT x.key, x.n, round(coalesce(s5, 1), 9)::DOUBLE AS s5, round(median, 9) AS median FROM (SELECT key, count(*) AS n FROM lo GROUP BY key HAVING count(*) >= 10) x LEFT JOIN (SELECT key, min(survival) FILTER (t <= 5) AS s5, min(t) FILTER (survival <= 0.5 + 1e-12) AS median FROM km WHERE events > 0 GROUP BY key) k ON k.key = x.key", KM_ENDED),
)
FAM = "f AS (SELECT d.*, date_diff('day', t0, app_date) / 30.44 AS lag FROM (SELECT *, owner AS place FROM docs) d JOIN (SELECT family_id, min(app_date) AS t0 FROM docs GROUP BY 1) x ON x.family_id = d.family_id), f2 AS (SELECT * FROM f WHERE lag BETWEEN 0 AND 120 AND family_id IN (SELECT family_id FROM f WHERE lag BETWEEN 0 AND 120 GROUP BY 1 HAVING count(DISTINCT place) >= 2))"
REG.docs("market_entry", lambda d: S.market_entry(d.withColumn("country", F.col("owner"))).withColumn("months", F.round("months", 7)), sql("SELECT company, place AS country, count(*) AS n, round(avg(lag), 7) AS months FROM (SELECT *, unnest(co_applicants) AS company FROM f2) GROUP BY 1, 2 HAVING count(*) >= 3", FAM))
REG.docs("first_entries", lambda d: S.first_entries(d.withColumn("country", F.col("owner"))), sql("SELECT country, count(*) AS n, count(*) / (SELECT count(DISTINCT family_id) FROM docs) AS share FROM (SELECT family_id, arg_min(owner, (app_date, doc_id)) AS country FROM docs GROUP BY 1) GROUP BY 1"))
AG = "ag AS (SELECT DISTINCT company, base_year AS year, unnest(agents) AS agent FROM comp), af AS (SELECT *, min(year) OVER (PARTITION BY company, agent) AS first, min(year) OVER (PARTITION BY company) AS start FROM ag)"
REG.docs("new_agents_share", S.new_agents, sql("SELECT a.company, a.year, n, new_share, a.year > start AND n >= 3 AND new_share >= 0.25 AS signal FROM (SELECT company, year, avg((first = year)::INT) AS new_share, min(start) AS start FROM af GROUP BY ALL) a JOIN (SELECT company, base_year AS year, count(*) AS n FROM comp GROUP BY ALL) c ON c.company = a.company AND c.year = a.year", COMPANY, AG))
REG.docs("examiner_eye", lambda d: S.examiner_eye(d, F.col("oa_count"), F.col("npl_count")), sql("SELECT tech, count(*) AS n, avg(oa_count) AS avg_examiner, avg(npl_count) AS avg_applicant, avg(oa_count) > 1.8 * avg(npl_count) AND avg(oa_count) >= 2 AS risky FROM (SELECT oa_count, npl_count, unnest(tech_list) AS tech FROM docs) GROUP BY tech"))


def urgent() -> Column:
    return F.array_contains("tech_c_list", "1-URGENT")


REG.docs("expedited_rate", lambda d: S.flag_rate(d, urgent(), {"tech": S.primary_tech(), "year": F.col("base_year")}), sql("SELECT tech_list[1] AS tech, base_year AS year, count(*) AS n, avg(list_contains(tech_c_list, '1-URGENT')::INT) AS rate FROM docs GROUP BY 1, 2 HAVING count(*) >= 2"))
REG.docs("expedited_surge", lambda d: S.surge(d, urgent(), S.primary_tech()).select("key", *rounded("recent_rate prior_rate surge")), sql(f"SELECT key, round(a, 9) AS recent_rate, round(b, 9) AS prior_rate, round(a - b, 9) AS surge FROM (SELECT tech_list[1] AS key, avg(list_contains(tech_c_list, '1-URGENT')::INT) FILTER (base_year > {Y} - 3) AS a, avg(list_contains(tech_c_list, '1-URGENT')::INT) FILTER (base_year <= {Y} - 3) AS b, count(*) FILTER (base_year > {Y} - 3) AS n, count(*) FILTER (base_year <= {Y} - 3) AS m FROM docs GROUP BY 1) WHERE n >= 5 AND m >= 5"))
REG.docs("exam_request_rate", lambda d: S.flag_rate(d, F.col("is_granted"), {"company": F.col("applicant")}, 5), sql("SELECT applicant AS company, count(is_granted) AS n, avg(is_granted::INT) AS rate FROM docs GROUP BY 1 HAVING count(is_granted) >= 5"))
REG.docs("divisional_rate", lambda d: S.flag_rate(d, F.size("tech_list") >= 5, {"company": F.col("applicant")}, 8), sql("SELECT applicant AS company, count(*) AS n, avg((len(tech_list) >= 5)::INT) AS rate FROM docs GROUP BY 1 HAVING count(*) >= 8"))
REG.docs("burst_windows", lambda d: S.bursts(d, "applicant", "app_date", 60, 16))
MM = "date_diff('day', app_date, reg_date) / 30.44"
MAD = f"mx AS (SELECT doc_id, tech_list[1] AS key, round({MM}, 9) AS value FROM docs), md AS (SELECT key, quantile_cont(value, 0.5) AS med FROM mx GROUP BY key HAVING count(*) >= 8), mz AS (SELECT mx.*, med, abs(value - med) AS d FROM mx JOIN md ON md.key = mx.key), ma AS (SELECT key, quantile_cont(d, 0.5) AS mad FROM mz GROUP BY key)"
REG.docs("mad_outliers", lambda d: S.mad_outliers(d, F.datediff("reg_date", "app_date") / 30.44, S.primary_tech()).select("doc_id", "key", *rounded("value z", 7)), sql("SELECT doc_id, mz.key, round(value, 7) AS value, round(0.6745 * (value - med) / CASE WHEN mad > 0 THEN mad ELSE 1.0 END, 7) AS z FROM mz JOIN ma ON ma.key = mz.key WHERE abs(0.6745 * (value - med) / CASE WHEN mad > 0 THEN mad ELSE 1.0 END) > 2.5", MAD))
DI = """dk AS (SELECT *, tech_list[1] AS k FROM docs), dc AS (SELECT k, avg(claims_count) AS m, stddev_samp(claims_count) AS s FROM dk GROUP BY k ORDER BY count(*) DESC, k LIMIT 8), dt AS (SELECT company FROM comp GROUP BY company ORDER BY count(*) DESC, company LIMIT 8)"""
REG.docs("disclosure_z", lambda d: S.disclosure(d, F.col("claims_count")).withColumn("z", F.round("z", 7)),
         sql("SELECT x.company, x.k AS tech, x.n, round((x.mc - dc.m) / dc.s, 7) AS z FROM (SELECT company, k, count(*) AS n, avg(claims_count) AS mc FROM (SELECT *, unnest(co_applicants) AS company FROM dk) GROUP BY ALL HAVING count(*) >= 3) x JOIN dc ON dc.k = x.k WHERE x.company IN (SELECT company FROM dt)", COMPANY, DI))
REG.docs("disputes", lambda d: S.disputes(d, F.col("owner") != F.col("applicant")), sql("SELECT tech, count(*) AS n, count(*) FILTER (owner <> applicant) AS disputed, avg(cites_forward) FILTER (owner <> applicant) AS avg_cites_disputed, avg(cites_forward) FILTER (owner = applicant) AS avg_cites_other FROM (SELECT owner, applicant, cites_forward, unnest(tech_list) AS tech FROM docs) GROUP BY tech"))
REG.docs("dispute_edges", lambda d: S.dispute_edges(d, F.when(F.col("oa_count") >= 3, F.col("country"))), sql("SELECT country AS claimant, owner, count(*) AS n FROM docs WHERE oa_count >= 3 GROUP BY 1, 2"))
REG.docs("quality_split", lambda d: S.quality_split(d, urgent()), sql("SELECT list_contains(tech_c_list, '1-URGENT') AS flag, count(*) AS n, avg(cites_forward) AS avg_cites, avg(is_granted::INT) AS grant_rate, avg(active_flag::INT) AS active_rate FROM docs GROUP BY 1"))


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "Novelty and INVENTIVE step").when(F.col("event_type") == "click", "clarity, 112").when(F.col("event_type") == "view", "other matter").otherwise("")
    return S.rejection_reasons(table(spark, sf_dir, "events").withColumn("rejection_reason", text))


REG.add("rejection_reasons", _reasons, "SELECT reason, count(*) AS n FROM (SELECT unnest(CASE event_type WHEN 'error' THEN ['진보성', '신규성'] WHEN 'click' THEN ['기재불비'] ELSE ['기타'] END) AS reason FROM events WHERE event_type IN ('error', 'click', 'view')) GROUP BY reason")
REG.docs("science_link", S.science_link, sql("SELECT tech, count(*) AS n, avg((npl_count > 0)::INT) AS npl_rate, avg(npl_count) AS avg_npl, avg(cites_forward) FILTER (npl_count > 0) AS avg_cites_npl, avg(cites_forward) FILTER (npl_count = 0) AS avg_cites_other FROM (SELECT npl_count, cites_forward, unnest(tech_list) AS tech FROM docs) GROUP BY tech HAVING count(*) >= 3"))
REG.docs("assignments", lambda d: S.assignments(d, "applicant", "owner", "reg_date"), sql("SELECT year(reg_date)::INT AS year, applicant AS source, owner AS target, count(*) AS n FROM docs GROUP BY ALL"))
REG.docs("examiners", lambda d: S.examiners(d, F.get("agents", F.lit(0))), sql(f"SELECT agents[1] AS examiner, count(*) AS n, avg(is_granted::INT) AS grant_rate, avg(oa_count) AS avg_actions, avg({MM}) FILTER ({MM} > 0 AND {MM} <= 240) AS avg_months FROM docs GROUP BY 1 HAVING count(*) >= 3"))
REG.docs("state_maintenance", lambda d: S.state_maintenance(d, "family_countries", "tech_l1_list"), sql("SELECT company, sum(len(family_countries))::BIGINT AS valid, sum(len(tech_l1_list))::BIGINT AS lapsed, sum(len(family_countries)) / (sum(len(family_countries)) + sum(len(tech_l1_list))) AS keep FROM comp GROUP BY company", COMPANY))
REG.docs("licences", lambda d: S.licences(d, urgent()), sql("SELECT company, count(*) AS n, count(*) FILTER (list_contains(tech_c_list, '1-URGENT')) AS licensed, avg(list_contains(tech_c_list, '1-URGENT')::INT) AS rate FROM comp GROUP BY company HAVING count(*) FILTER (list_contains(tech_c_list, '1-URGENT')) > 0", COMPANY))
REG.docs("standards", lambda d: S.standards(d.withColumn("sep_org", F.when(F.col("oa_count") >= 2, F.get("tech_l1_list", F.lit(0))).otherwise(""))), sql("SELECT tech_l1_list[1] AS org, company, count(*) AS n FROM comp WHERE oa_count >= 2 GROUP BY 1, 2", COMPANY))
REG.docs("gov_program_rate", lambda d: S.flag_rate(d, F.col("country") == "ASIA", {"company": F.col("owner")}, 3), sql("SELECT owner AS company, count(*) AS n, avg((country = 'ASIA')::INT) AS rate FROM docs GROUP BY 1 HAVING count(*) >= 3"))
