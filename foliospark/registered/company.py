"""Queries on companies: portfolios, transitions, lead and lag, indices, ownership, executives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import company as K
from ..operators import expand as X
from ..plans.binding import sql
from . import Registry
from .core import COMPANY, PAIRS, TECH, TY, Y

REG = Registry()
CT = "ct AS (SELECT company, doc_id, base_year, cites_forward, unnest(tech_list) AS tech FROM comp)"
CTN = "ctn AS (SELECT company, tech, count(*) AS n FROM ct GROUP BY company, tech)"
CY = "cy AS (SELECT company, base_year AS year, count(*) AS n FROM comp GROUP BY company, base_year)"
MINE = "list_contains(co_applicants, 'NATION_6')"


def rounded(names: str, digits: int = 9):
    return [F.round(c, digits).alias(c) for c in names.split()]


REG.docs("transition_cooccurrence", K.transition, sql(f"SELECT a AS source, b AS target, (count(*) FILTER (base_year > {Y} - 3) - count(*) FILTER (base_year <= {Y} - 3))::DOUBLE AS weight FROM pairs WHERE base_year > {Y} - 6 GROUP BY a, b HAVING weight > 0 ORDER BY weight DESC, source, target LIMIT 120", TECH, PAIRS))
TR = f"""o AS (SELECT DISTINCT KEY AS k, tech AS source FROM tech WHERE base_year <= {Y} - 3 AND base_year > {Y} - 6), n AS (SELECT DISTINCT KEY AS k, tech AS target FROM tech WHERE base_year > {Y} - 3),
links AS (SELECT source, target, round(sum(round(1.0::DOUBLE / (s * t), 12)), 9) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY k) AS s FROM o) o JOIN (SELECT *, count(*) OVER (PARTITION BY k) AS t FROM n) n ON o.k = n.k GROUP BY source, target ORDER BY weight DESC, source, target LIMIT 120)"""
REG.docs("transition_applicant", lambda d: K.transition(d, "applicant").withColumn("weight", F.round("weight", 7)), sql("SELECT source, target, round(weight, 7) AS weight FROM links", TECH, TR.replace("KEY", "applicant")))
REG.docs("transition_family", lambda d: K.transition(d, "family", top=100000).withColumn("weight", F.round("weight", 6)), sql("SELECT source, target, round(weight, 6) AS weight FROM links", TECH, TR.replace("KEY", "family_id").replace("LIMIT 120", "LIMIT 100000")))
REG.docs("transition_net_inflow", lambda d: K.net_inflow(K.transition(d)), sql(f"""SELECT tech, sum(i) AS inflow, sum(o) AS outflow, sum(i - o) AS net FROM (SELECT target AS tech, weight AS i, 0.0::DOUBLE AS o FROM l UNION ALL SELECT source, 0.0, weight FROM l) GROUP BY tech""", TECH, PAIRS, f"l AS (SELECT a AS source, b AS target, (count(*) FILTER (base_year > {Y} - 3) - count(*) FILTER (base_year <= {Y} - 3))::DOUBLE AS weight FROM pairs WHERE base_year > {Y} - 6 GROUP BY a, b HAVING weight > 0 ORDER BY weight DESC, source, target LIMIT 120)"))
CONC = M.concentration_sql("ctn", "company")
INV = "ci AS (SELECT company, i, count(*) AS n FROM (SELECT company, unnest(inventors) AS i FROM comp) GROUP BY company, i)"
DNA_SQL = f"""dna AS (SELECT b.company, b.n, c.hhi AS tech_concentration, c.entropy_norm AS tech_diversity, e.new_class_entry, coalesce(k.combos, 0) / b.n AS combo_diversity, f.family_size, b.intl_scope, b.grant_keep_ratio, b.avg_citations, f.continuation_ratio, b.co_apply_ratio, p.hhi AS inventor_concentration, g.growth AS recent_growth
FROM (SELECT company, count(*) AS n, avg(len(family_countries)) AS intl_scope, avg(cites_forward) AS avg_citations, avg((len(co_applicants) >= 2)::INT) AS co_apply_ratio, (count(*) FILTER (is_granted AND active_flag))::DOUBLE / nullif(count(*) FILTER (is_granted), 0) AS grant_keep_ratio FROM comp GROUP BY company) b
JOIN ({CONC}) c ON c.company = b.company JOIN (SELECT company, (count(*) FILTER (lo > {Y} - 3))::DOUBLE / count(*) AS new_class_entry FROM (SELECT company, tech, min(base_year) AS lo FROM ct GROUP BY ALL) GROUP BY company) e ON e.company = b.company
LEFT JOIN (SELECT company, count(*) AS combos FROM (SELECT DISTINCT c.company, p.a, p.b FROM comp c JOIN pairs p ON p.doc_id = c.doc_id) GROUP BY company) k ON k.company = b.company
JOIN ({M.concentration_sql("ci", "company")}) p ON p.company = b.company JOIN (SELECT company, avg(c) AS family_size, avg((c >= 2)::INT) AS continuation_ratio FROM (SELECT company, family_id, count(*) AS c FROM comp GROUP BY ALL) GROUP BY company) f ON f.company = b.company JOIN g ON g.company = b.company)"""
REG.docs("dna_metrics", lambda d: K.dna_metrics(d).select("company", "n", *rounded(" ".join(K.DNA))), sql("SELECT company, n, " + ", ".join(f"round({c}, 9) AS {c}" for c in K.DNA) + " FROM dna", TECH, PAIRS, COMPANY, CT, CTN, INV, CY, M.growth_sql("cy", "company", 3, Y), DNA_SQL))
REL = "rel AS (SELECT company, (count(*) OVER (ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / count(*) OVER () AS n_rank, " + ", ".join(f"CASE WHEN max({c}) OVER () > 0 THEN greatest(coalesce({c}, 0), 0) / max({c}) OVER () ELSE 0 END AS {c}" for c in K.DNA) + " FROM dna)"
REG.docs("dna_types", lambda d: K.dna_types(K.dna_metrics(d)).select("company", "type", F.round("n_rank", 9).alias("n_rank"), *rounded("tech_concentration recent_growth")), sql("""SELECT company, CASE WHEN new_class_entry >= 0.6 AND recent_growth >= 0.6 AND avg_citations >= 0.5 THEN '선도 개척형' WHEN grant_keep_ratio >= 0.6 AND (family_size >= 0.5 OR intl_scope >= 0.5) THEN '권리 장벽형' WHEN tech_concentration >= 0.6 AND tech_diversity <= 0.4 THEN '집중 방어형'
  WHEN combo_diversity >= 0.6 AND tech_diversity >= 0.5 THEN '융합 확장형' WHEN recent_growth >= 0.6 AND avg_citations <= 0.4 THEN '추격 확장형' WHEN n_rank >= 0.7 AND avg_citations <= 0.4 AND grant_keep_ratio <= 0.4 THEN '양적 출원형' ELSE '균형형' END AS type, round(n_rank, 9) AS n_rank, round(tech_concentration, 9) AS tech_concentration, round(recent_growth, 9) AS recent_growth FROM rel""", TECH, PAIRS, COMPANY, CT, CTN, INV, CY, M.growth_sql("cy", "company", 3, Y), DNA_SQL, REL))  # fmt: skip
REG.docs("portfolio_overlap", lambda d: K.portfolio_overlap(d).select("a", "b", *rounded("cosine jaccard")), sql("""SELECT x.company AS a, y.company AS b, round(sum(x.n::DOUBLE * y.n) / (any_value(p.s) * any_value(q.s)), 9) AS cosine, round(count(*)::DOUBLE / (any_value(p.k) + any_value(q.k) - count(*)), 9) AS jaccard FROM ctn x JOIN ctn y ON x.tech = y.tech AND x.company < y.company
JOIN (SELECT company, sqrt(sum(n::DOUBLE * n)) AS s, count(*) AS k FROM ctn GROUP BY company) p ON p.company = x.company JOIN (SELECT company, sqrt(sum(n::DOUBLE * n)) AS s, count(*) AS k FROM ctn GROUP BY company) q ON q.company = y.company GROUP BY 1, 2""", COMPANY, CT, CTN))  # fmt: skip
LL = """w AS (SELECT tech, company, base_year AS year, count(*)::DOUBLE AS w FROM ct WHERE company IN (SELECT company FROM comp GROUP BY company ORDER BY count(*) DESC, company LIMIT 20) GROUP BY ALL),
sp AS (SELECT tech, min(year) AS lo, max(year) AS hi FROM w GROUP BY tech HAVING count(DISTINCT year) >= 5), able AS (SELECT tech, company FROM w GROUP BY ALL HAVING sum(w) >= 10),
dn AS (SELECT g.tech, g.company, g.year, coalesce(w.w, 0.0) AS w FROM (SELECT able.tech, company, unnest(range(lo, hi + 1)) AS year FROM able JOIN sp ON sp.tech = able.tech) g LEFT JOIN w ON w.tech = g.tech AND w.company = g.company AND w.year = g.year),
lg AS (SELECT x.tech, x.company AS a, y.company AS b, l AS lag, count(*) AS n, var_pop(x.w) AS vx, var_pop(y.w) AS vy, covar_pop(x.w, y.w) AS c FROM dn x CROSS JOIN (SELECT unnest(range(-3, 4)) AS l) JOIN dn y ON y.tech = x.tech AND y.year = x.year + l AND x.company < y.company GROUP BY ALL),
best AS (SELECT tech, a, b, arg_max(lag, (round(abs(c / sqrt(vx * vy)), 12), -lag)) AS lag, arg_max(c / sqrt(vx * vy), (round(abs(c / sqrt(vx * vy)), 12), -lag)) AS corr FROM lg WHERE n >= 5 AND vx > 1e-24 AND vy > 1e-24 GROUP BY ALL),
ob AS (SELECT CASE WHEN lag > 0 THEN a ELSE b END AS leader, CASE WHEN lag > 0 THEN b ELSE a END AS follower, abs(lag) AS lag, corr FROM best WHERE corr >= 0.5 AND lag <> 0)"""
REG.docs("lead_lag", lambda d: K.lead_lag(d).select("leader", "follower", "n_obs", F.round("avg_lag", 6).alias("avg_lag"), F.round("avg_corr", 6).alias("avg_corr"), F.round("strength", 5).alias("strength")), sql("SELECT leader, follower, count(*) AS n_obs, round(avg(lag), 6) AS avg_lag, round(avg(corr), 6) AS avg_corr, round(avg(corr) * count(*), 5) AS strength FROM ob GROUP BY 1, 2", COMPANY, CT, LL))
SH = "sh AS (SELECT company, year, tech, n::DOUBLE / sum(n) OVER (PARTITION BY company, year) AS v FROM (SELECT company, base_year AS year, tech, count(*) AS n FROM ct GROUP BY ALL))"
REG.docs("trajectory_shares", lambda d: K.trajectory_shares(d).withColumn("value", F.round("value", 9)), sql("SELECT company, year, tech, round(v, 9) AS value FROM sh", COMPANY, CT, SH))
REG.docs("trajectory_length", lambda d: K.path_lengths(K.trajectory_shares(d)).withColumn("length", F.round("length", 7)), sql("""SELECT company, count(*) AS steps, round(sum(s), 7) AS length FROM (SELECT company, year, sqrt(sum(d * d)) AS s FROM (SELECT company, year, tech, sum(d) AS d FROM (SELECT company, year, tech, v AS d FROM sh UNION ALL SELECT company, year + 1, tech, -v FROM sh) GROUP BY ALL) WHERE year > (SELECT min(year) FROM sh) AND year <= (SELECT max(year) FROM sh) GROUP BY company, year) GROUP BY company""", COMPANY, CT, SH))
PI = """tk AS (SELECT *, tech_list[1] AS k FROM docs), cell AS (SELECT base_year, k, avg(cites_forward) AS m, count(*) AS n FROM tk GROUP BY ALL), yr AS (SELECT base_year, avg(cites_forward) AS m FROM tk GROUP BY ALL),
t AS (SELECT tk.*, cites_forward / CASE WHEN c.n >= 5 AND c.m > 0 THEN c.m WHEN y.m > 0 THEN y.m ELSE (SELECT avg(cites_forward) FROM docs) END AS tr, COVER * CASE legal_status WHEN 'Granted-Active' THEN 1.0::DOUBLE WHEN 'Pending' THEN 0.7 WHEN 'Unknown' THEN 1.0 ELSE 0.0 END AS mc
  FROM tk JOIN cell c ON c.base_year = tk.base_year AND c.k = tk.k JOIN yr y ON y.base_year = tk.base_year)"""
BY_NUMBER = PI.replace("COVER", "len(family_countries) / (SELECT avg(len(family_countries)) FROM docs)")
PAI = "SELECT company, 'active' AS scope, count(*) AS n, round(avg(tr), 7) AS tr, round(avg(mc), 7) AS mc, round(sum(tr * mc), 5) AS pai FROM (SELECT *, unnest(co_applicants) AS company FROM t) WHERE active_flag GROUP BY company HAVING count(*) >= 3"
#: Countries that stand for the nations of the tables, in the order of their numbers.
CODES = list(K.GNI)[:25]
INCOMES = "[" + ", ".join(f"{K.GNI[c]}::DOUBLE" for c in CODES) + "]"


def _coded(d: DataFrame) -> DataFrame:
    """Documents whose country list names a code and a count for each nation of their applicants."""
    code = lambda x: F.concat(F.element_at(F.array(*map(F.lit, CODES)), F.substring(x, 8, 2).cast("int") + 1), F.lit("-1"))
    return d.withColumn("family_countries", F.concat(F.transform("co_applicants", code), F.array(F.lit("LU-0"))))


REG.docs("cohort_tr", lambda d: K.technology_relevance(d, F.get("tech_list", F.lit(0)), F.col("base_year")).select("doc_id", F.round("tr", 9).alias("tr")), sql("SELECT doc_id, round(tr, 9) AS tr FROM t", BY_NUMBER))
REG.docs("pai_by_company", lambda d: K.portfolio_index(d).select("company", "scope", "n", *rounded("tr mc", 7), F.round("pai", 5).alias("pai")), sql(PAI, BY_NUMBER))
REG.docs("pai_by_income", lambda d: K.portfolio_index(_coded(d)).select("company", "scope", "n", *rounded("tr mc", 7), F.round("pai", 5).alias("pai")), sql(PAI, PI.replace("COVER", f"list_sum(list_transform(co_applicants, lambda x: {INCOMES}[substr(x, 8)::INT + 1])) / 27.5")))
REG.docs("entropy_norm", lambda d: M.concentration(X.explode_applicants(X.explode_tech(d)).groupBy("company", "tech").agg(F.count("*").alias("n")), ["company"]).select("company", *rounded("hhi entropy entropy_norm top1_share"), "k"), sql(f"SELECT company, round(hhi, 9) AS hhi, round(entropy, 9) AS entropy, round(entropy_norm, 9) AS entropy_norm, round(top1_share, 9) AS top1_share, k FROM ({CONC})", COMPANY, CT, CTN))
DIMS = " UNION ALL ".join(f"SELECT company, '{k}' AS dimension, unnest({c}) AS value FROM comp" for k, c in (("tech", "tech_list"), ("axis_b", "tech_b_list"), ("axis_c", "tech_c_list"), ("country", "family_countries"), ("inventor", "inventors")))
SC = f"dm AS (SELECT company, dimension, value, count(*) AS n FROM ({DIMS}) GROUP BY ALL), kd AS (SELECT dimension, count(DISTINCT value) AS kinds FROM dm GROUP BY dimension), top6 AS (SELECT company FROM comp GROUP BY company ORDER BY count(*) DESC, company LIMIT 6)"
REG.docs("scope_entropy", lambda d: K.scope_entropy(d).select("company", "dimension", *rounded("entropy top1_share")), sql(f"SELECT company, c.dimension, round(CASE WHEN kinds >= 2 THEN entropy / log2(kinds::DOUBLE) END, 9) AS entropy, round(top1_share, 9) AS top1_share FROM ({M.concentration_sql('dm', 'company, dimension')}) c JOIN kd ON kd.dimension = c.dimension WHERE company IN (SELECT company FROM top6)", COMPANY, SC))
YE = f"cyt AS (SELECT company, base_year AS year, tech, count(*) AS n FROM ct GROUP BY ALL), ye AS (SELECT c.company, c.year, entropy / log2((SELECT count(DISTINCT tech) FROM ct)::DOUBLE) AS entropy FROM ({M.concentration_sql('cyt', 'company, year')}) c JOIN cy ON cy.company = c.company AND cy.year = c.year WHERE cy.n >= 3)"
REG.docs("yearly_entropy", lambda d: K.yearly_entropy(d).select("company", "year", *rounded("entropy")), sql("SELECT company, year, round(entropy, 9) AS entropy FROM ye", COMPANY, CT, CY, YE))
REG.docs("scope_strategy", lambda d: K.scope_strategy(K.yearly_entropy(d)).select("company", *rounded("last3 prior3", 8), "peak_year", "strategy"), sql("""SELECT company, round(l, 8) AS last3, round(p, 8) AS prior3, peak_year, CASE WHEN l - p IS NULL THEN 'unknown' WHEN l - p > 0.03 THEN 'widening' WHEN l - p < -0.03 THEN 'narrowing' ELSE 'steady' END AS strategy FROM (SELECT company, avg(entropy) FILTER (r <= 3) AS l, avg(entropy) FILTER (r > 3 AND r <= 6) AS p, arg_min(year, (-round(entropy, 9), year)) AS peak_year FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY year DESC) AS r FROM ye) GROUP BY company)""", COMPANY, CT, CY, YE))
REG.docs("ownership_edges", K.ownership_edges, sql("SELECT applicant AS source, owner AS target, count(*) AS n FROM docs WHERE owner <> applicant GROUP BY 1, 2"))
REG.docs("ownership_balance", K.ownership_balance, sql("SELECT company, sum(a)::BIGINT AS acquired, sum(d)::BIGINT AS divested, sum(a - d)::BIGINT AS net FROM (SELECT owner AS company, 1 AS a, 0 AS d FROM docs WHERE owner <> applicant UNION ALL SELECT applicant, 0, 1 FROM docs WHERE owner <> applicant) GROUP BY company"))
REG.docs("ownership_quality", K.ownership_quality, sql("SELECT owner <> applicant AS transferred, count(*) AS n, avg(cites_forward) AS avg_cites, avg(active_flag::INT) AS active_rate FROM docs GROUP BY 1 HAVING count(*) >= 5"))
REG.docs("ownership_by_tech", K.ownership_by_tech, sql("SELECT tech, count(*) AS n, count(*) FILTER (owner <> applicant) AS transferred, avg((owner <> applicant)::INT) AS rate FROM (SELECT owner, applicant, unnest(tech_list) AS tech FROM docs) GROUP BY tech"))
REG.docs("owner_canonical", lambda d: d.groupBy("owner", "applicant").agg(F.count("*").alias("c")).groupBy("owner").agg(F.min_by("applicant", F.struct(-F.col("c"), "applicant")).alias("spelling")), sql("SELECT owner, arg_min(applicant, (-c, applicant)) AS spelling FROM (SELECT owner, applicant, count(*) AS c FROM docs GROUP BY ALL) GROUP BY owner"))
REG.docs("company_ranks", lambda d: K.company_ranks(d).select("company", "n", "rank", *rounded("share growth")), sql("SELECT r.company, n, rank, round(n / (SELECT count(*) FROM docs), 9) AS share, round(growth, 9) AS growth FROM (SELECT company, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, company) AS rank FROM comp GROUP BY company) r JOIN g ON g.company = r.company", COMPANY, CY, M.growth_sql("cy", "company", 3, Y)))
BCG = "bc AS (SELECT x.tech, x.n, CASE WHEN coalesce(rival, 0) = 0 THEN 2.0::DOUBLE ELSE greatest(x.n / rival, 0.02) END AS rel_share, coalesce(growth, 0) AS growth FROM (SELECT tech, max(n) FILTER (company = 'NATION_6') AS n, max(n) FILTER (company <> 'NATION_6') AS rival FROM ctn GROUP BY tech) x JOIN g ON g.tech = x.tech WHERE x.n > 0)"
REG.docs("bcg_quadrant", lambda d: K.bcg(d, "NATION_6").select("tech", "n", *rounded("rel_share growth"), "quadrant"), sql("SELECT tech, n, round(rel_share, 9) AS rel_share, round(growth, 9) AS growth, CASE WHEN up AND rel_share >= 1 THEN 'star' WHEN up THEN 'question' WHEN rel_share >= 1 THEN 'cash_cow' ELSE 'dog' END AS quadrant FROM (SELECT *, round(growth, 9) >= round((SELECT quantile_cont(growth, 0.5) FROM bc), 9) AS up FROM bc)", TECH, COMPANY, CT, CTN, TY, M.growth_sql("ty", "tech", 3, Y), BCG))
REG.docs("expiry_cliff", lambda d: K.expiry_cliff(d, "2016-06-01"), sql("SELECT company, year(expiry_date)::INT AS year, count(*) AS n FROM comp WHERE expiry_date >= DATE '2016-06-01' AND expiry_date < DATE '2026-06-01' AND active_flag IS DISTINCT FROM FALSE GROUP BY 1, 2", COMPANY))
EF = f"""ef0 AS (SELECT company, count(*) AS n, count(*) FILTER (base_year > {Y} - 3) AS recent_n, avg(cites_forward) AS cites, avg(family_size) AS family, avg(active_flag::INT) AS active FROM comp GROUP BY company HAVING count(*) >= 5 ORDER BY n DESC, company LIMIT 12),
ef AS (SELECT *, round(({" + ".join(f"(CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END)" for c in ("cites", "family", "active"))}) / 3, 3) AS quality FROM ef0)"""
REG.docs("rnd_efficiency", lambda d: K.rnd_efficiency(d).select("company", "n", "recent_n", *rounded("cites family active"), "quality", "quadrant"),
         sql("""SELECT company, n, recent_n, round(cites, 9) AS cites, round(family, 9) AS family, round(active, 9) AS active, quality,
  CASE WHEN big AND good THEN '양·질 겸비' WHEN big THEN '다작·저임팩트' WHEN good THEN '소작·정예' ELSE '양·질 모두 부족' END AS quadrant
FROM (SELECT *, n >= (SELECT quantile_cont(n, 0.5) FROM ef) AS big, quality >= (SELECT quantile_cont(quality, 0.5) FROM ef) AS good FROM ef)""", COMPANY, EF))  # fmt: skip
KP = """ks AS (SELECT doc_id, applicant AS company, base_year, unnest(inventors) AS i FROM docs WHERE len(co_applicants) <= 1), kp AS (SELECT company, i, count(*) AS n, max(base_year) AS last FROM ks GROUP BY ALL),
kr AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY n DESC, i) AS r, count(*) OVER (PARTITION BY company) AS k FROM kp),
kd AS (SELECT company, count(*) AS docs, count(*) FILTER (hit) / count(*) AS top_share FROM (SELECT s.company, doc_id, bool_or(r <= ceil(k / 10)) AS hit FROM ks s JOIN kr ON kr.company = s.company AND kr.i = s.i GROUP BY ALL) GROUP BY company)"""
REG.docs("key_people", lambda d: K.key_people(d).select("company", "inventors", "docs", *rounded("top_share hhi"), "idle"),
         sql(f"""SELECT x.company, inventors, docs, round(top_share, 9) AS top_share, round(hhi, 9) AS hhi, idle FROM (SELECT company, count(*) AS inventors, count(*) FILTER (last <= {Y} - 2) AS idle FROM kr WHERE k >= 5 GROUP BY company) x
JOIN kd ON kd.company = x.company JOIN ({M.concentration_sql('kp', 'company')}) h ON h.company = x.company""", KP))  # fmt: skip
CV = f"cv AS (SELECT tech, company, count(*) AS n, (count(*) FILTER (base_year > {Y} - 3)) / 3 AS v FROM ct GROUP BY ALL), ld AS (SELECT tech, arg_min(company, (-n, company)) AS leader, max(n) AS ln, arg_min(v, (-n, company)) AS lv FROM cv GROUP BY tech)"
REG.docs("catch_up", lambda d: K.catch_up(d, "NATION_6").select("tech", "leader", "gap", *rounded("own_speed lead_speed years")), sql("SELECT cv.tech, leader, ln - n AS gap, round(v, 9) AS own_speed, round(lv, 9) AS lead_speed, round(CASE WHEN v > lv THEN (ln - n) / (v - lv) END, 9) AS years FROM cv JOIN ld ON ld.tech = cv.tech WHERE company = 'NATION_6' AND leader <> 'NATION_6'", COMPANY, CT, CV))
# All companies have been in all classes for long: families stand for classes.
TH = f"""fc AS (SELECT company, base_year, cites_forward, family_id::VARCHAR AS tech FROM comp),
ft AS (SELECT family_id::VARCHAR AS tech FROM docs WHERE applicant = 'NATION_6' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5),
th AS (SELECT company, tech, count(*) AS n, min(base_year) AS entry, avg(cites_forward) AS cites FROM fc WHERE company <> 'NATION_6' AND tech IN (SELECT tech FROM ft) GROUP BY ALL HAVING min(base_year) > {Y} - 3 AND count(*) >= 2),
ts AS (SELECT *, round(0.5 * n / (SELECT max(n) FROM th) + 0.3 * (1 - ({Y} - entry) / 3) + 0.2 * cites / (SELECT max(cites) FROM th), 9) AS score FROM th)"""
REG.docs("threats", lambda d: K.threats(d.withColumn("tech_list", F.array(F.col("family_id").cast("string"))), "NATION_6").select("company", "tech", "n", "entry", *rounded("cites score", 7)), sql("SELECT company, tech, n, entry, round(cites, 7) AS cites, round(score, 7) AS score FROM ts ORDER BY ts.score DESC, company, tech LIMIT 15", COMPANY, TH))
PR = f"pr AS (SELECT * FROM docs WHERE {MINE} AND reg_date IS NOT NULL AND active_flag), pm AS (SELECT tech FROM (SELECT unnest(tech_list) AS tech FROM pr) GROUP BY tech ORDER BY count(*) DESC, tech LIMIT 3)"
REG.docs("pruning", lambda d: K.pruning(d.withColumn("cites_forward", F.col("cites_forward") - 1), "NATION_6", "2016-06-01").withColumn("age", F.round("age", 7)),
         sql("SELECT doc_id, round(date_diff('day', reg_date, DATE '2016-06-01') / 365.25, 7) AS age FROM pr WHERE date_diff('day', reg_date, DATE '2016-06-01') / 365.25 >= 5 AND cites_forward <= 1 AND len(family_countries) <= 1 AND NOT list_has_any(tech_list, (SELECT list(tech) FROM pm)) AND (SELECT count(*) FROM pr) >= 10", PR))
REG.docs("applicant_list", K.applicant_list, sql("SELECT company, count(*) AS n, count(*) FILTER (applicant = company) AS as_lead FROM comp GROUP BY company", COMPANY))
