"""Queries over the standard frame: filters, expansion, counts, growth, combinations, life cycle, charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import core as C
from ..operators import expand as X
from ..operators import filters as W
from ..plans.binding import sql
from . import Registry

REG = Registry()
Y = "(SELECT max(base_year) FROM docs)"
TECH = "tech AS (SELECT doc_id, base_year, applicant, co_applicants, family_id, active_flag, is_granted, cites_forward, expiry_date, family_countries, tech_l1_list, tech_b_list, tech_c_list, unnest(tech_list) AS tech FROM docs)"
COMPANY = "comp AS (SELECT *, unnest(co_applicants) AS company FROM docs)"
PAIRS = "pairs AS (SELECT x.doc_id, x.base_year, x.tech AS a, y.tech AS b, x.active_flag, x.co_applicants FROM tech x JOIN tech y ON x.doc_id = y.doc_id AND x.tech < y.tech)"
COMBOS = f"""pairc AS (SELECT a, b, company, min(base_year) AS lo, max(base_year) AS hi FROM (SELECT a, b, base_year, unnest(co_applicants) AS company FROM pairs) GROUP BY a, b, company),
pairn AS (SELECT a, b, count(*) AS n_applicants, count(*) FILTER (hi > {Y} - 3) AS n_recent_applicants, count(*) FILTER (lo > {Y} - 3) AS n_new_applicants FROM pairc GROUP BY a, b),
combos AS (SELECT p.a, p.b, count(*) AS n_ab, count(*) FILTER (base_year > {Y} - 3) AS n_recent, min(base_year) AS first_year, max(base_year) AS last_year, avg(active_flag::INT) AS active_ratio FROM pairs p GROUP BY p.a, p.b)"""
TECHN = "techn AS (SELECT tech, count(*) AS n FROM tech GROUP BY tech)"
TY = "ty AS (SELECT tech, base_year AS year, count(*)::DOUBLE AS n FROM tech GROUP BY tech, base_year)"

ID = "SELECT doc_id, base_year, applicant FROM docs"
SPEC = {"year_from": 1996, "year_to": 1999, "applicants": ["NATION_6", "NATION_18"], "active_only": True}


def _ids(d):
    return d.select("doc_id", "base_year", "applicant")


REG.docs("filter_common", lambda d: _ids(W.apply_filters(d, SPEC)), sql(ID + " WHERE base_year BETWEEN 1996 AND 1999 AND len(list_filter(co_applicants, lambda x: x IN ('NATION_6', 'NATION_18'))) > 0 AND active_flag"))
REG.docs("filter_classes", lambda d: _ids(W.apply_filters(d, {"tech": ["Brand#11", "Brand#23"], "tech_l1": ["ECONOMY", "PROMO", "STANDARD"], "countries": [" europe ", "ASIA"], "legal_statuses": ["Pending"]})),
         sql(ID + " WHERE list_has_any(tech_list, ['Brand#11', 'Brand#23']) AND list_has_any(tech_l1_list, ['ECONOMY', 'PROMO', 'STANDARD']) AND upper(trim(country)) IN ('EUROPE', 'ASIA') AND legal_status = 'Pending'"))
REG.docs("drill_tech", lambda d: _ids(W.select_documents(d, {"tech": "Brand#23", "year": 1997})), sql(ID + " WHERE list_contains(tech_list, 'Brand#23') AND base_year = 1997"))
REG.docs("drill_combo", lambda d: _ids(W.select_documents(d, {"combo": ["Brand#11", "Brand#23"]})), sql(ID + " WHERE list_contains(tech_list, 'Brand#11') AND list_contains(tech_list, 'Brand#23')"))
REG.docs("drill_primary", lambda d: _ids(W.select_documents(d, {"tech": "Brand#11", "tech_primary": True, "applicant": "NATION_12", "applicant_scope": "display"})), sql(ID + " WHERE tech_list[1] = 'Brand#11' AND applicant = 'NATION_12'"))
REG.docs("drill_joint", lambda d: _ids(W.select_documents(d, {"joint_only": True, "co_applicant": "NATION_14"})), sql(ID + " WHERE len(co_applicants) >= 2 AND list_contains(co_applicants, 'NATION_14')"))
REG.docs("drill_transferred", lambda d: _ids(W.select_documents(d, {"transferred": True, "owner": "NATION_18"})), sql(ID + " WHERE owner <> applicant AND owner = 'NATION_18'"))
REG.docs("drill_cell", lambda d: _ids(W.select_documents(d, {"cell": {"problem": "1-URGENT"}, "axis_cell": [("a", "Brand#11")]})), sql(ID + " WHERE list_contains(tech_c_list, '1-URGENT') AND list_contains(tech_list, 'Brand#11')"))
REG.docs("drill_transition", lambda d: _ids(W.select_documents(d, {"transition": ["Brand#11", "Brand#5"], "legal_status": "Pending"})), sql(ID + " WHERE (list_contains(tech_list, 'Brand#11') OR list_contains(tech_list, 'Brand#5')) AND legal_status = 'Pending'"))
REG.docs("drill_inventor", lambda d: _ids(W.select_documents(d, {"inventor": 7, "country": "ASIA"})), sql(ID + " WHERE list_contains(inventors, '7') AND country = 'ASIA'"))
REG.docs("paginate_docs", lambda d: _ids(W.page(d, 3, 50)), sql(ID + " ORDER BY doc_id LIMIT 50 OFFSET 100"))
REG.docs("family_representative", lambda d: d.transform(W.family_representatives).select("family_id", "doc_id"),
         sql("""SELECT family_id, doc_id FROM (SELECT family_id, doc_id, row_number() OVER (PARTITION BY family_id ORDER BY (CASE WHEN active_flag THEN 0 ELSE 1 END) + (CASE WHEN is_granted THEN 0 ELSE 1 END), app_date, doc_id) AS n FROM docs) WHERE n = 1"""))
REG.docs("analysis_unit_registration", lambda d: _ids(W.analysis_unit(d, "registration")), sql(ID + " WHERE is_granted"))

REG.docs("explode_duplicate", lambda d: X.explode_tech(d).groupBy("tech").agg(F.sum("weight").alias("w")), sql("SELECT tech, count(*)::DOUBLE AS w FROM tech GROUP BY tech", TECH))
REG.docs("explode_fractional", lambda d: X.explode_tech(d, "fractional").groupBy("tech").agg(F.round(F.sum("weight"), 6).alias("w")), sql("SELECT tech, round(sum(1.0::DOUBLE / k), 6) AS w FROM (SELECT unnest(tech_list) AS tech, len(tech_list) AS k FROM docs) GROUP BY tech"))
REG.docs("explode_primary", lambda d: X.explode_tech(d, "primary").groupBy("tech").agg(F.sum("weight").alias("w")), sql("SELECT tech_list[1] AS tech, count(*)::DOUBLE AS w FROM docs GROUP BY 1"))
REG.docs("explode_level", lambda d: X.explode_tech(d, "level_separate", "tech_l1_list").groupBy("tech").agg(F.sum("weight").alias("w")), sql("SELECT tech, count(*)::DOUBLE AS w FROM (SELECT unnest(tech_l1_list) AS tech FROM docs) GROUP BY tech"))
REG.docs("applicants_all", lambda d: X.explode_applicants(d).groupBy("company").agg(F.count("*").alias("n")), sql("SELECT company, count(*) AS n FROM comp GROUP BY company", COMPANY))
REG.docs("applicants_first", lambda d: X.explode_applicants(d, "first", ["NATION_18"]).groupBy("company").agg(F.count("*").alias("n")), sql("SELECT applicant AS company, count(*) AS n FROM docs WHERE applicant <> 'NATION_18' GROUP BY 1"))
REG.docs("tech_year_matrix", C.tech_year, sql("SELECT tech, year, n AS w FROM ty", TECH, TY))
REG.docs("company_shares", lambda d: C.company_shares(d).select("company", "tech", "w", F.round("share", 9).alias("share")), sql("SELECT company, tech, count(*)::DOUBLE AS w, round(count(*) / sum(count(*)) OVER (PARTITION BY company), 9)::DOUBLE AS share FROM (SELECT company, unnest(tech_list) AS tech FROM comp) GROUP BY company, tech", COMPANY))
REG.docs("combo_counts", lambda d: X.combo_counts(d, C.latest_year(d) - 2), sql("SELECT c.a, c.b, n_ab, n_recent, first_year, last_year, active_ratio, n_applicants, n_recent_applicants, n_new_applicants FROM combos c JOIN pairn n ON c.a = n.a AND c.b = n.b", TECH, PAIRS, COMBOS))
REG.docs("overview_kpis", C.overview_kpis, sql("SELECT count(*) AS n_docs, count(DISTINCT family_id) AS n_families, count(DISTINCT country) AS n_countries, avg(active_flag::INT) AS active_share, min(base_year) AS year_min, max(base_year) AS year_max, (SELECT count(DISTINCT company) FROM comp) AS n_applicants FROM docs", COMPANY))
REG.docs("tech_growth", lambda d: C.tech_growth(d).select("tech", "total", F.round("growth", 9).alias("growth"), "method"), sql("SELECT t.tech, t.total, round(growth, 9) AS growth, method FROM (SELECT tech, sum(n) AS total FROM ty GROUP BY tech HAVING sum(n) >= 3) t JOIN g ON g.tech = t.tech", TECH, TY, M.growth_sql("ty", "tech")))
REG.docs("growth_ladder", lambda d: M.growth_ladder(X.explode_applicants(d).groupBy("company", F.col("base_year").alias("year")).agg(F.count("*").alias("n")), ["company"], 3, year_max=2002).select("company", F.round("growth", 9).alias("growth"), "method"),
         sql("SELECT company, round(growth, 9) AS growth, method FROM g", COMPANY, "cy AS (SELECT company, base_year AS year, count(*) AS n FROM comp GROUP BY company, base_year)", M.growth_sql("cy", "company", 3, "2002")))
REG.docs("year_counts_dense", lambda d: M.dense_years(d.groupBy("country", F.col("base_year").alias("year")).agg(F.count("*").alias("n")), ["country"], year_max=2004),
         sql("SELECT s.country, s.year::INT AS year, coalesce(c.n, 0) AS n FROM (SELECT country, unnest(range(min(base_year), 2005)) AS year FROM docs GROUP BY country) s LEFT JOIN (SELECT country, base_year, count(*) AS n FROM docs GROUP BY ALL) c ON c.country = s.country AND c.base_year = s.year"))
# Classes are too dense here for new pairs or gaps: inventors stand for them.
INVENTED = TECH.replace("unnest(tech_list)", "unnest(inventors)")
REG.docs("new_combinations", lambda d: C.new_combinations(d, recent=6, labels="inventors"), sql(f"SELECT a, b, n_ab, first_year FROM combos WHERE first_year > {Y} - 6 AND n_ab >= 3", INVENTED, PAIRS, COMBOS))
REG.docs("strategy_change", lambda d: C.strategy_change(d).select("company", F.round("change", 9).alias("change"), "top_gaining", F.round("top_gain", 6).alias("top_gain"), "n_now", "n_before"), sql(f"""SELECT s.company, round(1 - sum(sx * sy) / sqrt(sum(sx * sx) * sum(sy * sy)), 9) AS change, arg_min(tech, (-round(sx - sy, 9), tech)) AS top_gaining, round(max(round(sx - sy, 9)), 6) AS top_gain, any_value(n_now) AS n_now, any_value(n_before) AS n_before
FROM (SELECT company, tech, x / sum(x) OVER (PARTITION BY company) AS sx, y / sum(y) OVER (PARTITION BY company) AS sy FROM (SELECT company, tech, (count(*) FILTER (base_year > {Y} - 3))::DOUBLE AS x, (count(*) FILTER (base_year <= {Y} - 3))::DOUBLE AS y FROM (SELECT company, base_year, unnest(tech_list) AS tech FROM comp WHERE base_year > {Y} - 6) GROUP BY company, tech)) s
JOIN (SELECT company, count(*) FILTER (base_year > {Y} - 3) AS n_now, count(*) FILTER (base_year <= {Y} - 3) AS n_before FROM comp WHERE base_year > {Y} - 6 GROUP BY company) n ON n.company = s.company WHERE n_now >= 3 AND n_before >= 3 GROUP BY s.company""", COMPANY))  # fmt: skip
CR = """ctop AS (SELECT tech, company FROM (SELECT tech, company, row_number() OVER (PARTITION BY tech ORDER BY count(*) DESC, company) AS r FROM (SELECT tech, unnest(co_applicants) AS company FROM tech) GROUP BY tech, company) WHERE r <= 3),
cr AS (SELECT t.tech, count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) FILTER (hit) / count(DISTINCT doc_id) AS cr FROM (SELECT x.tech, doc_id, c.company IS NOT NULL AS hit FROM (SELECT tech, doc_id, unnest(co_applicants) AS company FROM tech) x LEFT JOIN ctop c ON c.tech = x.tech AND c.company = x.company) t GROUP BY t.tech)"""
REG.docs("cr3_coverage", C.top_share, sql("SELECT * FROM cr", TECH, CR))
REG.docs("barrier_whitespace", lambda d: C.barrier_whitespace(d).select("tech", "n", "ag", F.round("cr3", 9).alias("cr3"), F.round("growth", 9).alias("growth"), F.round("barrier", 9).alias("barrier"), F.round("white", 9).alias("white")),
         sql("""SELECT cr.tech, cr.n, a.ag, round(cr, 9) AS cr3, round(growth, 9) AS growth, round(ag / cr.n * cr * ln(1 + ag), 9) AS barrier, round(CASE WHEN growth > 0 AND cr < 0.6 THEN growth * (1 - cr) / ln(ag + 2) END, 9) AS white
FROM cr JOIN (SELECT tech, count(*) FILTER (active_flag AND is_granted) AS ag FROM tech GROUP BY tech) a ON a.tech = cr.tech JOIN g ON g.tech = cr.tech WHERE cr.n >= 3""", TECH, CR, TY, M.growth_sql("ty", "tech")))  # fmt: skip
REG.docs("alerts", lambda d: C.alerts(d, "2015-01-01"), sql("""(SELECT 'cited' AS kind, doc_id::VARCHAR AS name, cites_forward AS value FROM docs ORDER BY value DESC, doc_id LIMIT 10)
UNION ALL (SELECT 'company', company, sum(cites_forward) AS v FROM comp GROUP BY company ORDER BY v DESC, company LIMIT 10)
UNION ALL SELECT 'expiring', '', count(*)::DOUBLE FROM docs WHERE expiry_date BETWEEN DATE '2015-01-01' AND DATE '2018-01-01'""", COMPANY))  # fmt: skip

PY = "py AS (SELECT a, b, base_year AS year, count(*) AS n FROM pairs GROUP BY a, b, base_year)"
EDGE = "n_ab * (SELECT count(*) FROM docs) / (x.n::DOUBLE * y.n)"
REG.docs("combo_metrics", lambda d: C.network_edges(d).select("a", "b", "n_ab", *[F.round(c, 9).alias(c) for c in ("jaccard", "lift", "pmi", "npmi", "growth")], "n_new_applicants"),
         sql(f"""SELECT c.a, c.b, n_ab, round(n_ab / (x.n + y.n - n_ab), 9)::DOUBLE AS jaccard, round({EDGE}, 9) AS lift, round(log2({EDGE}), 9) AS pmi, round(log2({EDGE}) / -log2(n_ab::DOUBLE / (SELECT count(*) FROM docs)), 9) AS npmi, round(growth, 9) AS growth, n_new_applicants
FROM (SELECT * FROM combos WHERE n_ab >= 3 ORDER BY n_ab DESC, a, b LIMIT 250) c JOIN techn x ON x.tech = c.a JOIN techn y ON y.tech = c.b JOIN pairn p ON p.a = c.a AND p.b = c.b JOIN g ON g.a = c.a AND g.b = c.b""", TECH, PAIRS, COMBOS, TECHN, PY, M.growth_sql("py", "a, b")))  # fmt: skip
L1 = "l1 AS (SELECT tech, arg_min(l1, (-c, l1)) AS l1 FROM (SELECT tech, l1, count(*) AS c FROM (SELECT tech, unnest(tech_l1_list) AS l1 FROM tech) GROUP BY tech, l1) GROUP BY tech)"
REG.docs("network_nodes", lambda d: C.network_nodes(d, C.network_edges(d, max_edges=40)).select("tech", "n", F.round("growth", 9).alias("growth"), "l1"), sql("""SELECT e.tech, n.n, round(growth, 9) AS growth, l1 FROM (SELECT DISTINCT unnest([a, b]) AS tech FROM (SELECT a, b FROM combos WHERE n_ab >= 3 ORDER BY n_ab DESC, a, b LIMIT 40)) e
JOIN techn n ON n.tech = e.tech JOIN l1 ON l1.tech = e.tech JOIN g ON g.tech = e.tech ORDER BY n.n DESC, e.tech LIMIT 80""", TECH, PAIRS, COMBOS, TECHN, TY, L1, M.growth_sql("ty", "tech")))  # fmt: skip
REG.docs("network_scope", lambda d: C.network_edges(d, scope_company="NATION_6", scope="display", max_edges=30).select("a", "b", "n_ab"), sql("SELECT a, b, n_ab FROM combos WHERE n_ab >= 3 ORDER BY n_ab DESC, a, b LIMIT 30", TECH.replace("FROM docs", "FROM docs WHERE applicant = 'NATION_6'"), PAIRS, COMBOS))
REG.docs("l1_lookup", lambda d: X.explode_tech(d).select("tech", F.explode("tech_l1_list").alias("l1")).groupBy("tech", "l1").agg(F.count("*").alias("c")).groupBy("tech").agg(F.min_by("l1", F.struct(-F.col("c"), "l1")).alias("l1")), sql("SELECT * FROM l1", TECH, L1))
EM = f"""em AS (SELECT c.a, c.b, n_ab, growth, greatest(coalesce(growth, 0.0), 0.0) AS g, {EDGE} AS lift, n_new_applicants, CASE WHEN la.l1 <> lb.l1 THEN 1.0 ELSE 0.5 END AS diversity, active_ratio FROM combos c JOIN techn x ON x.tech = c.a JOIN techn y ON y.tech = c.b JOIN pairn p ON p.a = c.a AND p.b = c.b JOIN g ON g.a = c.a AND g.b = c.b JOIN l1 la ON la.tech = c.a JOIN l1 lb ON lb.tech = c.b WHERE n_ab >= 3)"""
REG.docs("emerging_combinations", lambda d: C.emerging_combinations(d).select("a", "b", "n_ab", F.round("growth", 9).alias("growth"), F.round("lift", 9).alias("lift"), "n_new_applicants", "diversity", "active_ratio", F.round("score", 7).alias("score")),
         sql("SELECT a, b, n_ab, round(growth, 9) AS growth, round(lift, 9) AS lift, n_new_applicants, diversity::DOUBLE AS diversity, active_ratio, round(" + M.weighted_geometric_mean_sql([("norm_g", 1.0), ("norm_lift", 1.0), ("norm_n_new_applicants", 1.0), ("diversity", 0.5)]) + ", 7) AS score FROM nz",
             TECH, PAIRS, COMBOS, TECHN, L1, PY, M.growth_sql("py", "a, b", 3, Y), EM, M.normalize_sql("em", {"g": False, "lift": True, "n_new_applicants": True})))

CG = f"ends AS (SELECT unnest([a, b]) AS tech, first_year > {Y} - 3 AS new FROM combos WHERE n_ab >= NMIN), cg AS (SELECT tech, CASE WHEN count(*) > count(*) FILTER (new) THEN (2 * count(*) FILTER (new) - count(*)) / (count(*) - count(*) FILTER (new)) WHEN count(*) FILTER (new) > 0 THEN 1.0 ELSE 0.0 END AS combo_growth, count(*) AS adjacency FROM ends GROUP BY tech)"
ENT = f"""tc AS (SELECT tech, company, count(*) AS n, min(base_year) AS lo FROM (SELECT tech, base_year, unnest(co_applicants) AS company FROM tech) GROUP BY tech, company), ent AS (SELECT tech, count(*) FILTER (lo > {Y} - 3) AS new_entrants FROM tc GROUP BY tech)"""
LIFE = f"""lag_ AS (SELECT tech, z - i AS year, i, y AS w, y - lag(y) OVER (PARTITION BY tech ORDER BY i DESC) AS d FROM (SELECT d.*, {Y} AS z FROM g_dense d)),
past AS (SELECT tech, regr_slope(w, year) FILTER (i >= 3 AND i < 6) AS past_slope, bool_and(d > 0) FILTER (i < 2) AS rises, count(*) AS years FROM lag_ GROUP BY tech),
hh AS ({M.concentration_sql("tc", "tech")}),
base AS (SELECT tech, count(*) AS n, min(base_year) AS first_year, avg(active_flag::INT) AS active_ratio, avg(cites_forward) AS avg_cites FROM tech GROUP BY tech HAVING count(*) >= 3),
lc AS (SELECT b.tech, b.n, b.n AS total, growth, {Y} - first_year AS age, hhi, new_entrants, active_ratio, combo_growth, avg_cites, past_slope, rises, years FROM base b JOIN ent ON ent.tech = b.tech JOIN hh ON hh.tech = b.tech LEFT JOIN cg ON cg.tech = b.tech JOIN g ON g.tech = b.tech JOIN past ON past.tech = b.tech)"""
REG.docs("lifecycle_phase", lambda d: C.lifecycle(d).select("tech", "n", F.round("growth", 9).alias("growth"), "age", F.round("hhi", 9).alias("hhi"), "new_entrants", F.round("active_ratio", 9).alias("active_ratio"), F.round("combo_growth", 9).alias("combo_growth"), F.round("avg_cites", 9).alias("avg_cites"), F.round("maturity", 7).alias("maturity"), F.round("momentum", 7).alias("momentum"), "phase"),
         sql("""SELECT tech, n, round(growth, 9) AS growth, age, round(hhi, 9) AS hhi, new_entrants, round(active_ratio, 9) AS active_ratio, round(combo_growth, 9)::DOUBLE AS combo_growth, round(avg_cites, 9) AS avg_cites, round((norm_age + norm_total) / 2, 7) AS maturity, round((norm_growth + norm_new_entrants) / 2, 7) AS momentum,
  CASE WHEN years >= 6 AND past_slope <= 1e-9 AND rises AND new_entrants >= 1 AND combo_growth > 0 THEN 'Re-emerging' WHEN age <= 5 AND growth >= 0.3 THEN 'Emerging' WHEN growth >= 0.3 THEN 'Growing' WHEN growth < -0.1 THEN 'Declining' WHEN hhi < 0.15 AND new_entrants >= 1 THEN 'Competitive' ELSE 'Mature' END AS phase FROM nz""",
             TECH, PAIRS, COMBOS, CG.replace("NMIN", "1"), ENT, TY, M.growth_sql("ty", "tech", 3, Y), LIFE, M.normalize_sql("lc", {"age": False, "total": True, "growth": False, "new_entrants": True})))
WALLS = ["active_grants", "cr3", "core_share", "family_countries", "years_left"]
PARTS = ["g", "new_entrants", "combo_growth", "keyword_growth", "problem_recurrence", "adjacency"]
OPP = f"""prob AS (SELECT tech, 1 - count(DISTINCT p) / count(DISTINCT doc_id) AS problem_recurrence FROM (SELECT tech, doc_id, unnest(tech_c_list) AS p FROM tech) GROUP BY tech),
kw AS (SELECT tech, count(DISTINCT k) FILTER (late) AS now, count(DISTINCT k) FILTER (NOT late) AS old FROM (SELECT tech, base_year > {Y} - 3 AS late, unnest(tech_b_list) AS k FROM tech) GROUP BY tech),
core AS (SELECT tech, sum(cites_forward) FILTER (r <= greatest(k // 10, 1)) / sum(cites_forward) AS core_share FROM (SELECT tech, cites_forward, row_number() OVER (PARTITION BY tech ORDER BY cites_forward DESC, doc_id) AS r, count(*) OVER (PARTITION BY tech) AS k FROM tech) GROUP BY tech),
rights AS (SELECT tech, count(*) FILTER (active_flag AND is_granted) AS active_grants, avg(len(family_countries)) AS family_countries, coalesce(avg(l) FILTER (l > 0), 0.0) AS years_left FROM (SELECT *, date_diff('day', make_date({Y}::INT, 12, 31), expiry_date) / 365.25 AS l FROM tech) GROUP BY tech),
op AS (SELECT cr.tech, cr.n, greatest(coalesce(growth, 0.0), 0.0) AS g, new_entrants, greatest(coalesce(cg.combo_growth, 0.0), 0.0) AS combo_growth, greatest(CASE WHEN old > 0 THEN (now - old) / old WHEN now > 0 THEN 1.0 ELSE 0.0 END, 0.0) AS keyword_growth, problem_recurrence, coalesce(cg.adjacency, 0) AS adjacency, active_grants, cr AS cr3, core_share, rights.family_countries, years_left
  FROM cr JOIN ent ON ent.tech = cr.tech LEFT JOIN cg ON cg.tech = cr.tech JOIN prob ON prob.tech = cr.tech JOIN kw ON kw.tech = cr.tech JOIN core ON core.tech = cr.tech JOIN rights ON rights.tech = cr.tech JOIN g ON g.tech = cr.tech WHERE cr.n >= 3)"""
ATTR = M.weighted_geometric_mean_sql([("norm_g", 1.0), ("norm_new_entrants", 1.0), ("norm_combo_growth", 0.7), ("norm_keyword_growth", 0.5), ("norm_problem_recurrence", 0.5), ("norm_adjacency", 0.7)])
BARR = f"(({' + '.join(f'norm_{c}' for c in WALLS)}) / 5)"
REG.docs("opportunity", lambda d: C.opportunity(d, keywords=F.col("tech_b_list"), problems=F.col("tech_c_list")).select("tech", "n", "new_entrants", "adjacency", *[F.round(c, 6).alias(c) for c in ("growth", "combo_growth", "keyword_growth", "problem_recurrence", "core_share", "years_left", "attractiveness", "barrier", "entry", "score")]),
         sql(f"""SELECT tech, n, new_entrants, adjacency, round(g, 6) AS growth, round(combo_growth, 6)::DOUBLE AS combo_growth, round(keyword_growth, 6)::DOUBLE AS keyword_growth, round(problem_recurrence, 6) AS problem_recurrence, round(core_share, 6) AS core_share, round(years_left, 6) AS years_left,
  round({ATTR}, 6) AS attractiveness, round({BARR}, 6) AS barrier, round(1 - least({BARR}, 1.0), 6) AS entry, round({ATTR} * greatest(1 - least({BARR}, 1.0), 0.001), 6) AS score FROM nz""",
             TECH, PAIRS, COMBOS, CG.replace("NMIN", "3"), ENT, CR, TY, M.growth_sql("ty", "tech", 3, Y), OPP, M.normalize_sql("op", {c: c in ("new_entrants", "adjacency", "active_grants", "family_countries", "years_left") for c in PARTS + WALLS})))

REG.docs("basic_yearly", C.basic_yearly, sql("SELECT base_year AS year, count(*) AS total, count(*) FILTER (is_granted) AS granted, count(*) FILTER (active_flag) AS active FROM docs GROUP BY base_year"))
REG.docs("crosstab_flow", lambda d: C.crosstab(d, F.col("country"), F.get("family_countries", F.lit(0))), sql("SELECT country AS a, family_countries[1] AS b, count(*) AS n FROM docs GROUP BY 1, 2"))
REG.docs("applicant_year", C.applicant_year, sql("SELECT company, base_year AS year, count(*) AS n FROM comp WHERE company IN (SELECT company FROM comp GROUP BY company ORDER BY count(*) DESC, company LIMIT 10) GROUP BY company, base_year", COMPANY))
REG.docs("tree_prefixes", lambda d: C.tech_tree(d, ["tech_l1_list", "tech_list", "tech_b_list"]), sql("""SELECT path, depth::INT AS depth, n FROM (
SELECT tech_l1_list[1] AS path, 1 AS depth, count(*) AS n FROM docs GROUP BY 1 UNION ALL SELECT tech_l1_list[1] || ' / ' || tech_list[1], 2, count(*) FROM docs GROUP BY 1 UNION ALL SELECT tech_l1_list[1] || ' / ' || tech_list[1] || ' / ' || tech_b_list[1], 3, count(*) FROM docs GROUP BY 1)
WHERE depth < 3 OR n >= greatest(1, floor(0.002 * (SELECT count(*) FROM docs))) ORDER BY depth, n DESC, path LIMIT 400"""))  # fmt: skip
MINE = "list_contains(co_applicants, 'NATION_6')"
FOCUS = f"focus AS (SELECT tech, count(*) FILTER ({MINE}) AS total, count(*) FILTER ({MINE} AND base_year > {Y} - 3) AS recent, count(*) FILTER ({MINE} AND base_year <= {Y} - 3 AND base_year > {Y} - 6) AS prev, min(base_year) FILTER ({MINE}) AS first_year, count(*) AS market FROM tech GROUP BY tech HAVING count(*) FILTER ({MINE}) > 0)"
REG.docs("company_focus", lambda d: C.company_focus(d, "NATION_6").select("tech", "total", "recent", "prev", "first_year", F.round("share", 9).alias("share"), "rising", "new_entry"),
         sql(f"SELECT tech, total, recent, prev, first_year, round(total / market, 9) AS share, recent >= 2 AND recent / total >= 0.5 AND recent > prev AND total <= (SELECT quantile_cont(total, 0.5) FROM focus) AS rising, first_year > {Y} - 3 AS new_entry FROM focus", TECH, FOCUS))
REG.docs("tech_year_bubble", lambda d: C.tech_year_bubble(d, ["NATION_6", "NATION_18"], "tech_l1_list"), sql("SELECT company, tech, base_year AS year, count(*) AS n FROM (SELECT company, base_year, unnest(tech_l1_list) AS tech FROM comp WHERE company IN ('NATION_6', 'NATION_18')) GROUP BY ALL", COMPANY))
TOP12 = "top AS (SELECT tech FROM techn ORDER BY n DESC, tech LIMIT 12)"
REG.docs("upset_exact", C.upset, sql("SELECT combo, count(*) AS n FROM (SELECT string_agg(tech, ' & ' ORDER BY tech) AS combo FROM tech WHERE tech IN (SELECT tech FROM top) GROUP BY doc_id) GROUP BY combo ORDER BY n DESC, combo LIMIT 25", TECH, TECHN, TOP12))
GAPS = """top AS (SELECT tech FROM techn ORDER BY n DESC, tech LIMIT 8), tr AS (SELECT DISTINCT doc_id FROM tech WHERE tech IN (SELECT tech FROM top)), nn AS (SELECT count(*) AS n FROM tr), p AS (SELECT t.tech, n.n / (SELECT n FROM nn) AS p FROM top t JOIN techn n ON n.tech = t.tech),
s AS (SELECT a.tech || ' & ' || b.tech AS combo, a.p * b.p * (SELECT n FROM nn) AS e, [a.tech, b.tech] AS l FROM p a JOIN p b ON a.tech < b.tech UNION ALL SELECT a.tech || ' & ' || b.tech || ' & ' || c.tech, a.p * b.p * c.p * (SELECT n FROM nn), [a.tech, b.tech, c.tech] FROM p a JOIN p b ON a.tech < b.tech JOIN p c ON b.tech < c.tech),
cnt AS (SELECT combo, e, (SELECT count(*) FROM docs WHERE list_has_all(tech_list, s.l)) AS actual FROM s)"""
REG.docs("upset_gaps", lambda d: C.upset_gaps(d, labels="inventors").select("combo", F.round("expected", 6).alias("expected"), "actual", F.round("gap", 6).alias("gap")),
         sql("""SELECT combo, round(e, 6) AS expected, actual, round(round(e, 9) - actual, 6) AS gap FROM cnt
WHERE round(e, 9) >= 1.5 AND actual <= greatest(1, 0.15 * round(e, 9)) ORDER BY round(e, 9) - actual DESC, combo LIMIT 15""", INVENTED, TECHN, GAPS.replace("tech_list", "inventors")))  # fmt: skip
REG.docs("custom_chart_single", lambda d: C.custom_chart(d, ["country"], ["count", "families", "grant_rate", "avg_cites", "sum_claims", "joint_rate", "techs"]), sql("SELECT country AS dim1, count(*)::DOUBLE AS count, count(DISTINCT family_id)::DOUBLE AS families, avg(is_granted::INT) AS grant_rate, avg(cites_forward) AS avg_cites, sum(claims_count) AS sum_claims, avg((len(co_applicants) >= 2)::INT) AS joint_rate, len(list_distinct(flatten(list(tech_list))))::DOUBLE AS techs FROM docs GROUP BY country").replace("SELECT country AS dim1", "SELECT upper(country) AS dim1"))
REG.docs("custom_chart_matrix", lambda d: C.custom_chart(d, ["tech_l1", "year"], ["count", "active_rate"]), sql("SELECT t AS dim1, base_year::VARCHAR AS dim2, count(*)::DOUBLE AS count, avg(active_flag::INT) AS active_rate FROM (SELECT base_year, active_flag, unnest(tech_l1_list) AS t FROM docs) GROUP BY 1, 2"))
REG.docs("custom_chart_points", lambda d: C.custom_chart(d, ["applicant"], ["count", "avg_cites", "active_rate"], top=10), sql("SELECT company AS dim1, count(*)::DOUBLE AS count, avg(cites_forward) AS avg_cites, avg(active_flag::INT) AS active_rate FROM comp GROUP BY company ORDER BY count DESC, company LIMIT 10", COMPANY))
AX = """ax AS (SELECT b.v AS a, c.v AS b, b.doc_id FROM (SELECT doc_id, unnest(tech_b_list) AS v FROM docs) b JOIN (SELECT doc_id, unnest(tech_c_list) AS v FROM docs) c ON b.doc_id = c.doc_id),
axa AS (SELECT a FROM ax GROUP BY a ORDER BY count(*) DESC, a LIMIT 15), axb AS (SELECT b FROM ax WHERE a IN (SELECT a FROM axa) GROUP BY b ORDER BY count(*) DESC, b LIMIT 15), axm AS (SELECT a, b, count(*) AS n FROM ax WHERE a IN (SELECT a FROM axa) AND b IN (SELECT b FROM axb) GROUP BY a, b)"""
REG.docs("axis_matrix", C.axis_matrix, sql("SELECT * FROM axm", AX))
REG.docs("axis_entropy", lambda d: C.axis_entropy(C.axis_matrix(d)).select("a", "total", F.round("entropy_norm", 9).alias("entropy_norm")), sql("SELECT a, sum(n)::BIGINT AS total, round((log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n)) / log2((SELECT count(DISTINCT b) FROM axm)::DOUBLE), 9) AS entropy_norm FROM axm GROUP BY a HAVING sum(n) >= 5", AX))
REG.docs("axis_triples", C.axis_triples, sql("SELECT a, b, c, count(*) AS n FROM (SELECT a, b, unnest(tech_c_list) AS c FROM (SELECT a, unnest(tech_b_list) AS b, tech_c_list FROM (SELECT unnest(tech_l1_list) AS a, tech_b_list, tech_c_list FROM docs))) GROUP BY a, b, c ORDER BY n DESC, a, b, c LIMIT 120"))
PS = """psx AS (SELECT b.v AS solution, c.v AS problem, b.doc_id, b.base_year, b.active_flag, b.co_applicants FROM (SELECT doc_id, base_year, active_flag, co_applicants, unnest(tech_b_list) AS v FROM docs) b JOIN (SELECT doc_id, unnest(tech_c_list) AS v FROM docs) c ON b.doc_id = c.doc_id),
ps AS (SELECT * FROM psx WHERE solution IN (SELECT solution FROM psx GROUP BY solution ORDER BY count(*) DESC, solution LIMIT 40)),
psy AS (SELECT problem, solution, base_year AS year, count(*) AS n FROM ps GROUP BY ALL),
psn AS (SELECT problem, solution, string_agg(company, ', ' ORDER BY r) AS top_applicants FROM (SELECT problem, solution, company, row_number() OVER (PARTITION BY problem, solution ORDER BY count(*) DESC, company) AS r FROM (SELECT problem, solution, unnest(co_applicants) AS company FROM ps) GROUP BY problem, solution, company) WHERE r <= 3 GROUP BY problem, solution)"""
REG.docs("problem_solution", lambda d: C.problem_solution(d).select("problem", "solution", "n", F.round("growth", 9).alias("growth"), F.round("active_ratio", 9).alias("active_ratio"), "top_applicants"),
         sql("SELECT p.problem, p.solution, p.n, round(growth, 9) AS growth, round(active_ratio, 9) AS active_ratio, top_applicants FROM (SELECT problem, solution, count(*) AS n, avg(active_flag::INT) AS active_ratio FROM ps GROUP BY ALL) p JOIN g ON g.problem = p.problem AND g.solution = p.solution JOIN psn ON psn.problem = p.problem AND psn.solution = p.solution", PS, M.growth_sql("psy", "problem, solution")))
REG.docs("cell_detail", lambda d: C.cell_detail(d, "1-URGENT", "small ring").select("cell", "n", F.round("growth", 9).alias("growth"), F.round("active_ratio", 9).alias("active_ratio"), F.round("opportunity", 9).alias("opportunity")),
         sql("SELECT '1-URGENT / small ring' AS cell, c.n, round(growth, 9) AS growth, round(active_ratio, 9) AS active_ratio, round(greatest(coalesce(growth, 0), 0) / (1 + greatest(coalesce(growth, 0), 0)) * (1 - coalesce(active_ratio, 0)), 9) AS opportunity FROM (SELECT count(*) AS n, avg(active_flag::INT) AS active_ratio FROM cell HAVING count(*) > 0) c, g",
             "cell AS (SELECT *, 1 AS kk FROM docs WHERE list_contains(tech_c_list, '1-URGENT') AND list_contains(tech_b_list, 'small ring'))", "cely AS (SELECT kk, base_year AS year, count(*) AS n FROM cell GROUP BY ALL)", M.growth_sql("cely", "kk")))
M30 = "date_diff('day', app_date, reg_date) / 30.44"
REG.docs("months_to_grant", lambda d: C.months_to_grant(d, F.col("base_year")), sql(f"SELECT base_year AS key, count(*) AS n, avg({M30}) AS avg_months FROM docs WHERE {M30} > 0 AND {M30} <= 240 GROUP BY 1"))
REG.docs("claim_bins", C.claim_bins, sql("SELECT CASE WHEN claims_count <= 5 THEN '(0, 5]' WHEN claims_count <= 10 THEN '(5, 10]' WHEN claims_count <= 15 THEN '(10, 15]' WHEN claims_count <= 20 THEN '(15, 20]' WHEN claims_count <= 30 THEN '(20, 30]' ELSE '(30, 1000]' END AS bin, count(*) AS n, avg(cites_forward) AS avg_cites FROM docs WHERE claims_count > 0 AND claims_count <= 1000 GROUP BY 1"))
REG.docs("co_applicant_pairs", C.co_applicants, sql("SELECT x.company AS a, y.company AS b, count(*) AS n FROM comp x JOIN comp y ON x.doc_id = y.doc_id AND x.company < y.company GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 100", COMPANY))
REG.docs("expiry_by_year", C.expiry_by_year, sql("SELECT year(expiry_date)::INT AS year, count(*) AS n, count(*) FILTER (active_flag) AS active FROM docs GROUP BY 1"))
REG.docs("quality_report", lambda d: C.quality_report(d, 2030), sql("""SELECT unnest(['year_sum', 'year_coverage', 'future_years', 'applicant_coverage', 'duplicate_ids', 'registered_before_filed', 'orphan_levels', 'status_coverage', 'citations']) AS "check",
 unnest([y::DOUBLE, y / n, f::DOUBLE, 1 - a / n, (n - ids)::DOUBLE, r::DOUBLE, o::DOUBLE, s / n, c / n]) AS value, unnest([y <= n, y / n >= 0.9, f = 0, a / n <= 0.1, n = ids, r = 0, o = 0, s / n >= 0.8, c > 0]) AS passed
FROM (SELECT count(*) AS n, count(base_year) AS y, count(*) FILTER (base_year > 2030) AS f, count(*) FILTER (coalesce(trim(applicant), '') = '') AS a, count(DISTINCT doc_id) AS ids, count(*) FILTER (reg_date < app_date) AS r, count(*) FILTER (len(tech_list) > 0 AND len(tech_l1_list) = 0) AS o, count(*) FILTER (legal_status <> 'Unknown') AS s, count(cites_forward) AS c FROM docs)"""))  # fmt: skip
REG.docs("filter_options", C.filter_options, sql("SELECT facet, value, n FROM (SELECT facet, value, count(*) AS n, row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, value) AS r FROM (SELECT 'applicant' AS facet, company AS value FROM comp UNION ALL SELECT 'country', country FROM docs UNION ALL SELECT 'legal_status', legal_status FROM docs UNION ALL SELECT 'tech', tech FROM tech UNION ALL SELECT 'tech_l1', unnest(tech_l1_list) FROM docs) GROUP BY facet, value) WHERE r <= 50", TECH, COMPANY))
REG.docs(
    "own_capability", lambda d: C.own_capability(d, F.col("family_id") == 7),
    sql("""SELECT tech, count(*) FILTER (family_id = 7) AS n_own, CASE WHEN count(*) FILTER (family_id = 7) > 0 THEN 1.0 WHEN bool_or(list_has_any(tech_list, (SELECT list(DISTINCT tech) FROM tech WHERE family_id = 7))) THEN 0.5 ELSE 0.0 END::DOUBLE AS capability
FROM (SELECT family_id, tech_list, unnest(tech_list) AS tech FROM docs) GROUP BY tech""", TECH),
)
