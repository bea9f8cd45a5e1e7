"""Analyses of one company's documents, and what stands behind one cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import core as C
from ..operators.filters import applicant_mask
from ..plans.binding import DOCS_SQL, sql
from . import Registry, core

REG = Registry()
COMPANY = "NATION_6"
#: The documents of which the company is an applicant stand for all in another query's SQL.
ITS = DOCS_SQL.replace("docs AS (", "docs_all AS (", 1) + f",\ndocs AS (SELECT * FROM docs_all WHERE applicant = '{COMPANY}' OR list_contains(co_applicants, '{COMPANY}'))"

for _name in ("lifecycle_phase", "opportunity", "emerging_combinations", "problem_solution"):
    REG.docs(f"{_name}_of_company", lambda d, f=core.REG.over_docs[_name]: f(d.where(applicant_mask(COMPANY))), core.REG.sql[_name].replace(DOCS_SQL, ITS))

REG.docs(
    "cell_view", lambda d: C.cell_view(d.withColumn("indep_claim", F.concat_ws(", ", "tech_b_list")), "1-URGENT", "small ring"),
    sql("""SELECT 'year' AS part, base_year::VARCHAR AS name, count(*) AS n FROM cell GROUP BY ALL UNION ALL (SELECT 'applicant', company, count(*) FROM (SELECT unnest(co_applicants) AS company FROM cell) GROUP BY company ORDER BY count(*) DESC, company LIMIT 5)
UNION ALL SELECT 'claim', arg_min(left(array_to_string(tech_b_list, ', '), 600), doc_id), NULL FROM cell""", "cell AS (SELECT * FROM docs WHERE list_contains(tech_c_list, '1-URGENT') AND list_contains(tech_b_list, 'small ring'))"),
)
