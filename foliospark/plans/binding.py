"""The driver's star-schema tables read as a document portfolio: one order is one document.

``documents`` builds the standard frame from them; ``DOCS_SQL`` is the same in
SQL, the common start of the registered queries' SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The columns that are made of the lines' parts, and of their suppliers.
OF_PARTS = {"tech_list", "tech_l1_list", "tech_b_list"}
OF_SUPPLIERS = {"co_applicants", "owner", "family_countries", "family_size"}
#: The columns that count a line as often as a join repeats it.
_COUNTED = {"cites_forward", "claims_count", "class_confidence", "oa_count", "npl_count", "cites_backward"}
#: The sets that are gathered line by line.
_GATHERED = OF_PARTS | OF_SUPPLIERS | {"inventors"}


def _keyed(df: DataFrame, key: str) -> bool:
    """Whether no key of a table is there twice, so that a join with it repeats no row."""
    return df.groupBy(key).count().where("count > 1").isEmpty()


def documents(spark: SparkSession, sf_dir: str, columns: set[str] | None = None) -> DataFrame:
    """The standard frame, or ``columns`` of it. What a query doesn't use is pruned down to the scans.

    Lines are joined with their parts and suppliers if a column is made of these, or if lines are counted and keys are repeated, as lines are then too.
    """
    t = lambda n: table(spark, sf_dir, n)
    nation, region = t("nation"), t("region")
    asked = lambda of: columns is None or bool(columns & of)
    lines = t("lineitem")
    if parts := asked(OF_PARTS) or (asked(_COUNTED) and not _keyed(t("part"), "p_partkey")):
        lines = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if suppliers := asked(OF_SUPPLIERS) or (asked(_COUNTED) and not all(_keyed(t(n), k) for n, k in (("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")))):
        lines = (
            lines.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
            .join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_nation"), F.col("n_regionkey").alias("s_regionkey")), "s_nationkey", "left")
            .join(region.select(F.col("r_regionkey").alias("s_regionkey"), F.col("r_name").alias("s_region")), "s_regionkey", "left")
        )
    if columns is not None and asked(_GATHERED):  # sets of one line each would be made and dealt otherwise
        lines = lines.repartition("l_orderkey")
    distinct = lambda c: F.array_sort(F.collect_set(F.col(c).cast("string")))
    of_parts = [distinct("p_brand").alias("tech_list"), distinct("p_type").alias("tech_l1_list"), distinct("p_name").alias("tech_b_list")]
    of_suppliers = [distinct("s_nation").alias("_nations"), distinct("s_region").alias("family_countries"), F.max_by("s_nation", F.struct("l_suppkey", "l_linenumber", "l_partkey")).alias("owner")]
    per = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        *(of_parts if parts else []), *(of_suppliers if suppliers else []),
        F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")).alias("inventors"),
        F.max("l_shipdate").cast("date").alias("reg_date"), F.count("*").cast("double").alias("cites_forward"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("claims_count"),
        (F.sum(F.round((1 - F.col("l_discount")) * 100).cast("long")) / F.count("*") / 100).alias("class_confidence"),
        F.sum((F.col("l_returnflag") == "R").cast("long")).cast("double").alias("oa_count"), F.sum((F.col("l_linestatus") == "O").cast("long")).cast("double").alias("npl_count"),
    )
    who = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    o = t("orders").join(per, "o_orderkey").join(who, F.col("o_custkey") == F.col("c_custkey"))
    status = F.col("o_orderstatus")
    day = F.col("o_orderdate").cast("date")
    made = {
        "doc_id": F.col("o_orderkey"), "family_id": F.col("o_custkey"), "applicant": F.col("n_name"),
        "co_applicants": F.concat(F.array("n_name"), F.array_remove("_nations", F.col("n_name"))), "owner": F.col("owner"),
        "tech_list": F.col("tech_list"), "tech_l1_list": F.col("tech_l1_list"), "tech_b_list": F.col("tech_b_list"), "tech_c_list": F.array("o_orderpriority"), "inventors": F.col("inventors"), "agents": F.array("c_mktsegment"),
        "app_date": day, "reg_date": F.col("reg_date"), "expiry_date": F.add_months(day, 240), "base_year": F.year(day), "country": F.col("r_name"), "family_countries": F.col("family_countries"),
        "legal_status": F.when(status == "F", "Granted-Active").when(status == "O", "Pending").otherwise("Unknown"),
        "is_granted": F.when(status == "F", True).when(status == "O", False),
        "active_flag": F.when(status == "F", F.col("c_acctbal") >= 0).when(status == "O", True),
        **{k: F.col(k) for k in ("cites_forward", "claims_count", "class_confidence", "oa_count", "npl_count")},
        # Stand-ins for columns that these tables don't have.
        "cites_backward": F.col("npl_count"), "family_size": (F.size("_nations") + F.size("inventors")).cast("double"),
    }
    return o.select(*[v.alias(k) for k, v in made.items() if columns is None or k in columns])


DOCS_SQL = """docs AS (
  SELECT o_orderkey AS doc_id, o_custkey AS family_id, n.n_name AS applicant, list_concat([n.n_name], list_filter(p.nations, lambda x: x <> n.n_name)) AS co_applicants, p.owner,
    p.tech_list, p.tech_l1_list, p.tech_b_list, [o_orderpriority] AS tech_c_list, p.inventors, [c_mktsegment] AS agents,
    o_orderdate::DATE AS app_date, p.reg_date, (o_orderdate::DATE + INTERVAL 240 MONTH)::DATE AS expiry_date, year(o_orderdate)::INTEGER AS base_year, r.r_name AS country, p.family_countries,
    CASE o_orderstatus WHEN 'F' THEN 'Granted-Active' WHEN 'O' THEN 'Pending' ELSE 'Unknown' END AS legal_status,
    CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS is_granted,
    CASE o_orderstatus WHEN 'F' THEN c_acctbal >= 0 WHEN 'O' THEN TRUE END AS active_flag,
    p.cites_forward, p.claims_count, p.class_confidence, p.oa_count, p.npl_count, p.npl_count AS cites_backward, (len(p.nations) + len(p.inventors))::DOUBLE AS family_size
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey JOIN (
    SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS tech_list, list_sort(list(DISTINCT p_type)) AS tech_l1_list, list_sort(list(DISTINCT p_name)) AS tech_b_list,
      list_sort(list(DISTINCT sn.n_name)) AS nations, list_transform(list_sort(list(DISTINCT l_suppkey)), lambda x: x::VARCHAR) AS inventors, list_sort(list(DISTINCT sr.r_name)) AS family_countries,
      max(l_shipdate)::DATE AS reg_date, count(*)::DOUBLE AS cites_forward, sum(l_quantity::BIGINT)::DOUBLE AS claims_count,
      sum(round((1 - l_discount) * 100)::BIGINT)::DOUBLE / count(*) / 100 AS class_confidence, arg_max(sn.n_name, (l_suppkey, l_linenumber, l_partkey)) AS owner,
      (count(*) FILTER (l_returnflag = 'R'))::DOUBLE AS oa_count, (count(*) FILTER (l_linestatus = 'O'))::DOUBLE AS npl_count
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
    GROUP BY l_orderkey
  ) p ON p.l_orderkey = o_orderkey
)"""


def sql(body: str, *ctes: str) -> str:
    """A query over ``docs`` and further CTEs."""
    return "WITH " + ",\n".join([DOCS_SQL, *[c.strip().rstrip(",") for c in ctes if c.strip()]]) + "\n" + body
