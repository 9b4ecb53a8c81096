"""Projections of the driver's tables onto the relations the operators take, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.numbers import round2

REF_DAY = date(2024, 1, 24)
REF = "DATE '2024-01-24'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task takes where rows are dealt by their number.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows`` dealt by keys over as many tasks as ``n``, the rows of the table, asks for.  Left to itself Spark joins partitions by
    their compressed bytes, and rows that compress well fill the memory of few tasks."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), *keys)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), F.col("ts").alias("started"), F.floor(F.col("value") * 60).cast("long").alias("duration_sec"), (F.col("event_type") == "signup").alias("manual"))


def active_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select(F.col("user_id").alias("project_id"), F.to_date("ts").alias("day")).distinct()


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation count as deleted, so that some sessions are orphans."""
    c = table(spark, sf_dir, "customer").where("c_nationkey <> 3")
    technique = F.when(F.col("c_mktsegment") == "FURNITURE", "crochet").when(F.col("c_mktsegment") != "BUILDING", "knitting")
    status = F.when(F.col("c_mktsegment") == "MACHINERY", "done").when(F.col("c_mktsegment") == "AUTOMOBILE", "paused").otherwise("wip")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), technique.alias("technique"), status.alias("status"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger lines as typed text: decimal commas, blanks, gifts, undated ones."""
    li, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    price = F.replace(round2(F.col("l_extendedprice") / F.col("l_quantity")).cast("string"), F.lit("."), F.lit(","))
    currency = F.element_at(F.array(*map(F.lit, ("EUR", "USD", "GBP", "CHF", "CAD"))), F.col("n_regionkey") + 1)
    undated = (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("id"), F.col("l_partkey").alias("yarn_id"), F.when(F.col("l_returnflag") == "R", "gift").otherwise("buy").alias("kind"),
        F.col("l_quantity").cast("string").alias("quantity"), F.when(F.col("l_tax") == 0, "").otherwise(price).alias("unit_price"), currency.alias("currency"),
        F.when(undated, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"), F.lit("yarn").alias("category"), F.concat(F.lit("#"), F.col("l_partkey").cast("string")).alias("label"),
    )


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size <= 10")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") == 1, "").otherwise(F.col("p_retailprice").cast("string")).alias("price"), F.lit("EUR").alias("currency"), F.lit("").alias("date"),
        (F.col("p_size") == 2).alias("builtin"), F.when(F.col("p_size") == 3, F.lit(1).cast("long")).alias("owner_project_id"), F.col("p_type").alias("category"),
    )


def tools_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), round2(F.abs("s_acctbal")).cast("string").alias("price"), F.lit("USD").alias("currency"), F.lit("2000-01-01").alias("date"))


def yarns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stock, with reservations by supplier (the project) taken from returned lines and consumption from old ones."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")

    def held(condition: str, name: str) -> DataFrame:
        per = li.where(condition).groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
        return per.groupBy("l_partkey").agg(F.map_from_entries(F.collect_list(F.struct("l_suppkey", "q"))).alias(name)).withColumnRenamed("l_partkey", "id")

    base = p.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), F.lit("").alias("color"), F.lit("").alias("notes"), F.col("p_type").alias("weight"), F.col("p_size").cast("string").alias("grams"),
        F.when(F.col("p_size") == 7, "").otherwise(F.col("p_retailprice").cast("string")).alias("price"), F.when(F.col("p_size") > 25, "EUR").otherwise("").alias("currency"),
        (F.col("p_size") * 20 - 20).cast("double").alias("quantity"), F.when(F.col("p_size") > 5, F.array(F.lit("Vegan"), F.lit("organic"))).otherwise(F.array(F.lit("organic"))).alias("labels"),
    )
    return base.join(held("l_returnflag = 'R'", "reservations"), "id", "left").join(held("l_returnflag = 'A'", "consumed"), "id", "left")


def stock_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_nationkey <> 3")
    return s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "done").otherwise("wip").alias("status"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source."""
    from loomspan.operators.documents import lines_of

    return lines_of(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


#: The same relations for the oracle, as common table expressions.
SQL = {
    "sessions": "sessions AS (SELECT event_id AS id, user_id AS project_id, ts AS started, CAST(floor(value * 60) AS BIGINT) AS duration_sec, event_type = 'signup' AS manual, CAST(ts AS DATE) AS d FROM events WHERE event_type IN ('purchase', 'signup'))",
    "active_days": "active_days AS (SELECT DISTINCT user_id AS project_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'click')",
    "projects": "projects AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'crochet' WHEN c_mktsegment <> 'BUILDING' THEN 'knitting' END AS technique, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'done' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'paused' ELSE 'wip' END AS status FROM customer WHERE c_nationkey <> 3)",
    "by_day": "by_day AS (SELECT d, sum(duration_sec) AS total_sec, count(*) AS n, max(started) AS last_start FROM sessions GROUP BY d)",
    "lines": """lines AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS id, l_partkey AS yarn_id, l_returnflag = 'R' AS gift, l_quantity AS q,
        CASE WHEN l_tax = 0 THEN NULL ELSE floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 END AS p,
        list_extract(['EUR', 'USD', 'GBP', 'CHF', 'CAD'], n_regionkey + 1) AS currency,
        CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS dt, 'yarn' AS category, '#' || l_partkey AS label
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "expenses": """expenses AS (SELECT id, yarn_id, gift, q, p, currency, dt, category, label FROM lines
        UNION ALL SELECT 'pat:' || p_partkey, NULL, FALSE, 1, p_retailprice, 'EUR', '', 'pattern', p_name FROM part WHERE p_size <= 10 AND p_size NOT IN (1, 2, 3)
        UNION ALL SELECT 'tool:' || s_suppkey, NULL, FALSE, 1, floor(abs(s_acctbal) * 100 + 0.5) / 100, 'USD', '2000-01-01', 'tool', s_name FROM supplier)""",
    "amounts": "amounts AS (SELECT *, CASE WHEN gift THEN 0 ELSE coalesce(p, 0) * q END AS amount FROM expenses)",
    "yarns": """yarns AS (SELECT p_partkey AS id, p_brand AS brand, p_name AS model, p_type AS weight, p_size AS grams, CASE WHEN p_size = 7 THEN NULL ELSE p_retailprice END AS price,
        CASE WHEN p_size > 25 THEN 'EUR' ELSE '' END AS currency, CAST(p_size * 20 - 20 AS DOUBLE) AS quantity, p_size > 5 AS vegan FROM part)""",
    "reserved": "reserved AS (SELECT l_partkey AS yarn_id, l_suppkey AS project_id, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)",
    "consumed": "consumed AS (SELECT l_partkey AS yarn_id, l_suppkey AS project_id, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)",
    "stock_projects": "stock_projects AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'done' ELSE 'wip' END AS status FROM supplier WHERE s_nationkey <> 3)",
    "doc_lines": """doc_lines AS (SELECT doc, page, ln - 1 AS line_no, body AS text FROM (SELECT source AS doc, doc_id AS page, trim(unnest(string_split_regex(coalesce(text, ''), '\\r?\\n')), ' ') AS body,
        generate_subscripts(string_split_regex(coalesce(text, ''), '\\r?\\n'), 1) AS ln FROM documents) WHERE body <> '')""",
}


def sql(body: str, *names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + body
