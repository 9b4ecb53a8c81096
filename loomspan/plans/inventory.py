"""Named queries for the rules that ``catalogue`` does not reach, over stand-ins built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import catalogues, dates, fibres, numbers, text
from loomspan.operators import activity, documents, exports, imports, layout, ledger, mutations, progress, reference, steps, stock, tools
from loomspan.plans import standins as S
from loomspan.plans.catalogue import LCS
from loomspan.plans.registry import query
from loomspan.plans.standins import REF, REF_DAY, sql, table

R2 = "floor(({}) * 100 + 0.5) / 100"


def _text(array: Column) -> Column:
    """An array as one text, so that results compare."""
    return F.array_join(F.transform(array, lambda x: F.coalesce(x.cast("string"), F.lit("?"))), "|")


# stock and reservations -----------------------------------------------------------------------------------------------

_HELD = "y AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS quantity, p_size % 7 AS a, p_size % 5 AS b, p_size % 4 AS c FROM part)"


def _held(spark: SparkSession, d: str) -> DataFrame:
    """Stock reserved for projects 1 and 2 (skeins a and b) and partly used by project 1 (c)."""
    p = table(spark, d, "part").selectExpr("p_partkey AS id", "CAST(p_size AS DOUBLE) AS quantity", "p_size % 7 AS a", "p_size % 5 AS b", "p_size % 4 AS c")
    pair = lambda *kv: F.create_map(*(x for k, v in kv for x in (F.lit(k).cast("long"), F.col(v).cast("double"))))
    return p.withColumn("reservations", pair((1, "a"), (2, "b"))).withColumn("consumed", pair((1, "c")))


def _at(column: str, project: int) -> Column:
    return F.coalesce(F.try_element_at(F.col(column), F.lit(project).cast("long")), F.lit(0.0))


@query(f"WITH {_HELD} SELECT id, greatest(quantity - b, 0.0) AS for_first, greatest(quantity - a, 0.0) AS for_second, greatest(quantity - a - b, 0.0) AS for_other FROM y")
def available_to_project(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d).select("id", *(stock.available_for(F.lit(k).cast("long")).alias(n) for k, n in ((1, "for_first"), (2, "for_second"), (3, "for_other"))))


@query(f"WITH {_HELD} SELECT id, greatest(least(10.0, quantity - b), 0.0) AS first, CAST(b AS DOUBLE) AS second FROM y")
def reserve_stock(spark: SparkSession, d: str) -> DataFrame:
    return stock.reserve(_held(spark, d), F.lit(1).cast("long"), F.lit(10.0)).select("id", _at("reservations", 1).alias("first"), _at("reservations", 2).alias("second"))


@query(f"WITH {_HELD}, t AS (SELECT *, CASE WHEN a > 0 THEN greatest(least(3.0, quantity - b), 0.0) ELSE 0.0 END AS took FROM y) SELECT id, quantity - took AS quantity, 0.0 AS reserved, c + took AS used FROM t")
def consume_stock(spark: SparkSession, d: str) -> DataFrame:
    return stock.consume(_held(spark, d), F.lit(1).cast("long"), F.lit(3.0)).select("id", "quantity", _at("reservations", 1).alias("reserved"), _at("consumed", 1).alias("used"))


@query(f"WITH {_HELD}, t AS (SELECT *, greatest(least(5.0, c + greatest(quantity - a - b, 0)), 0.0) AS used FROM y) SELECT id, quantity + c - used AS quantity, used FROM t")
def correct_consumption(spark: SparkSession, d: str) -> DataFrame:
    """Done twice, as the second time must change nothing."""
    one = F.lit(1).cast("long")
    twice = stock.correct_consumption(stock.correct_consumption(_held(spark, d), one, F.lit(5.0)), one, F.lit(5.0))
    return twice.select("id", "quantity", _at("consumed", 1).alias("used"))


@query(f"WITH {_HELD}, r AS (SELECT 1 AS project_id WHERE EXISTS (SELECT 1 FROM y WHERE a > 0) UNION ALL SELECT 2 WHERE EXISTS (SELECT 1 FROM y WHERE b > 0)) SELECT s_suppkey AS project_id, CASE s_suppkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'abandoned' ELSE 'pause' END AS status, s_suppkey % 3 < 2 AND s_suppkey IN (SELECT project_id FROM r) AS asks FROM supplier")
def consumption_asked(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "supplier").selectExpr("s_suppkey AS project_id", "CASE s_suppkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'abandoned' ELSE 'pause' END AS status")
    return stock.asks_consumption(changes, _held(spark, d))


_COLOURS = "CASE p_size % 5 WHEN 0 THEN 'hsl(4 65% 49%)' WHEN 1 THEN 'hsl(212 55% 52%)' WHEN 2 THEN 'hsl(1 2% 3%)' WHEN 3 THEN '' END"


@query(f"SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'rouge' WHEN 1 THEN 'bleu' WHEN 2 THEN '__custom__' ELSE '' END AS family, p_size % 5 = 1 AS blue FROM part WHERE {_COLOURS} IS NOT NULL OR p_size % 5 = 4")
def colour_families(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_COLOURS).alias("color_value"))
    return y.where(stock.matches_color("")).select("id", stock.color_family(F.col("color_value")).alias("family"), stock.matches_color("bleu").alias("blue"))


@query(sql("""SELECT id FROM (SELECT y.id, CASE WHEN y.quantity = 0 AND c.q > 0 THEN 'used' WHEN least(coalesce(r.q, 0), y.quantity) <= 0 THEN 'free' WHEN NOT r.all_done THEN 'reserved' WHEN r.q >= y.quantity THEN 'used' ELSE 'usedPartial' END AS state
    FROM yarns y LEFT JOIN (SELECT yarn_id, sum(q) AS q FROM consumed GROUP BY 1) c ON c.yarn_id = y.id
    LEFT JOIN (SELECT r.yarn_id, sum(r.q) AS q, bool_and(coalesce(p.status = 'done', FALSE)) AS all_done FROM reserved r LEFT JOIN stock_projects p ON p.id = r.project_id WHERE r.q > 0 GROUP BY 1) r ON r.yarn_id = y.id) WHERE state = 'reserved'""", "yarns", "reserved", "consumed", "stock_projects"))
def stock_by_state(spark: SparkSession, d: str) -> DataFrame:
    return stock.usage_state(S.yarns(spark, d), S.stock_projects(spark, d)).where(stock.matches_state("reserved")).select("id")


@query("""SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'none' WHEN 'error' THEN 'unknown' ELSE CASE WHEN regexp_extract(props, '[0-9]+')::INT = 0 THEN 'free' ELSE 'amount' END END AS state, event_type <> 'view' AS noted FROM events""")
def price_states(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of events as prices with a decimal comma; errors have the text they came in, views none."""
    number = F.concat(F.regexp_extract("props", "[0-9]+", 0), F.lit(",0"))
    y = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", " ").when(F.col("event_type") == "error", F.col("props")).otherwise(number).alias("price"))
    return y.select("id", ledger.price_state().alias("state"), numbers.has_value(F.col("price")).alias("noted"))


_LISTS = ("l AS (SELECT l_orderkey AS project_id, l_partkey AS yarn_id, l_linenumber AS pos, CASE l_partkey % 3 WHEN 0 THEN ['wool', 'silk'] WHEN 1 THEN ['cotton'] ELSE ['silk', 'linen', 'silk'] END AS comp FROM lineitem)")


@query(f"WITH {_LISTS}, e AS (SELECT project_id, pos, unnest(comp) AS fibre, generate_subscripts(comp, 1) AS place FROM l), f AS (SELECT project_id, fibre, min(pos * 100 + place) AS k FROM e GROUP BY ALL) SELECT project_id, string_agg(fibre, ', ' ORDER BY k, fibre) AS fibres FROM f GROUP BY 1")
def composition_text(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    usage = li.selectExpr("l_orderkey AS project_id", "l_partkey AS yarn_id", "l_linenumber AS pos")
    yarns = p.selectExpr("p_partkey AS id", "CASE p_partkey % 3 WHEN 0 THEN array('wool', ' silk') WHEN 1 THEN array('cotton') ELSE array('silk', 'linen', 'silk') END AS composition")
    return stock.composition_summary(usage, yarns)


# ledger ---------------------------------------------------------------------------------------------------------------


@query(sql("SELECT DISTINCT CASE WHEN dt = '' THEN 'unknown' ELSE dt[1:4] END AS year FROM lines UNION ALL SELECT 'all'", "lines"))
def year_menu(spark: SparkSession, d: str) -> DataFrame:
    return ledger.year_options(S.lines(spark, d))


@query(sql("SELECT id, dt AS date FROM lines WHERE yarn_id < 50 AND NOT gift", "lines"))
def newest_lines(spark: SparkSession, d: str) -> DataFrame:
    return ledger.newest_first(S.lines(spark, d).where("yarn_id < 50 AND kind = 'buy'")).select("id", "date")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'EUR' WHEN p_size % 2 = 0 THEN 'CHF' ELSE '' END AS currency FROM part")
def currency_filled(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "part").selectExpr("p_partkey AS id", "CASE WHEN p_size % 2 = 0 THEN '1' ELSE ' ' END AS price", "CASE WHEN p_size % 6 = 0 THEN 'EUR' ELSE '' END AS currency")
    return ledger.fill_currency(ledger.fill_currency(y, "CHF"), "XXX").select("id", "currency")


# tools ----------------------------------------------------------------------------------------------------------------

_TYPE = "CASE p_size % 6 WHEN 0 THEN 'interchangeable' WHEN 1 THEN 'circular' WHEN 2 THEN 'cable' WHEN 3 THEN 'standard' WHEN 4 THEN 'hookKit' ELSE 'gone' END"
_KIT = "p_size % 6 IN (0, 4)"


def _tools(spark: SparkSession, d: str) -> DataFrame:
    """Tools of several types; kits hold the size, the size and a half more, and three cables."""
    p = table(spark, d, "part").selectExpr("p_partkey AS id", "p_name AS name", f"{_TYPE} AS type", "p_size / 4.0D AS mm", "p_size")
    kit = F.expr(_KIT)
    cables = F.array(*(F.struct(F.lit(cm).cast("double").alias("cm"), F.lit(join).cast("string").alias("join")) for cm, join in ((80, "l"), (60, None), (80, "s"))))
    return p.select(
        "id", "name", "type", F.when(kit, "kit").otherwise("needle").alias("category"), F.when(~kit & (F.col("p_size") % 5 != 0), F.col("mm")).alias("size_mm"),
        F.when(kit, F.array(F.col("mm") + 0.5, F.col("mm"), F.col("mm"))).otherwise(F.array().cast("array<double>")).alias("kit_sizes"), F.when(kit, cables).alias("kit_cables"), F.lit(1).alias("quantity"), F.lit("available").alias("status"),
    )


_MM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS INT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_US = "(VALUES " + ", ".join(f"({mm}, {'NULL' if us is None else repr(us)})" for mm, us, _ in catalogues.KNITTING_SIZES) + ") s(mm, us)"


@query(f"SELECT p_partkey AS id, CASE WHEN {_KIT} THEN {_MM.format('(p_size / 4.0)')} || ' – ' || {_MM.format('(p_size / 4.0 + 0.5)')} || ' mm' WHEN p_size % 5 = 0 THEN '' ELSE {_MM.format('(p_size / 4.0)')} || ' mm' || coalesce(' · US ' || s.us, '') END AS label, CASE WHEN {_KIT} THEN '60|80 s|80 l' ELSE '' END AS cables, CASE p_size % 6 WHEN 3 THEN 'crochet' WHEN 4 THEN 'crochet' WHEN 5 THEN '' ELSE 'knitting' END AS serves FROM part LEFT JOIN {_US} ON p_size / 4.0 = s.mm AND NOT {_KIT} AND p_size % 5 <> 0")
def tool_labels(spark: SparkSession, d: str) -> DataFrame:
    t = exports.with_equivalents(_tools(spark, d))
    cables = F.transform(tools.tool_cables(), lambda c: F.concat_ws(" ", c["cm"].cast("int").cast("string"), c["join"]))
    serves = F.when(exports.serves("crochet"), "crochet").when(exports.serves("knitting"), "knitting").otherwise("")
    return t.select("id", tools.size_text(F.col("us")).alias("label"), F.array_join(cables, "|").alias("cables"), serves.alias("serves"))


@query(f"SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'kit' WHEN 4 THEN 'kit' WHEN 3 THEN 'hook' ELSE 'needle' END AS category, CASE WHEN {_KIT} OR p_size % 6 = 2 OR p_size % 5 = 0 THEN NULL ELSE p_size / 4.0 END AS size_mm, CASE WHEN {_KIT} THEN 3 ELSE 0 END AS sizes FROM part")
def tools_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _tools(spark, d).select("id", *exports.normalized_tool()).select("id", "category", "size_mm", F.size("kit_sizes").alias("sizes"))


@query(f"SELECT p_partkey AS id, s.us, CASE WHEN {_KIT} THEN CAST(p_size / 4.0 + 0.5 AS VARCHAR) || ' / ' || CAST(p_size / 4.0 AS VARCHAR) || ' / ' || CAST(p_size / 4.0 AS VARCHAR) ELSE '' END AS kit_sizes, CASE WHEN {_KIT} THEN '80 cm L ; 60 cm ; 80 cm S' END AS kit_cables FROM (SELECT *, CAST(p_size AS DOUBLE) AS z FROM part) LEFT JOIN {_US} ON p_size / 4.0 = s.mm AND NOT {_KIT} AND p_size % 5 <> 0".replace("CAST(p_size / 4.0 + 0.5 AS VARCHAR)", "CAST(z / 4 + 0.5 AS VARCHAR)").replace("CAST(p_size / 4.0 AS VARCHAR)", "CAST(z / 4 AS VARCHAR)"))
def tool_export_rows(spark: SparkSession, d: str) -> DataFrame:
    return exports.tool_export(_tools(spark, d)).select("id", "us", "kit_sizes", "kit_cables")


_PICKS = f"""t AS (SELECT p_partkey AS tool_id, unnest(CASE WHEN {_KIT} THEN [p_size / 4.0, p_size / 4.0 + 0.5] WHEN p_size % 5 = 0 THEN [] ELSE [p_size / 4.0] END) AS mm FROM part),
    k AS (SELECT l_orderkey AS project_id, CASE WHEN l_orderkey % 3 = 0 THEN 'done' ELSE 'wip' END AS status, l_linenumber - 1 AS place, l_partkey AS tool_id, p_size / 4.0 + CASE WHEN l_linenumber % 3 = 0 THEN 0.004 ELSE 0.0 END AS size_mm, CASE WHEN l_linenumber % 2 = 0 THEN 60.0 END AS cable_cm FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _pick_projects(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    mm = F.col("p_size") / 4.0 + F.when(F.col("l_linenumber") % 3 == 0, 0.004).otherwise(0.0)
    picks = li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("tool_id"), mm.alias("size_mm"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(60.0)).alias("cable_cm")))).alias("kit_picks"))
    return picks.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_orderkey") % 3 == 0, "done").otherwise("wip").alias("status"), "kit_picks")


@query(f"WITH {_PICKS} SELECT DISTINCT k.project_id, k.tool_id, CAST(floor(k.size_mm * 100 + 0.5) AS INT) AS size, k.cable_cm FROM k JOIN t ON t.tool_id = k.tool_id AND floor(t.mm * 100 + 0.5) = floor(k.size_mm * 100 + 0.5)")
def kit_picks_valid(spark: SparkSession, d: str) -> DataFrame:
    return tools.valid_picks(_pick_projects(spark, d), _tools(spark, d)).select("project_id", "tool_id", "size", "cable_cm")


@query(f"WITH {_PICKS}, v AS (SELECT DISTINCT k.project_id, k.tool_id, floor(k.size_mm * 100 + 0.5) AS size FROM k JOIN t ON t.tool_id = k.tool_id AND floor(t.mm * 100 + 0.5) = floor(k.size_mm * 100 + 0.5) WHERE k.status = 'wip' AND cable_cm = 60) SELECT p_partkey AS tool_id, c.cm AS cable_cm, CAST(c.n AS BIGINT) AS copies, CASE WHEN c.cm = 60 THEN coalesce(u.n, 0) ELSE 0 END AS taken FROM part CROSS JOIN (VALUES (60.0, 1), (80.0, 2)) c(cm, n) LEFT JOIN (SELECT tool_id, count(*) AS n FROM v GROUP BY 1) u ON u.tool_id = p_partkey WHERE {_KIT}")
def cable_copies(spark: SparkSession, d: str) -> DataFrame:
    return tools.cable_use(_tools(spark, d), _pick_projects(spark, d))


@query(f"SELECT DISTINCT unnest(CASE WHEN {_KIT} THEN [p_size / 4.0, p_size / 4.0 + 0.5] WHEN p_size % 5 = 0 THEN [] ELSE [p_size / 4.0] END) AS size_mm FROM part")
def owned_sizes(spark: SparkSession, d: str) -> DataFrame:
    return tools.owned_sizes(_tools(spark, d))


@query(f"SELECT p_partkey AS id FROM part WHERE ((NOT {_KIT} AND p_size = 13) OR ({_KIT} AND p_size IN (13, 11))) AND contains(lower(p_name), 'e')")
def tool_search(spark: SparkSession, d: str) -> DataFrame:
    return tools.filter_tools(_tools(spark, d), 3.25, " E ").select("id")


@query(f"SELECT p_partkey AS id, CASE WHEN {_KIT} THEN p_size IN (13, 11, 8, 6) WHEN p_size % 5 = 0 THEN FALSE ELSE p_size IN (13, 8) END AS matching FROM part")
def picker_first(spark: SparkSession, d: str) -> DataFrame:
    return tools.picker_order(_tools(spark, d), [3.25, 2.0]).select("id", "matching")


@query("SELECT o_custkey AS project_id, o_orderkey % 50 AS tool_id, min(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END) = 0 AS held FROM orders GROUP BY 1, 2")
def relinked_tools(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").selectExpr("o_custkey AS project_id", "o_orderkey % 50 AS tool_id", "o_orderstatus = 'O' AS held")
    return tools.relink(o.where("held"), o.where("NOT held"), "project_id", "tool_id")


@query(f"SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 4.5 WHEN 1 THEN 4.0 WHEN 2 THEN NULL END AS size_mm FROM customer WHERE c_custkey % 4 < 4 AND {REF} IS NOT NULL")
def requested_sizes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").selectExpr("c_custkey AS id", "CASE c_custkey % 4 WHEN 0 THEN '4,5 MM ' WHEN 1 THEN ' ' WHEN 2 THEN 'x mm' END AS mm", "CASE c_custkey % 4 WHEN 1 THEN '6' WHEN 2 THEN '7' WHEN 3 THEN 'none' END AS us")
    return exports.requested_mm(c).select("id", "size_mm")


_REC = ", ".join(f"({v})" for v in catalogues.RECOMMENDED_MM["knitting"])


@query(f"WITH g AS (SELECT p_partkey AS id, p_size % 8 + 2.0 AS mm, 15.0 + p_size % 10 AS target FROM part) SELECT id, CAST(CASE WHEN abs(20.0 / target - 1) <= 0.02 THEN mm ELSE v END AS DOUBLE) AS recommended FROM g CROSS JOIN (VALUES {_REC}) r(v) QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(v - CAST(mm * 20.0 AS DOUBLE) / target), v) = 1")
def recommended_needles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey AS id", "CAST(p_size % 8 + 2 AS DOUBLE) AS mm", "CAST(15 + p_size % 10 AS DOUBLE) AS target")
    return p.select("id", exports.recommended_mm(F.col("mm"), F.lit(20.0), F.col("target"), "knitting").alias("recommended"))


# versions, trash, settings --------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def trash_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders go to the trash and come back with all their fields."""
    live = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "o_totalprice AS price")
    left, trash = mutations.to_trash(live, live.where("status = 'F'"), "order", F.lit("2024-01-24"))
    return mutations.from_trash(trash, left, "order")


@query("SELECT o_orderkey AS item_id, 'order' AS type, '2024-01-24' AS deleted_at FROM orders WHERE o_orderstatus = 'F'")
def trash_rows(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status")
    return mutations.to_trash(live, live.where("status = 'F'"), "order", F.lit("2024-01-24"))[1].drop("payload")


@query("SELECT o_orderkey AS id, o_custkey AS project_id FROM orders")
def restored_orders(spark: SparkSession, d: str) -> DataFrame:
    """What a deleted customer took along is put back twice; the second time nothing is added."""
    o = {"orders": table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey AS project_id")}
    left, bundle = mutations.split_cascade(o, table(spark, d, "customer").where("c_nationkey = 5").selectExpr("c_custkey AS project_id"))
    return mutations.restore_cascade(mutations.restore_cascade(left, bundle), bundle)["orders"]


@query("SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 10 <> 3 THEN l_partkey END AS yarn_id, l_extendedprice AS price FROM lineitem")
def orphaned_lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_partkey AS yarn_id", "l_extendedprice AS price")
    return mutations.orphan(li, table(spark, d, "part").where("p_partkey % 10 = 3").selectExpr("p_partkey AS id")).select("id", "yarn_id", "price")


@query("SELECT l_orderkey AS project_id, l_partkey AS yarn_id, l_quantity AS quantity, least(l_quantity, coalesce(p_size, 0)) AS granted, l_quantity - least(l_quantity, coalesce(p_size, 0)) AS short FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 20")
def relinked_reservations(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "lineitem").selectExpr("l_orderkey AS project_id", "l_partkey AS yarn_id", "l_quantity AS quantity")
    return mutations.relink_reservations(wanted, table(spark, d, "part").where("p_size > 20").selectExpr("p_partkey AS yarn_id", "CAST(p_size AS DOUBLE) AS available"))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT -1, 'added'")
def settings_changed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").selectExpr("c_custkey AS key", "c_mktsegment AS value")
    changes = c.where("key % 3 = 0").withColumn("value", F.lit("new")).unionByName(spark.createDataFrame([(-1, "added")], "key long, value string"))
    return mutations.set_settings(c, changes)


@query("SELECT c_mktsegment AS value FROM customer WHERE c_custkey = 7")
def setting_value(spark: SparkSession, d: str) -> DataFrame:
    return mutations.get_setting(table(spark, d, "customer").selectExpr("c_custkey AS key", "c_mktsegment AS value"), 7)


@query("SELECT s_suppkey AS id FROM supplier UNION SELECT c_custkey FROM customer WHERE c_nationkey < 12")
def kept_ids(spark: SparkSession, d: str) -> DataFrame:
    return mutations.snapshot_ids(table(spark, d, "supplier").selectExpr("s_suppkey AS id"), table(spark, d, "customer").where("c_nationkey < 12").selectExpr("c_custkey AS id"))


@query("SELECT c_custkey AS pos, CASE WHEN c_custkey % 4 IN (0, 2) THEN '' ELSE 'bad_id' END AS code FROM customer")
def valid_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").selectExpr("c_custkey AS pos", "CASE c_custkey % 4 WHEN 0 THEN '12' WHEN 1 THEN '1.5' WHEN 2 THEN '7.0' END AS id")
    good, bad = mutations.valid_rows(c)
    return good.select("pos", F.lit("").alias("code")).unionByName(bad.select("pos", "code"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 1")
def changed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every third is as last seen, every third was changed, every third was never seen."""
    c = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS content")
    seen = c.where("id % 3 > 0").select("id", F.xxhash64(F.when(F.col("id") % 3 == 1, F.col("content")).otherwise("old")).alias("hash"))
    return mutations.changed_entries(c, seen).select("id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN 'note' ELSE c_mktsegment END AS notes, c_acctbal AS price FROM customer")
def merged_fields(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS notes", "c_acctbal AS price")
    ext = live.where("id % 2 = 0").select("id", F.lit("new").alias("name"), F.when(F.col("id") % 4 == 0, " note ").otherwise(" ").alias("notes"))
    return mutations.merge_fields(live, ext, ["name"], ["notes"])


@query("SELECT c_custkey + 100000 AS id, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE c_custkey END AS source_pattern_id, CAST(NULL AS VARCHAR) AS price, c_name AS name FROM customer WHERE c_nationkey = 4")
def forked_patterns(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 2 = 0 THEN 1L END AS source_pattern_id", "CAST(c_acctbal AS STRING) AS price", "c_name AS name")
    return mutations.fork(p, table(spark, d, "customer").where("c_nationkey = 4").selectExpr("c_custkey AS source_id", "c_custkey + 100000 AS id"))


@query("SELECT l_orderkey AS project_id, CAST(l_linenumber AS BIGINT) AS position, 'old' AS kind FROM lineitem WHERE l_orderkey % 2 = 1 UNION ALL SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1, 'new' FROM lineitem WHERE l_orderkey % 2 = 0 AND l_linenumber > 1")
def replaced_sections(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").selectExpr("l_orderkey AS project_id", "CAST(l_linenumber AS BIGINT) AS position")
    old = li.withColumn("kind", F.lit("old")).where("project_id % 2 = 1 OR project_id IN (2, 4, 6)").where("project_id % 2 = 1 OR position < 3")
    fresh = li.where("project_id % 2 = 0 AND position > 1").withColumn("kind", F.lit("new"))
    whole = li.where("project_id % 2 = 0").select("project_id").distinct()
    lonely = whole.join(fresh.select("project_id").distinct(), "project_id", "left_anti")
    return mutations.replace_children(old.join(lonely, "project_id", "left_anti"), fresh)


@query("SELECT o_orderkey AS id, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS sections FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_projects(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").selectExpr("l_orderkey AS project_id", "CAST(l_linenumber AS BIGINT) AS id", "l_quantity AS rows")
    out = mutations.nested(table(spark, d, "orders").selectExpr("o_orderkey AS id"), sections=li)
    return out.select("id", F.array_join(F.transform("sections", lambda s: s["id"].cast("string")), ",").alias("sections")).withColumn("sections", F.nullif("sections", F.lit("")))


_SYNC = "CASE WHEN c_custkey % 7 = 0 THEN 'orphan' WHEN c_custkey % 7 = 1 THEN 'aligned' WHEN c_custkey % 7 = 2 THEN 'healed' WHEN c_custkey % 7 IN (3, 4, 5) THEN 'vetoed' ELSE 'merged' END"


@query(f"SELECT c_custkey AS id, {_SYNC} AS action, CASE c_custkey % 7 WHEN 3 THEN 'no_sections' WHEN 4 THEN 'fewer_steps' WHEN 5 THEN 'too_many_warnings' END AS reason, CASE WHEN c_custkey % 7 IN (1, 2, 6) THEN 'now' WHEN c_custkey % 7 > 0 THEN 'old' END AS sync_hash FROM customer")
def sync_actions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_custkey % 7 AS k")
    ext = c.selectExpr("id", "'now' AS content_hash", "IF(k = 2, 'now', 'disk') AS disk_hash", "IF(k = 3, 0, 3) AS sections", "IF(k = 4, 4, 9) AS steps", "IF(k = 5, 11, 10) AS warnings")
    live = c.where("k > 0").selectExpr("id", "IF(k = 1, 'now', 'old') AS sync_hash", "6 AS live_sections", "9 AS live_steps")
    return mutations.sync_documents(ext, live)


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'made' END AS reader, coalesce(CASE WHEN p_size % 3 = 0 THEN 'x.pdf' END, '') AS pdf, p_size % 2 > 0 OR p_size % 3 > 0 AS changed FROM part")
def readers_backfilled(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey AS id", "IF(p_size % 2 = 0, p_name, NULL) AS reader", "IF(p_size % 3 = 0, 'x.pdf', NULL) AS pdf", "array('a') AS gallery", "1 AS cover_index")
    return mutations.backfill_readers(p, F.lit("made")).select("id", "reader", "pdf", "changed")


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'data:xyz' WHEN 1 THEN 'a/' || (p_partkey % 20) || '.png' WHEN 2 THEN 'b/' || (p_partkey % 20) || '.png' END AS resolved, p_size % 4 = 3 AS missing FROM part")
def archive_references(spark: SparkSession, d: str) -> DataFrame:
    """Inline, by path, by name (the last folder of that name), and missing."""
    p = table(spark, d, "part").selectExpr("p_partkey AS id", "CASE p_size % 4 WHEN 0 THEN 'data:xyz' WHEN 1 THEN concat('a/', p_partkey % 20, '.png') WHEN 2 THEN concat('x/y/', p_partkey % 20, '.png') ELSE concat(p_partkey, '.gif') END AS ref")
    files = spark.range(20).select(F.explode(F.array(*(F.concat(F.lit(f), F.col("id").cast("string"), F.lit(".png")) for f in ("a/", "b/")))).alias("path"))
    return mutations.resolve_references(p, files).select("id", "resolved", "missing")


@query("SELECT CAST(p_size AS BIGINT) AS id, arg_min(p_name || ' [' || p_size || '] ', p_partkey) AS name FROM part WHERE p_partkey % 3 > 0 GROUP BY 1")
def folder_index(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("IF(p_partkey % 3 = 1, concat(p_name, ' [', p_size, '] '), concat(p_name, ' [', p_size, '] ')) AS name", "p_partkey AS pos", "p_partkey % 3 > 0 AS is_dir")
    return mutations.name_index(p)


# numbers, keys, days --------------------------------------------------------------------------------------------------


def _amount(x: str) -> str:
    """The SQL of a rounded amount as text: no decimals for whole ones."""
    r = R2.format(x)
    return f"CASE WHEN {r} = floor({r}) THEN CAST(CAST({r} AS BIGINT) AS VARCHAR) ELSE printf('%.2f', {r}) END"


_METRES, _OUNCES = "l_extendedprice / 7", "l_extendedprice / 9 / 28.349523125"


@query(f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber < 7 AS readable, CAST(CAST(l_quantity AS INT) AS VARCHAR) || ',53' AS kept, CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE replace(CAST(l_tax AS VARCHAR), '.', ',') END AS marked,
    CASE WHEN floor({_METRES} + 0.5) >= 1000 THEN {_amount(f'({_METRES}) / 1000')} || ' km' ELSE CAST(CAST(floor({_METRES} + 0.5) AS BIGINT) AS VARCHAR) || ' m' END AS metres,
    CAST(CAST(floor({_METRES} / 0.9144 + 0.5) AS BIGINT) AS VARCHAR) || ' yd' AS yards,
    CASE WHEN floor(l_extendedprice / 9 + 0.5) >= 1000 THEN {_amount('l_extendedprice / 9 / 1000')} || ' kg' ELSE CAST(CAST(floor(l_extendedprice / 9 + 0.5) AS BIGINT) AS VARCHAR) || ' g' END AS grams,
    CASE WHEN {_OUNCES} >= 16 THEN {_amount(f'({_OUNCES}) / 16')} || ' lb' ELSE {_amount(_OUNCES)} || ' oz' END AS ounces,
    CASE WHEN l_linenumber < 7 THEN l_tax * 0.9144 END AS canonical, floor(l_quantity * 1.5 / 28.349523125 * 1000 + 0.5) / 1000 AS shown FROM lineitem""")
def number_texts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("typed", F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_tax").cast("string")))
    metres, grams = F.col("l_extendedprice") / 7, F.col("l_extendedprice") / 9
    return li.select(
        "id", numbers.is_readable(F.col("typed")).alias("readable"), numbers.keep_decimal_characters(F.concat(F.lit("~"), F.col("l_quantity").cast("int").cast("string"), F.lit(" ,5x.3"))).alias("kept"),
        numbers.with_decimal_mark(F.col("typed")).alias("marked"), numbers.length_text(metres).alias("metres"), numbers.length_text(metres, "imperial").alias("yards"), numbers.weight_text(grams).alias("grams"),
        numbers.weight_text(grams, "imperial").alias("ounces"), numbers.to_canonical(F.replace("typed", F.lit("."), F.lit(",")), "length", "imperial").alias("canonical"), numbers.from_canonical(F.col("l_quantity") * 1.5, "weight", "imperial").alias("shown"),
    )


@query("SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_quantity >= l_linenumber THEN CAST(floor(l_quantity / l_linenumber) AS BIGINT) END AS every, CASE WHEN l_quantity >= l_linenumber THEN CAST(l_quantity AS BIGINT) % l_linenumber END AS longer, CASE WHEN l_quantity < l_linenumber THEN CAST(ceil(l_linenumber / l_quantity) AS BIGINT) END AS at_once FROM lineitem")
def shaping_rows(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), numbers.spread_over_rows(F.col("l_linenumber"), F.col("l_quantity").cast("long")).alias("s")).select("id", "s.every", "s.longer", "s.at_once")


@query("SELECT p_partkey AS id, sha256(p_name)[1:8] AS content, CAST(CASE WHEN p_size % 2 = 0 THEN p_size END AS BIGINT) AS folder, CASE WHEN p_size % 3 = 0 THEN 'superbulky' WHEN p_size % 3 = 1 THEN 'dk' END AS weight, CASE WHEN p_size % 2 = 0 THEN 'Brand Ä' ELSE 'other' END AS brand, 'ßß' AS eszett, length(p_name) AS bytes FROM part")
def content_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k, even = F.col("p_size") % 3, F.col("p_size") % 2 == 0
    weight = F.when(k == 0, "Super  Bulky (5)").when(k == 1, "DK / 8 ply").otherwise("thread")
    return p.select(
        F.col("p_partkey").alias("id"), text.content_id(F.col("p_name")).alias("content"), text.trailing_id(F.when(even, F.concat("p_name", F.lit(" ["), F.col("p_size").cast("string"), F.lit("] "))).otherwise(F.col("p_name"))).alias("folder"),
        text.first_keyword(F.regexp_replace(weight, " +", " "), catalogues.WEIGHT_KEYWORDS).alias("weight"), text.canonical_name(F.when(even, " bRAND ä ").otherwise("other"), ["Brand Ä", "Third"]).alias("brand"),
        text.fold_eszett(F.lit("ẞß")).alias("eszett"), numbers.base64_bytes(F.base64(F.col("p_name").cast("binary"))).cast("long").alias("bytes"),
    )


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice * 100 AS BIGINT) / 100.0 END AS number, replace(replace(o_orderpriority, ' ', '|'), '-', '|') AS lines,
    'k' || day(o_orderdate) || ', p' || year(o_orderdate) AS filled FROM orders""")
def typed_cells(spark: SparkSession, d: str) -> DataFrame:
    """Prices of orders as typed, thousands apart and with a comma; those of open ones with a second comma are no numbers."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    cell = F.concat_ws("", F.floor(cents / 100_000).cast("string"), F.lit(" "), F.lpad((F.floor(cents / 100) % 1000).cast("string"), 3, "0"), F.when(F.col("o_orderstatus") == "P", ",,").otherwise(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    counts = F.array(F.array(F.lit("0"), F.dayofmonth("o_orderdate").cast("string")), F.array(F.lit("1"), F.year("o_orderdate").cast("string")))
    said = F.regexp_replace("o_orderpriority", "[ -]", "\n \n")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), numbers.to_number(cell).alias("number"), F.array_join(text.lines(said), "|").alias("lines"), text.expand_counts(F.lit("k{{0}}, p{{1}}"), counts, F.lit(1)).alias("filled"))


@query(f"""SELECT event_id AS id, CAST(ts AS DATE) + 3 AS later, strftime(ts, '%Y-%m-%d') || ' 12:00:00' AS noon, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN 'someday' ELSE '' END AS shown,
    CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END AS imported, 'Mon|Tue|Wed|Thu|Fri|Sat|Sun' AS names FROM events WHERE {REF} IS NOT NULL""")
def day_texts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    day, k = F.date_format("ts", "yyyy-MM-dd"), F.col("event_id") % 4
    raw = F.when(k == 0, day).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, "someday")
    cell = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), day, F.lit("T10:00"))).otherwise(F.concat(F.lit("x"), day))
    return e.select(
        F.col("event_id").alias("id"), dates.shift_day(F.to_date("ts"), 3).alias("later"), F.date_format(dates.local_noon(day), "yyyy-MM-dd HH:mm:ss").alias("noon"), dates.shown_day(raw).alias("shown"),
        dates.import_date(cell).alias("imported"), F.array_join(dates.weekday_names(1, long=False), "|").alias("names"),
    )


@query("""WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 2 WHEN 0 THEN 'done' ELSE 'wip' END AS b, CASE c_custkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'wip' END AS n, CASE c_custkey % 5 WHEN 0 THEN '2024-01-02' ELSE '' END AS old, CASE c_custkey % 7 WHEN 0 THEN '2024-01-02' WHEN 1 THEN '2024-01-09' END AS new FROM customer)
    SELECT id, CASE WHEN new IS NOT NULL THEN new WHEN n = 'done' AND b <> 'done' AND old = '' THEN '2024-01-24' ELSE old END AS finished, CASE WHEN old = '' THEN '2024-01-24' ELSE old END AS started,
    coalesce(new, '') <> '' AND coalesce(new, '') <> old AND NOT coalesce(n <> b, FALSE) AND coalesce(n, b) <> 'done' AS derived FROM c""")
def status_dates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").selectExpr(
        "c_custkey AS id", "IF(c_custkey % 2 = 0, 'done', 'wip') AS b", "CASE c_custkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'wip' END AS n", "IF(c_custkey % 5 = 0, '2024-01-02', '') AS old", "CASE c_custkey % 7 WHEN 0 THEN '2024-01-02' WHEN 1 THEN '2024-01-09' END AS new"
    )
    today = F.lit("2024-01-24")
    return c.select(
        "id", dates.finished_at(F.col("b"), F.col("n"), F.col("old"), F.col("new"), today).alias("finished"), dates.started_at(F.col("old"), today).alias("started"), dates.derives_done(F.col("b"), F.col("old"), F.col("n"), F.col("new")).alias("derived")
    )


# fibres, cables, swatches ---------------------------------------------------------------------------------------------

_FIBRE = "CASE p_size % 6 WHEN 0 THEN array('Mérinos wool ', 'cotton') WHEN 1 THEN array('70% Alpaga / 30% nylon') WHEN 2 THEN array('Unobtainium', 'wool') WHEN 3 THEN array('Bamboo', 'LINEN') WHEN 4 THEN array(' ', '100%') ELSE array('mohair', 'mohair') END"


@query("SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'mixed' WHEN 1 THEN 'mixed' WHEN 2 THEN 'incomplete' WHEN 3 THEN 'plant' WHEN 5 THEN 'animal' END AS origin, CASE p_size % 6 WHEN 0 THEN 'Mérinos wool' WHEN 1 THEN '70% Alpaga / 30% nylon' WHEN 2 THEN 'wool' WHEN 5 THEN 'mohair' ELSE '' END AS animal, 'vegan|gots' AS labels, 'gots|vegan' AS kept, CASE p_size % 6 WHEN 0 THEN 2 WHEN 3 THEN 2 WHEN 2 THEN 2 WHEN 4 THEN 1 ELSE 1 END AS entries FROM part")
def fibre_origins(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_FIBRE).alias("c"))
    marks = F.array(F.lit(" GOTS"), F.lit("vegan"), F.lit("gots"), F.lit("home made"))
    return p.select("id", fibres.origin_key(F.col("c")).alias("origin"), _text(fibres.animal_entries(F.col("c"))).alias("animal"), _text(fibres.ordered_labels(marks)).alias("labels"), _text(fibres.labels(marks)).alias("kept"), F.size(text.distinct_trimmed(F.col("c"))).alias("entries"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN '80.0 s' WHEN 1 THEN '60.0 ?' END AS cable, CASE WHEN p_size > 10 THEN 'wool=' || p_size ELSE '' END AS percents, p_size % 4 AS swatches FROM part")
def sanitized_lists(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    raw = F.when(F.col("p_size") % 3 == 0, "80|s").when(F.col("p_size") % 3 == 1, "60|x").otherwise("long|s")
    c = fibres.cable(raw)
    percents = fibres.percentages(F.create_map(F.lit("wool"), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")), F.lit(" "), F.lit(1.0), F.lit("silk"), F.lit(float("nan"))))
    swatch = lambda ok: F.struct(F.when(ok, 20.0).alias("stitches"), F.lit(None).cast("double").alias("rows"))
    listed = F.array(*(swatch(F.col("p_size") % 4 > i) for i in range(3)), swatch(F.lit(False)))
    entries = F.transform(F.map_entries(percents), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string")))
    return p.select(F.col("p_partkey").alias("id"), F.when(c.isNotNull(), F.concat(c["cm"].cast("string"), F.lit(" "), F.coalesce(c["join"], F.lit("?")))).alias("cable"), F.array_join(entries, "|").alias("percents"), F.size(fibres.swatches(listed)).alias("swatches"))


# progress -------------------------------------------------------------------------------------------------------------

_STEP = "l_orderkey AS doc, CAST(l_linenumber AS INT) AS pos, l_linenumber = 2 AS note, l_returnflag = 'R' AS is_repeat, CAST(l_quantity AS INT) AS counter, 30 AS repeat_total, l_returnflag = 'A' AS marked"
_DONE = "s AS (SELECT *, CASE WHEN is_repeat THEN counter >= 30 ELSE marked END AS done FROM (SELECT " + _STEP + " FROM lineitem))"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*_STEP.split(", "))


@query(f"WITH {_DONE} SELECT doc, count_if(done) AS done, count(*) AS total FROM s WHERE NOT note GROUP BY 1")
def reader_progress_docs(spark: SparkSession, d: str) -> DataFrame:
    return progress.reader_progress(_steps(spark, d))


@query(f"WITH {_DONE} SELECT doc, CAST(coalesce(min(CASE WHEN pos >= CASE WHEN doc % 2 = 0 THEN 3 END THEN pos END), min(pos)) AS INT) AS pos FROM s WHERE NOT note AND NOT done GROUP BY 1")
def current_steps(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS doc", "3 AS pos")
    return progress.current_step(_steps(spark, d), last)


@query("SELECT o_orderkey AS doc, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3) THEN 3 END AS pos FROM orders")
def last_places(spark: SparkSession, d: str) -> DataFrame:
    return progress.last_place(table(spark, d, "orders").selectExpr("o_orderkey AS doc", "3 AS pos"), _steps(spark, d))


@query("WITH s AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS INT) AS pos, bool_or(l_returnflag = 'R') AS chart, bool_or(l_linestatus = 'O') AS visible, bool_or(l_partkey % 3 = 0) AS tracked FROM lineitem GROUP BY 1, 2) SELECT doc, pos, (SELECT max(c.pos) FROM s c WHERE c.doc = s.doc AND c.pos < s.pos AND c.chart AND c.visible AND c.pos > coalesce((SELECT max(t.pos) FROM s t WHERE t.doc = s.doc AND t.pos < s.pos AND t.tracked), 0)) AS chart FROM s")
def charts_before(spark: SparkSession, d: str) -> DataFrame:
    """The chart itself is not a tracked step here."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("pos")).agg(F.expr("bool_or(l_returnflag = 'R') AS is_chart"), F.expr("bool_or(l_linestatus = 'O') AS visible"), F.expr("bool_or(l_partkey % 3 = 0) AS tracked"))
    return progress.chart_before(s)


@query("SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'A' OR (l_quantity > 9 AND l_discount * 400 >= l_quantity) THEN 'done' WHEN l_linenumber = 2 THEN 'wip' WHEN l_discount > 0 THEN 'started' ELSE 'todo' END AS state, CASE WHEN l_linenumber = 1 THEN 'own' WHEN l_linenumber = 2 THEN 'common' ELSE '' END AS instructions FROM lineitem")
def section_states(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS id", "l_orderkey * 10 + 2 AS active", "IF(l_quantity > 9, l_quantity, 0) AS rows_total", "l_discount * 400 AS rows_done", "l_returnflag = 'A' AS marked_done",
        "IF(l_linenumber = 1, map('M', 'own'), map('L', 'x')) AS by_size", "IF(l_linenumber < 3, 'common', NULL) AS instructions",
    )
    return li.select("id", progress.section_state(F.col("active")).alias("state"), progress.section_instructions(F.lit("M")).alias("instructions"))


@query("SELECT coalesce(s.id, r.id) AS project_id, CASE WHEN s.total > 0 THEN s.done ELSE r.done END AS done, CASE WHEN s.total > 0 THEN s.total ELSE r.total END AS total FROM (SELECT c_custkey AS id, CAST(c_custkey % 5 AS BIGINT) AS done, CAST(c_custkey % 3 AS BIGINT) AS total FROM customer WHERE c_custkey % 2 = 0) s FULL JOIN (SELECT c_custkey AS id, CAST(7 AS BIGINT) AS done, CAST(9 AS BIGINT) AS total FROM customer WHERE c_custkey % 3 = 0) r ON r.id = s.id")
def combined_progress(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    sections = c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS project_id", "c_custkey % 5 AS done", "c_custkey % 3 AS total")
    return progress.combined_progress(sections, c.where("c_custkey % 3 = 0").selectExpr("c_custkey AS project_id", "7L AS done", "9L AS total"))


# activity -------------------------------------------------------------------------------------------------------------


@query(sql("SELECT DISTINCT d AS day FROM active_days WHERE d NOT IN (SELECT d FROM sessions WHERE project_id = 3)", "sessions", "active_days"))
def unexplained_days(spark: SparkSession, d: str) -> DataFrame:
    some = activity.by_day(S.sessions(spark, d).where("project_id = 3"), REF_DAY.year + 1)
    return activity.unexplained_days(activity.day_set(S.active_days(spark, d)), some)


@query(sql("SELECT d AS day, CAST(total_sec AS BIGINT) AS total_sec FROM by_day WHERE date_trunc('week', d) IN (SELECT DISTINCT date_trunc('week', d) FROM by_day ORDER BY 1 DESC LIMIT 2)", "sessions", "by_day"))
def recent_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Days of the last two weeks that have sessions, with their seconds."""
    days = activity.by_day(S.sessions(spark, d), REF_DAY.year + 1)
    return activity.recent_weeks(days.withColumn("week", F.date_trunc("week", "day")), 2).select("day", F.col("total_sec").cast("long").alias("total_sec"))


@query(sql("SELECT id FROM projects WHERE status = 'wip' ORDER BY name DESC LIMIT 1", "projects"))
def last_project(spark: SparkSession, d: str) -> DataFrame:
    return activity.last_project(S.projects(spark, d).selectExpr("id", "status", "name AS last_worked_at", "'' AS updated_at")).select("id")


@query(sql("SELECT (SELECT count(*) > 0 FROM sessions WHERE duration_sec > 86400) OR (SELECT count(*) > 0 FROM active_days WHERE d > DATE '2024-01-29') AS any", "sessions", "active_days"))
def has_activity(spark: SparkSession, d: str) -> DataFrame:
    """Whether there is a session of over a day, or an active day at the very end."""
    return activity.has_any(S.sessions(spark, d).where("duration_sec > 86400"), S.active_days(spark, d).where("day > DATE '2024-01-29'"))


@query("SELECT event_id AS id, CASE WHEN value * 60 - event_id % 5 >= 1 THEN CAST(floor(value * 60 - event_id % 5) AS BIGINT) END AS chunk FROM events")
def chunks_to_commit(spark: SparkSession, d: str) -> DataFrame:
    from loomspan.operators.sessionize import chunk_to_commit

    return table(spark, d, "events").select(F.col("event_id").alias("id"), chunk_to_commit(F.col("value") * 60, F.col("event_id") % 5).alias("chunk"))


# sources and sheets ---------------------------------------------------------------------------------------------------


@query("SELECT event_id AS id, value FROM events WHERE user_id = 7")
def seek_sessions(spark: SparkSession, d: str) -> DataFrame:
    from loomspan.sources.tables import seek

    return seek(table(spark, d, "events"), "user_id", 7).select(F.col("event_id").alias("id"), "value")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'crochet' ELSE 'knitting' END AS technique, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS tools FROM part")
def project_defaults(spark: SparkSession, d: str) -> DataFrame:
    from loomspan.sources.tables import with_defaults

    p = table(spark, d, "part").selectExpr("p_partkey AS id", "IF(p_size % 2 = 0, 'crochet', NULL) AS technique", "IF(p_size % 3 = 0, array(1L), NULL) AS tool_ids")
    return with_defaults(p, "projects").select("id", "technique", F.size("tool_ids").alias("tools"))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'model' WHEN 1 THEN 'grams' WHEN 2 THEN '' END AS field FROM part")
def header_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey AS id", "CASE p_size % 4 WHEN 0 THEN ' Yarn' WHEN 1 THEN 'GRAMS/Skein' WHEN 2 THEN 'total__yards' ELSE 'Mood' END AS header")
    return imports.header_rows(p).select("id", "field")


@query(f"SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS skeins, {R2.format('p_retailprice / p_size')} AS unit_price, {R2.format('p_size * 10 * 0.9144')} AS length_m, 'aran' AS weight_class, DATE '2024-02-03' AS bought_on, 'Blue' AS color FROM part")
def sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr(
        "p_partkey AS id", "CAST(p_size AS STRING) AS quantity", "replace(CAST(p_retailprice AS STRING), '.', ',') AS total_price", "CAST(p_size * 10 AS STRING) AS yards", "'' AS metres", "'50' AS grams",
        "' ' AS color", "'Blue' AS color_family", "'Aran (8 wpi)' AS weight", "'2024-02-03' AS date",
    )
    return imports.map_rows(p).select("id", "skeins", "unit_price", "length_m", "weight_class", "bought_on", "color")


# exports --------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, CAST(p_size * 20 - 20 AS VARCHAR) AS quantity, CAST(p_size AS VARCHAR) || ',50' AS length, 'wool / silk' AS composition, CASE WHEN p_size % 2 = 0 THEN 'L1' ELSE '' END AS lots, CASE WHEN p_size % 2 = 0 THEN '2024-01-01' ELSE '' END AS last_date FROM part")
def yarn_export_rows(spark: SparkSession, d: str) -> DataFrame:
    y = S.yarns(spark, d).withColumn("length_m", F.concat("grams", F.lit(",5"))).withColumn("composition", F.array(F.lit("wool"), F.lit("silk")))
    totals = table(spark, d, "part").where("p_size % 2 = 0").selectExpr("p_partkey AS yarn_id", "'L1' AS lots", "'2024-01-01' AS last_date")
    return exports.yarn_export(y, totals).select("id", "quantity", "length", "composition", "lots", "last_date")


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN '4.0 mm / 4.5 mm' ELSE '' END AS needles, 'M / L' AS sizes, c_custkey % 5 AS stars FROM customer")
def project_export_rows(spark: SparkSession, d: str) -> DataFrame:
    needle = lambda mm: F.struct(F.lit(mm).alias("mm"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("").alias("technique"), F.lit("").alias("status"), F.lit("").alias("started_at"), F.lit("").alias("finished_at"), F.when(F.col("c_custkey") % 2 == 0, F.array(needle(4.0), needle(4.5))).otherwise(F.array().cast("array<struct<mm:double>>")).alias("needles"), F.array(F.lit("M"), F.lit("L")).alias("sizes"), (F.col("c_custkey") % 5).alias("stars"))
    return exports.project_export(c).select("id", "name", "needles", "sizes", "stars")


@query("SELECT p_partkey AS id, p_name AS name, p_size % 3 AS sections FROM part")
def pattern_export_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("").alias("category"), F.lit("").alias("author"), F.slice(F.array(F.lit("a"), F.lit("b")), 1, F.col("p_size") % 3).alias("sections"), F.lit("").alias("price"), F.lit("").alias("currency"))
    return exports.pattern_export(p).select("id", "name", "sections")


# documents ------------------------------------------------------------------------------------------------------------

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')"


@query(f"SELECT doc_id, len(w) >= 6 AND len(list_filter(w, lambda x: length(x) = 1)) >= len(w) * 0.7 AS spaced, n_plain < 60 AND n_number >= 40 AND n_number >= n_plain * 2 AS tabular FROM (SELECT doc_id, w, len(list_filter(w, lambda x: regexp_matches(x, '^\\pL{{3,}}[.,:;!?)]*$'))) AS n_plain, len(list_filter(w, lambda x: regexp_matches(x, '^\\(?[0-9¼½¾.,/%-]+\\)?$'))) AS n_number FROM (SELECT doc_id, {_WORDS} AS w FROM documents))")
def page_genres(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", documents.is_spaced(t).alias("spaced"), documents.is_tabular(t).alias("tabular"))


#: French texts with blanks between all their letters, so that some documents are letter-spaced.
_GATED = r"""d AS (SELECT doc_id, source = 'src0' AS several, CASE WHEN lang = 'fr' THEN regexp_replace(coalesce(text, ''), '([^ \n])', '\1 ', 'g') ELSE coalesce(text, '') END AS t FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS w FROM d),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM d),
    p AS (SELECT doc_id, n, line, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS w FROM l),
    a AS (SELECT doc_id, sum(length(line)) AS size, coalesce(sum(length(line)) FILTER (len(w) >= 6 AND len(list_filter(w, lambda x: length(x) = 1)) >= 0.7 * len(w)), 0) AS apart,
            coalesce(string_agg(array_to_string(w, ''), chr(10) ORDER BY n) FILTER (len(w) >= 6 AND len(list_filter(w, lambda x: length(x) = 1)) >= 0.7 * len(w)), '') AS letters FROM p GROUP BY doc_id),
    g AS (SELECT *, len(w) >= 6 AND len(list_filter(w, lambda x: length(x) = 1)) >= len(w) * 0.7 AS spaced,
            len(list_filter(w, lambda x: regexp_matches(x, '^\pL{3,}[.,:;!?)]*$'))) AS n_plain, len(list_filter(w, lambda x: regexp_matches(x, '^\(?[0-9¼½¾.,/%-]+\)?$'))) AS n_number,
            2.0 * contains(t, 'the')::INT + 1.0 * contains(t, 'tion')::INT AS score, 2.0 * regexp_matches(lower(t), 'licen[sc]e')::INT + 1.0 * contains(t, '@')::INT AS contra FROM w),
    v AS (SELECT *, CASE WHEN spaced THEN NULL WHEN n_plain < 60 AND n_number >= 40 AND n_number >= n_plain * 2 AND contra = 0 THEN NULL WHEN contra > 0 AND contra >= score + 1 THEN 'other'
            WHEN score < 2 THEN CASE WHEN contra > 0 THEN 'other' ELSE 'no_markers' END END AS reason FROM g JOIN a USING (doc_id))"""


@query(f"""WITH {_GATED} SELECT doc_id AS id, reason, size > 0 AND apart >= 300 AND apart >= size * 0.6 AND regexp_matches(letters, '(?i)tion') AS illegible, CASE WHEN reason IS NOT NULL THEN 'not_pattern' WHEN several THEN 'several' ELSE '' END AS rejected,
    concat_ws('|', CASE WHEN reason IS NOT NULL THEN 'not_pattern' END, CASE WHEN several THEN 'several' END) AS reasons FROM v""")
def genre_gates(spark: SparkSession, d: str) -> DataFrame:
    """Documents that speak of licences or addresses are of another genre than those that say "the" or "-tion"."""
    apart = F.when(F.col("lang") == "fr", F.regexp_replace(F.coalesce("text", F.lit("")), r"([^ \n])", "$1 ")).otherwise(F.coalesce("text", F.lit("")))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), apart.alias("text"), (F.col("source") == "src0").alias("several"))
    gated = documents.genre(docs, [("the", "the", 2.0), ("tion", "tion", 1.0)], [("licence", "(?i)licen[sc]e", 2.0), ("mail", "@", 1.0)], 2.0, 1.0)
    out = documents.rejection(gated.withColumn("scanned", F.lit(False)).withColumn("several", F.coalesce("several", F.lit(False))))
    return out.select("id", "reason", documents.illegible(F.col("text"), "tion").alias("illegible"), F.coalesce("rejected", F.lit("")).alias("rejected"), _text(F.col("reasons")).alias("reasons"))


_EDGE = """e AS (SELECT *, line_no < greatest(floor((last_no + 1) * 0.12), 1) OR line_no > last_no - greatest(floor((last_no + 1) * 0.12), 1) AS edge, CASE WHEN length(text) <= 4000 THEN trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) END AS key
        FROM (SELECT *, max(line_no) OVER (PARTITION BY doc, page) AS last_no FROM l)),
    r AS (SELECT doc, key FROM e WHERE edge AND key IS NOT NULL GROUP BY doc, key HAVING count(DISTINCT page) >= greatest(2, ceil((SELECT count(DISTINCT page) FROM l x WHERE x.doc = e.doc) / 2.0)))"""
_NOTES = "l AS (SELECT l_orderkey AS doc, l_suppkey % 3 AS page, CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey) - 1 AS INT) AS line_no, CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey) = 1 AND l_orderkey % 2 = 0 THEN 'Page ' || (l_suppkey % 3) || ' of  3' ELSE 'line ' || l_returnflag || ' ' || l_linestatus END AS text FROM lineitem)"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders on three pages; pages of even orders start with the same heading but for its number.  An order has few lines, so
    they are dealt by orders."""
    li = table(spark, d, "lineitem")
    cells = li.selectExpr("l_orderkey AS doc", "l_suppkey % 3 AS page", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey", "l_returnflag", "l_linestatus")
    at = F.row_number().over(Window.partitionBy("doc", "page").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey"))
    text = "IF(at = 1 AND doc % 2 = 0, concat('Page ', page, ' of  3'), concat('line ', l_returnflag, ' ', l_linestatus)) AS text"
    return S.dealt(cells, li.count(), "doc").withColumn("at", at).selectExpr("doc", "page", "CAST(at - 1 AS INT) AS line_no", text)


@query(f"WITH {_NOTES}, {_EDGE} SELECT doc, page, line_no, text FROM e WHERE NOT edge OR key IS NULL OR (doc, key) NOT IN (SELECT doc, key FROM r)")
def stripped_lines(spark: SparkSession, d: str) -> DataFrame:
    return documents.strip_short(_notes(spark, d))


@query(f"WITH {_NOTES} SELECT doc, page, count_if(length(text) <= 8) > 0.5 * count(*) AS captions FROM l GROUP BY 1, 2 HAVING count_if(length(text) <= 8) > 0.5 * count(*)")
def caption_pages(spark: SparkSession, d: str) -> DataFrame:
    return documents.caption_pages(_notes(spark, d).withColumn("right", F.lit(True)), 8).withColumn("captions", F.lit(True))


@query(f"WITH {_NOTES} SELECT doc, count(DISTINCT page) FILTER (text LIKE 'line R%') AS pages FROM l GROUP BY 1")
def multi_columns(spark: SparkSession, d: str) -> DataFrame:
    return documents.multi_column_pages(_notes(spark, d).withColumn("multi", F.col("text").startswith("line R")))


@query(f"WITH {_NOTES} SELECT doc, CASE page WHEN 2 THEN 0 ELSE 1 END AS page, line_no FROM l WHERE page <> 1")
def chosen_pages(spark: SparkSession, d: str) -> DataFrame:
    return documents.page_subset(_notes(spark, d), [2, 0]).select("doc", "page", "line_no")


@query("WITH s AS (SELECT l_orderkey AS doc, l_partkey AS page, l_returnflag = 'R' AS title, CASE l_returnflag WHEN 'R' THEN 'Sleeve ' || l_linenumber ELSE 'text' END AS text FROM lineitem) SELECT doc, page, CAST(sum(CASE WHEN title THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section, CASE WHEN title THEN 'sleeve' ELSE 'none' END AS kind FROM s QUALIFY count(*) OVER (PARTITION BY doc, page) = 1")
def sections_cut(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc", "l_partkey AS page", "0 AS line_no", "IF(l_returnflag = 'R', concat('Sleeve ', l_linenumber), 'text') AS text")
    cut = documents.segment(li, F.col("text").startswith("Sleeve"))
    once = li.groupBy("doc", "page").count().where("count = 1").select("doc", "page")
    return cut.join(once, ["doc", "page"], "left_semi").select("doc", "page", "section", documents.title_kind(F.col("text"), [("^slee", "sleeve"), ("^body", "body")], "none").alias("kind"))


@query("""WITH c AS (SELECT p_partkey AS id, p_size % 5 AS k, p_size % 7 AS s, p_size % 11 AS w FROM part), d AS (SELECT id, CASE WHEN s > 0 THEN least(s, 3) / CAST(s AS DOUBLE) ELSE 0.0 END AS steps, k, w FROM c)
    SELECT id, CAST(floor(100 * (0.3 * (CASE WHEN k > 0 THEN 1.0 / k ELSE 0.0 END) + 0.3 * steps + 0.2 * 1.0 + 0.2 * greatest(0.0, 1 - w / 10.0)) + 0.5) AS INT) AS confidence, steps = 0 AS none FROM d""".replace("0.2 * 1.0", "0.2"))
def confidence_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey AS id", "p_size % 5 AS sections_total", "1 AS sections_known", "p_size % 7 AS total_lines", "least(p_size % 7, 3) AS structured_lines", "0 AS vectors_seen", "0 AS vectors_ok", "p_size % 11 AS warnings")
    scored = documents.confidence(p)
    return scored.select("id", "confidence", ((F.col("level") == "low") & (F.col("total_lines") == 0)).alias("none"))


@query(sql("""SELECT doc AS id, CASE WHEN contains(body, keys[mid + 1]) THEN list_max(list_filter(range(0, 9), lambda k: k <= mid AND contains(body, array_to_string(keys[mid - k + 1:mid + 1], ' ')))) ELSE -1 END::INT AS before
    FROM (SELECT *, array_to_string(keys[greatest(mid - 2, 0) + 1:mid + 2], ' ') AS body FROM (SELECT doc, list(lower(text) ORDER BY page, line_no) AS keys, count(*) // 2 AS mid FROM (SELECT page AS doc, 0 AS page, line_no, text FROM doc_lines) GROUP BY doc))""", "doc_lines"))
def continuity_counts(spark: SparkSession, d: str) -> DataFrame:
    """The middle line of every document and a step made of it, the two lines before and the one after."""
    lines = S.document_lines(spark, d).select(F.col("page").alias("id"), "line_no", F.lower("text").alias("t"))
    held = lines.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "t"))), lambda s: s["t"]).alias("keys")).withColumn("at", F.floor(F.size("keys") / 2).cast("int"))
    first = F.greatest(F.col("at") - 2, F.lit(0))
    body = F.array_join(F.slice("keys", first + 1, F.col("at") + 2 - first), " ")
    return held.withColumn("body", body).select("id", documents.continuity(F.col("keys"), F.col("at"), F.col("body")).cast("int").alias("before"))


@query(r"""WITH l AS (SELECT doc, line_no, text FROM (SELECT doc_id AS doc, n - 1 AS line_no, trim(body, ' ') AS text FROM (SELECT doc_id, unnest(string_split_regex(t, '\r?\n')) AS body, generate_subscripts(string_split_regex(t, '\r?\n'), 1) AS n
            FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '([^\n]{50,60}?)[ ]', '\1' || chr(10), 'g') AS t FROM documents))) WHERE text <> ''),
    b AS (SELECT *, lag(text) OVER (PARTITION BY doc ORDER BY line_no) AS before FROM l),
    f AS (SELECT *, before IS NOT NULL AND NOT regexp_matches(before, '[.!?:;]$') AND NOT regexp_matches(text, '^(\p{Lu}|[-*•]|[0-9]+[.)])') AND length(before) >= 30 AS goes_on FROM b),
    p AS (SELECT doc, line_no, text, sum((NOT coalesce(goes_on, FALSE))::INT) OVER (PARTITION BY doc ORDER BY line_no) AS paragraph FROM f)
    SELECT doc, CAST(paragraph AS BIGINT) AS paragraph, string_agg(text, ' ' ORDER BY line_no) AS text FROM p GROUP BY doc, paragraph""")
def reflowed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of documents that are set in lines of about 60 characters, by flags alone."""
    docs = table(spark, d, "documents").withColumn("text", F.regexp_replace("text", r"([^\n]{50,60}?)[ ]", "$1\n"))
    lines = documents.lines_of(docs, "doc_id", "doc_id", "text")
    return documents.reflow(lines).select("doc", "paragraph", "text")


@query(f"""WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, list_filter(list_transform(string_split(replace(coalesce(text, ''), ' ', chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS w FROM conversations),
    p AS (SELECT x.id, x.w AS a, y.w AS b FROM t x JOIN t y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1), {LCS}
    SELECT id, CASE WHEN la + lb = 0 THEN 1.0 ELSE floor(200000 * n / (la + lb) + 0.5) / 100000 END AS ratio, CAST(lb - n AS BIGINT) AS missing FROM n""")
def text_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation with the next, word by word."""
    t = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", F.replace("text", F.lit(" "), F.lit("\n")).alias("a"))
    pairs = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    return documents.similarity(pairs).select("id", "ratio", "missing")


# lines of instructions ------------------------------------------------------------------------------------------------

_LINE = "CASE p_size % 5 WHEN 0 THEN concat('Cast on ', p_size, ' (', p_size + 10, ', ', p_size + 20, ') sts') WHEN 1 THEN 'Row 1: knit' WHEN 2 THEN concat('repeat from * ', p_size, ' times') WHEN 3 THEN 'Note: 10/12/14 rows' ELSE 'k2tog = knit two together' END"


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'Cast on {{0}} sts' WHEN 3 THEN 'Note: {{0}} rows' ELSE '' END AS t, CASE p_size % 5 WHEN 0 THEN p_size || ' (' || (p_size + 10) || ', ' || (p_size + 20) || ')' WHEN 3 THEN '10 (12, 14)' ELSE '' END AS c, CASE p_size % 5 WHEN 1 THEN 'row' WHEN 2 THEN 'repeat' WHEN 3 THEN 'note' ELSE 'text' END AS type, CASE WHEN p_size % 5 = 2 THEN p_size END AS times, p_size % 5 = 1 AS row_start, p_size % 5 IN (1, 4) AS verb, CASE p_size % 5 WHEN 4 THEN 'k2tog' ELSE '' END AS abbreviation FROM part".replace("'{{0}} rows'", "'{{0}} rows'"))
def instruction_lines(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_LINE).alias("text"))
    out = steps.with_placeholders(p, 3)
    t, has = F.col("text"), F.size("c") > 0
    words = steps.glossary(p.withColumn("doc", F.col("id"))).select("id", F.col("abbreviation").alias("a"))
    return out.join(words, "id", "left").select(
        "id", F.when(has, F.col("t")).otherwise("").alias("t"), F.when(has, steps.paper_notation(F.col("c")[0])).otherwise("").alias("c"), steps.step_type(t).alias("type"), steps.repeat_count(t).alias("times"),
        steps.row_start(t).alias("row_start"), steps.lexicon_hit(t, ["knit", "purl"]).alias("verb"), F.coalesce("a", F.lit("")).alias("abbreviation"),
    )


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Ana Lind' END AS author, CASE p_size % 3 WHEN 1 THEN 'SIZES AND' ELSE 'plain title' END AS title, CASE WHEN p_size % 2 = 0 THEN 12 END AS repeats FROM part")
def title_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 3
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), steps.author(F.when(k == 0, "Pattern by: Ana Lind").otherwise("by the sea")).alias("author"), steps.despaced(F.when(k == 1, "S I Z E S  A N D").otherwise("plain title")).alias("title"),
        layout.chart_repeats(F.when(F.col("p_size") % 2 == 0, "work chart 12 times").otherwise("work chart"), r"chart (\d+) times").alias("repeats"),
    )


@query("WITH l AS (SELECT l_orderkey AS doc, l_suppkey % 3 AS page, l_partkey AS line_no, l_quantity AS size, CASE WHEN l_linenumber = 1 THEN '12' ELSE 'Title ' || l_partkey END AS text FROM lineitem) SELECT doc, arg_max(text, (size, -line_no)) AS title FROM l WHERE page = 0 AND text <> '12' GROUP BY 1")
def first_titles(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc", "l_suppkey % 3 AS page", "l_partkey AS line_no", "l_quantity AS size", "IF(l_linenumber = 1, '12', concat('Title ', l_partkey)) AS text")
    return steps.document_title(li)


@query("WITH l AS (SELECT l_orderkey AS doc, l_suppkey % 3 AS page, l_partkey AS line_no, CASE l_returnflag WHEN 'R' THEN 'notes' WHEN 'A' THEN 'sizes' ELSE 'other' END AS kind, 'ease ' || l_linenumber || l_partkey AS text FROM lineitem) SELECT doc, arg_min(text, (CASE kind WHEN 'sizes' THEN 1 WHEN 'notes' THEN 2 ELSE 3 END, page, line_no, text)) AS hint FROM l GROUP BY 1")
def ease_hints(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc", "l_suppkey % 3 AS page", "l_partkey AS line_no", "CASE l_returnflag WHEN 'R' THEN 'notes' WHEN 'A' THEN 'sizes' ELSE 'other' END AS kind", "concat('ease ', l_linenumber, l_partkey) AS text")
    low = li.groupBy("doc", "page", "line_no", "kind").agg(F.min("text").alias("text"))
    return steps.first_hint(low, "^ease", ["sizes", "notes"])


@query("SELECT p_partkey AS doc, '# ' || p_name || chr(10) || '## Sizes' || chr(10) || '- one' || chr(10) || 'two ' || p_size AS text FROM part")
def markdown_written(spark: SparkSession, d: str) -> DataFrame:
    """Parsed and written again."""
    p = table(spark, d, "part").selectExpr("p_partkey AS doc", "concat('# ', p_name, '\n\n##  Sizes\n* one\n\ntwo ', p_size) AS text")
    return steps.write_markdown(steps.parse_markdown(p))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'no_id|' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'no_kind|' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN 'empty_step|' ELSE '' END AS faults, 3 AS steps FROM part")
def reader_checks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey AS key", "p_partkey AS doc", "IF(p_size % 2 = 0, ' ', 'a') AS id", "IF(p_size % 3 = 0, NULL, 'body') AS kind", "'T' AS title", "concat('Row 1\n\n knit\n', 'end') AS instructions", "p_size")
    made = steps.to_reader(p).select(F.col("doc").alias("key"), F.size("steps").alias("n"))
    faulty = p.withColumn("steps", F.array(F.struct(F.when(F.col("p_size") % 5 == 0, "").otherwise("k").alias("t"))))
    checked = steps.reader_faults(faulty).join(made, "key")
    return checked.select(F.col("key").alias("id"), F.array_join(F.transform("faults", lambda f: F.concat(f, F.lit("|"))), "").alias("faults"), F.col("n").alias("steps"))


# positioned text ------------------------------------------------------------------------------------------------------


@query("WITH g AS (SELECT l_orderkey AS doc, floor(l_linenumber / 2) AS band, l_partkey AS x, chr(65 + CAST(l_linenumber AS INT)) || l_partkey AS text, 100 - floor(l_linenumber / 2) * 10 AS y FROM lineitem) SELECT doc, string_agg(text, ' ' ORDER BY x, text) AS text, CAST(min(x) AS DOUBLE) AS x, CAST(max(y) AS DOUBLE) AS y FROM g GROUP BY doc, band")
def glyph_rows(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc", "0 AS page", "CAST(l_partkey AS DOUBLE) AS x", "CAST(100 - floor(l_linenumber / 2) * 10 AS DOUBLE) AS y", "1.0 AS width", "concat(chr(65 + l_linenumber), l_partkey) AS text")
    return layout.rows_of(g).select("doc", "text", "x", "y")


@query("""WITH b AS (SELECT l_suppkey AS doc, l_linenumber AS page, CAST(l_partkey * 40 AS DOUBLE) AS x0, CAST(l_partkey * 40 AS DOUBLE) + l_quantity AS x1 FROM lineitem),
    r AS (SELECT *, max(x1) OVER (PARTITION BY doc, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
    n AS (SELECT *, sum(CASE WHEN x0 - reach <= 8 THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS region FROM r)
    SELECT doc, page, min(x0) AS x0, max(x1) AS x1, count(*) AS paths FROM n GROUP BY doc, page, region HAVING max(x1) - min(x0) >= 40 AND count(*) >= 2""")
def merged_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a supplier as boxes beside each other, one page a line number."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") * 40.0).alias("x0"), F.col("l_quantity").alias("w"))
    b = li.select("doc", "page", F.monotonically_increasing_id().alias("box"), "x0", F.lit(0.0).alias("y0"), (F.col("x0") + F.col("w")).alias("x1"), F.lit(50.0).alias("y1"))
    return layout.merge_boxes(b, least_paths=2).select("doc", "page", "x0", "x1", "paths")


@query("WITH l AS (SELECT l_orderkey AS doc, l_partkey AS page, CAST(l_linenumber AS DOUBLE) AS y, 'Part ' || (l_suppkey % 4) AS text FROM lineitem) SELECT o_orderkey AS doc, o_orderkey % 4 AS section, m.page, m.y FROM orders JOIN (SELECT doc, text, arg_min(page, (page, y)) AS page, arg_min(y, (page, y)) AS y FROM l GROUP BY 1, 2) m ON m.doc = o_orderkey AND m.text = 'Part ' || (o_orderkey % 4)")
def title_places(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc", "l_partkey AS page", "CAST(l_linenumber AS DOUBLE) AS y", "concat('Part ', l_suppkey % 4) AS text")
    sections = table(spark, d, "orders").selectExpr("o_orderkey AS doc", "o_orderkey % 4 AS section", "concat('PART ', o_orderkey % 4) AS title")
    return layout.title_events(sections, li)


@query("WITH l AS (SELECT l_orderkey AS doc, l_partkey AS page, max(CAST(l_linenumber AS BIGINT)) AS line_no FROM lineitem GROUP BY 1, 2), i AS (SELECT o_orderkey AS doc, o_custkey AS page, o_orderkey AS id FROM orders) SELECT i.doc, i.id, l.line_no FROM i ASOF LEFT JOIN l ON l.doc = i.doc AND i.page >= l.page")
def image_lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("page")).agg(F.max("l_linenumber").cast("long").alias("line_no")).withColumn("y", F.lit(0.0))
    images = table(spark, d, "orders").selectExpr("o_orderkey AS doc", "o_custkey AS page", "0.0D AS y", "o_orderkey AS id")
    return layout.nearest_line(images, li)


@query("WITH i AS (SELECT l_orderkey AS doc, l_partkey * 10 + l_linenumber AS pos, CASE WHEN l_returnflag = 'R' THEN 'grid' ELSE 'photo' END AS kind, CAST(l_quantity * 5 AS INT) AS w, 'p' || (l_suppkey % 3) AS src FROM lineitem), k AS (SELECT * FROM i WHERE kind = 'grid' OR w >= 96), o AS (SELECT doc, w, src, min(pos) AS pos, arg_min(kind, (pos, kind <> 'grid', kind)) AS kind, count(*) AS n FROM k GROUP BY doc, w, src) SELECT doc, pos, kind, kind <> 'grid' AND n > 1 AS repeated FROM o QUALIFY kind = 'grid' OR row_number() OVER (PARTITION BY doc, kind = 'grid' ORDER BY pos, kind, w, src) <= 2")
def galleries(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc", "l_partkey * 10 + l_linenumber AS pos", "IF(l_returnflag = 'R', 'grid', 'photo') AS kind", "CAST(l_quantity * 5 AS INT) AS w", "100 AS h", "concat('p', l_suppkey % 3) AS src")
    return layout.gallery(i, 96, 2).select("doc", "pos", "kind", "repeated")


@query("WITH p AS (SELECT l_orderkey AS doc, l_suppkey AS page, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2) SELECT doc, min(page) AS page FROM p WHERE page > 1 AND n % 2 = 0 GROUP BY 1")
def chart_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("page")).agg(F.min("l_linenumber").alias("n"))
    return layout.chart_page(p.withColumn("text", F.when(F.col("n") % 2 == 0, "see chart").otherwise("none")), "chart")


@query("WITH l AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS n FROM lineitem), f AS (SELECT doc, n, n = 1 AS h, n % 2 = 0 AS s FROM l) SELECT doc, n AS line_no FROM f WHERE h AND (SELECT count(*) FROM f x WHERE x.doc = f.doc AND x.s) >= 2")
def supply_headings(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc", "0 AS page", "l_linenumber AS line_no").distinct()
    return layout.supply_heading(li, F.col("line_no") == 1, F.col("line_no") % 2 == 0).select("doc", "line_no")


# what a document says about itself ------------------------------------------------------------------------------------

_BOOK = "array('Materials', 'yarn a', 'yarn b', 'Row 1', 'Row 2', 'filler', 'filler', 'filler', 'filler')"


@query("SELECT s_suppkey AS doc, 5 AS pages, CASE s_suppkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS patterns, s_suppkey % 5 = 0 AS several FROM supplier")
def pattern_books(spark: SparkSession, d: str) -> DataFrame:
    """Five pages that each repeat heading, supplies and rows: with a new title before each, without, with titles but in a new
    language each, with titles but without rows, and without supplies."""
    k = F.col("doc") % 5
    line = F.col("line")
    text_ = F.when((line == "title") & (k != 1), F.concat(F.lit("Pattern "), F.col("page").cast("string"))).when(line == "title", "same").when(line.startswith("Row") & (k == 3), "plain").when(line.startswith("yarn") & (k == 4), "plain").otherwise(line)
    pages = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("page"))
    lines_ = pages.select("doc", "page", F.posexplode(F.expr(f"concat(array('title'), {_BOOK})")).alias("line_no", "line")).withColumn("text", text_)
    sized = lines_.withColumn("size", F.when(F.col("text").startswith("Pattern"), 20.0).otherwise(10.0))
    language = F.when(k == 2, F.col("page").cast("string")).otherwise("en")
    t = F.col("text")
    found = reference.several_patterns(sized, t == "Materials", language, t.startswith("yarn"), t.startswith("Row"), F.lit(None).cast("string"))
    return found.select("doc", F.col("pages").cast("int").alias("pages"), F.col("patterns").cast("int").alias("patterns"), "several")


@query("SELECT s_suppkey AS doc, CASE WHEN s_suppkey % 3 = 0 THEN 11 ELSE 0 END AS cells, s_suppkey % 3 = 0 AS label FROM supplier")
def chart_cell_counts(spark: SparkSession, d: str) -> DataFrame:
    """Ten rows of five symbols with a label inside: a chart where the rows are dense; else too few symbols, or words."""
    body = F.when(F.col("doc") % 3 == 0, "x x x x x").when(F.col("doc") % 3 == 1, "x").otherwise("some words")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("i"))
    cells = rows.select("doc", F.lit(0).alias("page"), F.col("i").cast("string").alias("cell"), F.lit(10.0).alias("x"), F.lit(60.0).alias("end_x"), (F.col("i") * 10.0).alias("y"), body.alias("text"))
    label = rows.where("i = 1").select("doc", F.lit(0).alias("page"), F.lit("label").alias("cell"), F.lit(20.0).alias("x"), F.lit(40.0).alias("end_x"), F.lit(55.0).alias("y"), F.lit("Section 2").alias("text"))
    found = reference.chart_cells(cells.unionByName(label)).groupBy("doc").agg(F.count(F.lit(1)).cast("int").alias("n"), F.bool_or(F.col("cell") == "label").alias("label"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc")).join(found, "doc", "left").select("doc", F.coalesce("n", F.lit(0)).alias("cells"), F.coalesce("label", F.lit(False)).alias("label"))
