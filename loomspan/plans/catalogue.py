"""Named queries over the driver's tables and the DuckDB SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import catalogues, dates, numbers, text
from loomspan.operators import activity, documents, exports, imports, layout, ledger, mutations, progress, sessionize, steps, stock, tools
from loomspan.plans import standins as S
from loomspan.plans.registry import ORACLE, QUERIES, query  # noqa: F401
from loomspan.plans.standins import REF, REF_DAY, sql, table

LAST_YEAR = REF_DAY.year + 1
START, END = dates.window_bounds(REF_DAY, "month")
R2 = "floor(({}) * 100 + 0.5) / 100"


def _daily(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return activity.by_day(S.sessions(spark, d), LAST_YEAR, *keys)


# activity ------------------------------------------------------------------------------------------------------------


@query(sql(f"""SELECT c.d AS day, CAST(date_trunc('week', c.d) AS DATE) AS week, CAST(isodow(c.d) - 1 AS INT) AS weekday,
    CAST(CASE WHEN c.d > {REF} THEN 0 ELSE coalesce(b.total_sec, 0) END AS BIGINT) AS total_sec, CAST(CASE WHEN c.d > {REF} THEN 0 ELSE coalesce(b.n, 0) END AS BIGINT) AS sessions,
    CAST(CASE WHEN c.d > {REF} OR coalesce(b.total_sec, 0) <= 0 THEN 0 WHEN b.total_sec < 1800 THEN 1 WHEN b.total_sec < 3600 THEN 2 WHEN b.total_sec < 7200 THEN 3 ELSE 4 END AS INT) AS level, c.d > {REF} AS future
    FROM (SELECT CAST(unnest(generate_series(date_trunc('week', {REF}) - INTERVAL 84 DAY, date_trunc('week', {REF}) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS d) c LEFT JOIN by_day b ON c.d = b.d""", "sessions", "by_day"))
def activity_calendar(spark: SparkSession, d: str) -> DataFrame:
    return activity.activity_calendar(S.sessions(spark, d), REF_DAY, "quarter")


@query(sql("SELECT strftime(date_trunc('week', d), '%Y-%m-%d') AS period, CAST(date_trunc('week', d) AS DATE) AS start_day, CAST(sum(duration_sec) AS BIGINT) AS total_sec FROM sessions GROUP BY 1, 2", "sessions"))
def activity_by_week(spark: SparkSession, d: str) -> DataFrame:
    return activity.by_period(S.sessions(spark, d), "week", LAST_YEAR)


@query(sql("SELECT strftime(w, '%Y-%m-%d') AS period, w AS start_day, CAST(sum(duration_sec) AS BIGINT) AS total_sec FROM (SELECT d - CAST(dayofweek(d) AS INT) AS w, duration_sec FROM sessions) GROUP BY 1, 2", "sessions"))
def activity_by_sunday_week(spark: SparkSession, d: str) -> DataFrame:
    return activity.by_period(S.sessions(spark, d), "week", LAST_YEAR, first_day=0)


@query(sql("SELECT strftime(d, '%Y-%m') AS period, CAST(date_trunc('month', d) AS DATE) AS start_day, CAST(sum(duration_sec) AS BIGINT) AS total_sec FROM sessions GROUP BY 1, 2", "sessions"))
def activity_by_month(spark: SparkSession, d: str) -> DataFrame:
    return activity.by_period(S.sessions(spark, d), "month", LAST_YEAR)


@query(sql(f"SELECT CAST(coalesce(sum(duration_sec), 0) AS BIGINT) AS total_sec FROM sessions WHERE started >= date_trunc('week', {REF})", "sessions"))
def current_week_seconds(spark: SparkSession, d: str) -> DataFrame:
    return activity.seconds_since(S.sessions(spark, d), dates.week_start(F.lit(REF_DAY)).cast("timestamp_ntz"))


@query(sql("SELECT CAST(w.k AS INT) AS weekday, CAST(coalesce(sum(b.total_sec), 0) AS BIGINT) AS total_sec FROM range(7) w(k) LEFT JOIN by_day b ON isodow(b.d) - 1 = w.k GROUP BY w.k", "sessions", "by_day"))
def weekday_totals(spark: SparkSession, d: str) -> DataFrame:
    return activity.weekday_totals(_daily(spark, d))


@query(sql("SELECT CAST(isodow(d) - 1 AS INT) AS weekday, CAST(sum(total_sec) AS BIGINT) AS total_sec FROM by_day GROUP BY 1 HAVING sum(total_sec) > 0 ORDER BY 2 DESC, 1 LIMIT 1", "sessions", "by_day"))
def best_weekday(spark: SparkSession, d: str) -> DataFrame:
    return activity.best_weekday(_daily(spark, d))


@query(sql("SELECT d AS day, CAST(total_sec AS BIGINT) AS total_sec FROM by_day WHERE total_sec > 0 ORDER BY 2 DESC, 1 DESC LIMIT 1", "sessions", "by_day"))
def best_day(spark: SparkSession, d: str) -> DataFrame:
    return activity.best_day(_daily(spark, d))


@query(sql(f"""SELECT (SELECT count(*) FROM (SELECT d FROM sessions UNION SELECT d FROM active_days) WHERE d BETWEEN DATE '{START}' AND DATE '{END}') AS active_days, CAST({(END - START).days + 1} AS BIGINT) AS elapsed_days, t AS total_sec,
    CAST(CASE WHEN t > 0 THEN floor(t / (SELECT count(*) FROM (SELECT d FROM sessions UNION SELECT d FROM active_days) WHERE d BETWEEN DATE '{START}' AND DATE '{END}') + 0.5) END AS BIGINT) AS average_sec
    FROM (SELECT CAST(coalesce(sum(total_sec), 0) AS BIGINT) AS t FROM by_day WHERE d BETWEEN DATE '{START}' AND DATE '{END}')""", "sessions", "active_days", "by_day"))
def active_days(spark: SparkSession, d: str) -> DataFrame:
    daily = _daily(spark, d)
    return activity.active_share(daily, activity.day_set(daily, S.active_days(spark, d)), START, END)


_RUNS = "r AS (SELECT project_id, d - CAST(row_number() OVER (PARTITION BY project_id ORDER BY d) AS INT) AS g, d FROM (SELECT DISTINCT project_id, d FROM sessions{}) u), i AS (SELECT project_id, max(d) AS last_d, count(*) AS n FROM r GROUP BY project_id, g)"


@query(sql(", " + _RUNS.format(f" WHERE d <= {REF}") + f" SELECT project_id, CAST(max(CASE WHEN last_d >= {REF} - 1 THEN n ELSE 0 END) AS BIGINT) AS streak FROM i GROUP BY project_id", "sessions").replace("\n, r", ",\nr"))
def current_streak(spark: SparkSession, d: str) -> DataFrame:
    return activity.current_streak(_daily(spark, d, "project_id"), REF_DAY, "project_id")


@query(sql(", " + _RUNS.format("") + " SELECT project_id, CAST(max(n) AS BIGINT) AS streak FROM i GROUP BY project_id", "sessions").replace("\n, r", ",\nr"))
def longest_streak(spark: SparkSession, d: str) -> DataFrame:
    return activity.longest_streak(_daily(spark, d, "project_id"), "project_id")


@query(sql(f"""SELECT strftime(w, '%Y-%m') AS month, CAST(min(w) AS DATE) AS first_week, count(*) AS weeks
    FROM (SELECT unnest(generate_series(date_trunc('week', {REF}) - INTERVAL 84 DAY, date_trunc('week', {REF}), INTERVAL 7 DAY)) AS w) GROUP BY 1""", "sessions"))
def month_groups(spark: SparkSession, d: str) -> DataFrame:
    return activity.month_groups(activity_calendar(spark, d))


@query(sql("SELECT project_id, CAST(sum(duration_sec) AS BIGINT) AS total_sec, max(started) AS last_start FROM sessions GROUP BY 1 HAVING sum(duration_sec) > 0 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1", "sessions"))
def top_project(spark: SparkSession, d: str) -> DataFrame:
    return activity.top_project(_daily(spark, d, "project_id"))


@query(sql("""SELECT s.d AS day, s.project_id, CAST(sum(s.duration_sec) AS BIGINT) AS total_sec, count(*) AS sessions, coalesce(p.name, '') AS name, p.id IS NULL AS orphan
    FROM sessions s LEFT JOIN projects p ON s.project_id = p.id GROUP BY s.d, s.project_id, p.name, p.id""", "sessions", "projects"))
def day_project_detail(spark: SparkSession, d: str) -> DataFrame:
    return activity.day_detail(_daily(spark, d, "project_id"), S.projects(spark, d))


@query(sql("SELECT s.id, s.project_id, s.started, s.duration_sec, s.manual, coalesce(p.name, '') AS name FROM sessions s LEFT JOIN projects p ON s.project_id = p.id ORDER BY s.started DESC, s.id DESC LIMIT 20", "sessions", "projects"))
def recent_sessions(spark: SparkSession, d: str) -> DataFrame:
    return activity.recent_sessions(S.sessions(spark, d), S.projects(spark, d), 20).select("id", "project_id", "started", "duration_sec", "manual", "name")


@query(sql("SELECT s.id, s.project_id, s.duration_sec FROM sessions s WHERE EXISTS (SELECT 1 FROM projects p WHERE p.id = s.project_id AND coalesce(p.technique, 'knitting') = 'knitting')", "sessions", "projects"))
def technique_filter(spark: SparkSession, d: str) -> DataFrame:
    return activity.filter_technique(S.sessions(spark, d), S.projects(spark, d), "knitting").select("id", "project_id", "duration_sec")


@query(sql("SELECT bool_or(coalesce(technique, 'knitting') = 'crochet') AND bool_or(coalesce(technique, 'knitting') <> 'crochet') AS shown FROM projects", "projects"))
def technique_choice(spark: SparkSession, d: str) -> DataFrame:
    return activity.both_techniques(S.projects(spark, d))


@query(sql("SELECT project_id, id, started, duration_sec FROM sessions WHERE NOT manual QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started DESC, id DESC) = 1", "sessions"))
def last_session_per_project(spark: SparkSession, d: str) -> DataFrame:
    return activity.last_timed_session(S.sessions(spark, d))


@query(sql("""SELECT project_id, CAST(episode AS BIGINT) AS episode, arg_min(id, (started, id)) AS first_id, min(started) AS started, CAST(sum(duration_sec) AS BIGINT) AS duration_sec, count(*) AS chunks FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY project_id ORDER BY started, id ROWS UNBOUNDED PRECEDING) AS episode FROM (
    SELECT *, CASE WHEN epoch_us(started) - max(epoch_us(started) + duration_sec * 1000000) OVER (PARTITION BY project_id ORDER BY started, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM sessions WHERE NOT manual)) GROUP BY project_id, episode""", "sessions"))
def session_merge(spark: SparkSession, d: str) -> DataFrame:
    return sessionize.merge_sessions(S.sessions(spark, d), "project_id")


@query(sql(f"""SELECT day, weekday, relative, minutes, clock FROM (SELECT d AS day, CAST((dayofweek(d) + 1) % 7 AS INT) AS weekday,
    CASE WHEN {REF} - d = 0 THEN 'today' WHEN {REF} - d = 1 THEN 'yesterday' WHEN {REF} - d BETWEEN 2 AND 6 THEN dayname(d) ELSE strftime(d, '%Y-%m-%d') END AS relative, m,
    CASE WHEN m // 60 = 0 THEN m || ' min' WHEN m % 60 = 0 THEN (m // 60) || ' h' ELSE (m // 60) || ' h ' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || ' min' END AS minutes,
    CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') || ':' ELSE (s // 60) || ':' END || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock
    FROM (SELECT d, CAST(total_sec AS BIGINT) AS s, CAST(floor(total_sec / 60 + 0.5) AS BIGINT) AS m FROM by_day))""", "sessions", "by_day"))
def day_labels(spark: SparkSession, d: str) -> DataFrame:
    day, s = F.col("day"), F.col("total_sec")
    return _daily(spark, d).select("day", dates.weekday_index(day, 6).alias("weekday"), dates.relative_label(day, F.lit(REF_DAY)).alias("relative"), numbers.minutes_text(s).alias("minutes"), numbers.clock_text(s).alias("clock"))


# ledger --------------------------------------------------------------------------------------------------------------


def _expenses(spark: SparkSession, d: str) -> DataFrame:
    return ledger.expense_lines(S.lines(spark, d), S.patterns(spark, d), S.tools_ledger(spark, d))


_LEDGER = ("lines", "expenses", "amounts")


@query(sql(f"SELECT currency, {R2.format('sum(amount)')} AS amount FROM amounts WHERE amount <> 0 GROUP BY 1", *_LEDGER))
def spend_by_currency(spark: SparkSession, d: str) -> DataFrame:
    return ledger.by_currency(_expenses(spark, d))


@query(sql(f"SELECT c.category, a.currency, {R2.format('sum(a.amount)')} AS amount FROM (VALUES ('yarn'), ('pattern'), ('tool')) c(category) LEFT JOIN (SELECT * FROM amounts WHERE amount <> 0) a USING (category) GROUP BY 1, 2", *_LEDGER))
def spend_by_category(spark: SparkSession, d: str) -> DataFrame:
    return ledger.by_category(_expenses(spark, d))


@query(sql(f"SELECT dt[1:4] AS year, CASE WHEN grouping(dt[1:7]) = 0 THEN dt[1:7] END AS month, currency, {R2.format('sum(amount)')} AS amount, CAST(count(*) AS BIGINT) AS lines FROM amounts GROUP BY GROUPING SETS ((dt[1:4], dt[1:7], currency), (dt[1:4], currency))", *_LEDGER))
def spend_rollup(spark: SparkSession, d: str) -> DataFrame:
    return ledger.rollup(_expenses(spark, d))


@query(sql(f"SELECT currency, {R2.format('sum(amount)')} AS amount FROM amounts WHERE amount <> 0 AND dt = '' AND category = 'yarn' GROUP BY 1", *_LEDGER))
def spend_undated(spark: SparkSession, d: str) -> DataFrame:
    return ledger.by_currency(ledger.filter_category(ledger.filter_year(_expenses(spark, d), "unknown"), "yarn"))


@query(sql("SELECT DISTINCT dt[1:4] AS year FROM amounts", *_LEDGER))
def expense_years(spark: SparkSession, d: str) -> DataFrame:
    return ledger.years(_expenses(spark, d))


@query(sql("SELECT category, count(*) AS lines, count_if(NOT gift AND p IS NULL) AS unknown, count_if(gift) AS gifts FROM expenses GROUP BY 1", "lines", "expenses"))
def unknown_prices(spark: SparkSession, d: str) -> DataFrame:
    e = _expenses(spark, d).withColumn("category", ledger.category())
    return e.groupBy("category").agg(F.count(F.lit(1)).alias("lines"), F.count_if(ledger.price_unknown()).alias("unknown"), F.count_if(F.col("kind") == "gift").alias("gifts"))


@query(sql("SELECT category, coalesce(nullif(y.model, ''), e.label) AS label, count(*) AS lines FROM expenses e LEFT JOIN yarns y ON e.yarn_id = y.id AND y.grams <> 13 GROUP BY 1, 2", "lines", "expenses", "yarns"))
def expense_labels(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "part").where("p_size <> 13").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return ledger.labelled(_expenses(spark, d), live).groupBy("category", "label").agg(F.count(F.lit(1)).alias("lines"))


@query(sql("SELECT y.id AS yarn_id, 'buy' AS kind, coalesce(CAST(y.price AS VARCHAR), '') AS unit_price, CASE WHEN y.currency = '' THEN 'CHF' ELSE y.currency END AS currency, '' AS date, TRUE AS reconstructed FROM yarns y WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.yarn_id = y.id AND l.gift AND l.q > 40)", "lines", "yarns"))
def ledger_backfill(spark: SparkSession, d: str) -> DataFrame:
    y = S.yarns(spark, d).select("id", "quantity", "price", "currency", "weight")
    known = S.lines(spark, d).where("kind = 'gift' AND cast(quantity AS double) > 40")
    return ledger.backfill(y.where("weight = 'SMALL'"), y, known, "CHF").drop("quantity")


@query(sql(f"SELECT CASE WHEN currency = '' THEN 'EUR' ELSE currency END AS currency, {R2.format('sum(price * quantity)')} AS amount FROM yarns WHERE price IS NOT NULL GROUP BY 1", "yarns"))
def stock_value_by_currency(spark: SparkSession, d: str) -> DataFrame:
    return ledger.stock_value(S.yarns(spark, d), "EUR")


@query(sql(f"SELECT yarn_id, {R2.format('sum(q)')} AS skeins, coalesce(max(nullif(dt, '')), '') AS last_date FROM lines GROUP BY 1", "lines"))
def yarn_purchases(spark: SparkSession, d: str) -> DataFrame:
    return ledger.yarn_totals(S.lines(spark, d).withColumn("lot", F.lit(""))).drop("lots")


@query(sql(f"SELECT y.id AS yarn_id, {R2.format(R2.format('y.quantity + coalesce(c.q, 0)') + ' - coalesce(l.q, 0)')} AS gap FROM yarns y LEFT JOIN (SELECT yarn_id, sum(q) AS q FROM consumed GROUP BY 1) c ON c.yarn_id = y.id LEFT JOIN (SELECT yarn_id, sum(q) AS q FROM lines GROUP BY 1) l ON l.yarn_id = y.id", "yarns", "consumed", "lines"))
def stock_gap(spark: SparkSession, d: str) -> DataFrame:
    return ledger.stock_gap(S.yarns(spark, d), S.lines(spark, d).withColumn("lot", F.lit("")))


# stock ---------------------------------------------------------------------------------------------------------------


@query(sql(f"SELECT y.id, {R2.format('coalesce(r.q, 0)')} AS reserved, greatest(0.0, {R2.format('y.quantity - coalesce(r.q, 0)')}) AS available FROM yarns y LEFT JOIN (SELECT yarn_id, sum(q) AS q FROM reserved GROUP BY 1) r ON r.yarn_id = y.id", "yarns", "reserved"))
def stock_available(spark: SparkSession, d: str) -> DataFrame:
    return stock.with_availability(S.yarns(spark, d)).select("id", "reserved", "available")


@query(sql("""SELECT y.id, CASE WHEN y.quantity = 0 AND c.q > 0 THEN 'used' WHEN least(coalesce(r.q, 0), y.quantity) <= 0 THEN 'free' WHEN NOT r.all_done THEN 'reserved' WHEN r.q >= y.quantity THEN 'used' ELSE 'usedPartial' END AS state
    FROM yarns y LEFT JOIN (SELECT yarn_id, sum(q) AS q FROM consumed GROUP BY 1) c ON c.yarn_id = y.id
    LEFT JOIN (SELECT r.yarn_id, sum(r.q) AS q, bool_and(coalesce(p.status = 'done', FALSE)) AS all_done FROM reserved r LEFT JOIN stock_projects p ON p.id = r.project_id WHERE r.q > 0 GROUP BY 1) r ON r.yarn_id = y.id""", "yarns", "reserved", "consumed", "stock_projects"))
def stock_state(spark: SparkSession, d: str) -> DataFrame:
    return stock.usage_state(S.yarns(spark, d), S.stock_projects(spark, d))


@query(sql(f"""SELECT u.project_id, CASE WHEN y.currency = '' THEN 'EUR' ELSE y.currency END AS currency, {R2.format('sum(coalesce(y.price * u.q, 0))')} AS amount, count(y.price) AS priced, count_if(y.price IS NULL) AS unpriced
    FROM (SELECT project_id, yarn_id, sum(q) AS q FROM (SELECT * FROM reserved UNION ALL SELECT * FROM consumed) GROUP BY 1, 2) u JOIN yarns y ON y.id = u.yarn_id WHERE u.q > 0 GROUP BY 1, 2""", "yarns", "reserved", "consumed"))
def project_cost(spark: SparkSession, d: str) -> DataFrame:
    return stock.project_cost(S.yarns(spark, d), "EUR")


@query(sql("SELECT project_id FROM (SELECT DISTINCT project_id, yarn_id FROM (SELECT * FROM reserved WHERE q >= 50 UNION ALL SELECT * FROM consumed WHERE q >= 50)) u JOIN yarns y ON y.id = u.yarn_id GROUP BY 1 HAVING bool_and(y.vegan)", "yarns", "reserved", "consumed"))
def vegan_projects(spark: SparkSession, d: str) -> DataFrame:
    big = lambda c: F.map_filter(c, lambda _, v: v >= 50).alias(c)
    y = S.yarns(spark, d).select("id", "labels", big("reservations"), big("consumed"))
    return stock.projects_all_labelled(y, "Vegan")


@query(sql("SELECT id, brand, model, weight FROM yarns WHERE contains(lower(brand || ' ' || model), 'red') AND weight = 'PROMO' AND grams >= 6", "yarns"))
def stock_search(spark: SparkSession, d: str) -> DataFrame:
    return S.yarns(spark, d).where(stock.matches(query=" Red ", weight="PROMO", label="vegan")).select("id", "brand", "model", "weight")


@query(sql("SELECT id, CASE weight WHEN 'LARGE' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'PROMO' THEN 3 ELSE 999 END AS place, lower(brand) AS brand_key FROM yarns", "yarns"))
def stock_sort(spark: SparkSession, d: str) -> DataFrame:
    """The whole stock in order, with the keys it is sorted by."""
    order = ("LARGE", "SMALL", "PROMO")
    return stock.sort_yarns(S.yarns(spark, d), "weight", order).select("id", stock.weight_rank(F.col("weight"), order).alias("place"), F.lower("brand").alias("brand_key"))


@query(sql("SELECT CAST(grams AS DOUBLE) AS value, CAST(grams AS VARCHAR) AS grams FROM yarns GROUP BY ALL", "yarns"))
def facet_grams(spark: SparkSession, d: str) -> DataFrame:
    return stock.grams_options(S.yarns(spark, d))


@query(sql("SELECT brand FROM (SELECT DISTINCT trim(brand) AS brand FROM yarns UNION SELECT unnest(['Brand#1', 'Own spun']))", "yarns"))
def facet_brand(spark: SparkSession, d: str) -> DataFrame:
    return stock.brand_options(S.yarns(spark, d), ["Brand#1", "Own spun"])


@query(sql("SELECT DISTINCT weight, CASE weight WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 3 END AS place FROM yarns", "yarns"))
def facet_weight(spark: SparkSession, d: str) -> DataFrame:
    return stock.present(S.yarns(spark, d), "weight", ["SMALL", "TINY", "LARGE"]).withColumn("place", F.col("place").cast("int"))


@query(sql(f"SELECT {R2.format('sum(quantity)')} AS skeins, {R2.format('sum(quantity * grams)')} AS grams FROM yarns", "yarns"))
def stock_totals(spark: SparkSession, d: str) -> DataFrame:
    return stock.stock_totals(S.yarns(spark, d).withColumn("length_m", F.lit("0"))).drop("metres")


@query("SELECT c.category, count(p.p_partkey) AS n FROM (VALUES ('SMALL'), ('TINY')) c(category) LEFT JOIN (SELECT * FROM part WHERE p_size <= 10) p ON p.p_type = c.category GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM part WHERE p_size <= 10")
def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    return stock.count_by_category(S.patterns(spark, d), ["SMALL", "TINY"])


# tools ---------------------------------------------------------------------------------------------------------------

_TOOLS = "tools AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 4 = 0 THEN 'kit' ELSE 'needle' END AS category, CASE WHEN p_size % 4 = 0 THEN [p_size / 4.0, p_size / 4.0 + 0.5, p_size / 4.0] WHEN p_size % 5 = 0 THEN [] ELSE [p_size / 4.0] END AS sizes FROM part), orders_ AS (SELECT l_orderkey AS id, CASE WHEN l_orderkey % 3 = 0 THEN 'done' ELSE 'wip' END AS status, list(l_partkey ORDER BY l_linenumber, l_partkey) AS tool_ids FROM lineitem GROUP BY 1)"


def _tools(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    mm, kit = F.col("p_size") / 4.0, F.col("p_size") % 4 == 0
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(kit, "kit").otherwise("needle").alias("category"), F.when(~kit & (F.col("p_size") % 5 != 0), mm).alias("size_mm"),
        F.when(kit, F.array(mm, mm + 0.5, mm)).alias("kit_sizes"), F.lit(2).alias("quantity"), F.col("p_type").alias("type"),
    )


def _tool_projects(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return li.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_orderkey") % 3 == 0, "done").otherwise("wip").alias("status"), F.transform("x", lambda s: s["l_partkey"]).alias("tool_ids"))


@query(f"WITH {_TOOLS} SELECT project_id, tool_id, CAST(min(ord) - 1 AS INT) AS place, name FROM (SELECT id AS project_id, unnest(tool_ids) AS tool_id, generate_subscripts(tool_ids, 1) AS ord FROM orders_) x JOIN tools t ON t.id = x.tool_id JOIN part ON p_partkey = t.id AND p_size <> 13 GROUP BY project_id, tool_id, name")
def linked_tools(spark: SparkSession, d: str) -> DataFrame:
    return tools.linked_tools(_tool_projects(spark, d), _tools(spark, d).where("coalesce(size_mm, kit_sizes[0], 0) <> 3.25"))


@query(f"WITH {_TOOLS} SELECT tool_id, min(project_id) AS project_id, count(*) AS holders FROM (SELECT DISTINCT id AS project_id, unnest(tool_ids) AS tool_id FROM orders_ WHERE status = 'wip') GROUP BY 1")
def tools_in_use(spark: SparkSession, d: str) -> DataFrame:
    return tools.in_use(_tool_projects(spark, d))


@query(f"WITH {_TOOLS} SELECT t.id, CAST(20 - coalesce(h.n, 0) AS BIGINT) AS free FROM tools t LEFT JOIN (SELECT tool_id, count(*) AS n FROM (SELECT DISTINCT id AS project_id, unnest(tool_ids) AS tool_id FROM orders_ WHERE status = 'wip') GROUP BY 1) h ON h.tool_id = t.id WHERE 20 - coalesce(h.n, 0) > 0")
def kit_availability(spark: SparkSession, d: str) -> DataFrame:
    return tools.free_tools(_tools(spark, d).withColumn("quantity", F.lit(20)), _tool_projects(spark, d)).select("id", "free")


@query(f"WITH {_TOOLS} SELECT id AS tool_id, unnest(list_distinct(sizes)) AS size_mm FROM tools WHERE len(sizes) > 0 UNION ALL SELECT id, NULL FROM tools WHERE len(sizes) = 0")
def group_by_size(spark: SparkSession, d: str) -> DataFrame:
    return tools.group_by_size(_tools(spark, d))


@query(f"WITH {_TOOLS} SELECT DISTINCT CAST(floor(l_quantity / 8 * 100 + 0.5) AS INT) AS size FROM lineitem WHERE CAST(floor(l_quantity / 8 * 100 + 0.5) AS INT) NOT IN (SELECT CAST(floor(unnest(sizes) * 100 + 0.5) AS INT) FROM tools)")
def missing_sizes(spark: SparkSession, d: str) -> DataFrame:
    return tools.missing_sizes(table(spark, d, "lineitem").select((F.col("l_quantity") / 8).alias("size_mm")), _tools(spark, d))


@query(f"WITH {_TOOLS} SELECT type, CAST(place AS INT) AS place, id, CAST(row_number() OVER (PARTITION BY type ORDER BY s NULLS LAST, id) AS INT) AS rank FROM (SELECT t.id, p_type AS type, CASE p_type WHEN 'SMALL' THEN 1 WHEN 'PROMO' THEN 2 END AS place, list_min(sizes) AS s FROM tools t JOIN part ON p_partkey = t.id) WHERE place IS NOT NULL")
def tools_by_type(spark: SparkSession, d: str) -> DataFrame:
    return tools.group_by_type(_tools(spark, d), ["SMALL", "PROMO"])


# import and export ---------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT c_custkey AS pos, c_mktsegment AS brand, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) || ' Écru' ELSE lower(c_mktsegment) || ' ecru' END AS model, CAST(c_nationkey AS VARCHAR) AS color, CASE WHEN c_custkey % 9 = 0 THEN 'Used up' WHEN c_custkey % 9 = 1 THEN NULL ELSE 'In Stash' END AS status, c_acctbal > 5000 AS fam FROM customer),
    k AS (SELECT pos, color, fam, coalesce(status, '') = 'In Stash' AS s, lower(brand) || '|' || strip_accents(lower(model)) || '|' || color AS key, lower(brand) || '|' || strip_accents(lower(model)) || '|' AS bare FROM r),
    e AS (SELECT key AS stored FROM k WHERE color = '7' UNION SELECT bare FROM k WHERE pos = 30)
    SELECT pos, key, CASE WHEN NOT s THEN 'status' WHEN key IN (SELECT stored FROM e) OR (fam AND bare IN (SELECT stored FROM e)) OR row_number() OVER (PARTITION BY key, s ORDER BY pos) > 1 THEN 'present' ELSE 'new' END AS class FROM k""")
def import_classify(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    model = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.upper("c_mktsegment"), F.lit(" Écru"))).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" ecru")))
    status = F.when(F.col("c_custkey") % 9 == 0, "Used up").when(F.col("c_custkey") % 9 != 1, "In Stash")
    rows = c.select(F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("brand"), model.alias("model"), F.col("c_nationkey").cast("string").alias("color"), status.alias("status"), (F.col("c_acctbal") > 5000).alias("color_from_family"))
    stored = rows.where("color = '7'").select("brand", "model", "color").union(rows.where("pos = 30").select("brand", "model", F.lit("")))
    return imports.classify(rows, stored).select("pos", "key", "class")


@query("""SELECT o_orderkey || ';' || CASE WHEN o_orderkey % 4 = 0 THEN '''=' || o_orderpriority WHEN o_orderkey % 4 = 1 THEN '"' || o_orderpriority || ';x"' WHEN o_orderkey % 4 = 2 THEN '"a ""' || o_orderpriority || repeat('"', 3) ELSE o_orderpriority END || ';' || o_orderstatus AS line FROM orders""")
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    p = F.when(k == 0, F.concat(F.lit("="), "o_orderpriority")).when(k == 1, F.concat("o_orderpriority", F.lit(";x"))).when(k == 2, F.concat(F.lit('a "'), F.col("o_orderpriority"), F.lit('"'))).otherwise(F.col("o_orderpriority"))
    return imports.csv_lines(table(spark, d, "orders").withColumn("p", p), ["o_orderkey", "p", "o_orderstatus"])


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, lower(p_brand) || '|' || lower(p_name) || '|' AS key, p_brand || ' · ' || p_name AS label FROM part")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), text.slug(F.col("p_name")).alias("slug"), text.joined_key(F.col("p_brand"), F.col("p_name"), F.lit(None).cast("string")).alias("key"), text.label(F.col("p_brand"), F.lit(" "), F.col("p_name")).alias("label"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_discount + 0.0 AS parsed, floor(l_extendedprice / 7 * 100 + 0.5) / 100 AS rounded, CAST(floor(l_quantity / 7 * 100 + 0.5) AS INT) AS hundredths FROM lineitem")
def parse_decimal(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    typed = F.concat(F.lit(" "), F.replace(F.col("l_discount").cast("string"), F.lit("."), F.lit(",")), F.lit(" "))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), numbers.parse_decimal(typed).alias("parsed"), numbers.round2(F.col("l_extendedprice") / 7).alias("rounded"), numbers.hundredths(F.col("l_quantity") / 7).alias("hundredths"))


# progress, cascades, state -------------------------------------------------------------------------------------------


def _sections(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("project_id"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("long")).alias("rows_total"), F.floor(F.col("l_discount") * 400).cast("long").alias("rows_done"), (F.col("l_returnflag") == "R").alias("marked_done"))


@query("SELECT l_orderkey AS project_id, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE least(CAST(floor(l_discount * 400) AS BIGINT), CAST(l_quantity AS BIGINT)) END) AS BIGINT) AS done, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem WHERE l_linenumber > 1 GROUP BY 1")
def section_progress(spark: SparkSession, d: str) -> DataFrame:
    return progress.section_progress(_sections(spark, d))


@query("SELECT 'orders' AS relation, count_if(c.c_custkey IS NULL) AS kept, count(c.c_custkey) AS removed FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey = 5) c ON o_custkey = c_custkey UNION ALL SELECT 'sessions', count_if(c.c_custkey IS NULL), count(c.c_custkey) FROM events LEFT JOIN (SELECT * FROM customer WHERE c_nationkey = 5) c ON user_id = c_custkey")
def cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    removed = table(spark, d, "customer").where("c_nationkey = 5").select(F.col("c_custkey").alias("project_id"))
    children = {"orders": table(spark, d, "orders").withColumnRenamed("o_custkey", "project_id"), "sessions": table(spark, d, "events").withColumnRenamed("user_id", "project_id")}
    return mutations.cascade_counts(children, removed)


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)")
def cascade_bundle(spark: SparkSession, d: str) -> DataFrame:
    removed = table(spark, d, "customer").where("c_nationkey = 5").select(F.col("c_custkey").alias("project_id"))
    _, bundle = mutations.split_cascade({"orders": table(spark, d, "orders").withColumnRenamed("o_custkey", "project_id")}, removed)
    return bundle["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


_STEPS = "steps AS (SELECT l_orderkey AS doc, CAST(l_suppkey % 2 AS INT) AS section, l_partkey * 10 + l_linenumber AS pos, CAST(l_partkey % 50 AS VARCHAR) AS t FROM lineitem), fresh AS (SELECT doc, section, pos + 1000 AS pos, t FROM steps WHERE t <> '13')"


@query(f"WITH {_STEPS}, o AS (SELECT doc, section, t, min(pos) AS pos FROM steps GROUP BY ALL HAVING count(*) = 1), n AS (SELECT doc, section, t, min(pos) AS new_pos FROM fresh GROUP BY ALL HAVING count(*) = 1) SELECT s.doc, count(m.new_pos) AS kept, count_if(m.new_pos IS NULL) AS lost, CASE WHEN count_if(m.new_pos IS NULL) > 0 THEN 'modal' WHEN count(m.new_pos) > 0 THEN 'snackbar' ELSE 'none' END AS show FROM (SELECT DISTINCT doc, section, pos FROM steps) s LEFT JOIN (SELECT o.doc, o.section, o.pos, n.new_pos FROM o JOIN n USING (doc, section, t)) m USING (doc, section, pos) GROUP BY 1")
def reconcile_state(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    old = li.select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 2).cast("int").alias("section"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") % 50).cast("string").alias("text"))
    new = old.where("text <> '13'").withColumn("pos", F.col("pos") + 1000)
    return mutations.reconcile_report(mutations.reconcile_steps(old, new, old.select("doc", "section", "pos").distinct()))


# documents -----------------------------------------------------------------------------------------------------------


@query(sql("SELECT doc, key, count(DISTINCT page) AS on_pages, any_value(pages) AS pages FROM (SELECT e.*, CASE WHEN length(text) <= 4000 THEN trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) END AS key FROM (SELECT *, max(line_no) OVER (PARTITION BY doc, page) AS last_no FROM doc_lines) e WHERE line_no < greatest(floor((last_no + 1) * 0.12), 1) OR line_no > last_no - greatest(floor((last_no + 1) * 0.12), 1)) JOIN (SELECT doc, count(DISTINCT page) AS pages FROM doc_lines GROUP BY 1) USING (doc) WHERE key IS NOT NULL GROUP BY doc, key HAVING count(DISTINCT page) >= greatest(2, ceil(any_value(pages) / 10))", "doc_lines"))
def doc_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return documents.repeated_lines(S.document_lines(spark, d), one_in=10).select("doc", "key", "on_pages", "pages")


@query("SELECT doc_id, n >= 20 AND m >= n / 30.0 AS german FROM (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS n, len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda w: w IN (" + ", ".join(f"'{w}'" for w in documents.GERMAN) + "))) AS m FROM documents)")
def lang_german(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", documents.is_german(F.coalesce("text", F.lit(""))).alias("german"))


@query(sql("SELECT doc, sum(length(text)) / count(DISTINCT page) AS chars_per_page, sum(length(text)) / count(DISTINCT page) < 50 AS scanned FROM doc_lines GROUP BY 1", "doc_lines"))
def scanned_gate(spark: SparkSession, d: str) -> DataFrame:
    return documents.is_scanned(S.document_lines(spark, d))


_MARKERS = [("the", r"(?i)\bthe\b", 2.0), ("tion", "tion", 1.5), ("pipe", r" \| ", 0.5)]


@query("SELECT doc_id, 2.0 * CAST(regexp_matches(text, '(?i)\\bthe\\b') AS INT) + 1.5 * CAST(contains(text, 'tion') AS INT) + 0.5 * CAST(contains(text, ' | ') AS INT) AS score FROM documents")
def marker_score(spark: SparkSession, d: str) -> DataFrame:
    return documents.marker_score(table(spark, d, "documents"), _MARKERS).select("doc_id", "score")


#: The longest common subsequence of the lists a and b of a relation p (id, a, b): a row of the table for each element of a.
LCS = """r AS (SELECT id, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS row FROM p
        UNION ALL SELECT r.id, i + 1, list_transform(range(1, len(b) + 2), lambda j: greatest(row[j], coalesce(list_max(list_transform(list_filter(range(1, j), lambda k: b[k] = a[i + 1]), lambda k: row[k] + 1)), 0))) FROM r JOIN p ON p.id = r.id AND i < len(a)),
    n AS (SELECT p.id, len(a) AS la, len(b) AS lb, row[len(b) + 1] AS n FROM p JOIN r ON r.id = p.id AND r.i = len(a))"""
_OWN_LINES = "list_filter(list_transform(string_split(coalesce({}, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""WITH RECURSIVE p AS (SELECT x.doc_id AS id, {_OWN_LINES.format('x.text')} AS a, {_OWN_LINES.format('y.text')} AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1), {LCS}
    SELECT id AS doc_id, CASE WHEN la + lb = 0 THEN 1.0 ELSE floor(200000 * n / (la + lb) + 0.5) / 100000 END AS ratio, CAST(lb - n AS BIGINT) AS missing, CAST(la - n AS BIGINT) AS extra FROM n""")
def doc_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the one whose id is the next number; the pairs meet by a join on the id."""
    docs = table(spark, d, "documents")
    pairs = docs.select("doc_id", F.col("text").alias("a")).join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b")), "doc_id")
    return documents.similarity(pairs).select("doc_id", "ratio", "missing", "extra")


_TAGS = "</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav)\\b[^>]*>"
_PLAIN = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?i){_TAGS}', chr(10), 'g'), '<[^>]*>', '', 'g')"
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]
for _entity, _sign in _ENTITIES:
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_sign}')"


@query(f"""WITH h AS (SELECT nullif(lower(regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS doc, page_id AS page, list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS x FROM pages),
    l AS (SELECT doc, page, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS line_no FROM h),
    e AS (SELECT *, line_no < greatest(floor((last_no + 1) * 0.12), 1) OR line_no > last_no - greatest(floor((last_no + 1) * 0.12), 1) AS edge, CASE WHEN length(text) <= 4000 THEN trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) END AS key FROM (SELECT *, max(line_no) OVER (PARTITION BY doc, page) AS last_no FROM l)),
    p AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY 1), r AS (SELECT e.doc, key FROM e JOIN p ON p.doc = e.doc WHERE edge AND key IS NOT NULL GROUP BY e.doc, key, pages HAVING count(DISTINCT page) >= greatest(2, ceil(pages / 2.0)))
    SELECT e.doc, e.page, CAST(e.line_no AS INT) AS line_no, e.text FROM e LEFT JOIN r ON r.doc = e.doc AND r.key = e.key WHERE NOT edge OR r.key IS NULL""")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the raw web pages without those that repeat on the pages of their site (the host of the address)."""
    from loomspan.sources.tables import host, read_html_lines

    return documents.strip_boilerplate(read_html_lines(table(spark, d, "pages"), host(F.col("url"))))


@query(sql("""SELECT doc, page, CAST(paragraph AS BIGINT) AS paragraph, string_agg(text, ' ' ORDER BY line_no) AS text FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc, page ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS paragraph FROM (
    SELECT *, CASE WHEN before IS NOT NULL AND NOT regexp_matches(before, '[.!?:;]$') AND NOT regexp_matches(text, '^(\\p{Lu}|[-*•]|[0-9]+[.)])') AND length(before) >= 30 THEN 0 ELSE 1 END AS fresh
    FROM (SELECT *, lag(text) OVER (PARTITION BY doc, page ORDER BY line_no) AS before FROM doc_lines))) GROUP BY 1, 2, 3""", "doc_lines"))
def reflow_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return documents.reflow(S.document_lines(spark, d))


# more of activity, tools, progress and state --------------------------------------------------------------------------


@query(sql(f"SELECT project_id, min(d) AS start_day, greatest({REF}, max(d)) AS end_day FROM sessions WHERE project_id IN (SELECT id FROM projects) GROUP BY 1 UNION ALL SELECT id, {REF}, {REF} FROM projects WHERE id NOT IN (SELECT project_id FROM sessions)", "sessions", "projects").replace("SELECT project_id, min(d) AS start_day", f"SELECT project_id, least({REF}, min(d)) AS start_day"))
def project_windows(spark: SparkSession, d: str) -> DataFrame:
    p = S.projects(spark, d).withColumn("started_at", F.lit("2024-01-24")).withColumn("finished_at", F.lit(""))
    return activity.project_windows(p, S.sessions(spark, d), REF_DAY).select("project_id", "start_day", "end_day")


@query(sql(", r AS (SELECT project_id, d, d - CAST(row_number() OVER (PARTITION BY project_id ORDER BY d) AS INT) AS g FROM (SELECT DISTINCT project_id, d FROM sessions)), b AS (SELECT project_id, max(n) AS best FROM (SELECT project_id, g, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1) SELECT s.project_id, CAST(sum(duration_sec) AS BIGINT) AS total_sec, count(*) AS sessions, count(DISTINCT d) AS active_days, CAST(any_value(best) AS BIGINT) AS best_streak FROM sessions s JOIN projects p ON p.id = s.project_id JOIN b ON b.project_id = s.project_id GROUP BY 1", "sessions", "projects").replace("\n, r", ",\nr"))
def project_stats(spark: SparkSession, d: str) -> DataFrame:
    p = S.projects(spark, d).withColumn("started_at", F.lit("")).withColumn("finished_at", F.lit(""))
    return activity.project_stats(p, S.sessions(spark, d), REF_DAY).select("project_id", "total_sec", "sessions", "active_days", "best_streak")


@query(sql("SELECT count_if(status = 'wip') AS under_way, count_if(status = 'done') AS undated, CAST(0 AS BIGINT) AS finished FROM projects", "projects"))
def project_counts(spark: SparkSession, d: str) -> DataFrame:
    return activity.finished_in_window(S.projects(spark, d).withColumn("finished_at", F.lit("")), START, END)


@query(sql("SELECT status, id, place, CAST(rank AS INT) AS rank FROM (SELECT status, id, CASE status WHEN 'wip' THEN 1 ELSE 2 END AS place, row_number() OVER (PARTITION BY status ORDER BY name DESC, id) AS rank FROM projects WHERE status IN ('wip', 'done')) WHERE rank <= 3", "projects"))
def top_per_status(spark: SparkSession, d: str) -> DataFrame:
    return activity.top_per_status(S.projects(spark, d).withColumn("last_worked_at", F.col("name")), ["wip", "done"], 3)


@query("WITH t AS (SELECT user_id AS doc, event_id, event_type, ts FROM events) SELECT p.doc, p.event_id AS id, s.event_id AS section FROM (SELECT * FROM t WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM t WHERE event_type = 'signup') s ON p.doc = s.doc AND p.ts >= s.ts")
def as_of_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For each purchase the user's last signup at or before it."""
    e = table(spark, d, "events").select(F.col("user_id").alias("doc"), F.lit(0).alias("page"), F.col("ts").alias("y"), "event_id", "event_type")
    return documents.active_section(e.where("event_type = 'signup'").withColumnRenamed("event_id", "section"), e.where("event_type = 'purchase'").withColumnRenamed("event_id", "id"))


_SIZES = ", ".join(f"({mm}, {'NULL' if us is None else repr(us)}, {'NULL' if uk is None else repr(uk)})" for mm, us, uk in catalogues.KNITTING_SIZES)


@query(f"SELECT p_partkey AS id, s.us, s.uk FROM part LEFT JOIN (VALUES {_SIZES}) s(mm, us, uk) ON CAST(floor(p_size / 4.0 * 100 + 0.5) AS INT) = CAST(floor(s.mm * 100 + 0.5) AS INT)")
def size_equivalents(spark: SparkSession, d: str) -> DataFrame:
    return exports.with_equivalents(table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 4).alias("size_mm"))).select("id", "us", "uk")


@query("SELECT doc, section, pos, row_number() OVER (PARTITION BY doc, section ORDER BY pos) AS place, count(*) OVER (PARTITION BY doc, section) AS of FROM (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS section, l_partkey AS pos FROM lineitem WHERE l_returnflag <> 'R')")
def step_positions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    steps_ = li.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("section"), F.col("l_partkey").alias("pos")).distinct()
    return progress.step_positions(steps_.withColumn("note", F.lit(False))).select("doc", "section", "pos", F.col("place").cast("long").alias("place"), "of")


@query("SELECT l_orderkey AS doc, l_linenumber AS section, l_partkey AS copy FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity >= 40, l_quantity, l_partkey) = 1")
def working_copy(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return progress.working_copy(li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("section"), F.col("l_partkey").alias("copy"), F.col("l_quantity").alias("done"), F.lit(40.0).alias("total")))


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_nationkey < 10 UNION ALL SELECT c_name, CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey >= 10")
def merge_settings(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    snapshot = c.where("c_nationkey < 10").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    return mutations.merge_settings(snapshot, c.select(F.col("c_name").alias("key"), F.col("c_nationkey").cast("string").alias("value")), [])


_TYPED = "CASE WHEN length(text) <= 4000 AND regexp_matches(text, '(?i)^(notes?|nb|remarques?|hinweis|nota)\\s*:') THEN 'note' WHEN length(text) <= 4000 AND regexp_matches(text, '(?i)^(rows?|rnds?|rounds?|rangs?|tours?|reihen?|runden?|vueltas?|hileras?)\\s*\\d+') THEN 'row' ELSE 'text' END"


@query(sql(f"SELECT doc, {_TYPED} AS kind, count(*) AS n, count_if(length(text) <= 4000 AND len(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?')) >= 3 AND length(regexp_replace(text, '[^\\pL]', '', 'g')) <= len(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?')) * 4) AS tables FROM doc_lines GROUP BY 1, 2", "doc_lines"))
def line_types(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return S.document_lines(spark, d).groupBy("doc", steps.step_type(t).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(steps.table_row(t)).alias("tables"))


@query("SELECT doc_id AS doc, count_if(t LIKE '## %') AS sections, count_if(regexp_matches(t, '^[-*+]\\s+\\S')) AS bullets, count_if(t <> '') AS lines FROM (SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10))), ' ') AS t FROM documents) GROUP BY 1 HAVING count_if(t <> '') > 0")
def markdown_types(spark: SparkSession, d: str) -> DataFrame:
    parsed = steps.parse_markdown(table(spark, d, "documents"), "doc_id", "text")
    return parsed.groupBy("doc").agg(F.count_if(F.col("type") == "section").alias("sections"), F.count_if(F.col("type") == "bullet").alias("bullets"), F.count(F.lit(1)).alias("lines"))


@query("SELECT conv_id AS doc, turn, role, CASE WHEN count(*) OVER (PARTITION BY conv_id, role) > 1 THEN role || ' ' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) ELSE role END AS numbered FROM conversations")
def numbered_titles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.col("role").alias("title"))
    return documents.number_duplicates(c).select("doc", F.col("pos").alias("turn"), F.col("title").alias("role"), "numbered")


@query("SELECT o_orderkey AS doc, list_sort(list(l_quantity))[CAST(floor(count(*) / 2.0) AS INT) + 1] AS median FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_orderkey").alias("doc")).agg(documents.upper_median(F.collect_list("l_quantity")).alias("median"))


@query("SELECT o_custkey AS id, first_x, last_x, n FROM (SELECT o_custkey, g, min(x) AS first_x, max(x) AS last_x, count(*) AS n FROM (SELECT o_custkey, x, sum(f) OVER (PARTITION BY o_custkey ORDER BY x ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT o_custkey, o_totalprice AS x, CASE WHEN o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice) >= 20000 THEN 1 ELSE 0 END AS f FROM orders)) GROUP BY 1, 2)")
def value_gaps(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("x"))
    return layout.gaps(o, 20000.0, "id").select("id", "first_x", "last_x", "n")
