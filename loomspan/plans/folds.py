"""Named queries over folds with state, positioned text and documents put together, and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import assembly, dialect, headings, pages, reference, reflow, vectors
from loomspan.operators.documents import lines_of
from loomspan.plans import standins as S
from loomspan.plans.registry import query
from loomspan.plans.standins import table
from loomspan.streaming import timer

# timer and debounce ---------------------------------------------------------------------------------------------------


def commands(spark: SparkSession, d: str) -> DataFrame:
    """Events as commands of each user's timer."""
    name = F.element_at(F.create_map(*(F.lit(x) for x in ("signup", "open", "click", "play", "view", "pause", "purchase", "stop", "error", "discard"))), F.col("event_type"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("owner"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), name.alias("command"), (F.floor("value") % 3).cast("long").alias("project_id"), F.lit(0).cast("long").alias("section_id"))


@query()
def timer_writes(spark: SparkSession, d: str) -> DataFrame:
    """What the timers of all users write, by a replay of their commands."""
    return timer.replay_timer(commands(spark, d))


@query()
def timer_journal(spark: SparkSession, d: str) -> DataFrame:
    return timer.journal(timer.replay_timer(commands(spark, d)))


#: A burst of a user's events is due four hours after its last one, and a day after its first at the latest.
_QUIET, _LONGEST = 4 * 3_600_000, 24 * 3_600_000


@query(f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS ms, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
    r AS (SELECT key, n, ms AS first, ms AS last, 1 AS changes, value, CAST(NULL AS BIGINT) AS fired, CAST(NULL AS BIGINT) AS f_first, CAST(NULL AS INT) AS f_changes, CAST(NULL AS VARCHAR) AS f_value FROM e WHERE n = 1
          UNION ALL SELECT e.key, e.n, CASE WHEN due THEN e.ms ELSE r.first END, e.ms, CASE WHEN due THEN 1 ELSE r.changes + 1 END, e.value, CASE WHEN due THEN t END, CASE WHEN due THEN r.first END, CASE WHEN due THEN r.changes END, CASE WHEN due THEN r.value END
          FROM (SELECT *, least(last + {_QUIET}, first + {_LONGEST}) AS t FROM r) r JOIN e ON e.key = r.key AND e.n = r.n + 1, LATERAL (SELECT r.t <= e.ms AS due) x),
    f AS (SELECT key, fired, f_first AS first, f_changes AS changes, f_value AS value FROM r WHERE fired IS NOT NULL
          UNION ALL SELECT key, least(last + {_QUIET}, first + {_LONGEST}), first, changes, value FROM (SELECT *, max(n) OVER (PARTITION BY key) AS top FROM r) WHERE n = top)
    SELECT key, make_timestamp(fired * 1000) AS fired, make_timestamp(first * 1000) AS first, CAST(changes AS BIGINT) AS changes, value FROM f""")
def event_bursts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    out = timer.debounced(e, quiet_ms=_QUIET, longest_ms=_LONGEST)
    return out.withColumn("fired", F.col("fired").cast("timestamp_ntz")).withColumn("first", F.col("first").cast("timestamp_ntz"))


# positioned text ------------------------------------------------------------------------------------------------------


@query("""WITH i AS (SELECT l_orderkey AS doc, l_partkey % 600 AS x0, l_partkey % 600 + CAST(l_quantity AS INT) AS x1 FROM lineitem),
    u AS (SELECT DISTINCT doc, unnest(range(x0, x1)) AS x FROM i),
    s AS (SELECT doc, x, x - lag(x) OVER (PARTITION BY doc ORDER BY x) - 1 AS white FROM u),
    n AS (SELECT doc, x, sum(CASE WHEN white >= 48 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY x) AS strip FROM s)
    SELECT doc, 0 AS page, min(x) AS start, max(x) AS "end" FROM n GROUP BY doc, strip HAVING max(x) - min(x) + 1 >= 30""")
def page_strips(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as boxes on a page 600 units wide; strips between white of 48 units or more."""
    x = F.col("l_partkey") % 600
    boxes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(0).alias("page"), x.alias("x0"), (x + F.col("l_quantity").cast("int")).alias("x1"))
    return pages.strips(boxes, least=30)


def glyphs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order's supplier as glyph runs: three columns by part, rows by order."""
    page = F.floor(F.col("l_orderkey") / 4000).cast("int")
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), page.alias("page"), "l_orderkey", "l_partkey", "l_linenumber", "l_quantity").repartition("doc", "page").distinct()
    x = (F.col("l_partkey") % 4) * 140.0 + F.col("l_linenumber")
    return li.select("doc", "page", x.alias("x"), (40_000.0 - (F.col("l_orderkey") % 4000) * 9).alias("y"), (F.col("l_quantity") * 2).alias("w"), F.lit(10.0).alias("size"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"))


@query()
def page_column_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages in reading order, column by column."""
    return pages.page_lines(glyphs(spark, d))


# documents ------------------------------------------------------------------------------------------------------------


def wrapped(spark: SparkSession, d: str) -> DataFrame:
    """Documents set in lines of about 60 characters."""
    docs = table(spark, d, "documents").withColumn("text", F.regexp_replace("text", r"([^\n]{50,60}?)[ ]", "$1\n"))
    return lines_of(docs, "doc_id", "doc_id", "text")


@query()
def folded_lines(spark: SparkSession, d: str) -> DataFrame:
    """Logical lines of wrapped documents, by the fold over the text so far."""
    return reflow.reflow_lines(wrapped(spark, d), keys=("doc",)).select("doc", "line_no", "text", "lines")


@query()
def vector_lines(spark: SparkSession, d: str) -> DataFrame:
    """Size vectors in the lines of all documents."""
    found = vectors.size_vectors(lines_of(table(spark, d, "documents"), "doc_id", "doc_id", "text"))
    v = found.select("doc", "line_no", F.explode("vectors").alias("v"))
    return v.select("doc", "line_no", "v.start", F.col("v.end").alias("end"), "v.family", F.array_join("v.values", "|").alias("values"))


@query("""WITH t AS (SELECT user_id AS doc, event_id AS section, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, CAST(ts AS DATE) AS page, epoch(ts - date_trunc('day', ts)) AS down FROM events WHERE event_type = 'signup'),
    g AS (SELECT user_id AS doc, event_id AS grid, CAST(ts AS DATE) AS page, epoch(ts - date_trunc('day', ts)) AS down FROM events WHERE event_type = 'purchase'),
    a AS (SELECT g.doc, g.grid, g.page, g.down, max(t.position) AS after FROM g LEFT JOIN t ON t.doc = g.doc AND (t.page, t.down) <= (g.page, g.down) GROUP BY ALL),
    o AS (SELECT doc, 0 AS last, position AS after, 0 AS g, DATE '2000-01-01' AS page, 0.0 AS down, section, 'text' AS kind, NULL AS grid FROM t
          UNION ALL SELECT doc, (after IS NULL)::INT, after, 1, page, down, NULL, 'chart', grid FROM a)
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY last, after, g, page, down, grid) - 1 AS position, section, kind, grid FROM o""")
def promoted_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups as sections, a day as a page, purchases as charts between them."""
    e = table(spark, d, "events").select("event_type", F.col("user_id").alias("doc"), "event_id", F.to_date("ts").alias("page"), "ts")
    day = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.date_trunc("day", F.col("ts")).cast("timestamp"))
    placed = e.withColumn("y", -day.cast("double"))
    sections = assembly.renumber(placed.where("event_type = 'signup'"), "doc", ["ts", "event_id"]).withColumnRenamed("event_id", "section")
    grids = placed.where("event_type = 'purchase'").withColumnRenamed("event_id", "grid")
    return assembly.promote_grids(sections.withColumn("kind", F.lit("text")), sections, grids)


@query()
def placed_images(spark: SparkSession, d: str) -> DataFrame:
    """A picture in the middle of every document of a source, at the step it stands next to; steps are runs of three lines."""
    lines = S.document_lines(spark, d).withColumn("y", 100_000.0 - F.col("line_no"))
    section = F.floor(F.col("line_no") / 9)
    steps = lines.select("doc", F.concat_ws("/", F.col("page").cast("string"), section.cast("string")).alias("section"), (F.floor(F.col("line_no") / 3) % 3).cast("int").alias("step"), F.col("text").alias("line"))
    heads = lines.where("line_no % 9 = 0").select("doc", F.concat_ws("/", F.col("page").cast("string"), section.cast("string")).alias("section"), "page", "y")
    middle = lines.groupBy("doc", "page").agg(F.floor(F.max("line_no") / 2).alias("n"))
    images = middle.select("doc", F.col("page").alias("image"), "page", (100_000.0 - F.col("n")).alias("y"))
    return assembly.place_images(lines, steps, heads, images)


@query(r"""WITH l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL),
    c AS (SELECT conv_id AS doc, turn * 100000 + n AS line_no, CASE WHEN n = 1 THEN role END AS key, trim(regexp_replace(line, '\s{2,}', ' ', 'g')) AS said FROM l),
    w AS (SELECT *, key IS NOT NULL OR coalesce(regexp_matches(lag(said) OVER (PARTITION BY doc ORDER BY line_no), '[.!?]\s*$'), TRUE) AS opens FROM c WHERE said <> '' OR key IS NOT NULL),
    b AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc ORDER BY line_no) AS block FROM w),
    e AS (SELECT doc, min(line_no) AS line_no, max(key) AS key, string_agg(said, ' ' ORDER BY line_no) AS meaning FROM b GROUP BY doc, block HAVING max(key) IS NOT NULL),
    k AS (SELECT * FROM e WHERE (SELECT count(*) FROM e x WHERE x.doc = e.doc) >= 2)
    SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY line_no) AS INT) AS entry, line_no, key, meaning FROM k""")
def turn_glossary(spark: SparkSession, d: str) -> DataFrame:
    """Conversations set in two columns, the speaker left and what is said right, wrapped lines below."""
    c = table(spark, d, "conversations").where("role IS NOT NULL AND text IS NOT NULL").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    line_no = (F.col("turn") * 100_000 + F.col("n") + 1).alias("line_no")
    said = F.col("line")
    cells = c.where("n = 0").select(F.col("conv_id").alias("doc"), line_no, F.lit(40.0).alias("x"), F.col("role").alias("text")).unionByName(c.select(F.col("conv_id").alias("doc"), line_no, F.lit(120.0).alias("x"), said.alias("text")))
    return assembly.column_glossary(cells)


# what a document says about itself ------------------------------------------------------------------------------------

_MONTHS = "CASE WHEN o_orderstatus = 'F' THEN concat(month(o_orderdate), ' (', day(o_orderdate), ', ', year(o_orderdate) - 1990, ')') ELSE concat(lower(o_orderstatus), ' ', month(o_orderdate), ' ', day(o_orderdate)) END"


@query(f"""WITH l AS (SELECT o_custkey AS doc, o_orderkey AS n, o_orderstatus <> 'F' AS named, {_MONTHS} AS text FROM orders),
    d AS (SELECT doc, min(n) FILTER (named) AS first, count(*) FILTER (NOT named) AS vectors FROM l GROUP BY doc)
    SELECT d.doc, CASE WHEN first IS NOT NULL THEN 'line' WHEN vectors >= 3 THEN 'modal' ELSE 'none' END AS source,
           CASE WHEN first IS NOT NULL THEN replace(substr(l.text, 3), ' ', '|') WHEN vectors >= 3 THEN 'T1|T2|T3' ELSE '' END AS labels
    FROM d LEFT JOIN l ON l.doc = d.doc AND l.n = d.first""")
def size_label_sources(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as lines: status, month and day, or a vector of three for finished ones; two states count as size words."""
    lines = table(spark, d, "orders").selectExpr("o_custkey AS doc", "0 AS page", "o_orderkey AS line_no", f"{_MONTHS} AS text")
    return reference.size_labels(lines, words=("o", "p")).select("doc", "source", F.array_join("labels", "|").alias("labels"))


_TOLD = "CASE WHEN p_type = 'PROMO' THEN concat(split_part(p_name, ' ', 1), ' = ', replace(p_brand, '#', ' ')) ELSE concat(p_name, ' ', p_size, ' ', CASE p_type WHEN 'STANDARD' THEN 'cm' WHEN 'ECONOMY' THEN 'mm' WHEN 'MEDIUM' THEN 'g' WHEN 'LARGE' THEN 'yards' ELSE 'in' END) END"


@query(rf"""WITH l AS (SELECT CAST(floor(p_retailprice / 5) AS BIGINT) AS doc, p_partkey AS n, {_TOLD} AS text, p_type = 'PROMO' AS abbreviated FROM part),
    f AS (SELECT doc, n, text, CASE WHEN abbreviated THEN 'abbreviation' WHEN regexp_matches(text, '\b(ring|bolt)\b') AND regexp_matches(text, '\b([5-9] cm|1[0-9] in)\b') THEN 'gauge'
            WHEN regexp_matches(text, '\bgear\b') AND text LIKE '% mm' THEN 'needles' WHEN regexp_matches(text, '\b(widget|gizmo)\b') AND regexp_matches(text, ' (g|yards)$') THEN 'yarns' END AS field FROM l),
    t AS (SELECT doc, field, text, min(n) AS n FROM f WHERE field <> 'abbreviation' GROUP BY ALL),
    g AS (SELECT doc, string_agg(text, ' ' ORDER BY n) AS gauge FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n) - 1 AS i, min(n) OVER (PARTITION BY doc) AS first FROM t WHERE field = 'gauge') WHERE n = first + i GROUP BY doc),
    b AS (SELECT doc, string_agg(text, '|' ORDER BY n) FILTER (field = 'needles') AS needles, string_agg(text, '|' ORDER BY n) FILTER (field = 'yarns') AS yarns FROM t GROUP BY doc),
    a AS (SELECT doc, n, text, split_part(text, ' = ', 1) AS k, split_part(text, ' = ', 2) AS m FROM f WHERE field = 'abbreviation'),
    m AS (SELECT doc, k, min(n) AS n, arg_min(m, n) AS m FROM a GROUP BY doc, k),
    e AS (SELECT doc, string_agg(k || ' = ' || m, '|' ORDER BY n) AS abbreviations FROM m GROUP BY doc),
    o AS (SELECT a.doc, string_agg(a.text, '|' ORDER BY a.n) AS notes FROM a JOIN m ON a.doc = m.doc AND a.k = m.k WHERE lower(a.m) <> lower(m.m) GROUP BY a.doc)
    SELECT d.doc, coalesce(gauge, '') AS gauge, coalesce(needles, '') AS needles, coalesce(yarns, '') AS yarns, coalesce(abbreviations, '') AS abbreviations, coalesce(notes, '') AS notes
    FROM (SELECT doc FROM b UNION SELECT doc FROM e) d LEFT JOIN b ON b.doc = d.doc LEFT JOIN g ON g.doc = d.doc LEFT JOIN e ON e.doc = d.doc LEFT JOIN o ON o.doc = d.doc""")
def reference_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one price level as a document's lines: name, size and a unit, or a short name and a brand; nouns of the names are the
    words, and any small swatch will do."""
    words = reference.Words(
        stitches=("ring", "bolt"), needles=("gear",), fibres=("widget", "gizmo"), amounts=("g", "yards"), labels=(),
        swatches=(*((float(n), "cm") for n in range(5, 10)), *((float(n), "in") for n in range(10, 20))),
    )
    lines = table(spark, d, "part").selectExpr("CAST(floor(p_retailprice / 5) AS BIGINT) AS doc", "0 AS page", "p_partkey AS line_no", f"{_TOLD} AS text")
    return reference.reference_block(lines, words).select("doc", "gauge", *(F.array_join(c, "|").alias(c) for c in ("needles", "yarns", "abbreviations", "notes")))


# titles, sections, noise ----------------------------------------------------------------------------------------------


def set_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents, set the larger the shorter they are; those that begin with a capital D are bold, with an E italic."""
    lines = lines_of(table(spark, d, "documents"), "doc_id", "doc_id", "text")
    t = F.col("text")
    return lines.withColumn("size", 20.0 - F.least(F.floor(F.length(t) / 10), F.lit(10)).cast("double")).withColumn("bold", t.startswith("D")).withColumn("italic", t.startswith("E")).withColumn("y", 100_000.0 - F.col("line_no") * 15)


_SET = r"""l AS (SELECT doc_id AS doc, doc_id AS page, n - 1 AS line_no, body AS text, 20.0 - least(floor(length(body) / 10), 10) AS size FROM (SELECT doc_id, trim(unnest(string_split_regex(coalesce(text, ''), '\r?\n')), ' ') AS body,
        generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) AS n FROM documents) WHERE body <> ''),
    b AS (SELECT doc, arg_max(size, (n, -size)) AS body FROM (SELECT doc, size, sum(length(text)) AS n FROM l GROUP BY ALL) GROUP BY doc),
    t AS (SELECT l.*, length(text) BETWEEN 3 AND 42 AND NOT regexp_matches(text, '[.!?]$') AND length(regexp_replace(text, '[^\pL]', '', 'g')) >= 2 AND NOT regexp_matches(lower(text), '[0-9]\s*mm\b.*:$')
            AND NOT (text LIKE '(%' AND text LIKE '%)') AND NOT text LIKE 'E%' AND (text LIKE 'D%' OR (text = upper(text) AND text <> lower(text)) OR size >= body * 1.15)
            AND NOT regexp_matches(text, '(?i)^(rows?|rnds?|rounds?|rangs?|tours?|reihen?|runden?|vueltas?|hileras?)\s*\d+')
            AND NOT (len(regexp_extract_all(text, '\d+(?:[.,]\d+)?')) >= 3 AND length(regexp_replace(text, '[^\pL]', '', 'g')) <= 4 * len(regexp_extract_all(text, '\d+(?:[.,]\d+)?'))) AS title FROM l JOIN b ON b.doc = l.doc),
    a AS (SELECT *, title AND coalesce(lag(title) OVER w, FALSE) AND line_no = lag(line_no) OVER w + 1 AND 15 <= 2.0 * size AND abs(size - lag(size) OVER w) <= 0.1 * size AS more FROM t WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
    s AS (SELECT *, sum((title AND NOT coalesce(more, FALSE))::INT) OVER (PARTITION BY doc ORDER BY line_no) AS section FROM a),
    g AS (SELECT doc, section, coalesce(string_agg(text, ' ' ORDER BY line_no) FILTER (title), '') AS title, count_if(NOT title) AS lines FROM s GROUP BY doc, section)"""


@query(f"WITH {_SET} SELECT doc, section, title, lines FROM g x WHERE lines > 0 OR section = (SELECT max(section) FROM g y WHERE y.doc = x.doc AND lower(y.title) = lower(x.title))")
def section_titles(spark: SparkSession, d: str) -> DataFrame:
    """Sections of all documents by the size of their lines."""
    return headings.section_list(headings.sections(set_lines(spark, d))).select("doc", F.col("section").cast("decimal(38,0)").cast("long").alias("section"), "title", F.col("lines").cast("long").alias("lines"))


def noisy_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a source as a document's: lines of up to 40 characters stand in the right column, all of them 15 units apart."""
    lines = S.document_lines(spark, d)
    return lines.withColumn("right", F.length("text") <= 40).withColumn("y", 100_000.0 - F.col("line_no") * 15)


@query()
def noiseless_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents without heads, captions and broken addresses."""
    return headings.strip_noise(noisy_lines(spark, d), one_in=10, tails=[("here", "click")]).select("doc", "page", "line_no", "text")


# documents as structure -----------------------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT doc_id AS doc, n - 1 AS pos, line FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) AS n FROM documents)),
    f AS (SELECT *, trim(line) AS t, max((pos = 0 AND trim(line) = '---')::INT) OVER w AS fenced, sum((trim(line) = '---')::INT) OVER w AS dashes FROM l WINDOW w AS (PARTITION BY doc ORDER BY pos)),
    b AS (SELECT doc, pos, t, CASE WHEN regexp_matches(t, '^##\s+\S') THEN 'section' WHEN regexp_matches(t, '^#\s+\S') THEN 'title' WHEN regexp_matches(t, '^!\[[^\]]*\]\([^)]+\)$') THEN 'image' ELSE 'step' END AS type FROM f WHERE t <> '' AND NOT (fenced = 1 AND (dashes < 2 OR dashes = 2 AND t = '---'))),
    s AS (SELECT *, sum((type = 'section')::INT) OVER (PARTITION BY doc ORDER BY pos) AS section FROM b),
    g AS (SELECT doc, section, count_if(type = 'step') AS steps, count_if(type = 'image') AS images, bool_or(type = 'section') AS headed FROM s GROUP BY ALL),
    k AS (SELECT doc, count(*) AS sections, sum(steps) AS steps, sum(images) AS images FROM g WHERE headed OR steps > 0 OR images > 0 GROUP BY doc)
    SELECT doc_id AS doc, coalesce(sections, 0)::INT AS sections, coalesce(steps, 0)::INT AS steps, coalesce(images, 0)::INT AS images FROM documents LEFT JOIN k ON k.doc = doc_id""")
def nested_sections(spark: SparkSession, d: str) -> DataFrame:
    """How many sections, steps and images the tree of every document has."""
    tree = dialect.nested_documents(table(spark, d, "documents"), "doc_id")
    total = lambda part: F.aggregate("sections", F.lit(0), lambda n, s: n + F.size(s[part]))
    return tree.select("doc", F.size("sections").alias("sections"), total("steps").alias("steps"), total("images").alias("images"))


@query(r"""WITH l AS (SELECT doc_id AS doc, n - 1 AS line_no, trim(line, ' ') AS t FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) AS n FROM documents)),
    h AS (SELECT doc, line_no, regexp_extract_all(regexp_replace(t, '[^\pL\pN_]', ' ', 'g'), '[\pL\pN_]+') AS w FROM l WHERE t <> '')
    SELECT doc, line_no, len(list_filter(w, lambda x: x IN ('the', 'of', 'de', 'la', 'der', 'und')))::INT AS abbreviations FROM h WHERE len(list_filter(w, lambda x: x IN ('the', 'of', 'de', 'la', 'der', 'und'))) > 0""")
def abbreviated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents with small words in the part of abbreviations, and how many tokens these are."""
    docs = table(spark, d, "documents")
    keys = docs.select(F.col("doc_id").alias("doc"), F.explode(F.array(*map(F.lit, ("the", "of", "de", "la", "der", "und")))).alias("abbreviation"))
    lines = lines_of(docs, "doc_id", "doc_id", "text").select("doc", "line_no", F.col("text").alias("t"), F.array().cast("array<array<string>>").alias("c"))
    found = dialect.tokenized(lines, keys)
    return found.select("doc", "line_no", F.size(F.filter("tokens", lambda t: t["type"] == "abbr")).alias("abbreviations")).where("abbreviations > 0")
