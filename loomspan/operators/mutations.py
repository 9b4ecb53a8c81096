"""Versioned tables: cascades with undo, trash, snapshot merge, change detection, state carried over to a new version
(inventory A11, A12, A15, A20-A25, A33, C29-C34, D42, G4, G5, K1-K7, K16-K28).

Nothing is updated in place: each function returns the relations that replace the old ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import trailing_id


def split_cascade(tables: dict[str, DataFrame], removed: DataFrame, key: str = "project_id") -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """What stays and what goes with the removed keys, for each child table (K1); the second part is the undo bundle."""
    gone = removed.select(key).distinct()
    return {n: t.join(gone, key, "left_anti") for n, t in tables.items()}, {n: t.join(gone, key, "left_semi") for n, t in tables.items()}


def restore_cascade(tables: dict[str, DataFrame], bundle: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Put a bundle back, ids kept; rows that are there already stay as they are (K2, K5)."""
    return {n: t.unionByName(bundle[n].join(t.select("id"), "id", "left_anti")) if n in bundle else t for n, t in tables.items()}


def cascade_counts(tables: dict[str, DataFrame], removed: DataFrame, key: str = "project_id") -> DataFrame:
    """Rows that stay and go, a table."""
    gone = removed.select(key).distinct().withColumn("gone", F.lit(True))
    out = None
    for name, t in tables.items():
        part = t.join(gone, key, "left").agg(F.count_if(F.col("gone").isNull()).alias("kept"), F.count("gone").alias("removed")).select(F.lit(name).alias("relation"), "kept", "removed")
        out = part if out is None else out.unionByName(part)
    return out


def to_trash(live: DataFrame, ids: DataFrame, kind: str, deleted_at: Column) -> tuple[DataFrame, DataFrame]:
    """Rows move to the trash with their whole payload as JSON (K4)."""
    gone = ids.select("id").distinct()
    payload = F.to_json(F.struct(*live.columns))
    trash = live.join(gone, "id", "left_semi").select(F.col("id").alias("item_id"), F.lit(kind).alias("type"), deleted_at.alias("deleted_at"), payload.alias("payload"))
    return live.join(gone, "id", "left_anti"), trash


def from_trash(trash: DataFrame, live: DataFrame, kind: str) -> DataFrame:
    """Rows of the trash back in the shape of ``live`` (K5)."""
    back = trash.where(F.col("type") == kind).select(F.from_json("payload", live.schema).alias("r")).select("r.*")
    return live.unionByName(back.join(live.select("id"), "id", "left_anti"))


def orphan(lines: DataFrame, gone: DataFrame, key: str = "yarn_id") -> DataFrame:
    """Lines keep their money and lose their reference when its target is dropped for good (K6, K7)."""
    marked = gone.select(F.col("id").alias(key)).distinct().withColumn("_gone", F.lit(True))
    return lines.join(marked, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def relink_reservations(wanted: DataFrame, free: DataFrame) -> DataFrame:
    """Reservations given back to a restored project, clamped to what is free, with the shortfall (K3)."""
    got = F.least("quantity", F.greatest(F.coalesce("available", F.lit(0.0)), F.lit(0.0)))
    return wanted.join(free, "yarn_id", "left").withColumn("granted", got).withColumn("short", F.col("quantity") - F.col("granted")).drop("available")


def merge_settings(snapshot: DataFrame, current: DataFrame, excluded: list[str]) -> DataFrame:
    """Snapshot values win, other keys stay; excluded keys are never taken over."""
    taken = snapshot.where(~F.col("key").isin(excluded))
    return taken.unionByName(current.join(taken.select("key"), "key", "left_anti"))


def valid_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a whole-number id, and the rejected ones with a code."""
    number = F.col("id").cast("string").try_cast("double")
    good = F.coalesce(number.isNotNull() & (number == F.floor(number)), F.lit(False))
    return rows.where(good), rows.where(~good).withColumn("code", F.lit("bad_id"))


def snapshot_ids(active: DataFrame, trash: DataFrame) -> DataFrame:
    """Ids whose files must be kept: active or in the trash."""
    return active.select("id").union(trash.select("id")).distinct()


def changed_entries(external: DataFrame, witness: DataFrame) -> DataFrame:
    """Entries whose content differs from the one last seen, or was never seen."""
    now = external.select("id", F.xxhash64("content").alias("now"))
    return now.join(witness.select("id", "hash"), "id", "left").where(~F.col("now").eqNullSafe(F.col("hash"))).select("id", "now")


def merge_fields(live: DataFrame, external: DataFrame, taken: list[str], if_not_blank: list[str]) -> DataFrame:
    """Field-wise merge: some fields come from outside where present, some only where not blank, all others stay."""
    ext = external.select("id", *(F.col(c).alias(f"_{c}") for c in taken + if_not_blank))
    out = live.join(ext, "id", "left")
    for c in taken:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    for c in if_not_blank:
        out = out.withColumn(c, F.coalesce(F.nullif(F.trim(f"_{c}"), F.lit("")), c))
    return out.select(*live.columns)


def reconcile_steps(old: DataFrame, new: DataFrame, done: DataFrame) -> DataFrame:
    """Done steps carried to a new version.

    ``old`` and ``new`` have doc, section, pos and text; ``done`` has doc, section and pos.  A step is carried if its text is unique in
    its section on both sides; the result has the new position or null for what is lost.
    """
    key = ["doc", "section", "text"]
    once = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias(name)).where("n = 1").drop("n")
    match = once(old, "pos").join(once(new, "new_pos"), key).select("doc", "section", "pos", "new_pos")
    return done.join(match, ["doc", "section", "pos"], "left")


def reconcile_report(carried: DataFrame) -> DataFrame:
    """Kept and lost steps a document."""
    counts = carried.groupBy("doc").agg(F.count("new_pos").alias("kept"), F.count_if(F.col("new_pos").isNull()).alias("lost"))
    return counts.withColumn("show", F.when(F.col("lost") > 0, "modal").when(F.col("kept") > 0, "snackbar").otherwise("none"))


def fork(patterns: DataFrame, new_ids: DataFrame) -> DataFrame:
    """Copies for projects: own id, price gone, lineage to the first source."""
    src = patterns.join(new_ids.withColumnRenamed("id", "_new").withColumnRenamed("source_id", "id"), "id")
    return src.withColumn("source_pattern_id", F.coalesce("source_pattern_id", "id")).withColumn("price", F.lit(None).cast("string")).withColumn("id", F.col("_new")).drop("_new")


def replace_children(children: DataFrame, fresh: DataFrame, key: str = "project_id") -> DataFrame:
    """Children of the keys in ``fresh`` replaced by it, numbered in order."""
    order = Window.partitionBy(key).orderBy("position")
    numbered = fresh.withColumn("position", F.row_number().over(order) - 1)
    return children.join(fresh.select(key).distinct(), key, "left_anti").unionByName(numbered)


def nested(parents: DataFrame, **children: DataFrame) -> DataFrame:
    """Parents with each child table as an array of structs, joined once a table."""
    for name, child in children.items():
        rows = child.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("id", *(c for c in child.columns if c not in ("id", "project_id"))))).alias(name))
        parents = parents.join(rows.withColumnRenamed("project_id", "id"), "id", "left")
    return parents


def get_setting(settings: DataFrame, key: str) -> DataFrame:
    """The value under a key, pushed to the scan as a filter."""
    return settings.where(F.col("key") == key).select("value")


def set_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """Keys and values with the changed ones replaced or added."""
    return settings.join(changes.select("key"), "key", "left_anti").unionByName(changes.select("key", "value"))


def resolve_references(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """Archive entry of each reference: inline ones stay as they are, others by their exact path, then by their file name
    (of equally named entries the last path); ``missing`` marks what an archive lacks (A33).

    ``refs`` has ref; ``entries`` has path."""
    base = lambda c: F.substring_index(c, "/", -1)
    by_path = entries.select(F.col("path").alias("ref"), F.col("path").alias("_exact")).distinct()
    by_base = entries.groupBy(base(F.col("path")).alias("_base")).agg(F.max("path").alias("_named"))
    inline = F.startswith(F.col("ref"), F.lit("data:"))
    found = F.when(inline, F.col("ref")).otherwise(F.coalesce("_exact", "_named"))
    joined = refs.withColumn("_base", base(F.col("ref"))).join(by_path, "ref", "left").join(by_base, "_base", "left")
    return joined.withColumn("resolved", found).withColumn("missing", F.col("ref").isNotNull() & F.col("resolved").isNull()).drop("_base", "_exact", "_named")


def name_index(names: DataFrame) -> DataFrame:
    """id and name of entry folders by the number in their name; of folders with one number the first listed.
    ``names`` has name, pos and is_dir."""
    numbered = names.where("is_dir").withColumn("id", trailing_id(F.col("name"))).where("id IS NOT NULL")
    return numbered.groupBy("id").agg(F.min_by("name", "pos").alias("name"))


def backfill_readers(patterns: DataFrame, reader: Column) -> DataFrame:
    """Older patterns with the fields that later ones have: reader, pdf, gallery, cover_index; ``changed`` tells which rows
    differ, and a second run changes none (K22)."""
    fills = {"reader": reader, "pdf": F.lit(""), "gallery": F.array().cast("array<string>"), "cover_index": F.lit(0)}
    changed = F.lit(False)
    for c in fills:
        changed = changed | F.col(c).isNull()
    return patterns.withColumn("changed", changed).withColumns({c: F.coalesce(F.col(c), v) for c, v in fills.items()})


#: A merge is refused if less than this share of sections or steps is left, or with more warnings than this.
LEAST_LEFT, MOST_WARNINGS = 0.5, 10


def merge_veto() -> Column:
    """Why an outside version must not replace the inner one: null if it may, else the first of no_sections,
    fewer_sections, fewer_steps, too_many_warnings.  Reads sections, steps, live_sections, live_steps and warnings (K26)."""
    s, t, u, v = (F.coalesce(c, F.lit(0)) for c in ("sections", "live_sections", "steps", "live_steps"))
    return (
        F.when((s == 0) & (t > 0), "no_sections").when((t > 0) & (s < t * LEAST_LEFT), "fewer_sections")
        .when((v > 0) & (u < v * LEAST_LEFT), "fewer_steps").when(F.coalesce("warnings", F.lit(0)) > MOST_WARNINGS, "too_many_warnings")
    )


def sync_documents(external: DataFrame, live: DataFrame) -> DataFrame:
    """What happens to each outside document, and the witness to store.

    ``external`` has id, content_hash, disk_hash (the witness stored beside it), sections, steps, warnings; ``live`` has id,
    sync_hash, live_sections, live_steps.  ``aligned``: the database's witness says so; ``healed``: only the one beside it
    does, and the database's is set; ``orphan``: nothing to merge into; ``vetoed`` with the reason, no witness changes;
    ``merged``: the outside version is taken and both witnesses become its hash.
    """
    both = external.join(live.withColumn("_live", F.lit(True)), "id", "left")
    action = (
        F.when(F.col("_live") & F.col("sync_hash").eqNullSafe(F.col("content_hash")), "aligned")
        .when(F.col("disk_hash").eqNullSafe(F.col("content_hash")), F.when(F.col("_live"), "healed").otherwise("aligned"))
        .when(F.col("_live").isNull(), "orphan").when(merge_veto().isNotNull(), "vetoed").otherwise("merged")
    )
    out = both.withColumn("action", action)
    return out.select("id", "action", F.when(F.col("action") == "vetoed", merge_veto()).alias("reason"), F.when(F.col("action").isin("healed", "merged"), F.col("content_hash")).otherwise(F.col("sync_hash")).alias("sync_hash"))
