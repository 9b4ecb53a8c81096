"""Activity log: days, dense calendar, streaks, rankings (inventory B17-B20, B29, C1-C3, D1-D16, E1-E15).

A session row has ``project_id``, ``started`` (timestamp) and ``duration_sec``.  Every function that takes sessions reduces
them by day first, so what is windowed or joined afterwards has one row a day (and project), however long the log is.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import dates

DEFAULT_TECHNIQUE = "knitting"


def level(seconds: Column) -> Column:
    """0, then up to 30 minutes, an hour, two hours, and beyond; left ends included."""
    s = F.coalesce(seconds, F.lit(0))
    return F.when(s <= 0, 0).when(s < 1800, 1).when(s < 3600, 2).when(s < 7200, 3).otherwise(4)


def with_day(sessions: DataFrame, last_year: int, zone: str | None = None) -> DataFrame:
    """Adds ``day``; rows without a plausible day go (I8)."""
    return sessions.withColumn("day", dates.local_day(F.col("started"), zone)).where(dates.plausible(F.col("day"), last_year))


def by_day(sessions: DataFrame, last_year: int, *keys: str) -> DataFrame:
    """Seconds, sessions and last start a day, and a key such as the project."""
    return with_day(sessions, last_year).groupBy("day", *keys).agg(
        F.sum(F.coalesce("duration_sec", F.lit(0))).alias("total_sec"), F.count(F.lit(1)).alias("sessions"), F.max("started").alias("last_start")
    )


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row a day, at most the last 520 weeks before ``end``."""
    days = min((end - start).days + 1, dates.LONGEST_WEEKS * 7)
    return spark.range(max(days, 0)).select(F.date_sub(F.lit(end), F.col("id").cast("int")).alias("day"))


def activity_calendar(sessions: DataFrame, ref_day: date, period: str = "quarter", first_day: int = 1) -> DataFrame:
    """The dense grid: every day of whole weeks, gaps zero, days after ``ref_day`` flagged and zero."""
    start, _ = dates.window_bounds(ref_day, period, first_day)
    last = dates.window_bounds(ref_day, "month", first_day)[0].toordinal() + 7 * (dates.WINDOW_WEEKS["month"] - 1) + 6
    daily = by_day(sessions.where(F.col("started").cast("date").between(F.lit(start), F.lit(ref_day))), ref_day.year + 1)
    future = F.col("day") > F.lit(ref_day)
    return (
        calendar(sessions.sparkSession, start, date.fromordinal(last)).join(daily, "day", "left")
        .select(
            "day", dates.week_start(F.col("day"), first_day).alias("week"), dates.weekday_index(F.col("day"), first_day).alias("weekday"),
            F.when(future, 0).otherwise(F.coalesce("total_sec", F.lit(0))).cast("long").alias("total_sec"),
            F.when(future, 0).otherwise(F.coalesce("sessions", F.lit(0))).cast("long").alias("sessions"),
            F.when(future, 0).otherwise(level(F.col("total_sec"))).cast("int").alias("level"), future.alias("future"),
        )
    )


def month_groups(grid: DataFrame) -> DataFrame:
    """Runs of weeks that start in one month, with their length."""
    weeks = grid.select("week").distinct().withColumn("month", F.date_format("week", "yyyy-MM"))
    return weeks.groupBy("month").agg(F.min("week").alias("first_week"), F.count(F.lit(1)).alias("weeks"))


def recent_weeks(grid: DataFrame, most: int) -> DataFrame:
    """The last weeks of a grid."""
    return grid.join(grid.select("week").distinct().orderBy(F.desc("week")).limit(most), "week", "left_semi")


def by_period(sessions: DataFrame, granularity: str, last_year: int, first_day: int = 1) -> DataFrame:
    """Seconds a week, month or year."""
    day = F.col("day")
    return (
        by_day(sessions, last_year)
        .groupBy(dates.period_key(day, granularity, first_day).alias("period"), dates.period_start(day, granularity, first_day).alias("start_day"))
        .agg(F.sum("total_sec").alias("total_sec"))
    )


def seconds_since(sessions: DataFrame, instant: Column) -> DataFrame:
    """Seconds of sessions that start at or after an instant."""
    return sessions.where(F.col("started") >= instant).agg(F.coalesce(F.sum("duration_sec"), F.lit(0)).cast("long").alias("total_sec"))


def in_window(daily: DataFrame, start: date, end: date) -> DataFrame:
    """Days within the closed interval."""
    return daily.where(F.col("day").between(F.lit(start), F.lit(end)))


def weekday_totals(daily: DataFrame, first_day: int = 1) -> DataFrame:
    """Seconds by weekday, all seven present."""
    totals = daily.groupBy(dates.weekday_index(F.col("day"), first_day).alias("weekday")).agg(F.sum("total_sec").alias("s"))
    week = daily.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    return week.join(totals, "weekday", "left").select("weekday", F.coalesce("s", F.lit(0)).cast("long").alias("total_sec"))


def best_weekday(daily: DataFrame, first_day: int = 1) -> DataFrame:
    """Weekday with most seconds, the lowest of equals; null if there are none."""
    top = F.max(F.when(F.col("total_sec") > 0, F.struct("total_sec", (-F.col("weekday")).alias("k"))))
    return weekday_totals(daily, first_day).agg(top.alias("t")).select((-F.col("t.k")).alias("weekday"), F.col("t.total_sec").alias("total_sec"))


def best_day(daily: DataFrame) -> DataFrame:
    """Day with most seconds, the latest of equals."""
    top = F.max(F.when(F.col("total_sec") > 0, F.struct("total_sec", "day")))
    return daily.agg(top.alias("t")).select("t.day", "t.total_sec")


def day_set(*relations: DataFrame) -> DataFrame:
    """Distinct days of several relations."""
    out = relations[0].select("day")
    for r in relations[1:]:
        out = out.union(r.select("day"))
    return out.distinct()


def active_share(daily: DataFrame, days: DataFrame, start: date, end: date) -> DataFrame:
    """Active and elapsed days, and average seconds an active day: null, not 0, without any."""
    active = in_window(days, start, end).agg(F.count(F.lit(1)).alias("active_days"))
    total = in_window(daily, start, end).agg(F.coalesce(F.sum("total_sec"), F.lit(0)).cast("long").alias("total_sec"))
    average = F.when((F.col("active_days") > 0) & (F.col("total_sec") > 0), F.floor(F.col("total_sec") / F.col("active_days") + 0.5)).cast("long")
    return active.crossJoin(total).select("active_days", F.lit((end - start).days + 1).cast("long").alias("elapsed_days"), "total_sec", average.alias("average_sec"))


def unexplained_days(days: DataFrame, filtered_daily: DataFrame) -> DataFrame:
    """Active days that no filtered session explains; an average over them would mislead."""
    return days.join(filtered_daily.select("day"), "day", "left_anti")


def _islands(days: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Runs of consecutive days: first, last and length."""
    order = Window.partitionBy(*keys).orderBy("day")
    return (
        days.select(*keys, "day").distinct().withColumn("run", F.date_sub("day", F.row_number().over(order)))
        .groupBy(*keys, "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("length"))
    )


def current_streak(days: DataFrame, ref_day: date, *keys: str) -> DataFrame:
    """Length of the run that ends on ``ref_day`` or the day before; 0 if none does."""
    alive = (F.col("last_day") >= F.date_sub(F.lit(ref_day), 1)).cast("long")
    runs = _islands(days.where(F.col("day") <= F.lit(ref_day)), keys)
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.col("length") * alive), F.lit(0)).cast("long").alias("streak"))


def longest_streak(days: DataFrame, *keys: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Longest run, cut at the window's edges if one is given."""
    if start and end:
        days = in_window(days, start, end)
    return _islands(days, keys).groupBy(*keys).agg(F.coalesce(F.max("length"), F.lit(0)).cast("long").alias("streak"))


def top_project(daily_projects: DataFrame) -> DataFrame:
    """Project with most seconds; of equals the one worked on last, then the lowest id."""
    totals = daily_projects.groupBy("project_id").agg(F.sum("total_sec").alias("total_sec"), F.max("last_start").alias("last_start"))
    return totals.where("total_sec > 0").orderBy(F.desc("total_sec"), F.desc("last_start"), "project_id").limit(1)


def technique_of(technique: Column) -> Column:
    return F.coalesce(F.nullif(technique, F.lit("")), F.lit(DEFAULT_TECHNIQUE))


def filter_technique(sessions: DataFrame, projects: DataFrame, technique: str) -> DataFrame:
    """Sessions of projects of one technique; sessions without project only under ``all``."""
    if technique in ("", "all"):
        return sessions
    return sessions.join(filter_projects(projects, technique).select(F.col("id").alias("project_id")), "project_id", "left_semi")


def filter_projects(projects: DataFrame, technique: str) -> DataFrame:
    """(B18, B20)"""
    return projects if technique in ("", "all") else projects.where(technique_of(F.col("technique")) == technique)


def both_techniques(projects: DataFrame) -> DataFrame:
    """Whether the whole collection holds both techniques."""
    crochet = technique_of(F.col("technique")) == "crochet"
    return projects.agg((F.coalesce(F.max(crochet), F.lit(False)) & F.coalesce(F.max(~crochet), F.lit(False))).alias("shown"))


def recent_sessions(sessions: DataFrame, projects: DataFrame, most: int | None = None) -> DataFrame:
    """Sessions with project names ("" if the project is gone), latest first, undated last."""
    named = sessions.join(projects.select(F.col("id").alias("project_id"), "name"), "project_id", "left").withColumn("name", F.coalesce("name", F.lit("")))
    return named.orderBy(F.desc_nulls_last("started"), F.desc("id")).limit(most) if most else named


def day_detail(daily_projects: DataFrame, projects: DataFrame) -> DataFrame:
    """Seconds a day and project with the name, and whether the project is gone."""
    names = projects.select(F.col("id").alias("project_id"), "name", F.lit(True).alias("there"))
    return daily_projects.join(names, "project_id", "left").select("day", "project_id", "total_sec", "sessions", F.coalesce("name", F.lit("")).alias("name"), F.col("there").isNull().alias("orphan"))


def last_timed_session(sessions: DataFrame) -> DataFrame:
    """Last session of each project that was not entered by hand."""
    last = F.max(F.struct("started", "id", "duration_sec")).alias("s")
    return sessions.where(~F.coalesce("manual", F.lit(False))).groupBy("project_id").agg(last).select("project_id", "s.id", "s.started", "s.duration_sec")


def project_windows(projects: DataFrame, sessions: DataFrame, ref_day: date, first_day: int = 1) -> DataFrame:
    """Life of each project, declared and widened to its sessions, and its number of weeks."""
    span = with_day(sessions, ref_day.year + 1).groupBy("project_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    begin, finish = (dates.declared_day(F.col(c), ref_day.year + 1) for c in ("started_at", "finished_at"))
    start = F.least(F.coalesce(begin, "lo", F.lit(ref_day)), F.col("lo"))
    end = F.greatest(F.coalesce(finish, F.lit(ref_day)), F.col("hi"))
    weeks = F.least(F.datediff(dates.week_start(F.col("end_day"), first_day), dates.week_start(F.col("start_day"), first_day)) / 7 + 1, F.lit(dates.LONGEST_WEEKS))
    return projects.select(F.col("id").alias("project_id"), "started_at", "finished_at").join(span, "project_id", "left").select("project_id", start.alias("start_day"), end.alias("end_day")).withColumn("weeks", weeks.cast("int"))


def project_stats(projects: DataFrame, sessions: DataFrame, ref_day: date) -> DataFrame:
    """Seconds, sessions, active days and best streak within each project's window."""
    daily = by_day(sessions, ref_day.year + 1, "project_id")
    inside = daily.join(project_windows(projects, sessions, ref_day), "project_id").where(F.col("day").between(F.col("start_day"), F.col("end_day")))
    totals = inside.groupBy("project_id", "start_day", "end_day").agg(F.sum("total_sec").alias("total_sec"), F.sum("sessions").alias("sessions"), F.count(F.lit(1)).alias("active_days"))
    return totals.join(longest_streak(inside, "project_id").withColumnRenamed("streak", "best_streak"), "project_id")


def finished_in_window(projects: DataFrame, start: date, end: date) -> DataFrame:
    """Projects finished within the window, finished ones without date, and ones under way."""
    day = dates.declared_day(F.col("finished_at"), end.year + 1)
    done = F.col("status") == "done"
    return projects.agg(
        F.count_if(done & day.between(F.lit(start), F.lit(end))).alias("finished"), F.count_if(done & day.isNull()).alias("undated"), F.count_if(F.col("status") == "wip").alias("under_way")
    )


def last_project(projects: DataFrame) -> DataFrame:
    """The project under way worked on last."""
    return projects.where("status = 'wip'").orderBy(F.desc_nulls_last("last_worked_at"), F.desc_nulls_last("updated_at"), "id").limit(1)


def top_per_status(projects: DataFrame, order: list[str], most: int = 3) -> DataFrame:
    """The latest few of every status, statuses in their fixed order."""
    rank = F.row_number().over(Window.partitionBy("status").orderBy(F.desc_nulls_last("last_worked_at"), "id"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    return projects.where(F.col("status").isin(order)).select("status", "id", place.cast("int").alias("place"), rank.alias("rank")).where(F.col("rank") <= most)


def has_any(*relations: DataFrame) -> DataFrame:
    """Whether any of the unfiltered relations has a row; each is read up to its first."""
    out = relations[0].select(F.lit(1).alias("x")).limit(1)
    for r in relations[1:]:
        out = out.unionByName(r.select(F.lit(1).alias("x")).limit(1))
    return out.agg((F.count("x") > 0).alias("any"))
