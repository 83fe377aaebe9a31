"""Reports over reading sessions: days, streaks, runs, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest_rows


def clean_sessions(sessions: DataFrame) -> DataFrame:
    """One row per session id, the one received last (repeats say the same)."""
    return latest_rows(sessions, ["id"], [F.desc_nulls_last("received_at"), F.desc_nulls_last("ended_at"), F.desc_nulls_last("duration_secs")])


def seconds() -> Column:
    """The duration that counts: open sessions and negative durations are 0."""
    return F.greatest(F.coalesce("duration_secs", F.lit(0)), F.lit(0)).cast("long")


def daily_heatmap(sessions: DataFrame) -> DataFrame:
    """Per day: sessions, minutes (whole), words, pages and readers."""
    return sessions.groupBy(F.to_date("started_at").alias("day")).agg(
        F.count("*").alias("n_sessions"), F.floor(F.sum(seconds()) / 60).alias("minutes"), F.coalesce(F.sum("words_read"), F.lit(0)).alias("words"),
        F.coalesce(F.sum("pages_read"), F.lit(0)).cast("long").alias("pages"), F.countDistinct("user_id").alias("readers"),
    )


def dashboard(sessions: DataFrame, as_of: str) -> DataFrame:
    """One row of totals and of rolling windows before as_of, in one pass."""
    at = F.to_date(F.lit(as_of))
    day = F.to_date("started_at")
    last = lambda n: (day > F.date_sub(at, n)) & (day <= at)
    return sessions.agg(
        F.count("*").alias("n_sessions"), F.countDistinct("book_id").alias("books"), F.countDistinct("user_id").alias("users"), F.countDistinct(day).alias("reading_days"),
        F.sum(seconds()).alias("total_secs"), F.coalesce(F.sum("pages_read"), F.lit(0)).cast("long").alias("total_pages"), F.coalesce(F.sum("words_read"), F.lit(0)).alias("total_words"),
        F.count_if(last(7)).alias("sessions_7d"), F.coalesce(F.sum(F.when(last(7), seconds())), F.lit(0)).alias("secs_7d"),
        F.count_if(last(30)).alias("sessions_30d"), F.coalesce(F.sum(F.when(last(30), seconds())), F.lit(0)).alias("secs_30d"),
        F.count_if(F.col("ended_at").isNull()).alias("open_sessions"),
    )


def reading_days(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("user_id").isNotNull()).select("user_id", F.to_date("started_at").alias("day")).distinct()


def current_streak(sessions: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Per user the days of the streak up to as_of: it begins today or yesterday
    and goes on while no more than one day is missed between two reading days;
    the days present count."""
    at = F.to_date(F.lit(as_of))
    d = reading_days(sessions).filter((F.col("day") <= at) & (F.col("day") > F.date_sub(at, days)))
    w = Window.partitionBy("user_id").orderBy(F.desc("day"))
    gap = F.date_diff(F.coalesce(F.lag("day").over(w), at), F.col("day"))
    broken = F.when(F.lag("day").over(w).isNull(), gap > 1).otherwise(gap > 2)
    run = d.withColumn("broken", broken.cast("int")).withColumn("breaks", F.sum("broken").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("user_id").agg(F.count_if(F.col("breaks") == 0).alias("streak"))


def longest_run(sessions: DataFrame) -> DataFrame:
    """Per user the longest run of consecutive reading days (gaps and islands)."""
    d = reading_days(sessions)
    w = Window.partitionBy("user_id").orderBy("day")
    island = d.withColumn("island", F.date_sub("day", F.row_number().over(w)))
    runs = island.groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest_run"), F.count("*").alias("runs"))


def union_seconds(sessions: DataFrame) -> DataFrame:
    """Per user the seconds covered by sessions, overlaps counted once."""
    s = sessions.filter("user_id is not null and ended_at is not null and ended_at > started_at").select("user_id", F.unix_micros("started_at").alias("a"), F.unix_micros("ended_at").alias("b"))
    order = Window.partitionBy("user_id").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    part = s.withColumn("new", F.when(reach >= F.col("a"), 0).otherwise(1)).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = part.groupBy("user_id", "part").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("user_id").agg(F.expr("sum(b - a) div 1000000").alias("covered_secs"), F.count("*").alias("stretches"))


def newest_per_book(sessions: DataFrame) -> DataFrame:
    """The newest session of each book."""
    return latest_rows(sessions, ["book_id"], [F.desc("started_at"), F.desc("id")]).select("book_id", "id", "user_id", "started_at")


def on_this_day(sessions: DataFrame, as_of: str) -> DataFrame:
    """Sessions of the same month and day in earlier years, newest per book."""
    at = F.to_date(F.lit(as_of))
    day = F.to_date("started_at")
    same = sessions.filter((F.month(day) == F.month(at)) & (F.dayofmonth(day) == F.dayofmonth(at)) & (F.year(day) < F.year(at)))
    return newest_per_book(same)


def peaks_and_valleys(daily: DataFrame, day: str, value: str) -> DataFrame:
    """Strict local extremes of a daily series; the ends are neither. The series
    has a row per day, so one ordered pass holds it."""
    w = Window.partitionBy(F.lit(0)).orderBy(day)
    before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return daily.select(day, value, F.coalesce((v > before) & (v > after), F.lit(False)).alias("is_peak"), F.coalesce((v < before) & (v < after), F.lit(False)).alias("is_valley"))


def hourly_profile(sessions: DataFrame) -> DataFrame:
    """Sessions by hour of day with their average and 95th percentile length."""
    closed = sessions.filter("duration_secs >= 0")
    return closed.groupBy(F.hour("started_at").alias("hour")).agg(
        F.count("*").alias("n_sessions"), F.round(F.avg("duration_secs"), 4).alias("avg_secs"), F.percentile("duration_secs", F.lit(0.5)).alias("median_secs"),
        F.max("duration_secs").alias("max_secs"),
    )


def p95_nearest_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """The value at rank ceil(0.95 n) of each group."""
    w = Window.partitionBy(group).orderBy(value)
    ranked = df.filter(F.col(value).isNotNull()).select(group, value, F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy(group)).alias("n"))
    return ranked.filter(F.col("r") == F.ceil(F.col("n") * 0.95)).select(group, F.col(value).alias("p95"), "n")
