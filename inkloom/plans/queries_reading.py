"""Queries over reading sessions and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reading as R
from ..operators.relational import page
from ..sources.tables import table
from .register import registry

QUERIES, SQL, query = registry()
#: Everything that depends on "now" takes this day.
AS_OF = "2025-06-30"

SESSIONS = """s AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST, ended_at DESC NULLS LAST, duration_secs DESC NULLS LAST) AS n FROM reading_sessions) WHERE n = 1)"""
SECS = "greatest(coalesce(duration_secs, 0), 0)"


def sessions(spark, d):
    return R.clean_sessions(table(spark, d, "reading_sessions"))


@query(f"""WITH {SESSIONS} SELECT CAST(started_at AS DATE) AS day, count(*) AS n_sessions, CAST(floor(sum({SECS}) / 60.0) AS BIGINT) AS minutes, CAST(coalesce(sum(words_read), 0) AS BIGINT) AS words,
CAST(coalesce(sum(pages_read), 0) AS BIGINT) AS pages, count(DISTINCT user_id) AS readers FROM s GROUP BY 1""")
def daily_heatmap(spark, d):
    return R.daily_heatmap(sessions(spark, d))


@query(f"""WITH {SESSIONS}, x AS (SELECT *, CAST(started_at AS DATE) AS day, {SECS} AS secs FROM s)
SELECT count(*) AS n_sessions, count(DISTINCT book_id) AS books, count(DISTINCT user_id) AS users, count(DISTINCT day) AS reading_days, CAST(sum(secs) AS BIGINT) AS total_secs,
CAST(coalesce(sum(pages_read), 0) AS BIGINT) AS total_pages, CAST(coalesce(sum(words_read), 0) AS BIGINT) AS total_words,
count(*) FILTER (WHERE day > DATE '{AS_OF}' - 7 AND day <= DATE '{AS_OF}') AS sessions_7d, CAST(coalesce(sum(secs) FILTER (WHERE day > DATE '{AS_OF}' - 7 AND day <= DATE '{AS_OF}'), 0) AS BIGINT) AS secs_7d,
count(*) FILTER (WHERE day > DATE '{AS_OF}' - 30 AND day <= DATE '{AS_OF}') AS sessions_30d, CAST(coalesce(sum(secs) FILTER (WHERE day > DATE '{AS_OF}' - 30 AND day <= DATE '{AS_OF}'), 0) AS BIGINT) AS secs_30d,
count(*) FILTER (WHERE ended_at IS NULL) AS open_sessions FROM x""")
def reading_dashboard(spark, d):
    return R.dashboard(sessions(spark, d), AS_OF)


@query(f"""WITH {SESSIONS}, days AS (SELECT DISTINCT user_id, CAST(started_at AS DATE) AS day FROM s WHERE user_id IS NOT NULL AND CAST(started_at AS DATE) <= DATE '{AS_OF}' AND CAST(started_at AS DATE) > DATE '{AS_OF}' - 365),
g AS (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day DESC) AS later FROM days),
b AS (SELECT user_id, day, sum(CASE WHEN later IS NULL THEN CAST(DATE '{AS_OF}' - day > 1 AS INT) ELSE CAST(later - day > 2 AS INT) END) OVER (PARTITION BY user_id ORDER BY day DESC) AS breaks FROM g)
SELECT user_id, count(*) FILTER (WHERE breaks = 0) AS streak FROM b GROUP BY user_id""")
def user_streak(spark, d):
    return R.current_streak(sessions(spark, d), AS_OF)


@query(f"""WITH {SESSIONS}, days AS (SELECT DISTINCT user_id, CAST(started_at AS DATE) AS day FROM s WHERE user_id IS NOT NULL),
i AS (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM days), r AS (SELECT user_id, island, count(*) AS n FROM i GROUP BY ALL)
SELECT user_id, max(n) AS longest_run, count(*) AS runs FROM r GROUP BY user_id""")
def gaps_islands(spark, d):
    return R.longest_run(sessions(spark, d))


@query(f"""WITH {SESSIONS}, x AS (SELECT user_id, epoch_us(started_at) AS a, epoch_us(ended_at) AS b FROM s WHERE user_id IS NOT NULL AND ended_at > started_at),
n AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS new FROM x),
p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS part FROM n), m AS (SELECT user_id, part, min(a) AS a, max(b) AS b FROM p GROUP BY ALL)
SELECT user_id, CAST(sum(b - a) // 1000000 AS BIGINT) AS covered_secs, count(*) AS stretches FROM m GROUP BY user_id""")
def interval_union(spark, d):
    return R.union_seconds(sessions(spark, d))


@query(f"""WITH {SESSIONS} SELECT book_id, id, user_id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY started_at DESC, id DESC) AS k FROM s) WHERE k = 1""")
def newest_session_per_book(spark, d):
    return R.newest_per_book(sessions(spark, d))


@query(f"""WITH {SESSIONS}, x AS (SELECT * FROM s WHERE month(started_at) = 6 AND day(started_at) = 30 AND year(started_at) < 2025)
SELECT book_id, id, user_id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY started_at DESC, id DESC) AS k FROM x) WHERE k = 1""")
def on_this_day(spark, d):
    return R.on_this_day(sessions(spark, d), AS_OF)


@query(f"""WITH {SESSIONS}, x AS (SELECT CAST(started_at AS DATE) AS day, CAST(sum({SECS}) AS BIGINT) AS secs FROM s GROUP BY 1),
w AS (SELECT *, lag(secs) OVER (ORDER BY day) AS p, lead(secs) OVER (ORDER BY day) AS q FROM x)
SELECT day, secs, coalesce(secs > p AND secs > q, false) AS is_peak, coalesce(secs < p AND secs < q, false) AS is_valley FROM w""")
def peaks_valleys(spark, d):
    daily = sessions(spark, d).groupBy(F.to_date("started_at").alias("day")).agg(F.sum(R.seconds()).alias("secs"))
    return R.peaks_and_valleys(daily, "day", "secs")


@query(f"""WITH {SESSIONS} SELECT CAST(hour(started_at) AS INT) AS hour, count(*) AS n_sessions, round(avg(duration_secs), 4) AS avg_secs, CAST(quantile_cont(duration_secs, 0.5) AS DOUBLE) AS median_secs, max(duration_secs) AS max_secs
FROM s WHERE duration_secs >= 0 GROUP BY 1""")
def hourly_profile(spark, d):
    return R.hourly_profile(sessions(spark, d))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, value AS p95, n FROM r WHERE k = ceil(n * 0.95)""")
def p95_by_type(spark, d):
    return R.p95_nearest_rank(table(spark, d, "events"), "event_type", "value")


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS calls, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, round(avg(value), 9) AS mean, count(*) FILTER (WHERE event_type = 'error') AS errors
FROM events GROUP BY 1, 2""")
def usage_daily(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 9).alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""SELECT count(*) AS calls, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, round(sum(value), 4) AS total, round(avg(value), 9) AS mean, max(ts) AS last_ts,
count(*) FILTER (WHERE value > 50) AS large FROM events""")
def usage_summary(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 9).alias("mean"), F.max("ts").alias("last_ts"), F.count_if(F.col("value") > 50).alias("large"))


@query("""SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def json_key_cloud(spark, d):
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    return table(spark, d, "events").groupBy(k, "event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {SESSIONS}, b AS (SELECT id, title FROM (SELECT id, title, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, title DESC NULLS LAST) AS k FROM books) WHERE k = 1),
f AS (SELECT 'session' AS kind, book_id, started_at AS at, duration_secs AS amount, CAST(NULL AS VARCHAR) AS title FROM s
UNION ALL SELECT 'book', id, max(updated_at), NULL, max(title) FROM b JOIN (SELECT id AS i, updated_at FROM books) u ON u.i = b.id GROUP BY id
UNION ALL SELECT 'fingerprint', book_id, computed_at, CAST(char_count AS INT), NULL FROM book_fingerprints)
SELECT * FROM f""")
def activity_feed(spark, d):
    """Three kinds of activity under one schema."""
    from ..operators.relational import latest_rows

    s = sessions(spark, d).select(F.lit("session").alias("kind"), "book_id", F.col("started_at").alias("at"), F.col("duration_secs").alias("amount"))
    books = table(spark, d, "books")
    named = latest_rows(books.select("id", "title", "updated_at"), ["id"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("title")]).select(F.lit("book").alias("kind"), F.col("id").alias("book_id"), F.col("updated_at").alias("at"), "title")
    prints = table(spark, d, "book_fingerprints").select(F.lit("fingerprint").alias("kind"), "book_id", F.col("computed_at").alias("at"), F.col("char_count").cast("int").alias("amount"))
    return s.unionByName(named, allowMissingColumns=True).unionByName(prints, allowMissingColumns=True)


@query(f"""WITH {SESSIONS} SELECT user_id, count(*) AS n_sessions, count(DISTINCT book_id) AS books, CAST(sum({SECS}) AS BIGINT) AS secs, CAST(coalesce(sum(words_read), 0) AS BIGINT) AS words,
count(*) FILTER (WHERE ended_at IS NULL) AS open_sessions, max(started_at) AS last_at FROM s WHERE user_id IS NOT NULL GROUP BY user_id""")
def user_rollup(spark, d):
    return sessions(spark, d).filter("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.countDistinct("book_id").alias("books"), F.sum(R.seconds()).alias("secs"), F.coalesce(F.sum("words_read"), F.lit(0)).alias("words"), F.count_if(F.col("ended_at").isNull()).alias("open_sessions"), F.max("started_at").alias("last_at"))


@query(f"""WITH {SESSIONS} SELECT book_id, count(*) AS n_sessions FROM s LEFT JOIN (SELECT DISTINCT id FROM books) b ON b.id = s.book_id WHERE b.id IS NULL GROUP BY book_id""")
def sessions_of_lost_books(spark, d):
    """Anti join: sessions whose book no longer exists."""
    ids = table(spark, d, "books").select(F.col("id").alias("book_id")).distinct()
    return sessions(spark, d).join(ids, "book_id", "left_anti").groupBy("book_id").agg(F.count("*").alias("n_sessions"))


@query(f"""WITH {SESSIONS} SELECT id, user_id, book_id, started_at, (SELECT count(*) FROM s) AS total FROM s ORDER BY started_at DESC, id LIMIT 50""")
def session_page(spark, d):
    """The newest sessions, a page of 50, with the number of all."""
    from ..operators.relational import with_total

    s = sessions(spark, d).select("id", "user_id", "book_id", "started_at")
    return page(with_total(s), [F.desc("started_at"), F.asc("id")], 1, 50)
