"""Reads of a library as its pages show them: progress, shelves, recommendations,
series, queues, scopes with grants, filters written as data."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reading import seconds
from .relational import page

#: Sort keys a caller may name.
SORTS: dict[str, str] = {"title": "title", "author": "author", "created": "created_at", "updated": "updated_at", "words": "word_count"}


def blank(col: str) -> Column:
    return F.coalesce(F.trim(col), F.lit("")) == ""


def ranked(df: DataFrame, by: list[str], order: list[Column], top: int, name: str = "rank") -> DataFrame:
    """The first `top` rows of each group in a total order, numbered."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= top)


def visible_books(books: DataFrame, status: str | None = None) -> DataFrame:
    """Books that lists show: never archived ones, copies only if asked for."""
    b = books.filter("status <> 'archived'")
    return b.filter(F.col("status") == status) if status else b.filter("status <> 'duplicate'")


def sorted_page(books: DataFrame, sort: str = "created", ascending: bool = False, number: int = 1, size: int = 20) -> DataFrame:
    """A page by a named sort key, then the newest, then the id; an unknown key
    sorts by the day of creation."""
    key = F.col(SORTS.get(sort, "created_at"))
    return page(books, [key.asc_nulls_last() if ascending else key.desc_nulls_last(), F.desc_nulls_last("created_at"), F.asc("id")], number, size)


def metadata_quality(books: DataFrame, *filled: str) -> Column:
    """How many of the columns say something (a language of `unknown` doesn't)."""
    return functools.reduce(lambda a, c: a + F.when(blank(c) | (F.col(c) == "unknown"), 0).otherwise(1), filled, F.lit(0)).cast("int")


def reading_progress(sessions: DataFrame, books: DataFrame) -> DataFrame:
    """user_id, book_id, progress (0..1, words read of the book's), secs, last_read_at."""
    per = sessions.filter("user_id is not null").groupBy("user_id", "book_id").agg(
        F.sum(seconds()).alias("secs"), F.sum(F.greatest(F.coalesce("words_read", F.lit(0)), F.lit(0))).alias("words"), F.max("started_at").alias("last_read_at"),
    )
    share = F.when(F.col("word_count") > 0, F.least(F.lit(1.0), F.col("words") / F.col("word_count"))).otherwise(0.0)
    return per.join(books.select(F.col("id").alias("book_id"), "word_count"), "book_id").select("user_id", "book_id", F.round(share, 6).alias("progress"), "secs", "last_read_at")


def reading_shelves(progress: DataFrame, top: int = 15) -> DataFrame:
    """Per user the books being read and those finished, the latest read first."""
    shelf = F.when(F.col("progress") >= 1, "finished").when(F.col("progress") > 0, "reading")
    return ranked(progress.withColumn("shelf", shelf).filter("shelf is not null"), ["user_id", "shelf"], [F.desc("last_read_at"), F.asc("book_id")], top)


def signals_of(books: DataFrame, *cols: str) -> DataFrame:
    """book_id, signal: what marks a book, as "column:value"; blank values mark nothing."""
    each = F.array(*[F.when(~blank(c), F.concat(F.lit(f"{c}:"), F.trim(c))) for c in cols])
    return books.select(F.col("id").alias("book_id"), F.explode(F.array_distinct(F.array_compact(each))).alias("signal"))


def engagement(progress: DataFrame) -> Column:
    """What a book counts for in its reader's preferences."""
    return 1 + 3 * F.col("progress") + F.least(F.col("secs") / 3600, F.lit(6.0)) + F.when(F.col("progress") >= 1, 2.0).otherwise(0.0)


def preference_signals(progress: DataFrame, signals: DataFrame, top: int = 12) -> DataFrame:
    """user_id, signal, weight: the signals that mark each user most."""
    w = progress.withColumn("engagement", engagement(progress)).join(signals, "book_id").groupBy("user_id", "signal").agg(F.round(F.sum("engagement"), 6).alias("weight"))
    return ranked(w, ["user_id"], [F.desc("weight"), F.asc("signal")], top)


def recommendation_groups(progress: DataFrame, books: DataFrame, signals: DataFrame, top: int = 8) -> DataFrame:
    """user_id, shelf, rank, book_id: what to continue, what matches a user's
    signals and isn't begun, and the newest books."""
    begun = progress.select("user_id", "book_id").distinct()
    going = ranked(progress.filter("progress > 0 and progress < 1"), ["user_id"], [F.desc("last_read_at"), F.asc("book_id")], top).withColumn("shelf", F.lit("continue"))
    weights = preference_signals(progress, signals).drop("rank")
    score = weights.join(signals, "signal").groupBy("user_id", "book_id").agg(F.round(F.sum("weight"), 5).alias("score")).join(begun, ["user_id", "book_id"], "left_anti")
    match = ranked(score, ["user_id"], [F.desc("score"), F.asc("book_id")], top).withColumn("shelf", F.lit("matching"))
    newest = books.orderBy(F.desc_nulls_last("created_at"), "id").limit(top).select(F.col("id").alias("book_id"), F.row_number().over(Window.orderBy(F.desc_nulls_last("created_at"), "id")).alias("rank"))
    recent = begun.select("user_id").distinct().join(F.broadcast(newest), F.lit(True)).withColumn("shelf", F.lit("recent"))  # `top` rows at most
    return functools.reduce(DataFrame.unionByName, (x.select("user_id", "shelf", "rank", "book_id") for x in (going, match, recent)))


def similar_works(books: DataFrame, signals: DataFrame, top: int = 5, most_holders: int = 50) -> DataFrame:
    """a, b, score, rank: books that agree in author or share signals. The score is
    .15, .25 for the author, .1 for the language and .08 a signal up to .35. A
    signal of more than most_holders books marks none of them: that it is rare is
    what makes it one."""
    b = books.select("id", F.when(~blank("author"), F.trim("author")).alias("author"), F.when(F.col("language") != "unknown", F.col("language")).alias("language"))
    x, y = b.select(F.col("id").alias("a"), "author"), b.select(F.col("id").alias("b"), "author")
    author = x.join(y, "author").filter("a <> b").select("a", "b", F.lit(1).alias("same_author"), F.lit(0).alias("shared"))
    rare = signals.distinct().join(signals.distinct().groupBy("signal").agg(F.count("*").alias("n")).filter(F.col("n").between(2, most_holders)).select("signal"), "signal")
    s, t = rare.select("signal", F.col("book_id").alias("a")), rare.select("signal", F.col("book_id").alias("b"))
    shared = s.join(t, "signal").filter("a <> b").select("a", "b", F.lit(0).alias("same_author"), F.lit(1).alias("shared"))
    pair = author.union(shared).groupBy("a", "b").agg(F.max("same_author").alias("same_author"), F.sum("shared").alias("shared"))
    tongue = b.select("id", "language")
    pair = pair.join(tongue.select(F.col("id").alias("a"), F.col("language").alias("la")), "a").join(tongue.select(F.col("id").alias("b"), F.col("language").alias("lb")), "b")
    same = F.coalesce((F.col("la") == F.col("lb")).cast("int"), F.lit(0))
    score = F.least(F.lit(1.0), F.lit(0.15) + 0.25 * F.col("same_author") + 0.1 * same + F.least(0.08 * F.col("shared"), F.lit(0.35)))
    out = pair.select("a", "b", "shared", "same_author", same.cast("int").alias("same_language"), F.round(score, 6).alias("score"))
    return ranked(out, ["a"], [F.desc("shared"), F.desc("same_author"), F.desc("same_language"), F.desc("b")], top)


def series_order(titles: DataFrame, least: int = 2) -> DataFrame:
    """series_name, position, book_id: the books of each series of at least `least`,
    by volume (those without one last), then title, then id."""
    some = titles.groupBy("series_name").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & F.col("series_name").isNotNull()).select("series_name")
    w = Window.partitionBy("series_name").orderBy(F.coalesce("volume", F.lit(9999)), "title", "book_id")
    return titles.join(some, "series_name").withColumn("position", F.row_number().over(w))


def visible_scopes(users: DataFrame, direct: DataFrame, groups: DataFrame, members: DataFrame, scopes: DataFrame) -> DataFrame:
    """user, scope: the scopes each user may read: those granted to the user or to
    a group of the user's, and those nobody has a grant for."""
    granted = direct.select("user", "scope").union(members.join(groups, "group").select("user", "scope"))
    held = direct.select("scope").union(groups.select("scope")).distinct()
    open_ = scopes.select("scope").join(held, "scope", "left_anti")
    # the scopes are few and the product is the result
    return granted.join(scopes.select("scope"), "scope", "left_semi").select("user", "scope").union(users.select("user").crossJoin(open_)).distinct()


_TESTS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c.eqNullSafe(F.lit(v)), "neq": lambda c, v: ~c.eqNullSafe(F.lit(v)), "in": lambda c, v: c.isin(list(v)), "not_in": lambda c, v: ~F.coalesce(c.isin(list(v)), F.lit(False)),
    "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "before": lambda c, v: c < F.lit(v).cast("timestamp"), "after": lambda c, v: c > F.lit(v).cast("timestamp"),
    "contains": lambda c, v: F.contains(F.lower(c), F.lit(v.lower())), "not_contains": lambda c, v: ~F.coalesce(F.contains(F.lower(c), F.lit(v.lower())), F.lit(False)),
}


def smart_shelf(books: DataFrame, rules: list[tuple[str, str, object]], size: int = 50) -> DataFrame:
    """The books for which all rules (column, test, value) hold, the newest first.
    An unknown test raises; a null fails every test but neq, not_in and not_contains."""
    for column, test, value in rules:
        books = books.filter(_TESTS[test](F.col(column), value))
    return books.orderBy(F.desc_nulls_last("updated_at"), "id").limit(size)


def holding_all(rows: DataFrame, key: str, json_col: str, wanted: list[dict]) -> DataFrame:
    """Keys that have, for each of the wanted objects, a row whose JSON holds all
    of its members. One semi join per object."""
    keys = rows.select(key).distinct()
    for members in wanted:
        holds = functools.reduce(lambda a, b: a & b, (F.coalesce(F.get_json_object(json_col, f"$.{k}") == str(v), F.lit(False)) for k, v in members.items()), F.lit(True))
        keys = keys.join(rows.filter(holds).select(key).distinct(), key, "left_semi")
    return keys


def attributes_json(rows: DataFrame, key: str, name: str, value: Column) -> DataFrame:
    """key, attributes: the named values of each key as one JSON object, by name."""
    one = rows.groupBy(key, name).agg(F.max(value).alias("v"))
    return one.groupBy(key).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "v"))))).alias("attributes"))
