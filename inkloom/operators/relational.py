"""Building blocks of relational reads: latest rows, filters, pages, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order (total, or ties are arbitrary)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def contains_text(needle: str, *cols: str) -> Column:
    """Whether any column contains the needle, in any case; % and _ are literal.
    A blank needle matches everything."""
    needle = needle.strip().lower()
    if not needle:
        return F.lit(True)
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
    return out


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal the given values; None leaves a column free and
    a list means any of its values."""
    for c, v in wanted.items():
        if v is not None:
            df = df.filter(F.col(c).isin(v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page (from 1 on, of 1 to 100 rows) in a total order."""
    size = min(100, max(1, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """df with its number of rows in each row: one pass of counting that is
    joined as a single row, instead of a window over one partition."""
    return df.join(F.broadcast(df.agg(F.count("*").alias(name))), F.lit(True), "inner")


def facet(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Values of a column by count; the first `top` of them if that is given."""
    out = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(top) if top else out


def scoped(df: DataFrame, scope: DataFrame | None, on: str) -> DataFrame:
    """Rows visible in a scope: all for None, those with a key in it otherwise."""
    return df if scope is None else df.join(scope.select(on).distinct(), on, "left_semi")


def bridge_join(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """A many-to-many join through a bridge table holding both keys."""
    return left.join(bridge, left_key).join(right, right_key)


def either_key_join(pairs: DataFrame, a: str, b: str, rows: DataFrame, key: str, side: str = "side") -> DataFrame:
    """rows joined to the pairs that name them on either side: the pairs are
    turned into two oriented branches, so that it stays an equi-join."""
    left = pairs.withColumn(key, F.col(a)).withColumn(side, F.lit("a"))
    return left.unionByName(pairs.withColumn(key, F.col(b)).withColumn(side, F.lit("b"))).join(rows, key)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """old and new together, the newest row of each key by `order`; at a tie the
    new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_rows(both, keys, [order.desc_nulls_last(), F.desc("_new")]).drop("_new")


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """existing and those of wanted whose key isn't there yet."""
    new = wanted.dropDuplicates(keys).join(existing, keys, "left_anti")
    return existing.unionByName(new, allowMissingColumns=True)
