"""Best representative of each duplicate group, field by field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A value to survive: taken from the best member for which `present` holds."""

    name: str
    value: Column
    present: Column


def current_rows(df: DataFrame, key: str, at: str) -> DataFrame:
    """The row of each key with the latest `at` (a null one is earliest; equal
    ones are settled by the remaining columns, so the result is the same on
    every run). One aggregation; rows with a null key are left out."""
    rest = [c for c in df.columns if c not in (key, at)]
    best = F.max(F.struct(F.col(at).isNotNull(), F.col(at), *[F.col(c) for c in rest])).alias("best")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, F.col(f"best.{at}").alias(at), *[F.col(f"best.{c}").alias(c) for c in rest])


def survivorship(members: DataFrame, group: str, rank: list[Column], fields: list[Field]) -> DataFrame:
    """One row per group with, for each field, the value of the first member in
    rank order (least first) that has one, else null.

    rank holds expressions of which the least is the best and the last tells
    members apart; a descending key is negated by the caller. One aggregation
    for all fields: the least of (absent, rank, value). Groups that are null
    form no row; repeated members change nothing; an empty input gives an empty
    frame.
    """
    keys = [k.alias(f"k{i}") for i, k in enumerate(rank)]
    picks = [F.min(F.when(f.present, F.struct(*keys, f.value.alias("value")))).alias(f.name) for f in fields]
    best = members.filter(F.col(group).isNotNull()).groupBy(group).agg(*picks)
    return best.select(group, *[F.col(f"{f.name}.value").alias(f.name) for f in fields])


def descending(col: Column, missing: int = 9223372036854775807) -> Column:
    """A rank key of which the largest value comes first and a null last."""
    return F.coalesce(-col.cast("long"), F.lit(missing))
