"""Structured Streaming jobs: new files, incremental candidates, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_format
from ..operators.versions import chapter_fingerprints, shared_hash_candidates

SESSION = "id string, user_id string, book_id string, started_at timestamp, ended_at timestamp, duration_secs int, pages_read int, words_read bigint, received_at timestamp"


def watch_files(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """Stream of new documents in a folder: path, format, length, modified."""
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).load(root)
    return s.withColumn("format", file_format("path")).filter(F.col("format").isNotNull()).select("path", "format", "length", F.col("modificationTime").alias("modified"))


def session_counts(sessions: DataFrame, lateness: str = "2 days", window: str = "1 day") -> DataFrame:
    """Per day: sessions and seconds, repeated deliveries counted once; late rows
    are taken as long as the watermark holds their day."""
    s = sessions.withWatermark("started_at", lateness).dropDuplicatesWithinWatermark(["id"])
    return s.groupBy(F.window("started_at", window).alias("w")).agg(F.count("*").alias("n_sessions"), F.sum(F.greatest(F.coalesce("duration_secs", F.lit(0)), F.lit(0))).alias("secs")).select(F.col("w.start").alias("day"), "n_sessions", "secs")


def fold_progress(state: tuple[float, int, int] | None, rows: list[tuple[float, int, int]]) -> tuple[tuple[float, int, int], int]:
    """State (progress, micros of its update, seconds read in all) after updates
    (progress, micros, seconds): the newest position wins, an older one is a
    conflict, seconds always add up. Returns (state, conflicts)."""
    progress, at, secs = state or (0.0, -1, 0)
    conflicts = 0
    for p, t, s in sorted(rows, key=lambda r: r[1]):
        if t >= at:
            progress, at = p, t
        else:
            conflicts += 1
        secs += max(0, s)
    return (progress, at, secs), conflicts


def track_progress(updates: DataFrame) -> DataFrame:
    """Per (user_id, book_id) the latest position of updates(user_id, book_id,
    progress, updated_at, secs), with the seconds accumulated and the conflicts of
    each batch. The state is three numbers a key."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = [(float(r.progress), int(r.updated_at.value // 1000), int(r.secs)) for p in parts for r in p.itertuples()]
        new, conflicts = fold_progress(state.get if state.exists else None, rows)
        state.update(new)
        yield pd.DataFrame([[*key, new[0], new[2], conflicts]], columns=["user_id", "book_id", "progress", "secs", "conflicts"])

    return updates.groupBy("user_id", "book_id").applyInPandasWithState(
        step, "user_id string, book_id string, progress double, secs long, conflicts int", "progress double, at long, secs long", "update", "NoTimeout"
    )


def incremental_candidates(chapters_path: str, out: str, min_shared: int = 2) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over changed(book_id): candidates of the books changed in
    a batch against all, written under the batch's number (a repeated batch
    overwrites itself)."""

    def each(batch: DataFrame, number: int) -> None:
        changed = batch.select("book_id").distinct()
        chapters = batch.sparkSession.read.parquet(chapters_path)
        items = chapter_fingerprints(chapters).filter("char_count >= 120").select("book_id", F.col("layout_hash").alias("hash"))
        shared_hash_candidates(items, min_shared, changed=changed).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each
