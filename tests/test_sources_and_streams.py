import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from inkloom.plans.durable import Scratch, shared_dir
from inkloom.plans.sized import keep_keys
from inkloom.sources import files as S
from inkloom.streaming import jobs as J


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<c xmlns="x"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></c>')
        z.writestr("O/p.opf", '<package xmlns="x"><manifest><item id="b" href="2.html"/><item id="a" href="1.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/1.html", "<html><body><h1>One</h1><p>first &amp; foremost</p></body></html>")
        z.writestr("O/2.html", "<script>x()</script><p>second</p>")
    return out.getvalue()


def docx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w"><w:p><w:t>Hello </w:t><w:t>there</w:t></w:p><w:p><w:t>bye</w:t></w:p></w:d>')
    return out.getvalue()


def test_parsers():
    assert S.parse_document("雨".encode("gb18030"), "txt") == "雨" and S.parse_document(b"\xef\xbb\xbfx", "txt") == "x"
    assert S.parse_document(b"# Title\n**bold**", "markdown") == "Title\nbold"
    assert S.parse_document(epub(), "epub") == "One\nfirst & foremost\n\nsecond"
    assert S.parse_document(docx(), "docx") == "Hello there\nbye"
    assert S.parse_document(b"junk", "epub") is None and S.parse_document(b"junk", "pdf") is None


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "lib"
    for p, data in {"A series/b 1.txt": b"one", "A series/.hidden.txt": b"h", "A series/x.tmp": b"t", "A series/deep/c.md": b"two", "orphan.html": b"<p>three</p>", "A series/series.json": json.dumps({"name": "A", "author": "N"}).encode(), "B/metadata.json": b"{broken", "B/copy.txt": b"one"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(data)
    return root


def test_library_scan(spark, library):
    out = {r.rel: r for r in S.scan_library(spark, str(library)).collect()}
    assert set(out) == {"A series/b 1.txt", "A series/deep/c.md", "orphan.html", "B/copy.txt"}
    assert out["orphan.html"].series is None and out["A series/deep/c.md"].series == "A series" and out["A series/deep/c.md"].format == "markdown"
    side = S.sidecars(spark, str(library)).collect()
    assert [(r.series, r.meta.name) for r in side] == [("A series", "A")]
    known = spark.createDataFrame([(out["orphan.html"].file_hash,), (None,)], "file_hash string")
    assert S.new_files(S.scan_library(spark, str(library)), known).count() == 2
    assert {r.text for r in S.read_documents(spark, str(library)).filter("format = 'html'").collect()} == {"three"}


def test_json_lines(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text('{"pair_id": "1", "expected": "x"}\n\n{"pair_id": "2", "expected": "y", "more": 1}\n')
    assert S.read_json_lines(spark, str(p), "pair_id string, expected string", "pair_id").count() == 2
    p.write_text('{"pair_id": "1"}\n{"pair_id": "1"}\n')
    with pytest.raises(Exception, match="repeated id"):
        S.read_json_lines(spark, str(p), "pair_id string, expected string", "pair_id").collect()


def test_scratch_and_sized_join(spark):
    s = Scratch(spark)
    kept = s.keep(spark.range(10).withColumn("x", F.col("id") * 2))
    assert kept.count() == 10 and s.base.startswith(shared_dir(spark))
    keys = s.keep(spark.range(3))
    for most in (10, 1):
        assert keep_keys(kept, keys, "id", most).count() == 3
    s.drop(kept)
    with pytest.raises(Exception):
        spark.read.parquet(kept._inkloom_path).count()


def test_workers_find_the_package_from_anywhere(tmp_path):
    """A session started in another folder, without a path to the repository."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from inkloom.plans.registry import queries
print("ROWS", queries()["normalized_chapters"](s, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_file_stream(spark, library):
    assert sorted(r.format for r in drain(J.watch_files(spark, str(library)), "files")) == ["html", "markdown", "txt", "txt"]  # names with a dot first are hidden


def test_session_counts_stream(spark, tmp_path):
    rows = [("a", "2025-01-01 10:00:00", 60), ("a", "2025-01-01 10:00:00", 60), ("b", "2025-01-01 12:00:00", -5), ("c", "2025-01-20 00:00:00", 7)]
    df = spark.createDataFrame(rows, "id string, s string, duration_secs int").select("id", F.lit("u").alias("user_id"), F.lit("b").alias("book_id"), F.to_timestamp("s").alias("started_at"), "duration_secs")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = {str(r.day.date()): (r.n_sessions, r.secs) for r in drain(J.session_counts(stream), "sessions", "update")}
    assert out["2025-01-01"] == (2, 60)


def test_progress_fold_and_stream(spark, tmp_path):
    assert J.fold_progress(None, [(0.5, 20, 10), (0.2, 10, 5)]) == ((0.5, 20, 15), 0)
    assert J.fold_progress((0.5, 20, 15), [(0.1, 5, 3)]) == ((0.5, 20, 18), 1)
    df = spark.createDataFrame([("u", "b", 0.2, "2025-01-01", 5), ("u", "b", 0.6, "2025-01-03", 7), ("u", "b", 0.4, "2025-01-02", 1)], "user_id string, book_id string, progress double, at string, secs int").select("user_id", "book_id", "progress", F.to_timestamp("at").alias("updated_at"), "secs")
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    out = drain(J.track_progress(spark.readStream.schema(df.schema).parquet(str(tmp_path / "p"))), "progress", "update")
    assert [(r.user_id, r.progress, r.secs) for r in out] == [("u", 0.6, 13)]


def test_incremental_candidates_stream(spark, tmp_path):
    text = lambda k: f"The text of chapter {k} goes on. " * 10
    rows = [(b, k, f"{b}{k}", text(k + (0 if b in "xy" else 50))) for b in "xyz" for k in range(3)]
    spark.createDataFrame(rows, "book_id string, chapter_index int, id string, content string").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([("x",)], "book_id string").write.parquet(str(tmp_path / "changed"))
    s = spark.readStream.schema("book_id string").parquet(str(tmp_path / "changed"))
    q = s.writeStream.foreachBatch(J.incremental_candidates(str(tmp_path / "c"), str(tmp_path / "out"))).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert [tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("x", "y", 3)]
