"""Files as sources: library folders, sidecars, documents of several formats."""

from __future__ import annotations

import html
import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lazy import arrow_function
from ..functions.text import file_format

#: Names that a library scan leaves out.
EXCLUDED = (
    ".*", "Thumbs.db", "__MACOSX", "#recycle", "@eaDir", "@tmp", "@Recycle", ".@__thumb", "$RECYCLE.BIN", "System Volume Information", ".docker_temp",
    "*.tmp", "*.partial", "~$*", "*.crdownload", "*.part",
)
SIDECARS = ("series.json", "metadata.json", "comicinfo.json")


def glob_regex(globs: tuple[str, ...]) -> str:
    one = lambda g: "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in g)
    return "(?i)(^|/)(" + "|".join(one(g) for g in globs) + ")(/|$)"


def relative(path: str | Column, root: str) -> Column:
    p = F.regexp_replace(F.url_decode(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*", "/")
    return F.regexp_replace(p, "^" + re.escape(root.rstrip("/")) + "/", "")


def scan_library(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """path, rel, series, format, length, modified, file_hash of the documents
    under a folder; a file in the root itself belongs to no series. Contents are
    hashed in the scan and not carried on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    f = files.withColumn("rel", relative("path", root)).withColumn("format", file_format("path"))
    f = f.filter(F.col("format").isNotNull() & ~F.col("rel").rlike(glob_regex(excluded)))
    series = F.when(F.contains("rel", F.lit("/")), F.substring_index("rel", "/", 1))
    return f.select("path", "rel", series.alias("series"), "format", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_hash"))


def sidecars(spark: SparkSession, root: str, schema: str = "name string, author string, status string") -> DataFrame:
    """The first valid sidecar of each series, in the order of SIDECARS."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    f = files.withColumn("rel", relative("path", root)).withColumn("file", F.lower(F.regexp_extract("path", "([^/]+)$", 1)))
    f = f.filter(F.col("file").isin(*SIDECARS) & F.contains("rel", F.lit("/"))).withColumn("meta", F.from_json(F.col("content").cast("string"), schema, {"mode": "PERMISSIVE"})).filter("meta is not null and meta.name is not null")
    rank = F.array_position(F.array(*map(F.lit, SIDECARS)), F.col("file"))
    return f.groupBy(F.substring_index("rel", "/", 1).alias("series")).agg(F.min_by("meta", F.struct(rank, F.col("rel"))).alias("meta"))


def new_files(scan: DataFrame, books: DataFrame) -> DataFrame:
    """Files whose content is not yet among the books."""
    return scan.join(books.select("file_hash").filter("file_hash is not null").distinct(), "file_hash", "left_anti").dropDuplicates(["file_hash"])


def _strip_html(s: str) -> str:
    s = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", s)
    s = re.sub(r"(?i)<(?:br|/p|/div|/h[1-6]|/li)\b[^>]*>", "\n", s)
    s = html.unescape(re.sub(r"(?s)<[^>]*>", "", s))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in s.split("\n"))).strip()


def decode(data: bytes) -> str:
    """UTF-8 (with or without mark), UTF-16 by its mark, else GB18030."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for code in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def parse_document(data: bytes, kind: str) -> str | None:
    """Plain text of a document; null for a kind without a parser or a damaged
    file."""
    try:
        if kind == "txt":
            return decode(data)
        if kind == "markdown":
            return re.sub(r"(?m)^#{1,6}\s+|[*_`]{1,3}|^>\s?", "", decode(data))
        if kind == "html":
            return _strip_html(decode(data))
        if kind == "epub":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                box = ET.fromstring(z.read("META-INF/container.xml"))
                opf = next(e.get("full-path") for e in box.iter() if e.tag.endswith("rootfile"))
                package = ET.fromstring(z.read(opf))
                items = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
                base = opf.rpartition("/")[0]
                order = [items[e.get("idref")] for e in package.iter() if e.tag.endswith("}itemref") and e.get("idref") in items]
                return "\n\n".join(_strip_html(decode(z.read(f"{base}/{h}" if base else h))) for h in order)
        if kind == "docx":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                body = ET.fromstring(z.read("word/document.xml"))
            return "\n".join("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in body.iter() if p.tag.endswith("}p"))
    except Exception:  # noqa: BLE001 - a damaged file has no text
        return None
    return None


@arrow_function("string")
def parsed_text(content: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([parse_document(bytes(c), k) if c is not None else None for c, k in zip(content, kind)])


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """path, format, text, n_chars of every document under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    d = files.withColumn("format", file_format("path")).filter(F.col("format").isNotNull())
    d = d.select("path", "format", parsed_text("content", "format").alias("text"))
    return d.withColumn("n_chars", F.length("text"))


def read_json_lines(spark: SparkSession, path: str, schema: str, id_col: str) -> DataFrame:
    """Rows of a JSON-lines file with unique ids; a repeated id raises when read."""
    rows = spark.read.schema(schema).json(path).filter(F.col(id_col).isNotNull())
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(id_col))
    clash = F.raise_error(F.concat(F.lit("repeated id "), F.col(id_col).cast("string")))
    return rows.withColumn(id_col, F.when(n > 1, clash).otherwise(F.col(id_col)))
