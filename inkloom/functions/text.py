"""Text functions: cleaning, noise, language, tokens, names, as columns.

What Catalyst can express is a column of built-in functions; splitters and
similarity by subsequence are Arrow functions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lazy import arrow_function

#: What forum software and pirate sites leave in texts.
FORUM_WORDS = "签名|广告|本帖|发表于|楼主|回复|Discuz|论坛|下载地址|支持正版"
WATERMARKS = r"(?:本文首发|首发网址|正版阅读|防盗章节|盗版必究|请到[^\s]+阅读|手打吧|笔趣阁|起点中文网|纵横中文网)[^\n]*"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
URL = r"https?://[^\s]+"
#: A block between two rules that holds a forum word, at most 500 characters on
#: either side of it.
FORUM_BLOCK = rf"(?ms)^[\s\x{{3000}}]*[-=]{{3,}}[\s\x{{3000}}]*\n.{{0,500}}(?:{FORUM_WORDS}).{{0,500}}\n[\s\x{{3000}}]*[-=]{{3,}}[\s\x{{3000}}]*$"


def clean_text(col: str) -> Column:
    """A text without control characters, forum blocks, watermarks and URLs, four
    or more line breaks as three, each line and the whole trimmed."""
    c = F.regexp_replace(F.col(col), CONTROL, "")
    for pattern in (FORUM_BLOCK, WATERMARKS, URL):
        c = F.regexp_replace(c, pattern, "")
    c = F.regexp_replace(c, r"\n{4,}", "\n\n\n")
    c = F.regexp_replace(c, r"(?m)^[ \t\r\x{3000}\x{A0}]+|[ \t\r\x{3000}\x{A0}]+$", "")
    return F.regexp_replace(c, r"^[\s\x{3000}\x{A0}]+|[\s\x{3000}\x{A0}]+$", "")


def noise_score(col: str) -> Column:
    """Bytes of noise per byte of text, at most 1; 0 for an empty text."""
    noise = F.lit(0)
    for pattern in (FORUM_BLOCK, WATERMARKS, URL, CONTROL):
        noise = noise + F.octet_length(F.array_join(F.regexp_extract_all(F.col(col), F.lit(f"({pattern})"), F.lit(0)), ""))
    return F.when(F.octet_length(col) == 0, 0.0).otherwise(F.least(F.lit(1.0), noise / F.octet_length(col)))


def _count(col: str | Column, cls: str) -> Column:
    return F.length(F.regexp_replace(col, f"[^{cls}]", ""))


def language_profile(col: str) -> Column:
    """korean, japanese, chinese or english, by the shares of scripts among the
    letters of a whole text."""
    han, kana, hangul, latin = _count(col, r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"), _count(col, r"\x{3040}-\x{30FF}"), _count(col, r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}"), _count(col, "A-Za-z")
    total = F.greatest(han + kana + hangul + latin, F.lit(1))
    return F.when(hangul / total > 0.15, "korean").when(kana / total > 0.15, "japanese").when(han / total > 0.3, "chinese").otherwise("english")


#: Scripts as the detector by samples counts them.
SAMPLED = {"japanese": r"\x{3040}-\x{30FF}", "korean": r"\x{AC00}-\x{D7AF}", "chinese": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{2E80}-\x{2EFF}\x{3000}-\x{303F}"}


def language_by_samples(col: str, size: int = 2000) -> Column:
    """unknown, japanese, korean, chinese or english by the shares of scripts among
    all characters of three samples of a text (its start, middle and end), or of
    the whole of one no longer than two samples. Reading samples is what this
    detector is; language_profile() reads everything."""
    n = F.length(col)
    parts = F.concat(F.substring(col, 1, size), F.substring(col, F.floor(n / 2).cast("int") - size // 2 + 1, F.lit(size)), F.substring(col, n - size + 1, F.lit(size)))
    s = F.when(n <= 2 * size, F.col(col)).otherwise(parts)
    share = {k: F.length(F.regexp_replace(s, f"[^{c}]", "")) / F.length(s) for k, c in SAMPLED.items()}
    return F.when(F.coalesce(n, F.lit(0)) == 0, "unknown").when(share["japanese"] > 0.05, "japanese").when(share["korean"] > 0.05, "korean").when(share["chinese"] > 0.1, "chinese").otherwise("english")


def simple_word_count(col: str) -> Column:
    """Han characters and, of the rest, runs of letters and digits; 0 for null."""
    han, words = F.regexp_count(col, F.lit(r"[\x{4E00}-\x{9FFF}]")), F.regexp_count(F.regexp_replace(col, r"[\x{4E00}-\x{9FFF}]", " "), F.lit(r"[\p{L}\p{N}]+"))
    return F.coalesce(han + words, F.lit(0))


def token_estimate(col: str) -> Column:
    """Characters of Chinese, Japanese and Korean, words of Latin letters and
    digits, and punctuation, weighed; at least 1."""
    cjk = _count(col, r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}")
    words = F.regexp_count(F.col(col), F.lit("[0-9A-Za-z]+"))
    marks = _count(col, r"!-/:-@\[-`{-~。、！？；：「」『』（）【】《》")
    return F.greatest(F.lit(1), F.floor(cjk * 1.5 + words * 1.3 + marks * 0.5)).cast("int")


def text_quality(col: str) -> Column:
    """good, fair, poor or bad by the share of garbled characters."""
    bad = _count(col, r"\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{E000}-\x{F8FF}")
    share = 1 - bad / F.greatest(F.length(col), F.lit(1))
    return F.when(share >= 0.99, "good").when(share >= 0.95, "fair").when(share >= 0.8, "poor").otherwise("bad")


def file_format(path: str) -> Column:
    """Format by the extension of a path; null if it isn't one of the known."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("md", "markdown"), "markdown").when(ext.isin("html", "htm"), "html").when(ext.isin("txt", "epub", "pdf", "doc", "docx"), ext)


def query_terms(col: str) -> Column:
    """Distinct terms of at least two characters, in the order they come."""
    return F.filter(F.array_distinct(F.split(F.lower(col), r"[\s,.;:!?，。；：！？、\"'()（）]+")), lambda t: F.length(t) >= 2)


def paragraphs(col: str, start: int, count: int, most: int = 6000) -> Column:
    """So many paragraphs from one (0 on), at most `most` characters."""
    return F.left(F.array_join(F.slice(F.split(col, r"\n\s*\n"), start + 1, count), "\n\n"), F.lit(most))


_ENDS = re.compile(r"(?<=[。！？…])[”」』’）]*\s*|(?<=[.!?])[\"'”’)]*\s+|\n+")


def sentence_list(text: str | None) -> list[str]:
    """Sentences with what closes them; white space between them is dropped."""
    if not text:
        return []
    out, last = [], 0
    for m in _ENDS.finditer(text):
        piece = text[last : m.end()].strip()
        if piece:
            out.append(piece)
        last = m.end()
    tail = text[last:].strip()
    return [*out, tail] if tail else out


#: How chapters are headed, in the order the patterns are tried.
HEADINGS = (
    r"^[ \t　]*第[0-9零〇一二三四五六七八九十百千两]+[章回节節卷部集][^\n]{0,60}$",
    r"^[ \t]*(?:Chapter|CHAPTER|Part|PART)\s+[0-9IVXLC]+[^\n]{0,60}$",
    r"^[ \t]*제\s*[0-9]+\s*[장화][^\n]{0,60}$",
    r"^[ \t]*[0-9]{1,4}[.、][ \t]*[^\n]{1,60}$",
)


def chapter_list(text: str | None, size: int = 5120, preface: int = 100) -> list[tuple[str, int, int]]:
    """(title, start, end) of a text's chapters: by the first family of headings
    that finds more than one; text before the first is a preface if it is long
    enough. Without headings pieces of about `size` characters are cut, at a
    blank line in the last fifth if there is one."""
    if not text:
        return []
    for pattern in HEADINGS:
        found = list(re.finditer(pattern, text, re.M))
        if len(found) > 1:
            out = [("preface", 0, found[0].start())] if found[0].start() >= preface else []
            ends = [m.start() for m in found[1:]] + [len(text)]
            return out + [(m.group().strip(), m.start(), e) for m, e in zip(found, ends)]
    out, at = [], 0
    while len(text) - at > size:
        cut = text.rfind("\n\n", at + size * 4 // 5, at + size)
        cut = cut + 2 if cut >= 0 else at + size
        out.append((f"part {len(out) + 1}", at, cut))
        at = cut
    return [*out, (f"part {len(out) + 1}" if out else "whole text", at, len(text))]


def chunk_list(text: str | None, target: int = 512, most: int = 640, least: int = 200) -> list[tuple[int, str, bool]]:
    """(index, text, dialogue) chunks of whole sentences up to `target` characters,
    stretched to `most` while a quotation is open; a short last one joins the one
    before. dialogue: at least four quotation marks."""
    chunks: list[str] = []
    now, depth = "", 0
    for s in sentence_list(text):
        limit = most if depth > 0 else target
        if now and len(now) + len(s) + 1 > limit:
            chunks.append(now)
            now, depth = "", 0
        now = f"{now} {s}" if now and s[:1].isascii() else now + s
        depth += sum(s.count(c) for c in "“「『") - sum(s.count(c) for c in "”」』")
    if now:
        if chunks and len(now) < least and len(chunks[-1]) + len(now) <= most:
            chunks[-1] += " " + now
        else:
            chunks.append(now)
    return [(i, c, sum(c.count(q) for q in "“”「」『』\"") >= 4) for i, c in enumerate(chunks)]


@arrow_function("array<string>")
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(sentence_list)


@arrow_function("array<struct<title:string,start:int,end:int>>")
def chapters_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("title", "start", "end"), c)) for c in chapter_list(t)])


@arrow_function("array<struct<chunk_index:int,content:string,dialogue:boolean>>")
def chunks_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("chunk_index", "content", "dialogue"), c)) for c in chunk_list(t)])


@arrow_function("double")
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence over the longer length, in any case."""
    from ..operators.versions import longest_common

    return pd.Series([longest_common(x.lower(), y.lower()) / max(len(x), len(y)) if x and y else 0.0 for x, y in zip(a, b)])


@arrow_function("double")
def text_diff_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 LCS / (n + m) over the words of two texts."""
    from ..operators.versions import diff_ratio

    return pd.Series([diff_ratio((x or "").split(), (y or "").split()) for x, y in zip(a, b)])


#: Where a file name tells a number, tried in this order.
FILE_NUMBERS = (
    r"(?i)(?:v|vol\.?\s*)([0-9]+(?:\.[0-9]+)?)",
    r"第([0-9]+(?:\.[0-9]+)?)(?:卷|章|册|部|集)",
    r"(?i)(?:ch(?:apter)?\.?\s*)([0-9]+(?:\.[0-9]+)?)",
    r"(?i)(?:book\s+)?([0-9]+(?:\.[0-9]+)?)\s*[-–—]",
    r"[-–—\s]([0-9]+(?:\.[0-9]+)?)\s*$",
    r"^([0-9]+(?:\.[0-9]+)?)\s*[-–—.]",
)


def file_stem(path: str) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"\.[^.]+$", "")


def file_number(path: str) -> Column:
    """The number a file name tells, by the first pattern that finds one."""
    stem = file_stem(path)
    return F.coalesce(*[F.nullif(F.regexp_extract(stem, p, 1), F.lit("")).cast("double") for p in FILE_NUMBERS])


def title_author(path: str) -> Column:
    """struct(title, author) of a file name: 《title》author, title by author,
    author - title or title (author) with a short author, else the whole name."""
    stem = F.trim(file_stem(path))
    get = lambda p, i: F.trim(F.regexp_extract(stem, p, i))
    marked, by, dash, paren = r"^《([^》]+)》(?:作者[:：]?\s*)?(.*)$", r"(?i)^(.+?)\s+by\s+(.+)$", r"^(.{1,10}?)\s+[-–—]\s+(.+)$", r"^(.+?)\s*[（(]([^（()）]{1,10})[)）]$"
    made = lambda t, a: F.struct(t.alias("title"), F.nullif(a, F.lit("")).alias("author"))
    return (
        F.when(stem.rlike(marked), made(get(marked, 1), get(marked, 2))).when(stem.rlike(by), made(get(by, 1), get(by, 2)))
        .when(stem.rlike(dash), made(get(dash, 2), get(dash, 1))).when(stem.rlike(paren), made(get(paren, 1), get(paren, 2))).otherwise(made(stem, F.lit("")))
    )
