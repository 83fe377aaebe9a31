"""Variant spellings of names: every canonical rewriting of each name, exploded
and met by equality within a scope, scored by how rare a rewriting is there.

Readings of Chinese characters are those of the transliterator that comes with
Spark (all Han characters); which of them occur in names is counted in the names
themselves. Nicknames and legal forms are the tables below, or the caller's.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import Scratch
from . import kernels as K
from .components import connected_components
from .meeting import in_several, meet

#: Forms of address that name no one.
GENERIC = {"师兄", "师姐", "师父", "师傅", "前辈", "the stranger", "stranger", "master", "captain", "old friend", "friend", "elder", "sir", "lady", "lord", "madam", "the boss", "narrator"}
#: Titles before a name.
TITLES = {"captain", "dr", "elder", "lady", "lord", "madam", "master", "miss", "mr", "mrs", "ms", "prof", "professor", "sir"}
#: Given names and their short forms, the usual ones first.
NICKNAMES = """
abigail: abby gail
albert: bert bertie al
alexander: al alex sandy xander
alexandra: sandra alex lexi
alfred: alf alfie fred
amanda: mandy
andrew: andy drew
anthony: tony ant
arthur: art artie
barbara: barb babs
benjamin: ben benny benji
bernard: bernie
beatrice: bea trixie
caroline: carrie caro
catherine: cathy cate cat
charles: charlie chuck chas
charlotte: lottie charlie
christina: tina chrissy chris
christopher: chris kit topher
clifford: cliff
cynthia: cindy
daniel: dan danny
david: dave davey
deborah: deb debbie
donald: don donnie
dorothy: dot dolly dottie
douglas: doug
edward: ed eddie ned ted
eleanor: ellie nora nell
elizabeth: liz beth lizzie betty eliza
emily: em emmy
eugene: gene
francis: frank frankie
frances: fran frannie
franklin: frank
frederick: fred fritz freddie
gabriella: gabi gabby ella
george: georgie
gerald: gerry jerry
gregory: greg
harold: hal harry
henry: hank harry
isabella: isa bella izzy
jacob: jake
jacqueline: jackie
james: jim jimmy jamie
jennifer: jen jenny
jessica: jess jessie
john: johnny jack
jonathan: jon jonny
joseph: joe joey
josephine: jo josie
katherine: kate kathy kitty katie
kenneth: ken kenny
lawrence: larry laurie
leonard: len lenny leo
louis: lou louie
margaret: maggie peggy meg
martha: marty
matthew: matt matty
michael: mike mick mickey
nathaniel: nat nate
nicholas: nick nicky
oliver: ollie
oswald: oz ozzie
pamela: pam
patricia: pat patty trish
patrick: pat paddy
penelope: penny nell
peter: pete
philip: phil
raymond: ray
rebecca: becky becca
richard: dick rick rich richie
robert: bob rob bobby robbie
ronald: ron ronnie
samantha: sam
samuel: sam sammy
sarah: sally sadie
stephen: steve stevie
steven: steve
susan: sue susie
theodore: ted theo teddy
thomas: tom tommy
timothy: tim timmy
ursula: uschi sula
victoria: vicky tori
vincent: vince vinny
virginia: ginny
walter: walt wally
william: bill will billy liam
winifred: winnie
yolanda: yola landa
zachary: zach zack zac
"""
#: Short forms of the kinds of organisations.
LEGAL_FORMS = """
academy: acad
association: assn assoc
brotherhood: bros
company: co
corporation: corp
department: dept
foundation: fdn
incorporated: inc
institute: inst
international: intl
laboratory: lab
library: lib
limited: ltd
manufacturing: mfg
university: univ
"""
#: Surnames of two characters.
COMPOUND_SURNAMES = {"欧阳", "歐陽", "司马", "司馬", "诸葛", "諸葛", "上官", "东方", "東方", "夏侯", "皇甫", "慕容", "令狐", "尉迟", "尉遲", "公孙", "公孫", "独孤", "獨孤", "南宫", "南宮", "长孙", "長孫", "宇文", "端木", "司徒"}
#: The hundred most frequent Chinese surnames of one character.
COMMON_SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许邓韩冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏傅方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常"
)
_HAN = re.compile("[㐀-鿿]")


def name_table(text: str) -> dict[str, list[str]]:
    """Each full or short form and the full forms it may stand for, from lines
    "full: short short"; the forms of which it is the more usual one first."""
    out: dict[str, list[tuple[int, str]]] = {}
    for line in filter(None, map(str.strip, text.split("\n"))):
        full, _, short = line.partition(":")
        for n, x in enumerate((full, *short.split())):
            out.setdefault(x, []).append((n, full))
    return {x: [x] if (0, x) in fulls else [f for _, f in sorted(fulls, key=lambda f: f[0])] for x, fulls in out.items()}


@dataclass
class Tables:
    """What rewriting goes by: nicknames, legal forms, the reading of each Han
    character (as a surname, else as in any word), and the readings that names
    of the corpus begin with and go on with."""

    nicknames: dict[str, list[str]] = field(default_factory=lambda: name_table(NICKNAMES))
    legal_forms: dict[str, list[str]] = field(default_factory=lambda: name_table(LEGAL_FORMS))
    surname: dict[str, str] = field(default_factory=dict)
    reading: dict[str, str] = field(default_factory=dict)
    families: set[str] = field(default_factory=set)
    given: set[str] = field(default_factory=set)

    def read(self, han: str) -> tuple[str, list[str]] | None:
        """Surname and syllables of the given name of a name of 2 to 4 Han characters."""
        cut = 2 if han[:2] in COMPOUND_SURNAMES and len(han) > 2 else 1
        if not 2 <= len(han) <= 4 or not all(c in self.reading for c in han):
            return None
        return "".join(self.surname.get(c, self.reading[c]) for c in han[:cut]), [self.reading[c] for c in han[cut:]]

    def latin(self, tokens: list[str]) -> str | None:
        """Key of a Chinese name in Latin letters, either order, spaces anywhere:
        "zh" for one of readings that names of the corpus have, "zx" for one
        of other readings with a frequent surname."""
        if key := self._latin(tokens, self.families, self.given):
            return f"zh {key}"
        key = self._latin(tokens, self.families | self.common, self.syllables)
        return f"zx {key}" if key else None

    def _latin(self, tokens: list[str], families: set[str], given: set[str]) -> str | None:
        whole = "".join(tokens)
        for n in range(min(len(whole) - 1, 12), 0, -1):
            if whole[:n] in families and whole[:n] not in self.nicknames and (len(tokens) == 1 or tokens[0] == whole[:n]) and _syllables(whole[n:], given):
                return f"{whole[:n]} {whole[n:]}"
        if len(tokens) > 1 and tokens[-1] in families and tokens[-1] not in self.nicknames and _syllables("".join(tokens[:-1]), given):
            return f"{tokens[-1]} {''.join(tokens[:-1])}"
        return None

    @functools.cached_property
    def common(self) -> set[str]:
        return {self.surname[c] for c in COMMON_SURNAMES if c in self.surname}

    @functools.cached_property
    def syllables(self) -> set[str]:
        return set(self.reading.values())


def _syllables(s: str, known: set[str]) -> bool:
    """Whether s is one known syllable or two."""
    return s in known or any(s[:n] in known and s[n:] in known for n in range(1, min(len(s), 7)))


def han_readings(spark: SparkSession) -> Tables:
    """Tables with the readings of all Han characters, without tones. Two calls
    of the transliterator on the driver, whatever the data."""
    chars = [chr(c) for c in (*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000))]
    icu = spark._jvm.com.ibm.icu.text.Transliterator

    def read(rule: str) -> dict[str, str]:
        lines = icu.getInstance(f"{rule}; NFD; [:Mn:] Remove; NFC; Lower").transliterate("\n".join(chars)).split("\n")
        return {c: r for c, x in zip(chars, lines, strict=True) if (r := x.replace(" ", "")).isascii() and r.isalpha()}

    return Tables(surname=read("Han-Latin/Names"), reading=read("Han-Latin"))


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


def _clean(s: str) -> str:
    s = unicodedata.normalize("NFKC", s)
    s = re.sub(r"\([^)]*\)", " ", s)
    return re.sub(r"\s+", " ", re.sub("[\"“”‘’'「」『』]", " ", s)).strip(" .,;")


def _person(s: str, tables: Tables) -> list[tuple[str, str]]:
    if _HAN.search(s):
        han = s.replace(" ", "")
        if known := tables.read(han):
            return [("full", f"zh {known[0]} {''.join(known[1])}")]
        return [("exact", f"han {han}")]
    if re.match(r"(?i)the \w+.* of ", s):
        return [("exact", "epithet " + _fold(s))]
    if "," in s:
        last, _, first = s.partition(",")
        words = last.split()
        while len(words) > 1 and words[0].strip(".").lower() in TITLES:
            words.pop(0)
        s = f"{first.strip()} {' '.join(words)}"
    words = s.split()
    while len(words) > 1 and words[0].strip(".").lower() in TITLES:
        words.pop(0)
    s = " ".join(words)
    if len(words) == 1:
        s = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])", " ", s)
    tokens = [t for t in re.split(r"[\s.]+", _fold(s).replace("-", "")) if t]
    if not tokens:
        return []
    names = tables.nicknames
    if all(len(t) > 1 for t in tokens) and (key := tables.latin(tokens)):
        return [("full", key)]
    tokens = [names[t][0] if len(names.get(t, ())) == 1 else t for t in tokens]
    if len(tokens) == 1:
        return [("exact", f"one {tokens[0]}")]
    a, b = tokens[0], tokens[-1]
    if b in names and a not in names:
        a, b = b, a
    if len(a) > 1 and len(b) > 1:
        return [("short" if len(names.get(a, ())) > 1 else "full", f"la {a} {b}")]
    if len(a) == 1 and len(b) == 1:
        return [("part", f"initials {a} {b}")]
    return [("part", f"{a} {b}")] if b not in names or len(b) == 1 else [("part", f"{b} {a}")]


def _organization(s: str, tables: Tables) -> list[tuple[str, str]]:
    if _HAN.search(s):
        return [("exact", f"han {s.replace(' ', '')}")]
    if re.fullmatch(r"[A-Z]{2,5}", s):
        return [("part", f"acronym {s.lower()}")]
    if m := re.match(r"(?i)(\w+)\.? of (?:the )?(.+)", s):
        s = f"{m[2]} {m[1]}"
    if "," in s:
        tail, _, head = s.partition(",")
        s = f"{head.strip()} {tail}"
    s = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])", " ", s)
    words = [w for w in re.split(r"[\s.\-]+", _fold(s)) if w]
    if len(words) > 1 and words[0] == "the":
        words = words[1:]
    if not words:
        return []
    words[-1] = tables.legal_forms.get(words[-1], words[-1:])[0]
    words = [w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words]
    if len(words) > 1 and len(words[0]) == 1:
        return [("part", " ".join(words))]
    return [("full", "or " + " ".join(words))]


def rewritings(name: str | None, kind: str, tables: Tables) -> list[tuple[str, str]]:
    """Canonical forms of a name: ("full", key) names one entity, ("short", key)
    is full but for a given name that is short for several, ("part", key) may fit
    several entities, ("exact", key) is compared as it stands. Nothing for null, blank
    and generic names."""
    if name is None or not (s := _clean(name)) or _fold(s) in GENERIC:
        return []
    return (_organization if kind == "organization" else _person)(s, tables)


def partial_forms(key: str) -> list[str]:
    """What a full key may be shortened to: initials and acronyms."""
    tag, *words = key.split()
    if tag == "or":
        return ["acronym " + "".join(w[0] for w in words), " ".join([words[0][0], *words[1:]])] if len(words) > 1 else []
    if tag in ("zh", "zx"):
        family, given = words
        return [f"{given[0]} {family}", f"{given} {family[0]}", f"initials {given[0]} {family[0]}"]
    a, b = words[0], words[-1]
    return [f"{a[0]} {b}", f"{a} {b[0]}", f"initials {a[0]} {b[0]}"]


def _spelled(key: str) -> str:
    tag, *words = key.split()
    return " ".join(words) if tag == "or" else " ".join(sorted(words))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def deletions(text: str) -> np.ndarray:
    """Hashes of the text and of all it becomes with one character less: texts
    that differ by one edit have one of these in common."""
    x = K.mix(K.codepoints([text])[0].astype(np.uint64))
    n = len(x)
    power = np.ones(n + 1, dtype=np.uint64)
    np.multiply.accumulate(np.full(n, _BASE), out=power[1:])
    # the first i characters, weighted so that the first character counts most
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * power[:n][::-1], dtype=np.uint64)))
    after = upto[-1] - upto[1:]
    # without a character what is before it moves one place on: its weights are those of a text one shorter
    shorter = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x[:-1] * power[: n - 1][::-1], dtype=np.uint64)))[:n]
    return np.unique(np.concatenate((upto[-1:], shorter + after)))


def one_edit_apart(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours makes
    a into b (or they are equal)."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names)


def _attested(tables):
    """Readings that the names in Han characters begin with and go on with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[str, str]] = set()
        for batch in batches:
            for names in batch.column(0).to_pylist():
                for s in map(_clean, filter(None, names or [])):
                    if _HAN.search(s) and _fold(s) not in GENERIC and (known := tables.value.read(s.replace(" ", ""))):
                        met |= {("family", known[0]), *(("given", x) for x in known[1])}
        yield _columns(sorted(met), ["part", "reading"])

    return run


def _forms(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (scope, kind, i, *form)
                for scope, kind, i, names in zip(*(c.to_pylist() for c in batch.columns))
                for form in sorted({f for n in names or [] for f in rewritings(n, kind, tables.value)})
            ]
            yield _columns(rows, ["scope", "kind", "id", "level", "form"])

    return run


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _columns([(scope, kind, key, p) for scope, kind, key in zip(*(c.to_pylist() for c in batch.columns)) for p in partial_forms(key)], ["scope", "kind", "form", "short"])


def _lengthened(tables):
    """The full forms that a form with an ambiguous given name may stand for, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for scope, kind, key in zip(*(c.to_pylist() for c in batch.columns)):
                tag, a, *rest = key.split()
                rows += [(scope, kind, key, str(n), " ".join([tag, full, *rest])) for n, full in enumerate(tables.value.nicknames[a])]
            yield _columns(rows, ["scope", "kind", "form", "rank", "whole"])

    return run


def _resolved(forms: DataFrame, tables) -> DataFrame:
    """forms with each ambiguous short form ("short") as a full one: the only
    full form it may stand for that the scope has; itself where there are
    several; the most usual where there is none."""
    short = forms.filter("level = 'short'").select("scope", "kind", "form").distinct()
    may = short.mapInArrow(_lengthened(tables), "scope string, kind string, form string, rank string, whole string")
    there = forms.filter("level = 'full'").select("scope", "kind", F.col("form").alias("whole"), F.lit(True).alias("there")).distinct()
    found = may.join(there, ["scope", "kind", "whole"], "left").groupBy("scope", "kind", "form").agg(F.count("there").alias("n"), F.min(F.when(F.col("there"), F.col("whole"))).alias("one"), F.min_by("whole", "rank").alias("usual"))
    found = found.select("scope", "kind", "form", F.when(F.col("n") == 0, F.col("usual")).when(F.col("n") == 1, F.col("one")).otherwise(F.col("form")).alias("whole"), F.lit("short").alias("level"))
    return forms.join(found, ["scope", "kind", "form", "level"], "left").select("scope", "kind", "id", F.when(F.col("level") == "short", "full").otherwise(F.col("level")).alias("level"), F.coalesce("whole", "form").alias("form")).distinct()


def _spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, d: hashes of a form with one character less, and the digest of the form."""
    for batch in batches:
        digests, keys, salts = (c.to_pylist() for c in batch.columns)
        for d, key, salt in zip(digests, keys, salts):
            h = K.mix(deletions(_spelled(key)) ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([d], pa.binary()).take(pa.array(np.zeros(len(h), np.int8)))], ["h", "d"])


#: How sure a kind of key is to be a name as it should be written.
_SURE = {"zh": 0, "zx": 1, "la": 2, "or": 2}


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forms one slip apart and, where one of them is a reading, which is the slip.
    Two readings of equal standing are two names."""
    for batch in batches:
        rows = []
        for scope, kind, x, y in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = _SURE[x[:2]], _SURE[y[:2]]
            if (a == b == 2 or a != b) and one_edit_apart(_spelled(x), _spelled(y)):
                rows.append((scope, kind, x, y, None if a == b else x if a > b else y))
        yield _columns(rows, ["scope", "kind", "x", "y", "slip"])


def _one_slip(scratch: Scratch, keys: DataFrame) -> DataFrame:
    """scope, kind, x, y: full forms one slip of the pen apart."""
    digest = F.unhex(F.md5(_form()))
    salted = keys.select(digest.alias("d"), "form", F.xxhash64("scope", "kind").alias("salt"))
    near = scratch.keep(salted.mapInArrow(_spellings, "h long, d binary"))
    pairs = scratch.keep(meet(in_several(near, F.lit(1))).distinct())
    x = keys.select(digest.alias("d1"), "scope", "kind", F.col("form").alias("x"))
    y = keys.select(digest.alias("d2"), F.col("scope").alias("s2"), F.col("kind").alias("k2"), F.col("form").alias("y"))
    met = pairs.join(x, "d1").join(y, "d2").filter("scope = s2 and kind = k2").select("scope", "kind", "x", "y")
    close = scratch.keep(met.mapInArrow(_close, "scope string, kind string, x string, y string, slip string"))
    # a slip that is as near to several readings is no evidence for any
    vague = close.filter("slip is not null").groupBy("scope", "kind", "slip").count().filter("count > 1").select("scope", "kind", "slip")
    for side in "xy":
        close = close.join(vague.select("scope", "kind", F.col("slip").alias(side)), ["scope", "kind", side], "left_anti")
    return close


def _record(scope: str = "scope", kind: str = "kind", id_col: str = "id") -> F.Column:
    return F.concat_ws("\u0001", scope, kind, id_col)


def _form(form: str = "form") -> F.Column:
    return F.concat_ws("\u0001", "scope", "kind", F.lit("="), form)


def _distinct_hashes(nodes: DataFrame) -> bool:
    """Whether 64-bit hashes tell all nodes apart."""
    h, again = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    return nodes.groupBy(h.alias("h")).agg(F.min(again).alias("lo"), F.max(again).alias("hi")).filter("lo <> hi").isEmpty()


def _best_entities(fitted: DataFrame, short: DataFrame, least_score: float) -> DataFrame:
    """scope, kind, id, entity: the one entity with the highest sum of 1/n over the
    forms of a record that it fits, if that reaches least_score.

    An entity that fits only forms whose 1/n, summed from the least on, stay below
    least_score can't reach it: those forms bring no candidates, they only add
    to those of the others. So a form of n entities is joined to them only for
    records of n * least_score forms or more, and most records aren't at all."""
    record = ["scope", "kind", "id"]
    # sums of fractions that differ by rounding only are the same
    upto = F.round(F.sum(1 / F.col("n")).over(Window.partitionBy(*record).orderBy(F.desc("n"), "form").rowsBetween(Window.unboundedPreceding, Window.currentRow)), 9)
    known = fitted.filter("n is not null").withColumn("upto", upto)
    leading = known.filter(F.col("upto") >= least_score).select(*record, "form")
    candidates = leading.join(short, ["scope", "kind", "form"]).select(*record, "entity").distinct()
    scores = candidates.join(known.select(*record, "form", "n"), record).join(short, ["scope", "kind", "form", "entity"]).groupBy(*record, "entity").agg(F.round(F.sum(1 / F.col("n")), 9).alias("score"))
    # at most as many reach least_score as the record has forms, divided by it
    best = scores.filter(F.col("score") >= least_score).groupBy(*record).agg(F.sort_array(F.collect_list(F.struct("score", "entity")), False).alias("best"))
    return best.filter((F.size("best") == 1) | (F.col("best")[0]["score"] > F.get("best", F.lit(1))["score"])).select(*record, F.col("best")[0]["entity"].alias("entity"))


def link_names(df: DataFrame, scope: str, kind: str, id_col: str, names: F.Column, tables: Tables | None = None, least_score: float = 1.0) -> DataFrame:
    """id, entity_key: one row for each record that can be named, with the same
    entity_key for records of one scope and kind that denote the same entity.

    names is an array of the spellings a record goes by; tables may hold other
    nicknames, legal forms and readings. Records are joined to the canonical
    forms of their names, and forms one slip of the pen apart to each other
    (Chinese names in Latin letters only if one of them isn't a reading that
    names of the data have). Shortened forms are scored by their rarity: one that
    fits n entities of the scope speaks for each of them with 1/n, however many; a
    record that has only such forms goes to the entity with the highest
    sum if that reaches least_score and no other has as much. One whose forms
    fit only several entities stays alone, and forms that fit no full name link
    only records with the same one. No record is compared with all others of
    its scope. Null scope, kind or id and records without a usable name give no
    row; repeated rows count once.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(F.col(scope).cast("string").alias("scope"), F.col(kind).cast("string").alias("kind"), F.col(id_col).cast("string").alias("id"), names.alias("names"))
    rows = rows.filter(F.col("scope").isNotNull() & F.col("kind").isNotNull() & F.col("id").isNotNull())
    tables = tables or han_readings(spark)
    all_readings = spark.sparkContext.broadcast(tables)
    # some 400 syllables at most, whatever the data
    for r in rows.filter("kind <> 'organization'").select("names").mapInArrow(_attested(all_readings), "part string, reading string").distinct().collect():
        (tables.families if r["part"] == "family" else tables.given).add(r["reading"])
    known = spark.sparkContext.broadcast(tables)
    text = "scope string, kind string, "
    forms = scratch.keep(rows.mapInArrow(_forms(known), text + "id string, level string, form string").distinct())
    all_readings.destroy()
    forms = scratch.keep(_resolved(forms, known))
    keys = scratch.keep(forms.filter("level = 'full'").select("scope", "kind", "form").distinct())
    close = _one_slip(scratch, keys)

    strong = forms.filter("level <> 'part'")
    nodes = strong.select(_record().alias("node")).union(strong.select(_form().alias("node"))).distinct()
    node = F.xxhash64 if _distinct_hashes(nodes) else (lambda c: c)
    edges = strong.select(node(_record()).alias("a"), node(_form()).alias("b")).union(close.select(node(_form("x")), node(_form("y"))))
    groups = scratch.keep(connected_components(edges, "a", "b"))
    named = scratch.keep(strong.select("scope", "kind", "id").distinct().join(groups, node(_record()) == F.col("node")).select("scope", "kind", "id", F.col("component").cast("string").alias("entity_key")))

    of_key = keys.withColumn("node", node(_form())).join(groups, "node").select("scope", "kind", "form", F.col("component").cast("string").alias("entity"))
    short = scratch.keep(keys.mapInArrow(_shortened, text + "form string, short string").join(of_key, ["scope", "kind", "form"]).select("scope", "kind", F.col("short").alias("form"), "entity").distinct())
    fits = short.groupBy("scope", "kind", "form").agg(F.count("*").alias("n"))
    weak = forms.filter("level = 'part'").join(named.select("scope", "kind", "id"), ["scope", "kind", "id"], "left_anti")
    fitted = scratch.keep(weak.join(fits, ["scope", "kind", "form"], "left"))
    best = _best_entities(fitted, short, least_score)
    each = fitted.groupBy("scope", "kind", "id").agg(F.max(F.col("n").isNotNull()).alias("known"), F.min("form").alias("form")).join(best, ["scope", "kind", "id"], "left")
    alone = F.concat_ws("\u0001", "scope", "kind", F.lit("?"), "id")
    same = F.concat_ws("\u0001", "scope", "kind", F.lit("~"), "form")
    attached = each.select("scope", "kind", "id", F.coalesce("entity", F.when(F.col("known"), alone).otherwise(same)).alias("entity_key"))
    return scratch.keep(named.union(attached).select("id", "entity_key").distinct())


def linked_pairs(links: DataFrame) -> DataFrame:
    """a, b: ids (smaller first) with the same entity_key, each pair once."""
    left, right = links.select("entity_key", F.col("id").alias("a")), links.select("entity_key", F.col("id").alias("b"))
    return left.join(right, "entity_key").filter(F.col("a") < F.col("b")).select("a", "b").distinct()
