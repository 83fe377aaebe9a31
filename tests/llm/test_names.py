import pytest
from pyspark.sql import functions as F

from inkloom.llm.names import Tables, deletions, han_readings, link_names, linked_pairs, one_edit_apart, rewritings

TABLES = Tables()


@pytest.fixture(scope="module", autouse=True)
def tables(spark):
    """Readings as names in a corpus may hold them."""
    TABLES.__dict__ |= han_readings(spark).__dict__
    for name in ("萧寒星", "陆云河", "王小明"):
        family, given = TABLES.read(name)
        TABLES.families.add(family)
        TABLES.given |= set(given)


def keys(name, kind="character"):
    return rewritings(name, kind, TABLES)


def test_person_rewritings():
    full = [("full", "la william yorihurst")]
    for n in ("William Yorihurst", "Sir Yorihurst, Bill", "WILLIAM YORIHURST", "WilliamYorihurst", "William Brano Yorihurst", "“Bill” Yorihurst", "William Yörihurst", "Yorihurst William", "william yorihurst "):
        assert keys(n) == full, n
    zh = [("full", "zh xiao hanxing")]
    for n in ("萧寒星", "萧 寒星", "萧寒星（主角）", "Xiao Hanxing", "XIAO Hanxing", "Hanxing Xiao", "Xiao, Hanxing", "Xiao Han-Xing", "xiaohanxing", "Xiao Han Xing", "萧涵杏"):
        assert keys(n) == zh, n
    assert keys("K. Holelmont") == [("part", "k holelmont")] == keys("Holelmont, K.")
    assert keys("Katherine H.") == [("part", "katherine h")]


def test_organisation_rewritings():
    full = [("full", "or crimson peak company")]
    for n in ("Crimson Peak Company", "The Crimson Peak Co.", "Peak Company, Crimson", "Company of the Crimson Peak", "CrimsonPeak Company", "Crimson-Peak Company", "Crimson Peaks Company", "CRIMSON PEAK COMPANY"):
        assert keys(n, "organization") == full, n
    assert keys("CPC", "organization") == [("part", "acronym cpc")]


def test_nothing_for_generic_and_empty():
    assert [keys(n) for n in (None, "", "  ", "Captain", "师兄", "the stranger", "…")][:6] == [[]] * 6


def test_one_edit():
    for a, b in (("peichneyu", "peichenyu"), ("sect", "sct"), ("abc", "abc"), ("abc", "axc")):
        assert one_edit_apart(a, b) and one_edit_apart(b, a) and set(deletions(a)) & set(deletions(b))
    assert not one_edit_apart("abcd", "badc") and not one_edit_apart("abc", "abcde")


def test_links(spark):
    rows = [
        ("s", "character", "01", "William Yorihurst", None), ("s", "character", "02", "Bill  Yorihust", []), ("s", "character", "03", "W. Yorihurst", None), ("s", "character", "04", "the Quiet Map of Tsruhiroy", ["Captain", "William Yorihurst"]),
        ("s", "character", "05", "Walter Yorihurst", None), ("s", "character", "06", "Gabriella Yorihurst", None), ("s", "character", "07", "G. Yorihurst", ["", None, "old friend"]),
        ("s", "character", "08", "Captain", ["Captain"]), ("s", "character", "09", "Captain", None), ("t", "character", "10", "William Yorihurst", None), (None, "character", "11", "William Yorihurst", None),
        ("s", "organization", "12", "Copper Anvil Company", None), ("s", "organization", "13", "CAC", None), ("s", "organization", "14", "Copper Anvil Academy", None), ("s", "character", "01", "William Yorihurst", None),
        ("s", "character", None, "William Yorihurst", None), ("s", "character", "15", None, None), ("u", "character", "16", "Lu Yunhe", None), ("u", "character", "17", "Lu Yuhe", None), ("u", "character", "18", "x" * 5000, None),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], "series_id string, kind string, id string, name string, aliases array<string>, form string, level string, scope string")
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    got = {tuple(r) for r in linked_pairs(link_names(df, "series_id", "kind", "id", names)).collect()}
    # W. fits William and Walter; C A C fits a company and, as C A A would, no academy
    assert got == {("01", "02"), ("01", "04"), ("02", "04"), ("06", "07"), ("12", "13")}
    assert link_names(df.limit(0), "series_id", "kind", "id", names).count() == 0


def linked(spark, names, kind="character"):
    df = spark.createDataFrame([("s", kind, f"{k:02d}", n) for k, n in enumerate(names)], "series_id string, kind string, id string, name string")
    pairs = linked_pairs(link_names(df, "series_id", "kind", "id", F.array("name"))).collect()
    return {(names[int(r.a)], names[int(r.b)]) for r in pairs}


def test_usual_names(spark):
    pairs = [("Michael Doe", "Mike Doe"), ("James Roe", "Jim Roe"), ("Thomas Poe", "Tom Poe"), ("Richard Noe", "Dick Noe"), ("Samuel Low", "Sam Low"), ("Susan Row", "Sue Row"), ("王小明", "Wang Xiaoming"), ("张三", "Zhang San"), ("欧阳修", "Ouyang Xiu"), ("曾国藩", "Zeng Guofan")]
    assert linked(spark, [n for p in pairs for n in p]) == set(pairs)
    firms = [("Ninth Gate Incorporated", "Ninth Gate Inc."), ("Hollow Moon University", "Hollow Moon Univ"), ("Amber Sea Corporation", "Amber Sea Corp.")]
    assert linked(spark, [n for p in firms for n in p], "organization") == set(firms)


def test_short_form_of_several_names(spark):
    assert linked(spark, ["Samuel Low", "Sam Low", "Sammy Low"]) == {("Samuel Low", "Sam Low"), ("Samuel Low", "Sammy Low"), ("Sam Low", "Sammy Low")}
    assert linked(spark, ["Samantha Low", "Sam Low"]) == {("Samantha Low", "Sam Low")}
    assert linked(spark, ["Samantha Low", "Sam Low", "Samuel Low", "Low, Sam"]) == {("Sam Low", "Low, Sam")}


def test_rarity_scores(spark):
    """Two rewritings that fit two entities each point to the one they share."""
    rows = [("1", ["William York"]), ("2", ["Walter York"]), ("3", ["William Young"]), ("4", ["W. York", "William Y."]), ("5", ["W. York"])]
    df = spark.createDataFrame([("s", "character", *r) for r in rows], "series_id string, kind string, id string, names array<string>")
    assert {tuple(r) for r in linked_pairs(link_names(df, "series_id", "kind", "id", F.col("names"))).collect()} == {("1", "4")}


def test_rarity_scores_of_frequent_forms(spark):
    """Forms that fit many entities each, or sums of sixths: nothing is left out or lost by rounding."""
    others = [f"William Y{chr(97 + k)}{chr(97 + j)}rk" for k in range(3) for j in range(3)]
    given = [("William", "W"), ("Edwin", "E")]
    rows = [("target", [f"{g} {s}" for g, _ in given for s in ("Stone", "Quill", "Brand", "Frost", "Marsh")])]
    shorts = [f"{i}. {s}" for _, i in given for s in ("Stone", "Quill", "Brand", "Frost", "Marsh")]
    names = {"W": ["Walter", "Warren", "Wallace", "Winston", "Wendell", "Wilbur", "Wesley", "Warwick", "Wyatt"], "E": ["Edgar", "Edmund", "Elmer", "Ernest", "Ethan", "Evan", "Emmett", "Elias", "Ezra"]}
    rows += [(f"{f} {s}", [f"{f} {s}"]) for i in "WE" for f in names[i][:8] for s in ("Stone", "Quill", "Brand", "Frost", "Marsh")]
    rows += [("ten", shorts), ("eight", shorts[:8]), ("other", others)]
    df = spark.createDataFrame([("s", "character", *r) for r in rows], "series_id string, kind string, id string, names array<string>")
    links = {r.id: r.entity_key for r in link_names(df, "series_id", "kind", "id", F.col("names")).collect()}
    # ten forms that fit nine entities each, of which one fits all: 10/9; with eight of them 8/9
    assert links["ten"] == links["target"] and links["eight"] not in {links[i] for i in links if i != "eight"}
    six = [("target", [f"William {s}" for s in ("Stone", "Quill", "Brand", "Frost", "Marsh", "Thorn")])] + [(f"{f} {s}", [f"{f} {s}"]) for f in names["W"][:5] for s in ("Stone", "Quill", "Brand", "Frost", "Marsh", "Thorn")]
    six += [("six", [f"W. {s}" for s in ("Stone", "Quill", "Brand", "Frost", "Marsh", "Thorn")])]
    df = spark.createDataFrame([("s", "character", *r) for r in six], "series_id string, kind string, id string, names array<string>")
    assert {tuple(r) for r in linked_pairs(link_names(df, "series_id", "kind", "id", F.col("names"))).collect()} == {("six", "target")}


def test_names_of_any_length(spark):
    long = "".join(chr(97 + k * k % 26) for k in range(200_000))
    assert linked(spark, [f"Ada {long}", f"Ada {long[:-1]}", "x", ""]) == {(f"Ada {long}", f"Ada {long[:-1]}")}
