"""Column functions on cases of our own, and on forms made by rule."""

import itertools

import pytest
from pyspark.sql import functions as F

from orefolio.functions import compare, numbers, periods, text


def column(spark, values, fn):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in rows.select("k", fn(F.col("v")).alias("x")).orderBy("k").collect()]


def in_digits(n, zero):
    return "".join(chr(ord(zero) + int(c)) if c.isdigit() else c for c in n)


def test_quantity_value_of_labels_and_figures(spark):
    """Every label before every figure, in any of the three scripts of digits."""
    labels = ["", "Q3 2019: ", "q1-2020 ", "FY 2018-19: ", "H2 2021 ", "June 2017: ", "तीसरी तिमाही 2019: ", "वित्तीय वर्ष 2018-19 ", "जुलाई 2020: ", "నాల్గవ త్రైమాసికం 2019: ", "ఏప్రిల్ 2021: "]
    figures = {"7,31,250 t": 731250, "18.75 MT": 18.75, "64,300": 64300, "-12.5 kt": -12.5}
    cases = [(label + (shown if zero is None else in_digits(shown, zero)), value) for label, (shown, value) in itertools.product(labels, figures.items())
             for zero in (None, "०", "౦") if not (label.endswith(" ") and not label.endswith(": ") and shown.startswith("-"))]
    assert column(spark, [c for c, _ in cases], numbers.quantity_value) == [v for _, v in cases]


def test_quantity_value_of_odd_texts(spark):
    table = {"Q4": None, "not stated": None, "": None, None: None, "1987": 1987, "चौथी तिमाही 2031": None, "రెండవ త్రైమాసికం 2031": None, "May 310 t": None, "300 t over 2031-2034": 300,
             "2.4 lakh": 2.4, "some 17 of 90": 17}
    assert column(spark, list(table), numbers.quantity_value) == list(table.values())


def test_period_of(spark):
    table = {"2031-11-05": (2031, 4), "2031-04-30": (2031, 2), "Q4 2031": (2031, 4), "2031 q2": (2031, 2), "तृतीय तिमाही 2031": (2031, 3), "తృతీయ త్రైమాసికం 2031": (2031, 3),
             "चौथी तिमाही २०३१": (2031, 4), "మొదట త్రైమాసికం ౨౦౩౧": (2031, 1), "Sept 2031": (2031, 3), "अगस्त 2031": (2031, 3), "అక్టోబర్ 2031": (2031, 4),
             "1999": (1999, None), "27-10-2031": (2031, None), "2014-09": (2014, 3), "none": None, None: None}
    assert [x and tuple(x) for x in column(spark, list(table), periods.period_of)] == list(table.values())


#: Groups of forms that say the same; forms of different groups of one row disagree.
SAME = [[["strip mining", "Open-Pit", "खुली खदान", "బహిరంగ"], ["Shaft", "sub surface", "भूमिगत", "భూగర్భ"]],
        [["lignite", "लिग्नाइट", "Lignite."], ["bauxite", "बॉक्साइट"], ["चूना पत्थर", "Limestone"]],
        [["3,10,400 t", "310400 t", "310,401 tonnes"], ["29.9 MT", "29.90 mt", "30.0 MT"]],
        [["Korba", "korba  ", "Korba East"], ["Talcher"]]]


def test_values_conflict(spark):
    cases = [(a, b, False) for row in SAME for group in row for a, b in itertools.product(group, group)]
    cases += [(a, b, True) for row in SAME for x, y in itertools.permutations(row, 2) for a, b in itertools.product(x, y)]
    cases += [(None, "y", False), ("", "y", False), ("7.12 MT", "71.2 MT", True), ("abc", "ab c", False), ("coal", "no such thing", True)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    found = rows.select("k", compare.values_conflict(compare.parsed(F.col("a")), compare.parsed(F.col("b"))).alias("x")).orderBy("k").collect()
    assert [(cases[r["k"]][:2], r["x"]) for r in found] == [((a, b), want) for a, b, want in cases]


@pytest.mark.parametrize("a, b, same", [("Gevra Opencast Mine", "gevra  opencast-mines", True), ("The Dipka Colliery Co. Ltd", "Dipka", True), ("Project Amlohri", "Amlohri Project (India)", True),
                                        ("Pit 4 North", "Pit 5 North", False), ("Kusmunda Mine", "Khadia Mine", False)])
def test_mine_key(spark, a, b, same):
    x, y = column(spark, [a, b], lambda c: text.mine_key(c, F.lit(None).cast("string")))
    assert (x == y) is same and x


def test_generic_names_keep_a_key(spark):
    assert column(spark, ["Project of India", "", None], lambda c: text.mine_key(c, F.lit("").cast("string"))) == ["project of india", None, None]
    assert column(spark, ["", None], lambda c: text.mine_key(c, F.lit("Singrauli Mines"))) == ["singrauli", "singrauli"]


def test_verdict(spark):
    cases = [("Deep", "deep ", "exact"), ("Deep", "underground", "equivalent"), ("लौह अयस्क", "iron", "equivalent"), ("iron", None, "missing"), ("iron", " \t", "missing"), ("12 t", "19 t", "wrong")]
    rows = spark.createDataFrame(cases, "e string, a string, want string")
    for r in rows.select("want", compare.verdict(compare.parsed(F.col("e")), compare.parsed(F.col("a"))).alias("x")).collect():
        assert r["x"] == r["want"]


def test_search_variants(spark):
    table = {"7,31,250 tonnes in all": ["7,31,250 tonnes in all", "731250 tonnes in all", "7,31,250 tonnes", "7,31,250", "731250"], "about  18.75 Million  MT": ["about 18.75 Million MT", "18.75 Million MT", "18.75"],
             "coal": ["coal"], "42": [], None: [], "640": ["640"], "1,2": ["1,2"], "९९९ टन": ["९९९ टन", "९९९"]}
    assert column(spark, list(table), numbers.search_variants) == list(table.values())


def test_digit_tolerant_pattern(spark):
    rows = spark.createDataFrame([("640", "of 3,640 or 6400 and 640.", 22), ("731250", "= 7,31, 250 t", 3), ("b+c", "bc b+c", 4), ("12 MT", "at 112 mt, 12 Mt", 12), ("5 x", "no", 0)], "v string, t string, want int")
    for r in rows.select("v", "want", F.regexp_instr("t", numbers.digit_tolerant_pattern(F.col("v"))).alias("x")).collect():
        assert r["x"] == r["want"], r


def test_words_keep_marks(spark):
    assert column(spark, ["लौह अयस्क 17 pit no P12b_ఖని"], text.words)[0] == ["लौह", "अयस्क", "pit", "p12b_ఖని"]


def test_scripts(spark):
    assert column(spark, ["latin", "खनिज and ఖనిజ", "ఖని"], text.scripts_in) == [[], ["Devanagari", "Telugu"], ["Telugu"]]
    assert column(spark, ["latin", "ఖని", "कख ఖగ"], text.dominant_script) == [None, "Telugu", "Devanagari"]


def test_shorten_and_prompt(spark):
    assert column(spark, ["fits.docx", "b" * 50 + ".xlsx", "c" * 60], text.shorten_name) == ["fits.docx", "b" * 18 + "…" + "b" * 10 + ".xlsx", "c" * 21 + "…" + "c" * 12]
    assert column(spark, ["\tone\n\ttwo ", "y" * 400, None], text.prompt_field) == ["one two", "y" * 300 + "…", ""]
