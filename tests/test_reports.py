"""Reports, numbers by region, and questions that name no one."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from convolens.operators import evalkit, suites
from convolens.plans.parse import Contacts
from convolens.sources import contacts, phones

NUMBERS = [
    ("+1 (743) 555-3824", "FR", "+17435553824"), ("743-555-3824", "US", "+17435553824"), ("1 743 555 3824", "US", "+17435553824"), ("011 44 20 7183 8750", "US", "+442071838750"),
    ("020 7183 8750", "GB", "+442071838750"), ("00 33 1 42 68 53 00", "GB", "+33142685300"), ("01 42 68 53 00", "FR", "+33142685300"), ("33142685300", "FR", "+33142685300"),
    ("+351 212 345 678", None, "+351212345678"), ("06 12345678", "IT", "+390612345678"), ("8 912 345-67-89", "RU", "+79123456789"), ("+7 701 234 5678", "US", "+77012345678"),
    # not valid: too short, an area that begins with 1, unknown code, a card, no plan for the region, letters
    ("12345", "US", "12345"), ("143-555-3824", "US", "143-555-3824"), ("743-155-3824", "US", "743-155-3824"), ("+999 1234567", "US", "+999 1234567"), ("4994226020900891", "US", "4994226020900891"),
    ("743-555-3824", "XX", "743-555-3824"), ("743-555-3824", None, "743-555-3824"), ("call 743-555-3824", "US", "call 743-555-3824"), ("", "US", ""), ("+", "US", "+"),
    (" Mo@X.org ", "US", "mo@x.org"), (None, "US", None),
]


def test_numbers(spark):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(NUMBERS)], "i int, raw string, region string, want string")
    got = rows.withColumn("got", phones.normalised(F.col("raw"), F.col("region"))).orderBy("i").collect()
    assert [(r["raw"], r["got"]) for r in got] == [(r["raw"], r["want"]) for r in got]


def test_contacts_of_a_region(spark):
    raw = spark.createDataFrame([("c", "Mo", None, None, ["020 7183 8750", "555", "MO@X.org"])], "identifier string, nickname string, given string, family string, handles array<string>")
    assert contacts.normalise_contacts(raw, "GB").first()["handles"] == ["+442071838750", "555", "mo@x.org"]


def test_recall_report(spark):
    """Bands with their limits inside; rows without a value are in no band; a null category is a row of its own."""
    rows = [("a", 1.0, 1, 1, 0), ("a", 2.0, 1, 0, 0), ("b", 3.0, 0, 0, 1), (None, 4.0, 1, 1, None), ("b", None, 1, 1, 0)]
    out = evalkit.recall_report(spark.createDataFrame(rows, "kind string, far double, r50 int, r12 int, lost int"), "kind", ["r50", "r12"], "far", "lost")
    got = {(r["facet"], r["label"]): r for r in out.collect()}
    assert set(got) == {("category", "a"), ("category", "b"), ("category", None), ("overall", "OVERALL"), ("band", "Q1"), ("band", "Q2"), ("band", "Q3")}
    assert got["band", "Q1"]["n"] == 2 and got["band", "Q3"]["r12"] == 1.0
    top = got["overall", "OVERALL"]
    assert (top["n"], top["r50"], top["r12"], round(top["gap1"], 9), top["kill_rate"]) == (5, 0.8, 0.6, -0.2, 0.2)
    empty = evalkit.recall_report(spark.createDataFrame([], "kind string, r50 int"), "kind", ["r50"])
    assert [(r["n"], r["r50"], r["kill_rate"]) for r in empty.collect()] in ([(0, None, None)], [])


def test_compare_metrics(spark):
    """Pairs without one of the values do not count, nor cases of one target."""
    a = spark.createDataFrame([(1, "x", True, 1.0), (2, "x", True, 2.0), (3, "y", False, None), (4, "y", True, 5.0)], "i int, kind string, ok boolean, m double")
    b = spark.createDataFrame([(1, True, 2.0), (2, False, 4.0), (3, True, 1.0), (9, True, 1.0)], "i int, ok boolean, m double")
    got = {(r["metric"], r["label"]): r for r in evalkit.compare_metrics(a, b, ["i"], ["ok", "m"], "kind").collect()}
    assert set(got) == {("ok", "OVERALL"), ("ok", "x"), ("ok", "y"), ("m", "OVERALL"), ("m", "x")}
    ok, m = got["ok", "OVERALL"], got["m", "OVERALL"]
    assert (ok["n"], ok["a_better"], ok["b_better"], ok["chi2"], ok["delta"]) == (3, 1, 1, 0.0, 0.0)
    assert (m["n"], m["mean_a"], m["mean_b"], m["delta"]) == (2, 1.5, 3.0, 1.5) and round(m["high"] - m["low"], 6) == round(2 * 1.96 * 0.5, 6)
    assert got["ok", "y"]["low"] is None


def test_outcomes(spark):
    rows = spark.createDataFrame([("a", "pass"), ("a", "fail"), ("a", None), ("b", "pass"), ("b", "odd")], "kind string, how string")
    got = sorted(map(tuple, evalkit.outcomes(rows, "kind", "how", ["pass", "fail"]).collect()))
    assert got == [("a", 1, 1, 2, 0.5), ("b", 1, 0, 1, 1.0)]


@pytest.fixture
def negatives(spark):
    texts = ["We came from the beach and went with Kaya.", "from  the  Beach with JOSÉ", "with kaya from work, from Work", "with the kaya again", None, "from it", "xfrom home and more and more", "from work " * 40]
    m = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "msg_id long, text string")
    known = spark.createDataFrame([("Kaya Moreno",), (None,), ("?",)], "display_name string")
    return suites.corpus_negatives(m, known)


def test_corpus_negatives(negatives):
    """Blanks and case are one, contacts go with and without "the", texts that are too short or long and parts of words do not count."""
    assert sorted(map(tuple, negatives.collect())) == [("jos", 1), ("the beach", 2), ("work", 2)]


def test_probe_without_an_address_book(spark, negatives):
    """Without contacts no one is named and no name that was typed gets lost; with them the corpus's phrases name no one."""
    people, now = Contacts([("Kaya Moreno", ["+15550001"]), ("Sam Lee", ["sam@x.org"])]), datetime(2024, 6, 12, tzinfo=UTC)
    for r in suites.blind_probe(spark, people, now, negatives).collect():
        assert (r["invented"], r["lost"], r["passed"]) == (0, 0, r["n"]), r
    rates = {(r["kind"], r["form"]): r["rate"] for r in suites.parser_probe(spark, people, now, negatives).collect()}
    assert rates["negative", "corpus"] == 1.0 and rates["positive", "plain"] == 1.0
