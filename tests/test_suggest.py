"""Suggestions against a look at every name."""

import random

import pytest
from pyspark.sql import functions as F

from convolens.functions.names import fold_name, osa_distance
from convolens.operators.suggest import NameIndex, _numbered, chat_names, edits_allowed, numbered_pieces, suggest_chats, write_names

NAMES = [
    (1, "José Ñandú"), (1, "Pepe"), (2, "Jose Nandu"), (3, "Ann-Marie O'Neil"), (4, None), (5, "  "), (6, "Li"), (7, "abababababab"), (8, "ababababab"), (9, "Dinner club, Anna, Bo"),
    (10, "anna"), (11, "nana nana"), (12, "Charlotte"), (13, "Charltote"), (14, "Charlott"), (15, "x" * 65), (16, "x" * 200 + " needle"), (17, "aaaaaaaa"), (18, "aaaaaa"), (3, "Ann-Marie O'Neil"),
]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    return NAMES + [(100 + i, " ".join("".join(r.choices("abc", k=r.randint(1, 9))) for _ in range(r.randint(1, 3)))) for i in range(300)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return write_names(spark.createDataFrame(rows, "owner long, shown string"), str(tmp_path_factory.mktemp("names") / "n"))


@pytest.mark.parametrize("part", ["a", "an", "ann", "anna", "nandu", "Ñ", "club anna", "needle", "zz", "bca", "o'n", "ab ", "abcab"])
def test_containing_is_a_scan(index, rows, part):
    want = {(o, s) for o, s in rows if fold_name(part) in fold_name(s or "") and fold_name(s or "")}
    got = [(r.owner, r.shown) for r in index.containing(part).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("asked", ["jsoe", "charlotte", "charlote", "abababab", "baababab", "aaaaaaaa", "aaaa", "abcabcab", "cabbac", "bacc", "li", "il", "anna", "ana marie oneil", "ann marie oneil", "x" * 64, "x" * 70, "", "?"])
def test_misspelt_is_a_scan(index, rows, asked):
    a = fold_name(asked)
    k, want = edits_allowed(a), {}
    for o, s in rows:
        text = fold_name(s or "")
        for w in {text, *text.split()} - {""}:
            if a and len(w) <= 66 and len(a) <= 64 and (d := osa_distance(w, a)) <= k:
                want[o, s] = min(d, want.get((o, s), 9))
    got = {(r.owner, r.shown): r.distance for r in index.misspelt(asked).collect()}
    assert got == want


def test_pieces_are_those_of_the_asked_text(spark):
    words = ["a", "abab", "aaaaaaaaaaaaaaaa", "naïve", "xyx yxy"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", numbered_pieces(F.col("w")).alias("p")).collect()
    assert {r.w: r.p for r in got} == {w: _numbered(w) for w in words}
    assert all(len(set(r.p)) == len(r.p) == len(r.w) + 2 for r in got)


def test_order_of_suggestions(spark, tmp_path):
    i = write_names(spark.createDataFrame([(1, "Joanna"), (2, "Anna Lee"), (3, "Bo Anna"), (4, "Anan"), (5, "Zed"), (5, "Anna")], "owner long, shown string"), str(tmp_path / "n"))
    assert [(r.owner, r.distance) for r in i.suggest("anna").collect()] == [(5, 0), (2, 0), (3, 0), (1, 0), (4, 1)]
    assert [r.owner for r in i.suggest("anna", 2).collect()] == [5, 2]
    assert i.suggest("", 3).count() == 3


def test_no_names(spark, tmp_path):
    i = write_names(spark.createDataFrame([], "owner long, shown string"), str(tmp_path / "n"))
    assert i.suggest("anna").count() == i.containing("").count() == i.misspelt("anna").count() == 0


def test_only_lists_of_pieces_are_read(spark, index):
    plan = NameIndex(spark, index.root).texts_with("needle")._jdf.queryExecution().toString()
    assert "EqualTo(piece," in plan and "owners" not in plan


def test_chats(spark, tmp_path):
    meta = spark.createDataFrame([(1, ["Ann", "Bo"], 2, "Ann, Bo"), (2, [], 0, "Dinner club"), (3, ["Bo"], 1, "Bo"), (4, ["Joann"], 1, "Joann")], "chat_id long, participants array<string>, participant_count int, title string")
    chunks = spark.createDataFrame([(1, 5.0), (1, 9.0), (3, 7.0)], "chat_id long, end_ts double")
    i = write_names(chat_names(meta), str(tmp_path / "n"))
    ask = lambda part, n=20: [tuple(r) for r in suggest_chats(i, meta, chunks, part, n).collect()]
    assert ask("ANN") == [(1, "Ann, Bo", 2, 2, 9.0), (4, "Joann", 1, 0, None)]
    assert [r[0] for r in ask("bo")] == [1, 3] and [r[0] for r in ask("")] == [1, 3, 2, 4] and [r[0] for r in ask("", 1)] == [1] and ask("nobody") == []
