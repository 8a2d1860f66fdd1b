"""Checks of whole answers, and measures against answers that can be computed."""

import pytest
from pyspark.sql import functions as F

from convolens.operators import evalkit
from convolens.plans.parse import ParsedQuery

MESSAGE = "struct<ts:double,msg_id:long,is_from_me:boolean,sender:string,text:string>"


def answer(spark, sessions, ordering="recent", behind=0, stale=False):
    df = spark.createDataFrame([(i + 1, s, []) for i, s in enumerate(sessions)], f"place int, hit_messages array<{MESSAGE}>, context_messages array<{MESSAGE}>")
    return df.withColumn("ordering", F.lit(ordering)).withColumn("n_messages_since_index", F.lit(behind)).withColumn("index_stale", F.lit(stale))


GOOD = [[(50.0, 5, False, "Kaya Moreno", "dinner at six")], [(20.0, 2, False, "Kaya Moreno", "hello"), (30.0, 3, False, "Kaya Moreno", "there")]]


def test_a_good_answer_passes(spark):
    q = ParsedQuery("q", senders=("h1",), participants=("h1",), date_from=10.0, date_to=60.0)
    r = evalkit.answer_checks(answer(spark, GOOD), q, {"handles": ["H1"], "sender": "Kaya", "date": True, "results": True, "words": "Dinner"}).first().asDict()
    assert all(v is not False for v in r.values()) and r["self_filter_applied"] is None and r["lexical_presence"] and r["recency_session_order"]


@pytest.mark.parametrize(
    "sessions,q,expected,kw,fails",
    [
        (GOOD, ParsedQuery("q"), {"handles": ["h1"]}, {}, "person_filter_applied"),
        (GOOD, ParsedQuery("q"), {"date": True}, {}, "date_filter_applied"),
        (GOOD, ParsedQuery("q"), {"from_me": True}, {}, "self_filter_applied"),
        (GOOD, ParsedQuery("q"), {"media": True}, {}, "media_filter_applied"),
        (GOOD, ParsedQuery("q"), {"sender": "Sam"}, {}, "sender_is_expected"),
        (GOOD, ParsedQuery("q", date_from=25.0), {}, {}, "date_containment"),
        (GOOD[::-1], ParsedQuery("q"), {}, {}, "recency_session_order"),
        (GOOD, ParsedQuery("q"), {"words": "lunch"}, {}, "lexical_presence"),
        (GOOD, ParsedQuery("q"), {}, {"behind": 3}, "freshness_declared"),
        (GOOD, ParsedQuery("q"), {}, {"ordering": "none"}, "ordering_declared"),
        ([], ParsedQuery("q"), {"results": True}, {}, "nonempty"),
        ([[]], ParsedQuery("q"), {}, {}, "no_empty_sessions"),
        ([[(1.0, 1, True, None, "x")]], ParsedQuery("q", senders=("h1",)), {}, {}, "no_self_in_sender"),
        ([*GOOD, [(5.0, 9, False, "Sam", "x")]], ParsedQuery("q", senders=("h1",)), {}, {}, "sender_purity"),
    ],
)
def test_each_fault_is_seen(spark, sessions, q, expected, kw, fails):
    r = evalkit.answer_checks(answer(spark, sessions, **kw), q, expected).first().asDict()
    assert r[fails] is False


def test_newest_metrics(spark):
    truth = spark.createDataFrame([(1, i, float(i)) for i in range(1, 31)] + [(2, 7, 7.0)], "case_id int, msg_id long, ts double")
    found = spark.createDataFrame([(1, i) for i in (30, 29, 28, 5, 99)], "case_id int, msg_id long")
    members = spark.createDataFrame([(i,) for i in range(1, 30)], "msg_id long")
    r = {x.case_id: x for x in evalkit.newest_metrics(found, truth, members).collect()}
    assert (r[1].precision, r[1].newest_present, r[1].indexed_coverage) == (0.8, 1.0, 0.95) and r[1].recall_top == pytest.approx(2 / 19)
    assert (r[2].precision, r[2].recall_top, r[2].newest_present) == (0.0, 0.0, 0.0)
    r = {x.case_id: x for x in evalkit.newest_metrics(found, truth, members, horizon=29.5).collect()}
    assert r[1].newest_is_indexed == 0.0 and r[1].indexed_coverage == 1.0 and r[1].recall_top == pytest.approx(2 / 20)


def test_filter_kill(spark):
    entries = spark.createDataFrame([(1, [10, 11]), (2, [12]), (3, [])], "entry_id int, positives array<long>")
    candidates = spark.createDataFrame([(1, 11), (2, 99)], "entry_id int, chunk_id long")
    assert tuple(evalkit.filter_kill(entries, candidates).first())[:2] == (3, 2)
