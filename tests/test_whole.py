"""Queries read every row of their tables."""

import pytest

from convolens.plans.registry import ORACLE, QUERIES, event_chunks, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rerank_head", "session_scores", "session_reserve", "paginate", "session_expand", "recency_slots", "attachments_collect", "live_tail_merge", "freshness"])
def test_no_filter_is_left(name):
    assert not [x for x in ("% 13 = 0", "% 11 = 0", "% 22", "% 50", "% 10 = 0", "event_id % 5") if x in ORACLE[name]]


def test_every_chunk_is_scored(spark):
    ids = [i for r in QUERIES["session_scores"](spark, SF).collect() for i in r.chunk_ids.split(",")]
    assert len(ids) == event_chunks(spark, SF).count() > 13


def test_every_user_is_collected(spark):
    assert QUERIES["attachments_collect"](spark, SF).count() == table(spark, SF, "events").select("user_id").distinct().count()
