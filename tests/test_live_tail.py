from datetime import UTC, datetime

import pytest

from convolens.plans.parse import ParsedQuery
from convolens.plans.search import Engine, build_index
from convolens.sources.store import IndexStore

T0 = datetime(2024, 5, 1, tzinfo=UTC).timestamp()
SCHEMA = "msg_id long, chat_id long, ts double, is_from_me boolean, handle string, text string, has_attachment boolean"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    """Three chats in the index; later messages in chats 1 and 2 that are not in it."""
    old = [(i, i % 3, T0 + i * 60, False, f"h{i % 3}", f"indexed words {i}", False) for i in range(12)]
    new = [(100, 1, T0 + 50_000, False, "h1", "news in one", False), (101, 2, T0 + 60_000, False, "h2", "news in two", False), (102, 2, T0 + 90_000, False, "h9", "late news", False)]
    root = str(tmp_path_factory.mktemp("tail"))
    build_index(spark, spark.createDataFrame(old, SCHEMA), root)
    chats = spark.createDataFrame([(0, 45), (1, 45), (2, 43)], "chat_id long, style int")
    return Engine(spark, IndexStore(spark, root), spark.createDataFrame(old + new, SCHEMA), chats=chats, now=T0 + 100_000)


def texts(engine, **filters):
    return {m.text for r in engine.browse(ParsedQuery("q", **filters)).collect() for m in r.hit_messages}


def test_unindexed_messages_are_shown(engine):
    assert {"news in one", "news in two", "late news"} <= texts(engine)


@pytest.mark.parametrize(
    "filters,shown",
    [
        ({"date_from": T0 + 70_000}, {"late news"}),
        ({"date_to": T0 + 55_000, "date_from": T0 + 40_000}, {"news in one"}),
        ({"is_group": True}, {"news in two", "late news"}),
        ({"is_group": False}, {"news in one"}),
        ({"chat_ids": (1,)}, {"news in one"}),
        ({"chat_ids": ()}, set()),
        ({"participants": ("h9",)}, {"news in two", "late news"}),
        ({"senders": ("h9",), "participants": ("h9",)}, {"late news"}),
    ],
)
def test_filters_hold_for_unindexed_messages(engine, filters, shown):
    assert {t for t in texts(engine, **filters) if "news" in t} == shown
