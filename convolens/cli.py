"""Command line: build, search, suggest, conversation, status."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from convolens.operators.hydrate import chat_metadata
from convolens.operators.suggest import NameIndex, chat_names, suggest_chats, write_names
from convolens.plans.parse import Contacts, parse_query, with_filters
from convolens.plans.search import Engine, build_index
from convolens.sources.contacts import handle_names
from convolens.sources.messages import chat_roster, chat_table, clean_messages, read_source
from convolens.sources.places import attachment_rows
from convolens.sources.store import IndexStore


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="convolens")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "search", "suggest", "conversation", "status"):
        s = sub.add_parser(name)
        s.add_argument("source", help="folder of the source relations")
        s.add_argument("index", help="folder of the index")
        s.add_argument("--contacts", help="table of contacts: identifier, display_name, handles")
        if name == "build":
            s.add_argument("--places", help="table of places: lat, lon, city, admin, country_code; images are looked at")
            s.add_argument("--home", default="~", help="what ~ stands for in names of attachments")
        if name == "suggest":
            s.add_argument("part", help="part of a chat's title or of a participant's name")
            s.add_argument("--limit", type=int, default=20)
        if name == "search":
            day = lambda d: datetime.fromisoformat(d).replace(tzinfo=UTC).timestamp()
            s.add_argument("--sender", action="append", dest="senders", help="name or handle, perhaps several times")
            s.add_argument("--participant", action="append", dest="participants")
            s.add_argument("--chat", action="append", type=int, dest="chat_ids")
            s.add_argument("--after", type=day, dest="date_from", help="a date; filters that are given go before those in the question")
            s.add_argument("--before", type=day, dest="date_to")
            s.add_argument("--media", action="store_true", default=None, dest="has_media")
            s.add_argument("--from-me", action="store_true", default=None, dest="from_me")
            s.add_argument("query")
            s.add_argument("--show", type=int, default=8)
            s.add_argument("--offset", type=int, default=0)
            s.add_argument("--redact", action="store_true")
        if name == "conversation":
            s.add_argument("chat_id", type=int)
            s.add_argument("--around", type=float)
            s.add_argument("--limit", type=int, default=50)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("convolens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tables = read_source(spark, a.source)
    messages = clean_messages(tables)
    if a.command == "build":
        gazetteer = spark.read.parquet(a.places) if a.places else None
        version = build_index(spark, messages, a.index, attachments=attachment_rows(tables), gazetteer=gazetteer, home=a.home)
        print(version)
    contacts = spark.read.parquet(a.contacts) if a.contacts else None
    names, store = handle_names(contacts) if contacts is not None else None, IndexStore(spark, a.index)
    if a.command in ("build", "suggest"):
        known = names if names is not None else spark.createDataFrame([], "handle string, display_name string")
        chats, held = chat_metadata(chat_table(tables), chat_roster(tables), known), f"{store.root}/{store.snapshot().version}/names"
        if a.command == "build":  # names lie in the folder of their version, and go with it
            write_names(chat_names(chats), held)
        else:
            suggest_chats(NameIndex(spark, held), chats, store.read("chunks"), a.part, a.limit).show(a.limit, False)
        return 0
    engine = Engine(spark, store, messages, names, chat_roster(tables), chat_table(tables))
    if a.command == "status":
        engine.status().show(truncate=False, vertical=True)
    elif a.command == "conversation":
        engine.conversation(a.chat_id, a.around, a.limit).show(a.limit, False)
    else:
        people = Contacts.collect(contacts, messages) if contacts is not None else None
        given = {k: getattr(a, k) for k in ("senders", "participants", "chat_ids", "date_from", "date_to", "has_media", "from_me")}
        q = with_filters(parse_query(a.query, datetime.now(UTC), people), people, **given)
        for row in engine.search(q, a.offset, a.show, a.redact).select("payload").collect():
            print(row["payload"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
