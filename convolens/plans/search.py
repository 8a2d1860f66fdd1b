"""The engine: building an index, searching, browsing, reading a conversation."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convolens.functions.text import TERM_STOPWORDS
from convolens.operators import batch, filters, hydrate, lexical, ranges, ranking, render, sessionize, vectors
from convolens.plans.parse import ParsedQuery, effective_filters
from convolens.schemas import SCHEMAS
from convolens.sources import places
from convolens.sources.scratch import keep
from convolens.sources.store import IndexStore, Snapshot

CALIBRATION_SAMPLE = 2000
#: Results of an arm: by words or vectors, and by the verbatim phrase.
ARM, PHRASE_ARM = 200, 20
#: For how long the number of messages that the index lacks is taken as known.
FRESH_SECONDS = 30.0


@dataclass
class Models:
    """What stands in for the two models until real ones are given; both are built once in each worker."""

    make_embedder: Callable = vectors.hashing_embedder
    pair_score: Callable[[str, list[str]], list[float]] = ranking.word_overlap


def window_rows(chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """chunk_id, pos, and the columns of the messages in each window."""
    return chunks.select("chunk_id", "chat_id", F.posexplode("msg_ids").alias("pos", "msg_id")).join(messages, ["chat_id", "msg_id"])


def build_index(spark: SparkSession, messages: DataFrame, out: str, models: Models | None = None, files: DataFrame | None = None, prune: bool = True, limit_chunks: int | None = None, source_version: int | None = None, attachments: DataFrame | None = None, gazetteer: DataFrame | None = None, home: str = "~", **cut) -> str:
    """Index ``messages`` at ``out``, or bring the index there up to date, as a new version; returns its name.

    Only chats whose messages (or ``files``: msg_id, files) have changed are cut anew. Windows that are as
    before keep their ids, and nothing of theirs is written; new and changed ones are embedded and
    make one segment, with tombstones of those that they replace and of those that are gone. The
    calibration of the first build stays, so that old and new vectors compare. ``limit_chunks``:
    build only the first so many windows by chat and place, and prune nothing. ``source_version``: which
    version of SourceSnapshots ``messages`` are; it is noted in the index. ``attachments`` (msg_id,
    attachment_id, filename) puts file names into the words in place of ``files``, and with a ``gazetteer`` names of
    places too: files not yet looked at, and those that failed, are opened. ``cut``: parameters of sessionize.chunk_messages. What a later table needs is written and read back.
    """
    models, store = models or Models(), IndexStore(spark, out)
    before, how = store.snapshot(missing_ok=True), json.dumps(sorted(cut.items()))
    w = store.writer(before.segments if before else ())
    some, existing = messages, before.read("chunks") if before else None
    if attachments is not None:
        if gazetteer is not None:
            seen, known = places.update_places(w, before, attachments, gazetteer, home)
        else:
            known = before.read("attachment_place") if before else spark.createDataFrame([], SCHEMAS["attachment_place"])
        files = w.put("words", places.attachment_words(attachments, known))
    state = sessionize.chat_states(messages.join(files, "msg_id", "left") if files is not None else messages)
    state = w.put("chat_state", state if limit_chunks is None else state.limit(0))
    if before and limit_chunks is None and before.meta.get("cut") == how:
        old = before.read("chat_state").select("chat_id", F.col("n").alias("old_n"), F.col("h").alias("old_h"))
        changed = ~(F.col("n").eqNullSafe(F.col("old_n")) & F.col("h").eqNullSafe(F.col("old_h")))
        touched = w.put("touched", state.join(old, "chat_id", "full").filter(changed).select("chat_id"))
        some, existing = (x.join(touched, "chat_id", "left_semi") for x in (some, existing))
    fresh = w.put("fresh", sessionize.with_content_hash(sessionize.chunk_messages(some, **cut), some, files))
    if limit_chunks is not None:
        fresh, prune = fresh.orderBy("chat_id", "position").limit(limit_chunks), False
    if before:
        diff = sessionize.positional_diff(fresh, existing, int(before.meta.get("top_id", 0)))
        diff = diff if prune else diff.withColumn("action", F.when(F.col("action") == "delete", "same").otherwise(F.col("action")))
    else:
        sizes = fresh.groupBy("chat_id").agg(F.count("*").alias("n"))
        starts = ranges.summed_before(sizes, "chat_id", F.col("n"), "start").select("chat_id", "start")
        diff = fresh.join(starts, "chat_id").select("chat_id", "position", F.lit("insert").alias("action"), (F.col("start") + F.col("position") + 1).alias("chunk_id"))
    diff = w.put("diff", diff)
    changed = diff.filter(F.col("action").isin("insert", "rewrite")).select("chat_id", "position", "chunk_id").join(fresh, ["chat_id", "position"])
    rows = window_rows(changed, some)
    rows = rows.join(files, "msg_id", "left") if files is not None else rows
    rows = w.put("rows", rows)
    texts = render.semantic_text(rows, ["chunk_id"]).join(render.lexical_text(rows, ["chunk_id"]), "chunk_id")
    bodies = [F.coalesce(c, F.lit("")).alias(c) for c in ("body_semantic", "body_lexical")]
    new = changed.join(texts, "chunk_id", "left").select("chunk_id", "chat_id", "position", "start_ts", "end_ts", "has_attachment", "msg_ids", "content_hash", *bodies)
    chunks = w.put("chunks", new)
    dead = w.put("tombstones", diff.filter(F.col("action").isin("rewrite", "delete")).select("chunk_id"))
    raw = w.put("raw", vectors.embed(chunks.select("chunk_id", "body_semantic"), "body_semantic", make=models.make_embedder).drop("body_semantic"))
    if before and "int8_absmax" in before.meta:
        most = float(before.meta["int8_absmax"])
    else:
        most = vectors.absmax(raw, "embedding", sample=CALIBRATION_SAMPLE, key="chunk_id").first()["absmax"]
    coded = raw.select("chunk_id", vectors.quantize_int8(F.col("embedding"), F.lit(max(most or 0.0, 1e-12))).alias("embedding"))
    w.put("vectors", coded.select("chunk_id", vectors.norm(F.col("embedding")).alias("norm"), "embedding"))
    members = w.put("chunk_message", sessionize.membership(chunks))
    if attachments is not None and gazetteer is not None:
        places.update_retries(w, before, attachments, seen, members)
    index = w.put("postings", lexical.postings(chunks, "chunk_id", "body_lexical", stem=True))
    terms = index.select("term", F.lit(1).alias("docs"))
    stats = w.put("doc_stats", lexical.doc_stats(chunks, "chunk_id", "body_lexical"))
    total = stats.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
    n, dl, top = total["n"], total["dl"], chunks.agg(F.max("chunk_id")).first()[0] or 0
    if before:
        gone = before.read("chunks").select("chunk_id", "body_lexical").join(dead, "chunk_id", "left_semi")
        terms = terms.unionByName(lexical.postings(gone, "chunk_id", "body_lexical", stem=True).select("term", F.lit(-1).alias("docs")))
        less = before.read("doc_stats").join(dead, "chunk_id", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        n, dl, top = n + int(before.meta["n_docs"]) - less["n"], dl + int(before.meta["sum_dl"]) - less["dl"], max(top, int(before.meta["top_id"]))
    w.put("terms", terms.groupBy("term").agg(F.sum("docs").alias("docs")).filter("docs != 0"))
    last = messages.agg(F.max("msg_id")).first()[0]
    return w.publish({
        "int8_absmax": None if most is None else str(most), "n_docs": str(n), "sum_dl": str(dl), "avgdl": str(dl / n if n else 0.0), "top_id": str(top), "cut": how, "last_msg_id": None if last is None else str(last), "source_version": None if source_version is None else str(source_version),
        "semantic_format_version": "1", "lexical_format_version": "1", "embed_version": "1",
    })


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A bounded list as a table of one partition, on which windows and groups need no shuffle."""
    kind = "array<struct<" + ", ".join(x.replace(" ", ":", 1) for x in schema.split(", ")) + ">>"
    names = [x.split()[0] for x in schema.split(", ")]
    body = json.dumps([dict(zip(names, r, strict=True)) for r in rows], default=str)
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(body), kind)))


SESSION = "chat_id long, day date, score double, latest double, chunk_ids array<long>, place int"


@dataclass
class Engine:
    """Searches an index; ``messages`` is the source as it is now, perhaps newer than the index. ``names``: (handle, display_name).

    Each question reads one snapshot of the index. Lists of results are bounded (hundreds of
    windows, tens of sessions), so between retrieval and the page they are on the driver.
    """

    spark: SparkSession
    index: IndexStore
    messages: DataFrame
    names: DataFrame | None = None
    roster: DataFrame | None = None
    chats: DataFrame | None = None
    models: Models | None = None
    now: float | None = None
    #: Newer messages than ``messages``, where these are the version that the index was built from.
    live: DataFrame | None = None

    @classmethod
    def of_versions(cls, spark: SparkSession, index: IndexStore, held, **more) -> Engine:
        """An engine that reads the messages of its sessions from the version that the index was built from, and what is newer from the newest one. ``held``: SourceSnapshots."""
        number = int(index.snapshot().meta["source_version"])
        return cls(spark, index, held.read(number), live=held.read(), **more)

    def __post_init__(self):
        self.live = self.live if self.live is not None else self.messages
        self.models = self.models or Models()
        self.roster = self.roster if self.roster is not None else self.messages.filter(F.col("handle").isNotNull()).select("chat_id", "handle").distinct()
        self.pages: dict = {}
        self.snapshot: Snapshot | None = None
        self.fresh: tuple | None = None

    def at(self) -> Snapshot:
        """The index as it is now; tables and settings of a version that is known are not looked up again."""
        fresh = self.index.snapshot()
        if self.snapshot is None or fresh.version != self.snapshot.version:
            self.snapshot = fresh
        return self.snapshot

    def freshness(self, at: Snapshot) -> tuple[float | None, int]:
        """The index's last time and how many messages are newer, looked up again after ``FRESH_SECONDS`` or with another version."""
        if self.fresh is None or self.fresh[0] != at.version or time.monotonic() - self.fresh[1] > FRESH_SECONDS:
            row = hydrate.freshness(self.live, at.read("chunks")).first()
            self.fresh = at.version, time.monotonic(), (row["horizon"], row["n_behind"])
        return self.fresh[2]

    def declared(self, nested: DataFrame, q: ParsedQuery, ordering: str, at: Snapshot) -> DataFrame:
        """What an answer says of itself: the filters that were used, its order, and how far the index is behind."""
        behind = self.freshness(at)[1]
        said = {"filters": json.dumps(effective_filters(q)), "ordering": ordering, "n_messages_since_index": behind, "index_stale": behind > 0}
        return nested.withColumns({k: F.lit(v) for k, v in said.items()})

    def chat_set(self, q: ParsedQuery) -> DataFrame | None:
        """Chats that the question's people, kinds and list of chats leave; None if it has none of these."""
        people = filters.participant_chats(self.roster, self.messages, list(q.participants)) if q.participants else None
        kinds = None
        if q.is_group is not None:
            base = self.chats if self.chats is not None else self.messages.select("chat_id").distinct().withColumn("style", F.lit(None).cast("int"))
            kinds = filters.chat_kinds(base, self.roster).filter(F.col("is_group") == q.is_group)
        listed = local(self.spark, [(c,) for c in q.chat_ids], "chat_id long") if q.chat_ids is not None else None
        return filters.chat_filter(people, kinds, listed)

    def candidates(self, q: ParsedQuery, by_sender: bool = True, at: Snapshot | None = None) -> DataFrame | None:
        at = at or self.at()
        out = filters.candidate_chunks(at.read("chunks"), q.date_from, q.date_to, q.has_media, self.chat_set(q))
        if q.senders and by_sender:
            out = filters.narrow_by_sender(out, filters.chunks_by_sender(self.messages, at.read("chunk_message"), list(q.senders), q.has_media))
        return out

    def arms(self, q: ParsedQuery, expansions: tuple[str, ...], at: Snapshot) -> tuple[list[tuple[int, int, int]], set[int]]:
        """(arm, chunk_id, rank) of vectors, words, the verbatim phrase and further phrasings; and the chunks that have the phrase."""
        if "int8_absmax" not in at.meta:
            raise RuntimeError("the index is not calibrated")
        candidates = self.candidates(q, at=at)
        unit = self.models.make_embedder()([vectors.QUERY_PREFIX + q.semantic])[0]
        coded = np.clip(np.rint(unit.astype(np.float64) * 127 / max(float(at.meta["int8_absmax"]), 1e-12)), -127, 127)
        dense = vectors.knn(at.read("vectors"), coded.tolist(), "chunk_id", "embedding", ARM, candidates).collect()
        best = sorted(dense, key=lambda r: (round(r["distance"], 9), r["chunk_id"]))
        out = [(0, r["chunk_id"], i + 1) for i, r in enumerate(best)]

        asked = [lexical.parse_terms(x, stem=True) for x in (q.semantic, *expansions)]
        terms = sorted({t for words in asked for t in words})
        if not terms:
            return out, set()
        docs = {r["term"]: r["docs"] for r in at.read("terms").filter(F.col("term").isin(*terms)).collect()}
        n, avgdl = int(at.meta["n_docs"]), max(float(at.meta["avgdl"]), 1e-9)
        hits = lexical.matched(at.read("postings"), terms, "chunk_id")
        scores: list[tuple[int, int, Column]] = [(i + 1, ARM, lexical.bm25_of(words, docs, n, avgdl)) for i, words in enumerate(asked) if words]
        phrase = asked[0]
        if len(phrase) > 1:  # as one term: all its places are as many as the windows that have it
            hits = hits.withColumn("times", lexical.phrase_count(phrase)).withColumn("with_phrase", F.count("times").over(W.partitionBy(F.col("times").isNotNull())))
            weight = lexical.idf(F.lit(n), F.col("with_phrase"))
            scores.append((len(asked) + 1, PHRASE_ARM, weight * lexical._weight(F.col("times"), F.col("dl"), F.lit(avgdl))))
        else:
            hits = hits.withColumn("times", lexical.phrase_count(phrase) if phrase else F.lit(None).cast("int"))
        if candidates is not None:
            hits = hits.join(candidates.select("chunk_id").distinct(), "chunk_id", "left_semi")
        rows = hits.select("chunk_id", F.col("times").isNotNull().alias("verbatim"), F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(k).alias("k"), s.alias("score")) for a, k, s in scores])).alias("x"))
        order = W.partitionBy("x.arm").orderBy(F.desc(F.round("x.score", 9)), "chunk_id")
        top = rows.filter("x.score is not null").withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= ARM) & (F.col("rank") <= F.col("x.k")))
        got = top.select(F.col("x.arm").alias("arm"), "chunk_id", "rank", "verbatim").collect()
        # arms in the order in which ties of the fusion look at them: words, the phrase, further phrasings
        place = {1: 1, len(asked) + 1: 2, **{i + 1: i + 2 for i in range(1, len(asked))}}
        return out + [(place[r["arm"]], r["chunk_id"], r["rank"]) for r in got], {r["chunk_id"] for r in got if r["verbatim"]}

    def retrieve(self, q: ParsedQuery, expansions: tuple[str, ...] = (), at: Snapshot | None = None) -> DataFrame:
        """(chunk_id, place, lexical): at most 50, from vectors, words, the verbatim phrase and further phrasings."""
        at = at or self.at()
        ranked, verbatim = self.arms(q, expansions, at)
        lists = local(self.spark, ranked, "arm int, chunk_id long, rank int")
        fused = [(r["chunk_id"], i + 1) for i, r in enumerate(ranking.rrf_rows(lists, "chunk_id").collect())]
        fused = local(self.spark, fused, "chunk_id long, rank int")
        found = sorted({c for a, c, _ in ranked if a > 0})
        newest = self.some_chunks(at, found).select("chunk_id", F.col("start_ts").alias("ts")).collect()
        times = local(self.spark, [tuple(r) for r in newest], "chunk_id long, ts double")
        places = ranking.reserve_recent(fused, times, "chunk_id")
        return local(self.spark, [(r["chunk_id"], r["place"], r["chunk_id"] in verbatim) for r in places.collect()], "chunk_id long, place int, lexical boolean")

    def retrieve_many(self, questions: DataFrame, qid: str, text: str, at: Snapshot | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """((qid, chunk_id, place), (qid, chunk_id, rank) of the fused list of 200, and of words alone): for many questions without filters what ``retrieve`` gives for each."""
        at = at or self.at()
        if "int8_absmax" not in at.meta:
            raise RuntimeError("the index is not calibrated")
        asked = keep(batch.asked(questions, qid, text, stem=True), "asked")
        prefixed = questions.filter(F.trim(F.coalesce(text, F.lit(""))) != "").select(F.col(qid).alias("qid"), F.concat(F.lit(vectors.QUERY_PREFIX), text).alias("t"))
        coded = vectors.quantize_int8(F.col("embedding"), F.lit(max(float(at.meta["int8_absmax"]), 1e-12)))
        dense = batch.knn_many(at.read("vectors"), vectors.embed(prefixed, "t", make=self.models.make_embedder).select("qid", coded.cast("array<double>").alias("q")), "chunk_id", "embedding", ARM)
        words = keep(batch.bm25_many(at.read("postings"), at.read("doc_stats"), asked, "chunk_id", ARM), "words")
        phrases = keep(batch.phrase_many(at.read("postings"), at.read("doc_stats"), asked, "chunk_id", PHRASE_ARM), "phrases")
        fused = keep(batch.fuse_many([dense, words, phrases], "chunk_id", most=ARM), "fused")
        matched = words.select("qid", "chunk_id").union(phrases.select("qid", "chunk_id")).distinct().join(at.read("chunks").select("chunk_id", F.col("start_ts").alias("ts")), "chunk_id")
        places = batch.reserve_recent_many(fused.filter(F.col("rank") <= ranking.FUSED), matched, "chunk_id")
        return places, fused.select("qid", "chunk_id", "rank"), words.select("qid", "chunk_id", "rank")

    def some_chunks(self, at: Snapshot, ids: list[int]) -> DataFrame:
        """Rows of a bounded list of windows; the filter on literal ids reaches the file."""
        return at.read("chunks").filter(F.col("chunk_id").isin(*ids)) if ids else at.read("chunks").limit(0)

    def ranked_sessions(self, q: ParsedQuery, expansions: tuple[str, ...] = (), at: Snapshot | None = None) -> DataFrame:
        at = at or self.at()
        key = (q, expansions, at.version)
        if key not in self.pages:
            while len(self.pages) >= 8:
                self.pages.pop(next(iter(self.pages)))
            places = self.retrieve(q, expansions, at)
            ids = [r["chunk_id"] for r in places.collect()]
            top = self.some_chunks(at, ids).select("chunk_id", "chat_id", "start_ts", "body_semantic").join(F.broadcast(places), "chunk_id")
            scored = ranking.rerank(q.semantic, top, "body_semantic", self.models.pair_score).drop("body_semantic").collect()
            marked = local(self.spark, scored, "chunk_id long, chat_id long, start_ts double, place int, lexical boolean, logit double")
            now = self.now or time.time()
            columns = ["chat_id", "day", "score", "latest", "chunk_ids"]
            best = ranking.reserve_sessions(ranking.sessions(ranking.head(marked, "chunk_id"), now)).select(*columns, "place")
            every = ranking.sessions(marked, now).select(*columns)
            first = {(r["chat_id"], r["day"]): r for r in best.collect()}
            rest = sorted((r for r in every.collect() if (r["chat_id"], r["day"]) not in first), key=lambda r: (-r["score"], r["chat_id"], r["day"]))
            ordered = [*sorted(first.values(), key=lambda r: r["place"]), *rest]
            self.pages[key] = [(*(r[c] for c in columns), i + 1) for i, r in enumerate(ordered)]
        return local(self.spark, self.pages[key], SESSION)

    def _rows(self, page: DataFrame, at: Snapshot) -> DataFrame:
        chunks = at.read("chunks")
        hits = page.select("chat_id", "day", F.explode("chunk_ids").alias("chunk_id"))
        # a page has few chats: only their windows can stand beside its hits
        own = chunks.select("chunk_id", "chat_id", "position").join(F.broadcast(page.select("chat_id").distinct()), "chat_id", "left_semi")
        near = ranking.expand(hits, own).select("chat_id", "day", F.explode("context_ids").alias("chunk_id"), F.lit(False).alias("is_hit"))
        wanted = hits.withColumn("is_hit", F.lit(True)).unionByName(near)
        return hydrate.hydrate(wanted, at.read("chunk_message"), self.messages, self.names)

    def _local(self, page: DataFrame) -> DataFrame:
        """A page, a few rows, as a table on the driver: what is read for it needs no earlier step again."""
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in page.schema)
        return local(self.spark, [tuple(r) for r in page.collect()], schema)

    def search(self, q: ParsedQuery, offset: int = 0, max_sessions: int = ranking.SESSIONS, redact: bool = False, expansions: tuple[str, ...] = ()) -> DataFrame:
        """One row a session of the page: chat_id, day, place, score, messages, confidence, payload, what ``declared`` adds, has_more, next_offset. A question without content browses."""
        if not q.semantic:
            return self.browse(q, offset, max_sessions, redact)
        at = self.at()
        page = self._local(ranking.page(self.ranked_sessions(q, expansions, at), offset, max_sessions))
        rows = filters.demote(self._rows(page, at), list(q.senders) or None, q.from_me, q.has_media)
        terms = [w for w in q.semantic.lower().split() if w not in TERM_STOPWORDS and len(w) > 1]
        nested = self.declared(hydrate.payload(hydrate.nest(rows), terms, redact), q, "relevance", at)
        return nested.join(page.select("chat_id", "day", "place", "score", "has_more", "next_offset"), ["chat_id", "day"]).orderBy("place")

    def browse(self, q: ParsedQuery, offset: int = 0, max_sessions: int = ranking.SESSIONS, redact: bool = False) -> DataFrame:
        """The newest sessions that pass the filters, with messages newer than the index that pass them too; no model is asked."""
        at = self.at()
        chunks = at.read("chunks")
        newest = self._local(ranking.browse(chunks, self.candidates(q, at=at)))
        order = W.partitionBy(F.lit(0)).orderBy(F.desc("latest"), "chat_id")
        page = self._local(ranking.page(newest.withColumn("place", F.row_number().over(order)).withColumn("score", F.col("latest")), offset, max_sessions))
        rows = self._rows(page, at)
        if offset == 0:
            horizon, behind = self.freshness(at)
            if behind:
                named = hydrate.with_sender(self.live, self.names)
                tail = hydrate.live_tail(named, horizon, hydrate.tail_limit(behind), q.date_to, self.chat_set(q), q.date_from)
                rows = hydrate.merge_rows(tail, rows)
        rows = ranking.newest_hits(filters.demote(rows, list(q.senders) or None, q.from_me, q.has_media), max_sessions)
        nested = self.declared(hydrate.payload(hydrate.nest(rows), (), redact).filter(F.size("hit_messages") > 0), q, "recent", at)
        return nested.join(page.select("chat_id", "day", "has_more", "next_offset"), ["chat_id", "day"], "left").orderBy(F.desc(F.element_at("hit_messages", -1)["ts"]), "chat_id")

    def conversation(self, chat_id: int, around_ts: float | None = None, limit: int = 50) -> DataFrame:
        return hydrate.conversation(hydrate.with_sender(self.messages, self.names), chat_id, around_ts, limit)

    def preview(self, q: ParsedQuery) -> DataFrame:
        """Bodies of the retrieved windows, without the source."""
        at = self.at()
        return at.read("chunks").select("chunk_id", "chat_id", "start_ts", "body_semantic").join(F.broadcast(self.retrieve(q, at=at)), "chunk_id").orderBy("place")

    def status(self) -> DataFrame:
        at = self.at()
        chunks = at.read("chunks")
        return hydrate.status(chunks, at.read("chunk_message"), self.messages).crossJoin(hydrate.freshness(self.messages, chunks))
