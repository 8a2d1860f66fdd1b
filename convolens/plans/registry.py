"""Queries over the driver's tables, one for each operator, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convolens.functions import names as N
from convolens.functions import text as T
from convolens.operators import arms, batch, evalkit, filters, harvest, hydrate, lexical, pivots, ranking, render, sessionize, suggest, suites, vectors
from convolens.plans.parse import Contacts, parse_table
from convolens.plans.search import Engine, build_index
from convolens.sources import contacts as C
from convolens.sources import phones, places
from convolens.sources.messages import attachments_by_message, clean_messages, conversation_messages, event_messages
from convolens.sources.scratch import keep, shared_base
from convolens.sources.snapshots import changes, replayed
from convolens.sources.store import IndexStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: A fixed present for queries that need one.
NOW = 1_760_000_000.0

MSGS = """msgs as (select conv_id*1000+turn as msg_id, conv_id as chat_id,
  (1700000000 + conv_id*86400 + turn*600 + case when turn >= 4 then 3600 else 0 end)::double as ts, role = 'user' as is_from_me,
  case when role <> 'user' then role end as handle, text, turn % 5 = 0 as has_attachment from conversations)"""
EV = """ev as (select event_id as msg_id, user_id as chat_id, epoch(ts)::double as ts, event_type = 'view' as is_from_me,
  case when event_type <> 'view' then event_type end as handle, event_type as text, event_type = 'purchase' as has_attachment from events)"""
SESSIONS = EV + """, gaps as (select *, case when ts - lag(ts) over (partition by chat_id order by ts, msg_id) > 2700 then 1 else 0 end as g from ev),
  sess as (select *, sum(g) over (partition by chat_id order by ts, msg_id rows unbounded preceding)::bigint as session from gaps),
  chunks0 as (select chat_id, session, min(msg_id) as chunk_id, min(ts) as start_ts, max(ts) as end_ts, bool_or(has_attachment) as has_attachment, list(msg_id) as msg_ids, count(*) as n from sess group by chat_id, session),
  chunks as (select *, (row_number() over (partition by chat_id order by session) - 1)::int as position from chunks0)"""
ACCENTS, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
TERMS = f"list_filter(string_split_regex(translate(regexp_replace(lower(coalesce(text, '')), '\\p{{M}}+', '', 'g'), '{ACCENTS}', '{PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
POSTINGS = f"""places as (select doc_id, unnest({TERMS}) as term from documents),
  post as (select term, doc_id, count(*) as tf from places group by all), stats as (select doc_id, len({TERMS}) as dl from documents),
  corpus as (select count(*) as n, avg(dl) as avgdl from stats)"""
QUERY_WORDS = ["the", "of", "and"]


def bm25_sql(words: list[str], extra: str = "") -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""hit as (select * from post where term in ({listed})), df as (select term, count(*) as df from hit group by term),
  scored as (select hit.doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score, count(*) as found
    from hit join df using (term) join stats using (doc_id) cross join corpus {extra} group by hit.doc_id),
  bm as (select doc_id, score from scored where found = {len(words)})"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of events as windows; the least message id is a window's id."""
    m = sessionize.gap_sessions(event_messages(spark, sf))
    g = m.groupBy("chat_id", "session").agg(F.min("msg_id").alias("chunk_id"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.max("has_attachment").alias("has_attachment"), F.collect_list("msg_id").alias("msg_ids"), F.count("*").alias("n"))
    return g.withColumn("position", F.row_number().over(W.partitionBy("chat_id").orderBy("session")) - 1)


def doc_index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    return lexical.postings(docs, "doc_id", "text"), lexical.doc_stats(docs, "doc_id", "text")


def r6(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name or c)


# sources


@query("epoch_normalize", "select event_id, round(epoch(ts), 3) as unix_ts from events")
def epoch_normalize(spark, sf):
    m = event_messages(spark, sf)
    raw = F.col("ts") - T.EPOCH_2001
    source = F.when(F.col("msg_id") % 2 == 0, raw * 1e9).otherwise(raw)
    return m.select(F.col("msg_id").alias("event_id"), F.round(T.unix_seconds(source), 3).alias("unix_ts"))


def source_tables(spark, sf):
    """The conversations spread over the seven source relations, every seventh turn as a reaction."""
    m = conversation_messages(spark, sf)
    people = spark.createDataFrame([(1, "assistant"), (2, "system")], "rowid long, id string")
    hid = F.when(F.col("handle") == "assistant", 1).when(F.col("handle") == "system", 2).cast("long")
    return {
        "message": m.select(F.col("msg_id").alias("rowid"), "text", F.lit(None).cast("binary").alias("attributed_body"), (F.col("ts") - T.EPOCH_2001).cast("long").alias("date"), F.lit(0).cast("long").alias("date_edited"), F.lit(0).cast("long").alias("date_retracted"), F.col("is_from_me").cast("int").alias("is_from_me"), hid.alias("handle_id"), (F.col("msg_id") % 7 == 6).cast("int").alias("associated_message_type")),
        "handle": people,
        "chat": m.select(F.col("chat_id").alias("rowid")).distinct().withColumn("style", F.lit(45)),
        "chat_message_join": m.select("chat_id", F.col("msg_id").alias("message_id")),
        "chat_handle_join": m.filter(hid.isNotNull()).select("chat_id", hid.alias("handle_id")).distinct(),
        "attachment": m.filter("has_attachment").select(F.col("msg_id").alias("rowid"), F.concat(F.lit("file"), "msg_id").alias("filename")),
        "message_attachment_join": m.filter("has_attachment").select(F.col("msg_id").alias("message_id"), F.col("msg_id").alias("attachment_id")),
    }


@query("messages_clean", f"with {MSGS} select msg_id, chat_id, ts, is_from_me, handle, nullif(text, '') as text, has_attachment from msgs where msg_id % 7 <> 6")
def messages_clean(spark, sf):
    return clean_messages(source_tables(spark, sf)).select("msg_id", "chat_id", "ts", "is_from_me", "handle", "text", "has_attachment")


@query("attachments_by_message", f"with {MSGS} select msg_id, 'file' || msg_id as filenames from msgs where has_attachment")
def attachments(spark, sf):
    return attachments_by_message(source_tables(spark, sf)).select("msg_id", F.array_join(F.transform("attachments", lambda a: a["filename"]), ",").alias("filenames"))


@query("attachments_collect", """with a as (select user_id, event_type, case event_type when 'purchase' then 'Photo' when 'click' then 'Video' when 'view' then 'PDF' else 'Attachment' end as label from events)
  select user_id, case when count(*) = 1 then min(label) when count(distinct label) = 1 then count(*) || ' ' || lower(min(label)) || 's' else count(*) || ' attachments' end as kind from a group by user_id""")
def attachments_collect(spark, sf):
    return collected(table(spark, sf, "events"))


def collected(e):
    mime = F.when(F.col("event_type") == "purchase", "image/png").when(F.col("event_type") == "click", "video/mp4").when(F.col("event_type") == "view", "application/pdf")
    labelled = e.withColumn("label", T.attachment_label(mime, F.lit(None).cast("string"), F.lit(0)))
    g = labelled.groupBy("user_id").agg(F.count("*").alias("c"), F.count_distinct("label").alias("k"), F.min("label").alias("one"))
    return g.select("user_id", T.joined_label(F.col("c"), F.col("k"), F.col("one")).alias("kind"))


# text


@query("token_count", r"select doc_id, len(regexp_extract_all(text, '\S+')) as n_tokens from documents")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query("redact_text", r"""select doc_id, md5(regexp_replace(regexp_replace(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '[email]', 'g'), '\+?[0-9][0-9\-\s().]{7,}[0-9]', '[phone]', 'g')) as redacted from documents""")
def redact_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted"))


@query("regex_signals", r"""select doc_id, 0 as has_url, regexp_matches(text, '\p{Nd}')::int as has_number, regexp_matches(text, '[\p{L}\p{N}_]{15,}')::int as has_long_token, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) as token_count from documents""")
def regex_signals(spark, sf):
    s = T.regex_signals(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *[s[k].alias(k) for k in ("has_url", "has_number", "has_long_token", "token_count")])


@query("strip_and_collapse_urls", r"""select page_id, regexp_replace(trim('see ' || url || ' now HTTPS:// end'), '(?i)https?://(?:www\.)?([^/\s]+)\S*', '[link:\1]', 'g').regexp_replace('(?i)https?://\S+', '[link:link]', 'g') as body from pages""")
def strip_and_collapse_urls(spark, sf):
    t = F.concat(F.lit(" see ￼ "), "url", F.lit(" now HTTPS:// end "))
    return table(spark, sf, "pages").select("page_id", T.collapse_urls(T.strip_placeholder(t)).alias("body"))


@query("middle_drop", r"""with t as (select doc_id, regexp_extract_all(text, '\S+') as w from documents)
  select doc_id, array_to_string(case when len(w) <= 21 then w else w[1:10] || w[len(w)-10:] end, ' ') as body from t""")
def middle_drop(spark, sf):
    w = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.middle_drop(w, 21), " ").alias("body"))


@query("query_term_match_score", r"""select doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')), ['thing', 'ing', 'der', 'hand'])) as score from documents""")
def query_term_match_score(spark, sf):
    terms = T.query_terms(F.lit("What is the thing? Ing, der hand"))
    return table(spark, sf, "documents").select("doc_id", T.match_score(F.col("text"), terms).alias("score"))


@query("vocab_overlap", r"""with b as (select item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: len(w) > 2 and not list_contains(['the','a','an','and','or','but','is','are','was','were','be','been','to','of','in','on','at','for','with','about','we','us','i','you','did','do','does','what','where','when','who','how','that','this','it','our','their','them','he','she','his','her','me'], w))) as w from benchmark),
  p as (select a.item_id, b.item_id as other, a.w as q, b.w as s from b a join b on b.item_id = a.item_id + 1)
  select item_id, other, round(case when len(q) = 0 then 0 else len(list_intersect(q, s)) / len(q) end, 6) as overlap from p""")
def vocab_overlap(spark, sf):
    b = table(spark, sf, "benchmark")
    o = b.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("text").alias("o_text"))
    return b.join(o, "item_id").select("item_id", "other", r6(T.vocabulary_overlap(F.col("text"), F.col("o_text")), "overlap"))


@query("surface_forms", """select c_custkey, f.form as form, f.text as text from customer, unnest([
  {'form': 'plain', 'text': c_name}, {'form': 'lower', 'text': lower(c_name)}, {'form': 'upper', 'text': upper(c_name)}, {'form': 'possessive', 'text': c_name || '''s'}, {'form': 'punctuated', 'text': c_name || '?'}, {'form': 'quoted', 'text': '"' || c_name || '"'},
  {'form': 'typo', 'text': c_name[1:len(c_name)//2-1] || c_name[len(c_name)//2+1] || c_name[len(c_name)//2] || c_name[len(c_name)//2+2:]}]) as t(f)""")
def surface_forms(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.explode(T.surface_forms(F.col("c_name"))).alias("f")).select("c_custkey", "f.form", "f.text")


@query("highlight", "select item_id, regexp_replace(text, '(?i)(the|ing)', '<mark>\\1</mark>', 'g') as marked from benchmark")
def highlight(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.highlight(F.col("text"), ["the", "ing", "a"]).alias("marked"))


@query("porter_terms")
def porter_terms(spark, sf):
    terms = lexical.postings(table(spark, sf, "documents"), "doc_id", "text").select("term").distinct()
    return terms.select("term", N.stem_udf("term").alias("stem"))


# windows


@query("gap_sessions", f"with {SESSIONS} select chat_id, session, count(*) as n, min(ts) as start_ts, max(ts) as end_ts from sess group by chat_id, session")
def gap_sessions(spark, sf):
    return sessionize.gap_sessions(event_messages(spark, sf)).groupBy("chat_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


@query("chunk_fold", rf"""with recursive {MSGS}, toks as (select *, len(regexp_extract_all(text, '\S+')) as n from msgs),
  gaps as (select *, case when ts - lag(ts) over (partition by chat_id order by ts, msg_id) > 2700 then 1 else 0 end as g from toks),
  sess as (select *, sum(g) over (partition by chat_id order by ts, msg_id rows unbounded preceding) as session from gaps),
  o as (select *, row_number() over (partition by chat_id, session order by ts, msg_id) - 1 as i, sum(n) over (partition by chat_id, session order by ts, msg_id rows unbounded preceding) as upto, count(*) over (partition by chat_id, session) as k from sess),
  r as (select chat_id, session, i, 0::bigint as s, null::bigint as closed from o where i = 0
    union all select o.chat_id, o.session, o.i, case when x.shut then greatest(r.s, o.i - 2) else r.s end, case when x.shut then r.s end from r join o on o.chat_id = r.chat_id and o.session = r.session and o.i = r.i + 1
      join o p on p.chat_id = r.chat_id and p.session = r.session and p.i = r.s, lateral (select (o.upto - p.upto + p.n > 40 or o.i - r.s >= 3) as shut) x),
  c as (select chat_id, session, closed as s, i as e from r where closed is not null union all select r.chat_id, r.session, s, k from r join o using (chat_id, session, i) where r.i = k - 1),
  w as (select c.chat_id, c.session, c.s, c.e, min(ts) as start_ts, max(ts) as end_ts, string_agg(msg_id::varchar, ',' order by ts, msg_id) as msg_ids, bool_or(has_attachment) as has_attachment from c join o on o.chat_id = c.chat_id and o.session = c.session and o.i >= c.s and o.i < c.e group by all)
  select chat_id, (row_number() over (partition by chat_id order by session, e) - 1)::int as position, start_ts, end_ts, msg_ids, has_attachment from w""")
def chunk_fold(spark, sf):
    c = sessionize.chunk_messages(conversation_messages(spark, sf), token_target=40, max_messages=3)
    return c.withColumn("msg_ids", F.array_join(F.col("msg_ids").cast("array<string>"), ","))


LABELS = f"""{MSGS}, p as (select *, row_number() over (partition by chat_id order by ts) - 1 as pos, case when not is_from_me then coalesce(handle, '?') end as other from msgs),
  f as (select chat_id, other, min(pos) as first from p where other is not null group by all), k as (select *, dense_rank() over (partition by chat_id order by first) as rank, count(*) over (partition by chat_id) as others from f),
  l as (select p.*, case when is_from_me then 'Me' when others <= 1 then 'Them' else chr((64 + rank)::int) end as label from p left join k on k.chat_id = p.chat_id and k.other = p.other)"""


def chat_rows(spark, sf):
    m = conversation_messages(spark, sf)
    return m.withColumn("pos", F.row_number().over(W.partitionBy("chat_id").orderBy("ts")) - 1)


@query("speaker_labels", f"with {LABELS} select chat_id, msg_id, label from l")
def speaker_labels(spark, sf):
    return render.speaker_labels(chat_rows(spark, sf), ["chat_id"]).select("chat_id", "msg_id", "label")


@query("format_semantic", rf"""with {LABELS}, s as (select *, trim(concat_ws(' ', nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), ''), case when has_attachment then '[attachment]' end)) as said from l),
  b as (select chat_id, string_agg(label || ': ' || said, chr(10) order by pos) as body from s where said <> '' group by chat_id), t as (select *, regexp_extract_all(body, '\S+') as w from b)
  select chat_id, case when len(w) <= 60 then body else array_to_string(w[1:30] || w[len(w)-29:], ' ') end as body_semantic from t""")
def format_semantic(spark, sf):
    return render.semantic_text(chat_rows(spark, sf), ["chat_id"], cap=60)


@query("format_lexical", rf"""with {MSGS}, s as (select *, trim(concat_ws(' ', nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), ''), case when has_attachment then '[attachment]' end)) as said from msgs)
  select chat_id, string_agg(said, chr(10) order by ts) as body_lexical from s where said <> '' group by chat_id""")
def format_lexical(spark, sf):
    return render.lexical_text(chat_rows(spark, sf), ["chat_id"])


DIFF = f"""{MSGS}, t as (select *, msg_id % 1000 as turn from msgs), old0 as (select chat_id, turn // 3 as k, list(msg_id order by msg_id) as ids from t where turn < 5 or chat_id % 4 = 0 group by all having chat_id % 5 > 0),
  old as (select chat_id, row_number() over (partition by chat_id order by k) as k, row_number() over (order by chat_id, k) as chunk_id, ids from old0),
  new0 as (select chat_id, turn // 3 as k, list(msg_id order by msg_id) as ids from t where chat_id % 4 > 0 or turn < 3 group by all), new as (select chat_id, row_number() over (partition by chat_id order by k) as k, ids from new0),
  d as (select coalesce(n.chat_id, o.chat_id) as chat_id, coalesce(n.k, o.k) as k, o.chunk_id as old_id, n.ids, case when n.ids is null then 'delete' when o.ids is null then 'insert' when n.ids = o.ids then 'same' else 'rewrite' end as action from new n full join old o on o.chat_id = n.chat_id and o.k = n.k),
  i as (select *, case when old_id is null then (select max(chunk_id) from old) + sum((old_id is null)::int) over (order by chat_id, k rows unbounded preceding) else old_id end as chunk_id from d)"""


def diff_frame(spark, sf):
    m = conversation_messages(spark, sf).withColumn("turn", F.col("msg_id") % 1000)
    cut = lambda df: df.groupBy("chat_id", F.floor(F.col("turn") / 3).alias("k")).agg(F.sort_array(F.collect_list("msg_id")).alias("msg_ids"))
    old = cut(m.filter("(turn < 5 or chat_id % 4 = 0) and chat_id % 5 > 0")).withColumn("chunk_id", F.row_number().over(W.orderBy("chat_id", "k")).cast("long"))
    new = cut(m.filter("chat_id % 4 > 0 or turn < 3")).withColumn("position", F.row_number().over(W.partitionBy("chat_id").orderBy("k")) - 1)
    return sessionize.positional_diff(new, old)


@query("positional_diff", f"with {DIFF} select chat_id, (k - 1)::int as position, action, chunk_id::bigint as chunk_id, coalesce(len(ids), 0) as n from i")
def positional_diff(spark, sf):
    return diff_frame(spark, sf).select("chat_id", "position", "action", "chunk_id", F.coalesce(F.size("msg_ids"), F.lit(0)).alias("n"))


@query("stale_chunks", f"with {DIFF} select chunk_id::bigint as chunk_id from i where action = 'delete'")
def stale_chunks(spark, sf):
    return diff_frame(spark, sf).filter("action = 'delete'").select("chunk_id")


# words


@query("postings_build", f"with {POSTINGS} select doc_id, count(*) as n_terms, sum(tf)::bigint as n_places, max(tf) as most from post group by doc_id")
def postings_build(spark, sf):
    return doc_index(spark, sf)[0].groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_places"), F.max("tf").alias("most"))


@query("term_stats", f"with {POSTINGS} select term, count(*) as docs, sum(tf)::bigint as places from post group by term")
def term_stats(spark, sf):
    return lexical.term_stats(doc_index(spark, sf)[0], "doc_id")


@query("idf_top5", f"""with {POSTINGS}, d as (select term, count(*) as df from post group by term), v as (select doc_id, list_sort(list(ln(n / df)), 'DESC') as v from post join d using (term) cross join corpus group by doc_id)
  select documents.doc_id, round(coalesce(list_avg(v[1:5]), 0), 6) as idf_mean from documents left join v using (doc_id)""")
def idf_top5(spark, sf):
    docs = table(spark, sf, "documents")
    return lexical.mean_top_idf(docs, doc_index(spark, sf)[0], "doc_id", "text").select("doc_id", r6("idf_mean"))


@query("bm25_topk", f"with {POSTINGS}, {bm25_sql(['thing', 'hand'])} select doc_id, round(score, 6) as score from bm order by round(score, 9) desc, doc_id limit 50")
def bm25_topk(spark, sf):
    index, stats = doc_index(spark, sf)
    return lexical.bm25(index, stats, lexical.parse_terms("Thing hand"), "doc_id", 50).select("doc_id", r6("score"))


@query("bm25_candidates", f"with {POSTINGS}, {bm25_sql(QUERY_WORDS, "join documents d on d.doc_id = hit.doc_id and d.source = 'src3'")} select doc_id, round(score, 8) as score from bm order by round(score, 9) desc, doc_id limit 50")
def bm25_candidates(spark, sf):
    index, stats = doc_index(spark, sf)
    some = table(spark, sf, "documents").filter("source = 'src3'").select("doc_id")
    return lexical.bm25(index, stats, QUERY_WORDS, "doc_id", 50, some).select("doc_id", r6("score", digits=8))


@query("phrase_search", f"""with {POSTINGS}, t as (select doc_id, ' ' || replace(array_to_string({TERMS}, ' '), ' ', '  ') || ' ' as x from documents),
  h as (select doc_id, (len(x) - len(replace(x, ' of  the ', ''))) // 9 as tf from t where contains(x, ' of  the ')), d as (select count(*) as df from h)
  select doc_id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) as score from h join stats using (doc_id) cross join corpus cross join d
  order by round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9) desc, doc_id limit 20""")
def phrase_search(spark, sf):
    index, stats = doc_index(spark, sf)
    return lexical.phrase_search(index, stats, ["of", "the"], "doc_id").select("doc_id", r6("score"))


# vectors

QVEC = "q as (select embedding as q from embeddings where vec_id = 0)"


def first_vector(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding")


@query("l2_normalize", "select vec_id, round(list_aggregate(list_transform(embedding, lambda x: x::double * x), 'sum'), 5) as size, round(embedding[1]::double, 5) as first from embeddings")
def l2_normalize(spark, sf):
    v = vectors.l2_normalize(F.transform("embedding", lambda x: x * 3))
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.dot(v, v), 5).alias("size"), F.round(v[0], 5).alias("first"))


@query("absmax_p999", "with x as (select abs(unnest(embedding))::double as x from embeddings) select round(quantile_cont(x, 0.999), 6) as absmax from x")
def absmax_p999(spark, sf):
    return vectors.absmax(table(spark, sf, "embeddings"), "embedding").select(r6("absmax"))


@query("quantize_int8", "with x as (select quantile_cont(abs(x), 0.999) as m from (select unnest(embedding)::double as x from embeddings)) select vec_id, array_to_string(list_transform(embedding, lambda x: round_even(greatest(-127, least(127, x::double * 127 / m)), 0)::int), ',') as coded from embeddings cross join x")
def quantize_int8(spark, sf):
    e = table(spark, sf, "embeddings")
    coded = e.crossJoin(F.broadcast(vectors.absmax(e, "embedding")))
    return coded.select("vec_id", F.array_join(vectors.quantize_int8(F.col("embedding"), F.col("absmax")).cast("array<string>"), ",").alias("coded"))


@query("knn_topk", f"with {QVEC} select vec_id, round(1 - list_cosine_similarity(embedding::double[], q::double[]), 6) as distance from embeddings cross join q order by round(1 - list_cosine_similarity(embedding::double[], q::double[]), 9), vec_id limit 20")
def knn_topk(spark, sf):
    return vectors.knn(table(spark, sf, "embeddings"), first_vector(spark, sf), "vec_id", "embedding", 20).select("vec_id", r6("distance"))


@query("knn_filtered", f"with {QVEC} select vec_id, round(1 - list_cosine_similarity(embedding::double[], q::double[]), 6) as distance from embeddings cross join q where label = 3 order by round(1 - list_cosine_similarity(embedding::double[], q::double[]), 9), vec_id limit 20")
def knn_filtered(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.knn(e, first_vector(spark, sf), "vec_id", "embedding", 20, e.filter("label = 3").select("vec_id")).select("vec_id", r6("distance"))


@query("nn_distance", """with p as (select a.vec_id, b.vec_id as other, round(1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as d from embeddings a join embeddings b on a.vec_id <> b.vec_id and a.vec_id // 2 <> b.vec_id // 2)
  select vec_id, arg_min(other, (d, other)) as nn_key, round(min(d), 6) as nn_distance from p group by vec_id""")
def nn_distance(spark, sf):
    e = table(spark, sf, "embeddings")
    pairs = e.select("vec_id", (F.col("vec_id") + F.when(F.col("vec_id") % 2 == 0, 1).otherwise(-1)).alias("other"))
    return pivots.nearest_other(e, "vec_id", "embedding", pairs, 128).select("vec_id", "nn_key", r6("nn_distance"))


# fusion and ranking

ARMS = f"""{POSTINGS}, {bm25_sql(['the', 'of'])}, {QVEC},
  a as (select doc_id, row_number() over (order by round(score, 9) desc, doc_id) as rank from bm qualify rank <= 200),
  b as (select vec_id as doc_id, row_number() over (order by round(1 - list_cosine_similarity(embedding::double[], q::double[]), 9), vec_id) as rank from embeddings cross join q qualify rank <= 200)"""


def two_arms(spark, sf):
    index, stats = doc_index(spark, sf)
    words = ranking.arm(lexical.bm25(index, stats, ["the", "of"], "doc_id"), "doc_id", F.desc(F.round("score", 9)), F.col("doc_id"))
    near = vectors.knn(table(spark, sf, "embeddings"), first_vector(spark, sf), "vec_id", "embedding").withColumnRenamed("vec_id", "doc_id")
    return [words, ranking.arm(near, "doc_id", F.round("distance", 9), F.col("doc_id"))]


def rrf_sql(wa: float, wb: float, top: int) -> str:
    return f"""with {ARMS}, u as (select doc_id, 0 as arm, rank, {wa} / (60 + rank) as s from a union all select doc_id, 1, rank, {wb} / (60 + rank) from b),
  f as (select doc_id, sum(s) as score, min(arm * 1000 + rank) as seen from u group by doc_id) select doc_id, round(score, 9) as score from f order by round(score, 12) desc, seen, doc_id limit {top}"""


@query("rrf_fuse", rrf_sql(1.0, 1.0, 50))
def rrf_fuse(spark, sf):
    return ranking.rrf(two_arms(spark, sf), "doc_id").select("doc_id", r6("score", digits=9))


@query("rrf_weighted", rrf_sql(0.7, 1.3, 50))
def rrf_weighted(spark, sf):
    return ranking.rrf(two_arms(spark, sf), "doc_id", weights=[0.7, 1.3]).select("doc_id", r6("score", digits=9))


@query("hybrid_search", rrf_sql(1.0, 1.0, 10))
def hybrid_search(spark, sf):
    return ranking.rrf(two_arms(spark, sf), "doc_id", top=10).select("doc_id", r6("score", digits=9))


@query("recency_slots", f"""with {EV}, fused as (select msg_id, row_number() over (order by msg_id * 7919 % 10007, msg_id) as rank from ev qualify rank <= 60),
  matched as (select msg_id, ts from ev), best as (select msg_id, 0 as part, rank::double as o from fused where rank <= 40),
  fresh as (select msg_id, 1 as part, -ts as o from matched where msg_id not in (select msg_id from best) order by ts desc, msg_id limit 10), rest as (select msg_id, 2 as part, rank::double as o from fused where rank > 40),
  one as (select msg_id, min((part, o)) as x from (select * from best union all select * from fresh union all select * from rest) group by msg_id)
  select msg_id, row_number() over (order by x, msg_id)::int as place from one qualify place <= 50""")
def recency_slots(spark, sf):
    m = event_messages(spark, sf)
    order = (F.col("msg_id") * 7919 % 10007, "msg_id")
    first = m.orderBy(*order).limit(60)  # a list of results, as an arm gives it
    fused = first.select("msg_id", F.row_number().over(W.orderBy(*order)).alias("rank"))
    return ranking.reserve_recent(fused, m.select("msg_id", "ts"), "msg_id")


@query("recency_order", f"with {SESSIONS} select chunk_id, start_ts from chunks order by start_ts desc, chunk_id limit 30")
def recency_order(spark, sf):
    return ranking.newest_first(event_chunks(spark, sf), "chunk_id").limit(30).select("chunk_id", "start_ts")


LOGIT = "(chunk_id * 37 % 101 - 80) / 10.0"
SCORED = f"{SESSIONS}, sc as (select *, {LOGIT} as logit, chunk_id % 5 = 0 as lexical from chunks)"


def scored_chunks(spark, sf):
    return event_chunks(spark, sf).withColumn("logit", (F.col("chunk_id") * 37 % 101 - 80) / 10.0).withColumn("lexical", F.col("chunk_id") % 5 == 0)


@query("rerank_head", f"""with {SCORED}, r as (select *, row_number() over (order by logit desc, chunk_id) as a from sc), t as (select *, row_number() over (partition by a > 9 order by start_ts desc, chunk_id) as b from r)
  select chunk_id, round(logit, 6) as logit from t where a <= 9 or b <= 3""")
def rerank_head(spark, sf):
    return ranking.head(scored_chunks(spark, sf), "chunk_id").select("chunk_id", r6("logit"))


SESS = f"""{SCORED}, g as (select chat_id, cast(to_timestamp(start_ts) at time zone 'UTC' as date) as day, sum(1 / (1 + exp(-logit))) as base, max(start_ts) as latest, max(case when lexical then start_ts end) as word_ts, list_sort(list(chunk_id)) as ids from sc group by all),
  ss as (select *, (base + case when word_ts is not null then 1.2 * pow(0.5, greatest(({NOW} - word_ts) / 86400, 0) / 30) else 0 end) * (1 + 0.6 * pow(0.5, greatest(({NOW} - latest) / 86400, 0) / 365)) as score from g)"""


@query("session_scores", f"with {SESS} select chat_id, day::varchar as day, round(score, 6) as score, latest, word_ts is not null as is_lexical, array_to_string(ids, ',') as chunk_ids from ss")
def session_scores(spark, sf):
    s = ranking.sessions(scored_chunks(spark, sf), NOW)
    return s.select("chat_id", F.col("day").cast("string").alias("day"), r6("score"), "latest", "is_lexical", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunk_ids"))


RESERVED = f"""{SESS}, r as (select *, row_number() over (order by score desc, chat_id, day) as r from ss), f as (select *, row_number() over (partition by r > 6 order by (word_ts is not null) desc, latest desc, chat_id, day) as fresh from r),
  pl as (select *, row_number() over (order by case when r <= 6 or fresh <= 2 then 0 else 1 end, score desc, chat_id, day)::int as place from f)"""


@query("session_reserve", f"with {RESERVED} select chat_id, day::varchar as day, place from pl")
def session_reserve(spark, sf):
    return ranking.reserve_sessions(ranking.sessions(scored_chunks(spark, sf), NOW)).select("chat_id", F.col("day").cast("string").alias("day"), "place")


@query("paginate", f"with {RESERVED} select chat_id, day::varchar as day, place, (select max(place) from pl) > 16 as has_more, case when (select max(place) from pl) > 16 then 16 end as next_offset from pl where place between 9 and 16")
def paginate(spark, sf):
    placed = ranking.reserve_sessions(ranking.sessions(scored_chunks(spark, sf), NOW))
    return ranking.page(placed, 8, 8).select("chat_id", F.col("day").cast("string").alias("day"), "place", "has_more", "next_offset")


@query("session_expand", f"""with {SCORED}, h as (select chat_id, cast(to_timestamp(start_ts) at time zone 'UTC' as date) as day, chunk_id, position from sc)
  select h.chat_id, h.day::varchar as day, array_to_string(list_sort(list(distinct c.chunk_id)), ',') as context_ids from h join chunks c on c.chat_id = h.chat_id and abs(c.position - h.position) <= 2
  where not exists (select 1 from h x where x.chat_id = h.chat_id and x.day = h.day and x.chunk_id = c.chunk_id) group by all""")
def session_expand(spark, sf):
    hits = scored_chunks(spark, sf).select("chat_id", ranking.day_of(F.col("start_ts")).alias("day"), "chunk_id")
    out = ranking.expand(hits, event_chunks(spark, sf))
    return out.select("chat_id", F.col("day").cast("string").alias("day"), F.array_join(F.col("context_ids").cast("array<string>"), ",").alias("context_ids"))


@query("browse_recent", f"""with {SESSIONS}, t as (select * from chunks order by start_ts desc, chunk_id desc limit 50)
  select chat_id, cast(to_timestamp(start_ts) at time zone 'UTC' as date)::varchar as day, max(start_ts) as latest, array_to_string(list_sort(list(chunk_id)), ',') as chunk_ids from t group by all""")
def browse_recent(spark, sf):
    return ranking.browse(event_chunks(spark, sf)).select("chat_id", F.col("day").cast("string").alias("day"), "latest", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunk_ids"))


@query("newest_budget", f"with {EV}, h as (select *, coalesce(handle = 'purchase', false) as hit from ev) select msg_id, hit and row_number() over (partition by hit order by ts desc, msg_id desc) <= 80 as is_hit from h")
def newest_budget(spark, sf):
    return ranking.newest_hits(event_messages(spark, sf).withColumn("is_hit", F.coalesce(F.col("handle") == "purchase", F.lit(False)))).select("msg_id", "is_hit")


# filters


def roster(spark, sf):
    return event_messages(spark, sf).filter("handle is not null and msg_id % 4 = 0").select("chat_id", "handle").distinct()


ROSTER = "roster as (select distinct chat_id, handle from ev where handle is not null and msg_id % 4 = 0)"


@query("participant_union", f"with {EV}, {ROSTER} select chat_id from roster where handle in ('purchase') union select chat_id from ev where not is_from_me and handle in ('purchase')")
def participant_union(spark, sf):
    return filters.participant_chats(roster(spark, sf), event_messages(spark, sf), ["purchase"])


@query("group_chats", f"with {EV}, {ROSTER}, c as (select distinct chat_id, case when chat_id % 3 = 0 then 45 when chat_id % 3 = 1 then 43 end as style from ev), s as (select chat_id, count(distinct handle) as n from roster group by chat_id) select chat_id, case when style is not null then style <> 45 else coalesce(n, 0) > 1 end as is_group from c left join s using (chat_id)")
def group_chats(spark, sf):
    style = F.when(F.col("chat_id") % 3 == 0, 45).when(F.col("chat_id") % 3 == 1, 43)
    return filters.chat_kinds(event_messages(spark, sf).select("chat_id").distinct().withColumn("style", style), roster(spark, sf))


@query("candidate_set", f"with {SESSIONS}, b as (select min(start_ts) + 86400 as lo, max(end_ts) - 86400 as hi from chunks) select chunk_id from chunks, b where start_ts >= lo and end_ts <= hi and has_attachment and chat_id in (select chat_id from ev where handle = 'purchase') and chat_id in (select chat_id from ev where chat_id % 2 = 0)")
def candidate_set(spark, sf):
    m, c = event_messages(spark, sf), event_chunks(spark, sf)
    ends = c.agg(F.min("start_ts"), F.max("end_ts")).first()
    chats = filters.chat_filter(m.filter("handle = 'purchase'").select("chat_id").distinct(), m.filter("chat_id % 2 = 0").select("chat_id").distinct())
    return filters.candidate_chunks(c, ends[0] + 86_400, ends[1] - 86_400, True, chats)


@query("sender_narrow", f"with {SESSIONS}, n as (select msg_id from ev where not is_from_me and handle = 'purchase' order by ts desc, msg_id desc limit 500) select distinct chunk_id from (select chunk_id, unnest(msg_ids) as msg_id from chunks) join n using (msg_id)")
def sender_narrow(spark, sf):
    return filters.chunks_by_sender(event_messages(spark, sf), sessionize.membership(event_chunks(spark, sf)), ["purchase"], lookback=500)


@query("hit_demotion", f"""with {EV}, h as (select *, cast(to_timestamp(ts) at time zone 'UTC' as date) as day, msg_id % 2 = 0 and not is_from_me and lower(handle) = 'purchase' and has_attachment as hit from ev)
  select msg_id, hit as is_hit from h qualify max(hit::int) over (partition by chat_id, day) = 1""")
def hit_demotion(spark, sf):
    m = event_messages(spark, sf).withColumn("day", ranking.day_of(F.col("ts"))).withColumn("is_hit", F.col("msg_id") % 2 == 0)
    return filters.demote(m, ["Purchase"], need_file=True).select("msg_id", F.coalesce("is_hit", F.lit(False)).alias("is_hit"))


# messages of sessions


@query("hydrate_nested", f"""with {MSGS}, w as (select chat_id, msg_id, msg_id % 1000 // 3 % 2 = 0 as hit from msgs)
  select w.chat_id, count(*) filter (hit) as n_hits, count(*) filter (not hit) as n_context, string_agg(case when not is_from_me then coalesce(case handle when 'assistant' then 'Ada' end, handle) else 'me' end, ',' order by ts, w.msg_id) filter (hit) as senders
  from w join msgs using (msg_id) where trim(coalesce(text, '')) <> '' or has_attachment group by w.chat_id""")
def hydrate_nested(spark, sf):
    m = conversation_messages(spark, sf)
    window = F.col("chat_id") * 10 + F.floor(F.col("msg_id") % 1000 / 3)
    members = m.select("msg_id", window.alias("chunk_id"))
    wanted = m.select("chat_id", window.alias("chunk_id")).distinct().withColumn("day", F.lit("d")).withColumn("is_hit", F.col("chunk_id") % 10 % 2 == 0)
    names = spark.createDataFrame([("assistant", "Ada")], "handle string, display_name string")
    n = hydrate.nest(hydrate.hydrate(wanted, members, m, names))
    said = F.array_join(F.transform("hit_messages", lambda x: F.coalesce(x["sender"], F.lit("me"))), ",")
    return n.select("chat_id", F.size("hit_messages").alias("n_hits"), F.size("context_messages").alias("n_context"), F.when(F.size("hit_messages") > 0, said).alias("senders"))


BUSY = "(select chat_id from ev group by chat_id order by count(*) desc, chat_id limit 1)"


def busiest(spark, sf):
    m = event_messages(spark, sf)
    top = m.groupBy("chat_id").count().orderBy(F.desc("count"), "chat_id").first()
    return m, top["chat_id"]


@query("conversation_recent", f"with {EV} select msg_id, ts from ev where chat_id = {BUSY} order by ts desc, msg_id desc limit 5")
def conversation_recent(spark, sf):
    m, chat = busiest(spark, sf)
    return hydrate.conversation(m, chat, limit=5).select("msg_id", "ts")


@query("conversation_around", f"""with {EV}, c as (select *, row_number() over (order by ts, msg_id) - 1 as i, count(*) over () as n from ev where chat_id = {BUSY}), m as (select (min(ts) + max(ts)) / 2 as x from c),
  a as (select arg_min(i, (abs(ts - x), i)) as a from c, m) select msg_id, ts from c, a where i >= greatest(0, least(a - 3, n - 6)) and i < greatest(0, least(a - 3, n - 6)) + 6""")
def conversation_around(spark, sf):
    m, chat = busiest(spark, sf)
    e = m.filter(F.col("chat_id") == chat).agg(((F.min("ts") + F.max("ts")) / 2).alias("x")).first()
    return hydrate.conversation(m, chat, e["x"], 6).select("msg_id", "ts")


@query("live_tail_merge", f"""with {EV}, h as (select quantile_disc(ts, 0.9) as h from ev), t as (select * from ev order by msg_id desc limit 500), tail as (select chat_id, msg_id, ts, true as hit from t, h where ts > h),
  old as (select chat_id, msg_id, ts, false as hit from ev) select chat_id, cast(to_timestamp(ts) at time zone 'UTC' as date)::varchar as day, msg_id, max(hit::int) = 1 as is_hit from (select * from tail union all select * from old) group by all""")
def live_tail_merge(spark, sf):
    m = event_messages(spark, sf)
    horizon = m.agg(F.expr("percentile_disc(0.9) within group (order by ts)").alias("h")).first()["h"]
    tail = hydrate.live_tail(m, horizon, 500)
    old = m.withColumn("day", ranking.day_of(F.col("ts"))).withColumn("is_hit", F.lit(False))
    return hydrate.merge_rows(tail, old).select("chat_id", F.col("day").cast("string").alias("day"), "msg_id", "is_hit")


@query("status_counts", f"with {SESSIONS} select count(*) as n_chunks, count(distinct chat_id) as n_chats, min(start_ts) as oldest, max(end_ts) as newest, (select count(distinct msg_id) from ev) as n_messages, (select count(distinct msg_id) from ev) as n_source_messages from chunks")
def status_counts(spark, sf):
    c = event_chunks(spark, sf)
    return hydrate.status(c, sessionize.membership(c), event_messages(spark, sf))


@query("freshness", f"with {SESSIONS}, h as (select max(end_ts) as horizon from chunks where end_ts <= (select quantile_disc(ts, 0.9) from ev)) select horizon, count(distinct msg_id) as n_behind, count(distinct msg_id) > 0 as stale from h left join ev on ts > horizon group by horizon")
def freshness(spark, sf):
    """The index as it was when nine tenths of the messages were there."""
    m = event_messages(spark, sf)
    then = m.agg(F.expr("percentile_disc(0.9) within group (order by ts)").alias("h")).first()["h"]
    return hydrate.freshness(m, event_chunks(spark, sf).filter(F.col("end_ts") <= then))


@query("inversions", f"with {EV} select count(*) as pairs, count(*) filter (b.ts < a.ts) as inverted from ev a join ev b on b.msg_id = a.msg_id + 1")
def inversions(spark, sf):
    return hydrate.inversions(event_messages(spark, sf))


@query("join_coverage", f"with {EV} select count(*) as messages, count(*) filter (chat_id % 3 > 0) as in_chunks, round(count(*) filter (chat_id % 3 > 0) / count(*), 6) as share from ev")
def join_coverage(spark, sf):
    members = sessionize.membership(event_chunks(spark, sf).filter("chat_id % 3 > 0"))
    return hydrate.coverage(event_messages(spark, sf), members).select("messages", "in_chunks", r6("share"))


# people

PEOPLE = [("c1", "Kaya Moreno", ["+15550001"]), ("c2", "Sam Lee", ["sam@x.org", "+15550002"]), ("c3", "José Álvarez", ["jose@x.org"]), ("c4", "Samantha Reed", ["+15550004"]), ("c5", "Anne-Marie Fox", ["+15550005"])]
SPANS = ["kaya", "Kaay", "sam lee", "Sma", "jose alvarez", "Samanta", "Reed", "anne", "nobody", "Kayla"]
PEOPLE_SQL = "people as (select * from (values ('c1', 'kaya moreno', 'kaya'), ('c2', 'sam lee', 'sam'), ('c3', 'jose alvarez', 'jose'), ('c4', 'samantha reed', 'samantha'), ('c5', 'anne marie fox', 'anne')) t(identifier, full_name, given))"
SPANS_SQL = "spans as (select unnest(['" + "', '".join(SPANS) + "']) as name)"


def people(spark):
    return spark.createDataFrame(PEOPLE, "identifier string, display_name string, handles array<string>")


def spans(spark):
    return spark.createDataFrame([(s,) for s in SPANS], "name string")


@query("name_exact", f"with {PEOPLE_SQL}, {SPANS_SQL} select name, identifier from spans join people on lower(name) = full_name or lower(name) = given and len(name) > 2")
def name_exact(spark, sf):
    return C.exact_name(people(spark), spans(spark)).select("name", "identifier")


@query("name_osa1", f"with {PEOPLE_SQL}, {SPANS_SQL} select name, identifier from spans join people on lower(name)[1] = given[1] and len(name) >= 4 and len(given) >= 4 and damerau_levenshtein(lower(name), given) <= 1")
def name_osa1(spark, sf):
    p = people(spark).select("identifier", F.split(N.fold_name_udf("display_name"), " ")[0].alias("given"))
    s = spans(spark).withColumn("n", F.lower("name"))
    near = (F.substring("n", 1, 1) == F.substring("given", 1, 1)) & (F.length("n") >= 4) & (F.length("given") >= 4)
    return s.join(F.broadcast(p), near).filter(N.osa_at_most_one(F.col("n"), F.col("given"))).select("name", "identifier")


@query("name_wratio")
def name_wratio(spark, sf):
    return spans(spark).crossJoin(F.broadcast(people(spark))).select("name", "identifier", N.weighted_ratio_udf("name", "display_name").alias("ratio"))


@query("suggest_prefix", "select 'c' || c_custkey as identifier, c_name as display_name from customer where lower(c_name) like 'customer#00000001%' order by c_name, identifier limit 8")
def suggest_prefix(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("identifier"), F.col("c_name").alias("display_name"))
    return hydrate.suggest_contacts(c, "customer#00000001")


NAMED = """named as (select 'c' || c_custkey as owner, c_name as shown from customer union all select 's' || s_suppkey, s_name from supplier union all select 'p' || p_partkey, p_name from part),
  folded as (select distinct owner, shown, trim(regexp_replace(lower(shown), '[^a-z0-9]+', ' ', 'g')) as text from named)"""
#: Asked with typing errors: letters changed round, a letter left out, two wrong figures, two words.
MISTYPED = ["wigdet", "anvl", "000000312", "larg anvli", "custommer"]


def name_index(spark: SparkSession, sf: str) -> suggest.NameIndex:
    """Customers, suppliers and parts by name."""
    named = lambda t, k, n: table(spark, sf, t).select(F.concat(F.lit(t[0]), k).alias("owner"), F.col(n).alias("shown"))
    every = named("customer", "c_custkey", "c_name").unionByName(named("supplier", "s_suppkey", "s_name")).unionByName(named("part", "p_partkey", "p_name"))
    return suggest.write_names(every, shared_base(spark, "names"))


@query("suggest_containing", f"with {NAMED} select part, owner, shown from folded join (select unnest(['widg', 'er 00000001', 'd', 'no such name']) as part) on contains(text, part)")
def suggest_containing(spark, sf):
    index = name_index(spark, sf)
    return reduce(DataFrame.unionByName, [index.containing(p).select(F.lit(p).alias("part"), "owner", "shown") for p in ("widg", "ER#00000001", "d", "no such name")]).withColumn("part", F.regexp_replace(F.lower("part"), "#", " "))


@query("suggest_mistyped", f"""with {NAMED}, words as (select distinct text, unnest(list_append(string_split(text, ' '), text)) as word from folded), asked as (select unnest({MISTYPED}) as asked),
  close as (select asked, text, min(damerau_levenshtein(word, asked)) as distance from words join asked on abs(len(word) - len(asked)) <= 2 where damerau_levenshtein(word, asked) <= case when len(asked) < 8 then 1 else 2 end group by all)
  select asked, owner, shown, distance::int as distance from close join folded using (text)""")
def suggest_mistyped(spark, sf):
    index = name_index(spark, sf)
    return reduce(DataFrame.unionByName, [index.misspelt(a).select(F.lit(a).alias("asked"), "owner", "shown", "distance") for a in MISTYPED])


@query("suggest_chats", f"""with {SESSIONS}, p as (select distinct chat_id, handle, case handle when 'purchase' then 'Shop' else handle end as name from ev where handle is not null),
  t as (select chat_id, string_agg(name, ', ' order by handle) as title, count(*)::int as participant_count from p group by chat_id)
  select t.chat_id, title, participant_count, count(*) as n_chunks, max(end_ts) as last_ts from t join chunks using (chat_id) where contains(lower(title), 'shop') group by all order by last_ts desc, chat_id limit 20""")
def suggest_chats(spark, sf):
    m = event_messages(spark, sf)
    names = spark.createDataFrame([("purchase", "Shop")], "handle string, display_name string")
    meta = hydrate.chat_metadata(m.select("chat_id").distinct(), m.filter("handle is not null").select("chat_id", "handle"), names)
    index = suggest.write_names(suggest.chat_names(meta), shared_base(spark, "names"))
    return suggest.suggest_chats(index, meta, event_chunks(spark, sf), "SHOP")


@query("chat_titles", f"with {EV}, p as (select distinct chat_id, handle, case handle when 'purchase' then 'Shop' else handle end as name from ev where handle is not null), t as (select chat_id, string_agg(name, ', ' order by handle) as title, count(*) as n from p group by chat_id) select c.chat_id, coalesce(n, 0) as participant_count, coalesce(title, 'Unknown conversation') as title from (select distinct chat_id from ev) c left join t using (chat_id)")
def chat_titles(spark, sf):
    m = event_messages(spark, sf)
    names = spark.createDataFrame([("purchase", "Shop")], "handle string, display_name string")
    return hydrate.chat_metadata(m.select("chat_id").distinct(), m.filter("handle is not null").select("chat_id", "handle"), names).select("chat_id", F.col("participant_count"), "title")


@query("contact_handles", "select * from (values ('c1', 'Mo', '+15551234567'), ('c1', 'Mo', 'mo@x.org'), ('c2', 'Ann Lee', '+442071838750'), ('c2', 'Ann Lee', '12345')) t(identifier, display_name, handle)")
def contact_handles(spark, sf):
    raw = spark.createDataFrame([("c1", "Mo", "Maurice", "Fox", ["(555) 123-4567", "MO@X.org"]), ("c2", None, "Ann", "Lee", ["+44 20 7183 8750", "12345"]), ("c3", " ", None, None, ["1"])], "identifier string, nickname string, given string, family string, handles array<string>")
    return C.normalise_contacts(raw).select("identifier", "display_name", F.explode("handles").alias("handle"))


@query("nearest_place", "with g as (select n_nationkey as k, n_name as city, -60 + n_nationkey * 5.0 as lat, -170 + n_nationkey * 13.0 as lon from nation), p as (select c_custkey, -59.5 + c_nationkey * 5.0 as lat, -169.6 + c_nationkey * 13.0 as lon from customer), d as (select c_custkey, city, pow(sin((radians(g.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.lat)) * pow(sin((radians(g.lon) - radians(p.lon)) / 2), 2) as d from p cross join g) select c_custkey, arg_min(city, d) || ' Reg United States' as place from d group by c_custkey")
def nearest_place(spark, sf):
    g = table(spark, sf, "nation").select((F.col("n_nationkey") * 5.0 - 60).alias("lat"), (F.col("n_nationkey") * 13.0 - 170).alias("lon"), F.col("n_name").alias("city"), F.lit("Reg").alias("admin"), F.lit("US").alias("country_code"))
    p = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") * 5.0 - 59.5).alias("lat"), (F.col("c_nationkey") * 13.0 - 169.6).alias("lon"))
    return C.nearest_place(p, g, "c_custkey")


def position_block(south: Column, west: Column, lat: tuple[Column, ...], lon: tuple[Column, ...]) -> Column:
    """The least TIFF that has a position: a header, a directory that points to four fields, and degrees, minutes and seconds as fractions."""
    four = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    sides = [F.when(south, "53").otherwise("4E"), F.when(west, "57").otherwise("45")]
    whole = [F.concat(four(x), F.lit("00000001")) for x in (*lat, *lon)]
    head = "4D4D002A00000008" "0001" "8825" "0004" "00000001" "0000001A" "00000000"
    fields = [F.lit("0004" "0001000200000002"), sides[0], F.lit("000000" "000200050000000300000050" "0003000200000002"), sides[1], F.lit("000000" "000400050000000300000068" "00000000")]
    return F.unhex(F.concat(F.lit(head), *fields, *whole))


@query("image_places", """with g as (select n_name as city, -60 + n_nationkey * 5.0 as lat, -170 + n_nationkey * 13.0 as lon from nation),
  p as (select c_custkey, case when c_custkey % 10 in (0, 2) then 'failed' when c_custkey % 10 = 1 then 'no-gps' else 'ok' end as outcome, (case when c_custkey % 2 = 0 then 1 else -1 end) * (c_custkey % 60 + c_custkey % 59 / 60 + 30 / 3600) as lat, (case when c_custkey % 3 = 0 then -1 else 1 end) * (c_custkey * 7 % 170 + c_custkey % 47 / 60 + 15 / 3600) as lon from customer),
  d as (select c_custkey, arg_min(city, pow(sin((radians(g.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.lat)) * pow(sin((radians(g.lon) - radians(p.lon)) / 2), 2)) || ' Reg United States' as place from p cross join g where outcome = 'ok' group by c_custkey)
  select c_custkey, outcome, case when outcome = 'ok' then round(lat, 6) end as lat, case when outcome = 'ok' then round(lon, 6) end as lon, place from p left join d using (c_custkey)""")
def image_places(spark, sf):
    g = table(spark, sf, "nation").select((F.col("n_nationkey") * 5.0 - 60).alias("lat"), (F.col("n_nationkey") * 13.0 - 170).alias("lon"), F.col("n_name").alias("city"), F.lit("Reg").alias("admin"), F.lit("US").alias("country_code"))
    k, kind = F.col("c_custkey"), F.col("c_custkey") % 10
    block = position_block(k % 2 != 0, k % 3 == 0, (k % 60, k % 59, F.lit(30)), (k * 7 % 170, k % 47, F.lit(15)))
    content = F.when(kind == 0, F.encode(F.lit("no image"), "utf-8")).when(kind == 1, F.unhex(F.lit("89504E470D0A1A0A"))).when(kind > 2, block)
    seen = table(spark, sf, "customer").select("c_custkey", places.image_position_udf(content).alias("p")).select("c_custkey", "p.outcome", "p.lat", "p.lon")
    return seen.join(C.nearest_place(seen, g, "c_custkey"), "c_custkey", "left").select("c_custkey", "outcome", r6("lat"), r6("lon"), "place")


@query("parse_queries")
def parse_queries(spark, sf):
    asked = ["what did Kaya say about dinner last week", "latest from sam", "photos from José in March", "may I borrow the car", "messages I sent yesterday", "lunch on 2024-05-03"]
    q = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "id long, query string")
    return parse_table(q, "query", datetime(2024, 6, 12, 15, tzinfo=UTC), Contacts.collect(people(spark))).select("id", "query", "parsed.*")


# evaluation


@query("temporal_isolation", f"with {SESSIONS} select chunk_id, round(coalesce(least(start_ts - lag(start_ts) over w, lead(start_ts) over w - start_ts) / 86400, 9999), 6) as isolation from chunks window w as (partition by chat_id order by start_ts, chunk_id)")
def temporal_isolation(spark, sf):
    return evalkit.temporal_isolation(event_chunks(spark, sf)).select("chunk_id", r6("isolation"))


@query("within_24h", f"with {SESSIONS} select chunk_id, count(*) over (partition by chat_id order by start_ts range between 86400 preceding and 86400 following) as n_24h from chunks")
def within_24h(spark, sf):
    return evalkit.within_a_day(event_chunks(spark, sf)).select("chunk_id", "n_24h")


@query("pctl_rank", "with v as (select event_id, floor(value) as v from events), n as (select count(*) as n from v where v <> 1), r as (select v, count(*) as c from v where v <> 1 group by v), b as (select v, coalesce(sum(c) over (order by v rows between unbounded preceding and 1 preceding), 0) as below from r) select event_id, round(coalesce(below / n, 1), 6) as share from v cross join n left join b using (v)")
def pctl_rank(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.floor("value"))
    return evalkit.rank_share(e, "v", "share", skip=1).select("event_id", r6("share"))


@query("quartile_bands", "with s as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from events), c as (select max(value) filter (i = n // 4) as a, max(value) filter (i = n // 2) as b, max(value) filter (i = 3 * n // 4) as c from s) select event_id, case when value < a then 0 when value < b then 1 when value < c then 2 else 3 end as band from events cross join c")
def quartile_bands(spark, sf):
    return evalkit.quartile_bands(table(spark, sf, "events"), "value", "band").select("event_id", "band")


@query("minmax_norm", "select event_id, round((value - min(value) over ()) / (max(value) over () - min(value) over ()), 6) as x from events")
def minmax_norm(spark, sf):
    return evalkit.minmax(table(spark, sf, "events"), "value", "x").select("event_id", r6("x"))


def candidate_frame(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 4).alias("nn_band"), (F.col("doc_id") * 31 % 97).cast("double").alias("idf_mean"), (F.col("doc_id") % 7).alias("entity_count"), F.floor(F.col("n_chars") / 6).alias("token_count"))


SCORES = """cand as (select doc_id as chunk_id, doc_id % 4 as nn_band, (doc_id * 31 % 97)::double as idf_mean, doc_id % 7 as entity_count, n_chars // 6 as token_count from documents),
  scores as (select *, nn_band / 3 + (idf_mean - min(idf_mean) over ()) / (max(idf_mean) over () - min(idf_mean) over ()) + (entity_count - min(entity_count) over ()) / (max(entity_count) over () - min(entity_count) over ())
    - case when token_count < 150 then (150 - token_count) / 150 when token_count > 600 then (token_count - 600) / 600 else 0 end as score from cand)"""


@query("candidate_score", f"with {SCORES} select chunk_id, round(score, 6) + 0 as score from scores")
def candidate_score(spark, sf):
    return evalkit.candidate_scores(candidate_frame(spark, sf)).select("chunk_id", (F.round("score", 6) + 0).alias("score"))


@query("stratified_sample", f"with {SCORES}, r as (select chunk_id, case nn_band when 0 then 0 when 3 then 2 else 1 end as stratum, row_number() over (partition by case nn_band when 0 then 0 when 3 then 2 else 1 end order by round(score, 9) desc, chunk_id) as r from scores) select chunk_id, stratum from r where r <= case stratum when 1 then 40 else 30 end")
def stratified_sample(spark, sf):
    scored = evalkit.candidate_scores(candidate_frame(spark, sf)).withColumn("score", F.round("score", 9))
    return evalkit.stratified(scored, 100).select("chunk_id", "stratum")


@query("eval_prefilter", f"""with {SCORES}, b as (select *, median(idf_mean) over () as m from cand where token_count between 40 and 900), g as (select *, idf_mean >= m and entity_count >= 2 as good from b), c as (select *, count(*) filter (good) over () >= 200 as enough from g)
  select chunk_id from c where good or not enough order by idf_mean desc, case when enough then entity_count end desc nulls last, chunk_id limit 200""")
def eval_prefilter(spark, sf):
    return evalkit.prefilter(candidate_frame(spark, sf), 200)


@query("category", """select doc_id, case when doc_id % 11 = 0 or doc_id % 13 = 0 then 'media_geo' when doc_id % 7 = 0 or doc_id % 17 = 0 then 'exact_string' when doc_id % 3 = 0 and doc_id % 5 >= 3 then 'person_filtered' when doc_id % 10 / 10 >= 0.8 then 'time_filtered' when doc_id % 6 >= 3 then 'multi_session' else 'topical' end as category from documents""")
def category(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    flags = d.select("doc_id", (i % 11 == 0).alias("has_geo"), (i % 13 == 0).alias("has_attachment"), (i % 7 == 0).alias("has_url"), (i % 17 == 0).alias("has_long_token"), (i % 3 == 0).alias("is_group"), (i % 5).alias("participant_count"), (i % 10 / 10).alias("isolation_share"), (i % 6).alias("n_24h"))
    return flags.select("doc_id", evalkit.category().alias("category"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"
WINDOWS = MSGS + """, mg as (select *, case when ts - lag(ts) over (partition by chat_id order by ts, msg_id) > 2700 then 1 else 0 end as g from msgs),
  ms as (select *, sum(g) over (partition by chat_id order by ts, msg_id rows unbounded preceding)::bigint as session from mg),
  sl as (select chat_id, session, list({'m': msg_id, 't': ts, 'f': has_attachment, 'x': coalesce(text, '')} order by ts, msg_id) as l from ms group by chat_id, session),
  wl as (select chat_id, unnest(range(0, greatest(1, len(l) - 1), 2)) as s, l from sl), ww as (select chat_id, l[s + 1:s + 3] as w from wl),
  win as (select w[1].m as chunk_id, chat_id, w[1].t as start_ts, list_bool_or(list_transform(w, lambda x: x.f))::int as has_attachment, list_transform(w, lambda x: x.m) as msg_ids, array_to_string(list_transform(w, lambda x: x.x), chr(10)) as body from ww)"""
HARVESTED = WINDOWS + rf""", ft as (select chunk_id, len(list_filter(regexp_extract_all(body, '[^\p{{L}}\p{{N}}_]{{0,2}}[\p{{L}}\p{{N}}_]+'), lambda x, i: regexp_matches(x, '^[^\p{{L}}\p{{N}}_]*[A-Z][a-z]+$') and not regexp_matches(x, '^[.!?]\s') and not (i = 1 and regexp_matches(x, '^[A-Z]')))) as entity_count,
    regexp_matches(body, '\[link:')::int as has_url, regexp_matches(body, '[\p{{L}}\p{{N}}_]{{15,}}')::int as has_long_token, len(regexp_extract_all(body, '[\p{{L}}\p{{N}}_]+')) as token_count from win),
  tm as (select distinct chunk_id, unnest({TERMS.replace("coalesce(text, '')", "body")}) as term from win), dm as (select term, count(*) as df from tm group by term),
  im as (select chunk_id, list_avg(list_sort(list(ln((select count(*) from win) / df)), 'DESC')[1:5]) as idf from tm join dm using (term) group by chunk_id),
  iso as (select chunk_id, coalesce(least(start_ts - lag(start_ts) over w, lead(start_ts) over w - start_ts) / 86400, 9999) as isolation, count(*) over (partition by chat_id order by start_ts range between 86400 preceding and 86400 following) as n_24h from win window w as (partition by chat_id order by start_ts, chunk_id)),
  pc as (select chat_id, count(distinct handle) as people from msgs where handle is not null group by chat_id),
  sig as (select win.chunk_id, has_attachment, len(msg_ids) as msg_count, entity_count, has_url, has_long_token, token_count, coalesce(idf, 0) as idf_mean, isolation, n_24h, coalesce(people, 0) as participant_count, (coalesce(people, 0) > 1)::int as is_group
    from win join ft using (chunk_id) join iso using (chunk_id) left join im using (chunk_id) left join pc using (chat_id)),
  vec as (select chunk_id, msg_ids, list_transform(string_split('{",".join(LETTERS)}', ','), lambda c: (len(lower(body)) - len(replace(lower(body), c, '')))::double) as v from win),
  bnd as (select *, median(idf_mean) over () as m, count(*) over () as n from sig where token_count between 40 and 900), gd as (select *, idf_mean >= m and entity_count >= 2 as good from bnd),
  en as (select *, count(*) filter (good) over () >= 100 as enough from gd), pre as (select chunk_id from en where n <= 100 or good or not enough order by idf_mean desc, case when enough then entity_count end desc nulls last, chunk_id limit 100),
  pr as (select a.chunk_id, b.chunk_id as other, round(1 - list_cosine_similarity(a.v, b.v), 9) as d from vec a join pre using (chunk_id) join vec b on a.chunk_id <> b.chunk_id and not list_has_any(a.msg_ids, b.msg_ids) where list_sum(a.v) > 0 and list_sum(b.v) > 0),
  nn as (select chunk_id, min(d) as nn_distance, arg_min(other, (d, other)) as nn_chunk_id from pr group by chunk_id),
  kn as (select *, row_number() over (order by nn_distance) - 1 as i, count(*) over () as n from sig join nn using (chunk_id)),
  qs as (select max(nn_distance) filter (i = n // 4) as q1, max(nn_distance) filter (i = n // 2) as q2, max(nn_distance) filter (i = 3 * n // 4) as q3 from kn),
  bd as (select kn.*, case when nn_distance <= q1 then 0 when nn_distance <= q2 then 1 when nn_distance <= q3 then 2 else 3 end as nn_band,
    case when isolation < 9999 then (select count(*) from kn k2 where k2.isolation < kn.isolation) / (select count(*) from kn k3 where k3.isolation < 9999) end as share from kn, qs),
  hv as (select *, case when has_attachment = 1 then 'media_geo' when has_url = 1 or has_long_token = 1 then 'exact_string' when is_group = 1 and participant_count >= 3 then 'person_filtered' when share >= 0.8 then 'time_filtered' when n_24h >= 3 then 'multi_session' else 'topical' end as category,
    nn_band / 3 + case when max(idf_mean) over () = min(idf_mean) over () then 0.5 else (idf_mean - min(idf_mean) over ()) / (max(idf_mean) over () - min(idf_mean) over ()) end
     + case when max(entity_count) over () = min(entity_count) over () then 0.5 else (entity_count - min(entity_count) over ()) / (max(entity_count) over () - min(entity_count) over ()) end
     - case when token_count < 150 then (150 - token_count) / 150 when token_count > 600 then (token_count - 600) / 600 else 0 end as score from bd)"""


def conversation_windows(spark, sf) -> DataFrame:
    """Windows of up to three turns, each beginning with the last turn of the one before, with their texts."""
    m = conversation_messages(spark, sf)
    w = sessionize.chunk_messages(m, token_target=1 << 30, max_messages=3, overlap=1).withColumn("chunk_id", F.col("msg_ids")[0])
    said = w.select("chunk_id", F.posexplode("msg_ids").alias("i", "msg_id")).join(m.select("msg_id", F.coalesce("text", F.lit("")).alias("x")), "msg_id")
    body = said.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]), "\n").alias("body"))
    return w.join(body, "chunk_id")


def harvested(spark, sf) -> DataFrame:
    """Signals of all windows of the conversations. Counts of letters stand in for an embedding, so that SQL can say the same."""
    w = conversation_windows(spark, sf)
    w = keep(w, "windows")
    low = F.col("low")
    counts = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("float") for c in LETTERS])
    # a window has a count that is not 0 if it has one of the letters; asked of the counts, all would be made twice
    vecs = w.select("chunk_id", F.lower("body").alias("low")).filter(F.col("low").rlike(f"[{LETTERS}]")).select("chunk_id", counts.alias("embedding"))
    members = conversation_messages(spark, sf).filter("handle is not null").select("chat_id", "handle").distinct()
    return harvest.harvest(w, vecs, members, shared_base(spark, "harvest"), target=100)


@query("harvest_candidates", f"with {HARVESTED} select sig.chunk_id, sig.entity_count, sig.token_count, sig.msg_count, round(sig.idf_mean, 6) as idf_mean, round(sig.isolation, 6) as isolation, sig.n_24h, round(hv.nn_distance, 6) as nn_distance, hv.nn_chunk_id, hv.nn_band, hv.category, round(hv.score, 6) + 0 as score from sig left join hv using (chunk_id)")
def harvest_candidates(spark, sf):
    return harvested(spark, sf).select("chunk_id", "entity_count", "token_count", "msg_count", r6("idf_mean"), r6("isolation"), "n_24h", r6("nn_distance"), "nn_chunk_id", "nn_band", "category", (F.round("score", 6) + 0).alias("score"))


@query("harvest_sample", f"with {HARVESTED}, st as (select chunk_id, category, case nn_band when 0 then 0 when 3 then 2 else 1 end as stratum, round(score, 9) as score from hv), rk as (select *, row_number() over (partition by stratum order by score desc, chunk_id) as r from st) select chunk_id, category, stratum from rk where r <= case stratum when 1 then 20 else 15 end")
def harvest_sample(spark, sf):
    return harvest.sample(harvested(spark, sf).withColumn("score", F.round("score", 9)), 50).select("chunk_id", "category", "stratum")


WILSON = "greatest(0, (p + 1.96*1.96/(2*n) - 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n))", "least(1, (p + 1.96*1.96/(2*n) + 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n))"


@query("recall_summary_rollup", f"with g as (select coalesce(lang, 'OVERALL') as category, count(*) as n, avg(quality) as p from labels join documents using (doc_id) group by rollup(lang)) select category, n, round(p, 6) as r50, round({WILSON[0]}, 6) as r50_low, round({WILSON[1]}, 6) as r50_high from g")
def recall_summary_rollup(spark, sf):
    l = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("category")), "doc_id").withColumnRenamed("quality", "r50")
    return evalkit.recall_summary(l, "category", ["r50"]).select("category", "n", r6("r50"), r6("r50_low"), r6("r50_high"))


@query("wilson", f"with g as (select source, count(*) as n, avg(toxic) as p from labels join documents using (doc_id) group by source) select source, round({WILSON[0]}, 6) as low, round({WILSON[1]}, 6) as high from g")
def wilson(spark, sf):
    g = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    low, high = evalkit.wilson(F.col("k"), F.col("n"))
    return g.select("source", r6(low, "low"), r6(high, "high"))


@query("mcnemar", "with g as (select count(*) as n, sum(quality)::bigint as a_hits, sum(toxic)::bigint as b_hits, count(*) filter (quality = 1 and toxic = 0) as only_a, count(*) filter (quality = 0 and toxic = 1) as only_b from labels) select *, round((b_hits - a_hits) / n, 6) as delta, round((only_a - only_b) * (only_a - only_b) / (only_a + only_b), 6) as chi2 from g")
def mcnemar(spark, sf):
    l = table(spark, sf, "labels")
    a, b = (l.select("doc_id", F.col(c).alias("hit")) for c in ("quality", "toxic"))
    return evalkit.compare_targets(a, b, "doc_id", "hit").select("n", "a_hits", "b_hits", "only_a", "only_b", r6("delta"), r6("chi2"))


@query("entry_recall", "select item_id, (item_id % 7 < 3)::int as r12, (item_id % 7 < 5)::int as r50 from benchmark")
def entry_recall(spark, sf):
    b = table(spark, sf, "benchmark")
    entries = b.select("item_id", F.col("item_id").alias("entry_id"), F.array(F.col("item_id") * 10, F.col("item_id") * 10 + 1).alias("positives"))
    found = b.select(F.col("item_id").alias("entry_id"), (F.col("item_id") * 10 + 1).alias("chunk_id"), F.when(F.col("item_id") % 7 < 3, 5).when(F.col("item_id") % 7 < 5, 40).otherwise(90).alias("rank"))
    return evalkit.entry_recall(entries, found, {"r12": 12, "r50": 50}).select("item_id", "r12", "r50")


@query("latency_summary", "select event_type as class, count(*) as n, round(median(value), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, max(value) as longest, round(avg((value > 20)::int) filter (event_id % 3 > 0), 6) as rate from events group by event_type")
def latency_summary(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("class"), F.col("value").alias("seconds"), F.when(F.col("event_id") % 3 > 0, F.col("value") > 20).alias("passed"))
    return evalkit.latency_summary(e).select("class", "n", r6("p50"), r6("p95"), "longest", r6("rate"))


@query("oracle_metrics", "with f as (select distinct user_id as case_id, event_id as msg_id from events where event_id % 3 = 0), t as (select distinct user_id as case_id, event_id as msg_id from events where event_id % 2 = 0), b as (select coalesce(f.case_id, t.case_id) as case_id, f.msg_id as f, t.msg_id as t from f full join t on f.case_id = t.case_id and f.msg_id = t.msg_id) select case_id, count(f) as n_found, count(t) as n_truth, round(case when count(f) > 0 then count(f + t) / count(f) end, 6) as precision, round(case when count(t) > 0 then count(f + t) / count(t) end, 6) as recall from b group by case_id")
def oracle_metrics(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("msg_id"))
    return evalkit.oracle_metrics(e.filter("msg_id % 3 = 0"), e.filter("msg_id % 2 = 0")).select("case_id", "n_found", "n_truth", r6("precision"), r6("recall"))


@query("stride_sample", "select event_id from (select event_id, row_number() over (order by ts, event_id) - 1 as i from events) where i % 37 = 0")
def stride_sample(spark, sf):
    return evalkit.every_nth(table(spark, sf, "events"), 37, "ts", "event_id").select("event_id")


@query("frequent_senders", f"with {EV} select handle, count(*) as n from ev where handle is not null group by handle order by n desc, handle limit 3")
def frequent_senders(spark, sf):
    return event_messages(spark, sf).filter("handle is not null").groupBy("handle").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "handle").limit(3)


# suites


@query("messages_from", f"with {EV}, b as (select min(ts) + 86400 as lo from ev) select msg_id, chat_id, ts from ev, b where not is_from_me and handle = 'purchase' and ts >= lo and has_attachment")
def messages_from(spark, sf):
    m = event_messages(spark, sf)
    return suites.messages_from(m, "Purchase", start=m.agg(F.min("ts")).first()[0] + 86_400, need_file=True)


@query("corpus_phrases", rf"""with {MSGS}, w as (select msg_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+') as w from msgs where msg_id % 7 = 0), p as (select array_to_string(w[1:4], ' ') as phrase, msg_id from w where len(w) >= 4)
  select phrase, min(msg_id) as msg_id from p group by phrase order by msg_id limit 50""")
def corpus_phrases(spark, sf):
    return suites.corpus_phrases(conversation_messages(spark, sf), stride=7)


@query("build_suite")
def build_suite(spark, sf):
    m = conversation_messages(spark, sf)
    names = spark.createDataFrame([("assistant", "Ada Byron"), ("system", "Sys Op")], "handle string, display_name string")
    return suites.build_suite(spark, suites.frequent_names(m, names), suites.corpus_phrases(m, stride=7, most=5))


@query("parser_probe")
def parser_probe(spark, sf):
    return suites.parser_probe(spark, Contacts.collect(people(spark)), datetime(2024, 6, 12, 15, tzinfo=UTC))


ASKED = f"""{POSTINGS}, said as (select doc_id, {TERMS} as w from documents), ask as (select doc_id as qid, list_filter(w[5:7], lambda x, i: list_position(w[5:7], x) = i) as words from said where doc_id % 50 = 0),
  qt as (select qid, len(words) as n_words, unnest(words) as term from ask), dfs as (select term, count(*) as df from post group by term),
  met as (select qid, post.doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from qt join post using (term) join dfs using (term) join stats on stats.doc_id = post.doc_id cross join corpus
    group by qid, post.doc_id, n_words having count(*) = n_words),
  many as (select qid, doc_id, score, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rank from met)"""


def document_questions(spark, sf):
    """(qid, words): three words from the beginning of each 50th document as questions against all documents."""
    d = table(spark, sf, "documents").filter("doc_id % 50 = 0")
    words = T.index_terms(F.coalesce("text", F.lit("")))
    return d.select(F.col("doc_id").alias("qid"), F.array_distinct(F.slice(words, 5, 3)).alias("words"), "text")


@query("bm25_many", f"with {ASKED} select qid, doc_id, round(score, 6) as score, rank::int as rank from many where rank <= 20")
def bm25_many(spark, sf):
    index, stats = doc_index(spark, sf)
    return batch.bm25_many(index, stats, document_questions(spark, sf).select("qid", "words"), "doc_id", 20).select("qid", "doc_id", r6("score"), "rank")


@query("phrase_many", f"""with {ASKED}, t as (select doc_id, ' ' || replace(array_to_string(w, ' '), ' ', '  ') || ' ' as x from said), a2 as (select qid, ' ' || array_to_string(words, '  ') || ' ' as p from ask where len(words) > 1),
  h as (select qid, t.doc_id, (len(x) - len(replace(x, p, ''))) // len(p) as tf from a2 join t on contains(x, p)), d as (select qid, count(*) as df from h group by qid),
  s as (select qid, h.doc_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as score from h join d using (qid) join stats on stats.doc_id = h.doc_id cross join corpus),
  r as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rank from s)
  select qid, doc_id, round(score, 6) as score, rank::int as rank from r where rank <= 20""")
def phrase_many(spark, sf):
    index, stats = doc_index(spark, sf)
    return batch.phrase_many(index, stats, document_questions(spark, sf).select("qid", "words"), "doc_id").select("qid", "doc_id", r6("score"), "rank")


@query("knn_many", """with p as (select a.vec_id as qid, b.vec_id, 1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as d from embeddings a, embeddings b where a.vec_id % 50 = 0),
  r as (select *, row_number() over (partition by qid order by round(d, 9), vec_id) as rank from p) select qid, vec_id, round(d, 6) as distance, rank::int as rank from r where rank <= 10""")
def knn_many(spark, sf):
    e = table(spark, sf, "embeddings")
    return batch.knn_many(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), "vec_id", "embedding", 10).select("qid", "vec_id", r6("distance"), "rank")


STOPPED = "['the','a','an','and','or','but','is','are','was','were','be','been','to','of','in','on','at','for','with','about','we','us','i','you','did','do','does','what','where','when','who','how','that','this','it','our','their','them','he','she','his','her','me']"


@query("question_filter", f"""with {ASKED}, q as (select qid, array_to_string(words, ' ') as query, text from ask join documents on documents.doc_id = qid),
  c as (select qid, list_distinct(list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'), lambda w: len(w) > 2 and not list_contains({STOPPED}, w))) as q, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as s from q),
  f as (select qid, min(case when doc_id = qid then rank end) as source_rank, coalesce(bool_or(rank = 1 and doc_id = qid), false) as sparse_first, string_agg(case when doc_id <> qid and rank <= 5 then doc_id::varchar end, ',' order by rank) as others from many where rank <= 300 group by qid)
  select c.qid, source_rank::int as source_rank, coalesce(sparse_first, false) as sparse_first, coalesce(others, '') as others,
   case when len(q) > 0 and len(list_intersect(q, s)) / len(q) > 0.4 then 'copied' when source_rank is null then 'not_found' when source_rank > 200 then 'hard' else 'kept' end as verdict from c left join f on f.qid = c.qid""")
def question_filter(spark, sf):
    index, stats = doc_index(spark, sf)
    q = document_questions(spark, sf)
    found = batch.bm25_many(index, stats, q.select("qid", "words"), "doc_id", 300).select("qid", "doc_id", "rank")
    asked = q.select("qid", F.array_join("words", " ").alias("query"), F.col("text").alias("source_text"), F.col("qid").alias("source"))
    out = suites.question_filter(suites.with_ranks(asked, found, found, "qid", "source", "doc_id"))
    return out.select("qid", "source_rank", "sparse_first", F.array_join(F.col("top_others").cast("array<string>"), ",").alias("others"), "verdict")


# reports

RECALLED = f"""{ASKED}, f as (select qid, min(rank) as rank from many where doc_id = qid and rank <= 50 group by qid),
  sc as (select ask.qid, lang, n_chars, (coalesce(rank, 99) <= 50)::int as r50, (coalesce(rank, 99) <= 12)::int as r12, (coalesce(rank, 99) <= 4)::int as r4, (len(words) < 3)::int as killed from ask join documents on doc_id = ask.qid left join f on f.qid = ask.qid),
  ln as (select *, row_number() over (order by n_chars) - 1 as i, count(*) over () as n from sc), qs as (select max(n_chars) filter (i = n // 4) as q1, max(n_chars) filter (i = n // 2) as q2, max(n_chars) filter (i = 3 * n // 4) as q3 from ln),
  bd as (select sc.*, case when n_chars <= q1 then 'Q1' when n_chars <= q2 then 'Q2' when n_chars <= q3 then 'Q3' else 'Q4' end as band from sc, qs),
  g as (select case when grouping(lang) = 0 then 'category' when grouping(band) = 0 then 'band' else 'overall' end as facet, case when grouping(lang) = 0 then lang when grouping(band) = 0 then band else 'OVERALL' end as label, count(*) as n, avg(r50) as p, avg(r12) as p12, avg(r4) as p4, avg(killed) as kill_rate
    from bd group by grouping sets ((lang), (band), ()))"""


@query("recall_report", f"with {RECALLED} select facet, label, n, round(p, 6) as r50, round({WILSON[0]}, 6) as r50_low, round({WILSON[1]}, 6) as r50_high, round(p12, 6) as r12, round(p4, 6) as r4, round(p12 - p, 6) + 0 as gap1, round(p4 - p12, 6) + 0 as gap2, round(kill_rate, 6) as kill_rate from g")
def recall_report(spark, sf):
    """Three words of each 50th document as a question: how far up its document is, by language and by quartile of length; questions of fewer words count as killed."""
    index, stats = doc_index(spark, sf)
    q = document_questions(spark, sf)
    found = batch.bm25_many(index, stats, q.select("qid", "words"), "doc_id", 50).filter("qid = doc_id").select("qid", "rank")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "lang", "n_chars")
    at = lambda n: F.coalesce(F.col("rank") <= n, F.lit(False)).cast("int")
    scored = q.join(d, "qid").join(found, "qid", "left").select("lang", "n_chars", at(50).alias("r50"), at(12).alias("r12"), at(4).alias("r4"), (F.size("words") < 3).cast("int").alias("killed"))
    out = evalkit.recall_report(scored, "lang", ["r50", "r12", "r4"], "n_chars", "killed")
    return out.select("facet", "label", "n", r6("r50"), r6("r50_low"), r6("r50_high"), r6("r12"), r6("r4"), (F.round("gap1", 6) + 0).alias("gap1"), (F.round("gap2", 6) + 0).alias("gap2"), r6("kill_rate"))


def outcome_sql(hits: str, out: str) -> str:
    return f"""{out} as (select ask.qid, coalesce(max(1.0::double / rank) filter (doc_id = ask.qid), 0) as reciprocal, coalesce(bool_or(doc_id = ask.qid and rank = 1), false)::int as first, count(doc_id) as hits
      from ask left join (select * from {hits} where rank <= 20) h on h.qid = ask.qid group by ask.qid)"""


# the terms of phrase_many's SQL, without what it selects
PHRASED = ORACLE["phrase_many"].rsplit("\n", 1)[0]


@query("compare_arms", f"""{PHRASED}, {outcome_sql("many", "am")}, {outcome_sql("r", "bm")},
  lo as (select m.metric, lang, case m.metric when 'reciprocal' then am.reciprocal when 'first' then am.first else am.hits end::double as a, case m.metric when 'reciprocal' then bm.reciprocal when 'first' then bm.first else bm.hits end::double as b
    from am join bm using (qid) join documents on doc_id = qid cross join (select unnest(['reciprocal', 'first', 'hits']) as metric) m),
  g as (select metric, case when grouping(lang) = 1 then 'OVERALL' else lang end as label, count(*) as n, avg(a) as mean_a, avg(b) as mean_b, avg(b - a) as delta, stddev_samp(b - a) / sqrt(count(*)) as se, count(*) filter (b < a) as x, count(*) filter (b > a) as y from lo group by grouping sets ((metric, lang), (metric)))
  select metric, label, n, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(delta, 6) + 0 as delta, round(delta - 1.96 * se, 6) + 0 as low, round(delta + 1.96 * se, 6) + 0 as high, x as a_better, y as b_better, round(case when x + y > 0 then (x - y) * (x - y) / (x + y) end, 6) as chi2 from g""")
def compare_arms(spark, sf):
    """Words against phrases on the same questions: reciprocal rank of the document, whether it comes first, and how many are found."""
    d = table(spark, sf, "documents")
    q = keep(document_questions(spark, sf).select("qid", "words"), "arm-questions")
    lang = keep(d.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "lang"), "arm-langs")

    def measured(found: DataFrame) -> DataFrame:
        own = F.col("doc_id") == F.col("qid")
        per = found.filter("rank <= 20").groupBy("qid").agg(F.max(F.when(own, 1 / F.col("rank"))).alias("reciprocal"), F.max(own & (F.col("rank") == 1)).alias("first"), F.count("*").alias("hits"))
        return q.join(per, "qid", "left").join(lang, "qid").select("qid", "lang", F.coalesce("reciprocal", F.lit(0.0)).alias("reciprocal"), F.coalesce("first", F.lit(False)).alias("first"), F.coalesce("hits", F.lit(0)).alias("hits"))

    a, b = map(measured, arms.both(d, q, "doc_id", "text", 20))
    out = evalkit.compare_metrics(a, b, ["qid"], ["reciprocal", "first", "hits"], "lang")
    zero = lambda c: (F.round(c, 6) + 0).alias(c)
    return out.select("metric", "label", "n", r6("mean_a"), r6("mean_b"), zero("delta"), zero("low"), zero("high"), "a_better", "b_better", r6("chi2"))


@query("verdict_pivot", "with v as (" + ORACLE["question_filter"] + ") select lang, count(*) filter (verdict = 'kept') as kept, count(*) filter (verdict = 'copied') as copied, count(*) filter (verdict = 'hard') as hard, count(*) filter (verdict = 'not_found') as not_found, count(*) as n, round(count(*) filter (verdict = 'kept') / count(*), 6) as rate from v join documents on doc_id = qid group by lang")
def verdict_pivot(spark, sf):
    v = question_filter(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "lang"), "qid")
    return evalkit.outcomes(v, "lang", "verdict", ["kept", "copied", "hard", "not_found"]).withColumn("n", F.col("n").cast("long")).withColumn("rate", F.round("rate", 6))


# numbers and negatives

REGIONS = {"en": "US", "fr": "FR", "de": "DE", "es": "ES"}
PLAN_SQL = "plan as (select * from (values " + ", ".join(f"('{r}', '{c}', '{t}', {lo}, {hi}, '^{first}')" for r, c, t, lo, hi, first in phones.PLAN) + ") t(region, code, trunk, least, most, first))"
VALID = "exists(select 1 from plan where plan.code = left({d}, {n}) and regexp_matches(substr({d}, {n} + 1), plan.first) and len({d}) - {n} between plan.least and plan.most)"


def international_sql(d: str) -> str:
    by = " ".join(f"when exists(select 1 from plan where code = left({d}, {n})) then {VALID.format(d=d, n=n)}" for n in (3, 2, 1))
    return f"case when len({d}) <= 15 and (case {by} else false end) then '+' || {d} end"


@query("phone_numbers", rf"""with {PLAN_SQL}, found as (select doc_id, trim(unnest(regexp_extract_all(text, '\+?\d[\d\-\s().]{{7,}}\d'))) as raw, case lang {' '.join(f"when '{k}' then '{v}'" for k, v in REGIONS.items())} end as region from documents),
  u as (select distinct doc_id, raw, found.region, code, trunk, case when found.region = 'US' then '011' else '00' end as abroad, regexp_replace(raw, '[^0-9]', '', 'g') as d from found left join plan using (region)),
  c as (select *, case when starts_with(d, trunk) and trunk <> '' then code || substr(d, len(trunk) + 1) end as d1, code || d as d2, case when code is not null and starts_with(d, abroad) then substr(d, len(abroad) + 1) end as d3, case when starts_with(d, code) then d end as d4 from u),
  x as (select *, case when starts_with(raw, '+') then {international_sql("d")} else coalesce({international_sql("d1")}, {international_sql("d2")}, {international_sql("d3")}, {international_sql("d4")}) end as number from c)
  select doc_id, raw, coalesce(number, raw) as handle, number is not null as valid from x""")
def phone_numbers(spark, sf):
    """What looks like a telephone number in each document, read by the numbering plan of its language's region; cards and addresses of machines stay as they are."""
    d = table(spark, sf, "documents")
    region = F.create_map(*[F.lit(x) for kv in REGIONS.items() for x in kv])[F.col("lang")]
    found = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.PHONE), F.lit(0))).alias("raw"), region.alias("region"))
    rows = found.select("doc_id", F.trim("raw").alias("raw"), "region").distinct().withColumn("handle", phones.normalised(F.col("raw"), F.col("region")))
    return rows.select("doc_id", "raw", "handle", (F.startswith("handle", F.lit("+")) & ~F.rlike("handle", F.lit("[^+0-9]"))).alias("valid"))


@query("corpus_negatives", rf"""with f as (select lower(unnest(regexp_extract_all(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:from|with)\s+((?:the\s+)?[a-z][a-z''-]+)', 1))) as p from conversations where len(text) >= 20),
  c as (select regexp_replace(p, '\s+', ' ', 'g') as phrase, count(*) as n from f group by 1 having len(phrase) >= 3), n as (select distinct trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) as name from customer)
  select phrase, n from c where not exists (select 1 from n as k where k.name = regexp_replace(phrase, '^the ', '') or string_split(k.name, ' ')[1] = regexp_replace(phrase, '^the ', '')) order by n desc, phrase limit 60""")
def corpus_negatives(spark, sf):
    return suites.corpus_negatives(conversation_messages(spark, sf), table(spark, sf, "customer").select(F.col("c_name").alias("display_name")), longest=None)


# changes of the source

OLD_NEW = f"{EV}, v as (select ev.*, value from ev join events on event_id = msg_id), a as (select msg_id, chat_id, ts, text from v where value < 60), b as (select msg_id, chat_id, ts, case when is_from_me then upper(text) else text end as text from v where value >= 20)"


def two_versions(spark, sf):
    """Events of small values, then those of greater ones with an edit of some: rows that come, go, change and stay."""
    m = event_messages(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("msg_id"), "value"), "msg_id")
    edited = F.when(F.col("is_from_me"), F.upper("text")).otherwise(F.col("text")).alias("text")
    return m.filter("value < 60").select("msg_id", "chat_id", "ts", "text"), m.filter("value >= 20").select("msg_id", "chat_id", "ts", edited)


@query("change_feed", f"with {OLD_NEW} select case when a.msg_id is null then 'insert' when b.msg_id is null then 'delete' else 'update' end as change, coalesce(a.msg_id, b.msg_id) as msg_id, coalesce(a.chat_id, b.chat_id) as chat_id, b.ts, b.text from a full join b on a.msg_id = b.msg_id and a.chat_id = b.chat_id where a.msg_id is null or b.msg_id is null or a.text is distinct from b.text")
def change_feed(spark, sf):
    return changes(*two_versions(spark, sf))


@query("snapshot_replay", f"with {OLD_NEW} select msg_id, chat_id, ts, text from b")
def snapshot_replay(spark, sf):
    return replayed(spark, shared_base(spark, "versions"), list(two_versions(spark, sf)))


# the whole engine


def demo_engine(spark, sf) -> Engine:
    m = conversation_messages(spark, sf)
    root = shared_base(spark, "index")
    build_index(spark, m, root)
    return Engine(spark, IndexStore(spark, root), m, now=NOW)


@query("engine_search")
def engine_search(spark, sf):
    from convolens.plans.parse import parse_query

    e = demo_engine(spark, sf)
    text = e.messages.filter("length(text) > 20").orderBy("msg_id").first()["text"]
    return e.search(parse_query(" ".join(text.split()[:6]), datetime.fromtimestamp(NOW, UTC))).select("chat_id", F.col("day").cast("string").alias("day"), "place", r6("score"), "confidence", "payload")


@query("engine_browse")
def engine_browse(spark, sf):
    from convolens.plans.parse import parse_query

    return demo_engine(spark, sf).browse(parse_query("latest messages", datetime.fromtimestamp(NOW, UTC))).select("chat_id", F.col("day").cast("string").alias("day"), F.size("hit_messages").alias("n_hits"), "payload")


@query("stateful_chunks_stream", f"""with {SESSIONS}, w as (select chat_id, case when n > 40 then 1 + ceil((n - 40) / 38.0) else 1 end as n from chunks0) select chat_id, sum(n)::bigint as n_windows from w group by chat_id""")
def stateful_chunks_stream(spark, sf):
    """The stateful operator over a stream of files in the order of time, to its end; a window that grew counts once."""
    from convolens.streaming.sync import window_stream

    m = event_messages(spark, sf).select("chat_id", "msg_id", "ts", F.lit(1).alias("tokens"))
    half = m.agg(F.percentile_approx("ts", 0.5).alias("h")).first()["h"]
    base = shared_base(spark, "stream")
    kind = "chat_id long, start_ts double"
    spark.createDataFrame([], kind).write.parquet(f"{base}/out/none")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    # the second half comes when the first is done, so batches are in the order of time whatever the number of files
    for part in (m.filter(F.col("ts") <= half), m.filter(F.col("ts") > half)):
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("chat_id long, msg_id long, ts double, tokens int").parquet(f"{base}/in")
        q = window_stream(stream).select("chat_id", "start_ts").writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    found = spark.read.schema(kind).option("recursiveFileLookup", True).parquet(f"{base}/out")
    return found.groupBy("chat_id").agg(F.count_distinct("start_ts").alias("n_windows"))
