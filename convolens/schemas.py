"""Schemas of the source relations and of the index tables, and checks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_DDL = {
    # source relations
    "message": "rowid long, text string, attributed_body binary, date long, date_edited long, date_retracted long, is_from_me int, handle_id long, associated_message_type int",
    "chat": "rowid long, style int",
    "chat_message_join": "chat_id long, message_id long",
    "chat_handle_join": "chat_id long, handle_id long",
    "handle": "rowid long, id string",
    "attachment": "rowid long, filename string",
    "message_attachment_join": "message_id long, attachment_id long",
    "contacts": "identifier string, display_name string, handles array<string>",
    # the cleaned row that everything else sees
    "messages": "msg_id long, chat_id long, ts double, is_from_me boolean, handle string, text string, date_edited double, date_retracted double, has_attachment boolean",
    # index tables
    "chunks": "chunk_id long, chat_id long, position int, start_ts double, end_ts double, has_attachment boolean, msg_ids array<long>, content_hash long, body_semantic string, body_lexical string",
    "chunk_message": "msg_id long, chunk_id long",
    "postings": "term string, chunk_id long, tf int, dl int, positions array<int>",
    "terms": "term string, docs long",
    "doc_stats": "chunk_id long, dl int",
    "vectors": "chunk_id long, norm double, embedding array<tinyint>",
    "tombstones": "chunk_id long",
    "chat_state": "chat_id long, n long, h long",
    "attachment_place": "attachment_id long, place string",
    "attachment_retry": "attachment_id long, chunk_id long",
    "meta": "key string, value string",
}
_TYPES: dict[str, DataType] = {"long": LongType(), "int": IntegerType(), "tinyint": ByteType(), "double": DoubleType(), "boolean": BooleanType(), "string": StringType(), "binary": BinaryType()}


def _struct(ddl: str) -> StructType:
    """Without a session, which Spark's own parser needs."""
    fields = [f.split() for f in ddl.split(", ")]
    return StructType([StructField(n, ArrayType(_TYPES[t[6:-1]]) if t.startswith("array<") else _TYPES[t]) for n, t in fields])


SCHEMAS: dict[str, StructType] = {k: _struct(v) for k, v in _DDL.items()}

#: Tables of a source without which nothing can be read.
REQUIRED = ("message", "chat", "chat_message_join", "chat_handle_join", "handle", "attachment", "message_attachment_join")


class SchemaDriftError(ValueError):
    """A source lacks tables or columns that it must have."""


def require_columns(tables: dict[str, DataFrame], names: tuple[str, ...] = REQUIRED) -> None:
    """Raise with all that is missing at once."""
    missing = [f"table {n}" for n in names if n not in tables]
    missing += [f"{n}.{c}" for n in names if n in tables for c in SCHEMAS[n].fieldNames() if c not in tables[n].columns]
    if missing:
        raise SchemaDriftError("missing: " + ", ".join(missing))


def optional(df: DataFrame, column: str, kind: str = "string") -> Column:
    """A column that older sources do not have: null there."""
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)
