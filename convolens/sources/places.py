"""Where attachments were taken: image files to positions to names of places, with a memory of what was looked at."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from convolens.functions.blobs import exif_position
from convolens.schemas import SCHEMAS
from convolens.sources.contacts import nearest_place
from convolens.sources.store import Snapshot, Writer, insert_new

# How image files begin, by their public formats.
SIGNATURES = (b"\xff\xd8\xff", b"II*\x00", b"MM\x00*", b"\x89PNG\r\n\x1a\n", b"GIF87a", b"GIF89a", b"BM")
OUTCOME = StructType([StructField("outcome", StringType()), StructField("lat", DoubleType()), StructField("lon", DoubleType())])


def is_image(head: bytes) -> bool:
    return head.startswith(SIGNATURES) or head[:4] == b"RIFF" and head[8:12] == b"WEBP" or head[4:8] == b"ftyp"


def image_position(data: bytes | None) -> tuple[str, float | None, float | None]:
    """(outcome, latitude, longitude): ok with a position; no-gps for an image without a usable one; failed for what is no image, to be tried again."""
    if not data or not is_image(data[:16]):
        return "failed", None, None
    lat, lon = exif_position(data) or (math.nan, math.nan)
    return ("ok", lat, lon) if abs(lat) <= 90 and abs(lon) <= 180 else ("no-gps", None, None)


@F.pandas_udf(OUTCOME)
def image_position_udf(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_position(x) for x in content], columns=OUTCOME.names)


def read_image(path: str) -> bytes | None:
    """A file of any store that pyarrow knows, whole if it is an image; None if there is none, or it can't be read."""
    from pyarrow.fs import FileSystem

    try:
        fs, name = FileSystem.from_uri(path)
        with fs.open_input_stream(name) as f:
            head = f.read(16)
            return head + f.read() if is_image(head) else None
    except (OSError, ValueError):
        return None


def look_at(paths: DataFrame) -> DataFrame:
    """(attachment_id, outcome, lat, lon) of ``paths``: attachment_id, path. A task holds one file at a time; only these files are opened."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = [image_position(read_image(p)) for p in b["path"]]
            yield pd.DataFrame({"attachment_id": b["attachment_id"], **{c: [s[i] for s in seen] for i, c in enumerate(OUTCOME.names)}})

    return paths.select("attachment_id", "path").repartition("path").mapInPandas(opened, StructType([StructField("attachment_id", LongType()), *OUTCOME]))


def attachment_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(msg_id, attachment_id, filename) of a message source."""
    a = tables["attachment"].select(F.col("rowid").alias("attachment_id"), "filename")
    return tables["message_attachment_join"].select(F.col("message_id").alias("msg_id"), "attachment_id").join(a, "attachment_id").select("msg_id", "attachment_id", "filename").distinct()


def pending(attachments: DataFrame, known: DataFrame, home: str = "~") -> DataFrame:
    """(attachment_id, path) of attachments that have a file name and were not yet looked at; a leading ``~`` stands for ``home``. An attachment of many messages is one row."""
    path = F.when(F.col("filename").startswith("~"), F.concat(F.lit(home), F.expr("substring(filename, 2)"))).otherwise(F.col("filename"))
    named = attachments.filter("trim(filename) <> ''").groupBy("attachment_id").agg(F.min("filename").alias("filename"))
    return named.join(known.select("attachment_id"), "attachment_id", "left_anti").select("attachment_id", path.alias("path"))


def update_places(w: Writer, before: Snapshot | None, attachments: DataFrame, gazetteer: DataFrame, home: str = "~") -> tuple[DataFrame, DataFrame]:
    """Look at what was not looked at, and write ``attachment_place``: a row for each readable image, with a null place where it has no position. Returns what was seen this time (attachment_id, outcome, lat, lon) and the table.

    What is there is never changed; a failed file has no row, so every build tries it again.
    """
    known = before.read("attachment_place") if before else attachments.sparkSession.createDataFrame([], SCHEMAS["attachment_place"])
    seen = w.put("seen_images", look_at(pending(attachments, known, home)))
    spots = nearest_place(seen.filter("outcome = 'ok'"), gazetteer, "attachment_id")
    placed = seen.filter("outcome <> 'failed'").join(spots, "attachment_id", "left").select("attachment_id", "place")
    return seen, w.put("attachment_place", insert_new(known, placed, "attachment_id"))


def update_retries(w: Writer, before: Snapshot | None, attachments: DataFrame, seen: DataFrame, members: DataFrame) -> DataFrame:
    """Write ``attachment_retry``: failed attachments and a window each; entries that are there stay while their file fails. ``members``: (msg_id, chunk_id) of windows that this build wrote."""
    failed = seen.filter("outcome = 'failed'").select("attachment_id")
    new = failed.join(attachments, "attachment_id").join(members, "msg_id").groupBy("attachment_id").agg(F.min("chunk_id").alias("chunk_id"))
    if before:
        old = before.read("attachment_retry").join(failed, "attachment_id", "left_semi")
        new = new.unionByName(old.join(new.select("attachment_id"), "attachment_id", "left_anti").select("attachment_id", "chunk_id"))
    return w.put("attachment_retry", new)


def attachment_words(attachments: DataFrame, places: DataFrame) -> DataFrame:
    """(msg_id, files): place, if known, and file name of each attachment, in order of ids: what the word index has of them."""
    rows = attachments.join(places.filter("place is not null"), "attachment_id", "left")
    words = F.array_compact(F.array("place", F.expr("nullif(trim(filename), '')")))
    every = F.array_sort(F.collect_list(F.struct("attachment_id", words.alias("words"))))
    return rows.groupBy("msg_id").agg(F.flatten(F.transform(every, lambda x: x["words"])).alias("files"))
