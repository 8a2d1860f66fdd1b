"""Image files to places in the word index, and files that fail and come back."""

import struct

import pytest
from pyspark.sql import functions as F

from convolens.plans.parse import ParsedQuery
from convolens.plans.search import Engine, build_index
from convolens.sources.places import attachment_words, image_position, look_at, pending
from convolens.sources.store import IndexStore

GAZETTEER = [(38.72, -9.14, "Lisbon", "Lisboa", "PT"), (-33.87, 151.21, "Sydney", "NSW", "AU")]
MESSAGES = "msg_id long, chat_id long, ts double, is_from_me boolean, handle string, text string, has_attachment boolean"
ATTACHED = "msg_id long, attachment_id long, filename string"


def jpeg(lat, lon, end="<"):
    """A JPEG with nothing but a block of positions."""
    gps = [(1, 2, 2, b"S\0\0\0" if lat < 0 else b"N\0\0\0"), (2, 5, 3, struct.pack(end + "I", 80)), (3, 2, 2, b"W\0\0\0" if lon < 0 else b"E\0\0\0"), (4, 5, 3, struct.pack(end + "I", 104))]
    triple = lambda x: struct.pack(end + "6I", int(abs(x)), 1, int(abs(x) % 1 * 60), 1, round(abs(x) * 60 % 1 * 60 * 1000), 1000)
    tiff = (b"II" if end == "<" else b"MM") + struct.pack(end + "HIHHHIII", 42, 8, 1, 0x8825, 4, 1, 26, 0)
    tiff += struct.pack(end + "H", 4) + b"".join(struct.pack(end + "HHI", *e[:3]) + e[3] for e in gps) + struct.pack(end + "I", 0) + triple(lat) + triple(lon)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"


@pytest.mark.parametrize("end", ["<", ">"])
def test_three_outcomes(end):
    outcome, lat, lon = image_position(jpeg(-33.87, 151.21, end))
    assert outcome == "ok" and abs(lat + 33.87) < 1e-5 and abs(lon - 151.21) < 1e-5
    assert image_position(b"\xff\xd8\xff\xd9")[0] == "no-gps"
    assert image_position(b"\x89PNG\r\n\x1a\n" + bytes(40))[0] == "no-gps"
    assert image_position(jpeg(10, 20, end)[:60])[0] == "no-gps"  # cut off inside the block
    assert image_position(jpeg(95.0, 20.0, end))[0] == "no-gps"  # no place on earth
    assert {image_position(x)[0] for x in (None, b"", b"plain text", b"\0" * 100)} == {"failed"}


def test_files_are_opened_once_and_by_name(spark, tmp_path):
    (tmp_path / "a b%.jpg").write_bytes(jpeg(38.7, -9.1))
    (tmp_path / "n.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    rows = [(1, 1, "~/a b%.jpg"), (2, 1, "~/a b%.jpg"), (1, 2, f"{tmp_path}/n.png"), (1, 3, "~/gone.jpg"), (1, 4, None), (1, 5, " "), (1, 6, "~/a b%.jpg"), (1, 7, str(tmp_path))]
    asked = pending(spark.createDataFrame(rows, ATTACHED), spark.createDataFrame([(6, None)], "attachment_id long, place string"), str(tmp_path))
    assert {r.attachment_id: r.outcome for r in look_at(asked).collect()} == {1: "ok", 2: "no-gps", 3: "failed", 7: "failed"} and asked.count() == 4


def test_words_of_attachments(spark):
    a = spark.createDataFrame([(1, 2, "b.jpg"), (1, 1, " "), (2, 3, None), (2, 1, "x")], ATTACHED)
    got = attachment_words(a, spark.createDataFrame([(1, "Lisbon"), (2, None)], "attachment_id long, place string"))
    assert {r.msg_id: r.files for r in got.collect()} == {1: ["Lisbon", "b.jpg"], 2: ["Lisbon", "x"]}


def test_a_failed_image_is_tried_again(spark, tmp_path):
    root, home = str(tmp_path / "i"), tmp_path / "home"
    home.mkdir()
    (home / "beach.jpg").write_bytes(jpeg(38.7, -9.1))
    (home / "flat.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    m = spark.createDataFrame([(i, i % 3, 1_700_000_000.0 + i * 50_000, True, None, f"look {i}", i < 6) for i in range(9)], MESSAGES)
    a = spark.createDataFrame([(0, 10, "~/beach.jpg"), (1, 11, "~/late.jpg"), (2, 12, "~/flat.png"), (3, 13, "~/never.jpg"), (4, 10, "~/beach.jpg")], ATTACHED)
    more = {"attachments": a, "gazetteer": spark.createDataFrame(GAZETTEER, "lat double, lon double, city string, admin string, country_code string"), "home": str(home)}
    table = lambda name: {r.attachment_id: r[1] for r in IndexStore(spark, root).read(name).collect()}
    window = lambda i: IndexStore(spark, root).read("chunk_message").filter(F.col("msg_id") == i).first().chunk_id

    build_index(spark, m, root, **more)
    assert table("attachment_place") == {10: "Lisbon Lisboa Portugal", 12: None}
    assert table("attachment_retry") == {11: window(1), 13: window(3)}
    find = lambda words: {x for r in Engine(spark, IndexStore(spark, root), m).search(ParsedQuery(words, None, None), 0, 8).select("payload").collect() for x in ("look 0", "look 1", "look 4") if x in r.payload}
    assert find("lisbon") >= {"look 0", "look 4"}

    first = IndexStore(spark, root).snapshot()
    (home / "beach.jpg").unlink()  # known places don't need the file
    (home / "late.jpg").write_bytes(jpeg(-33.9, 151.2))
    build_index(spark, m, root, **more)
    assert table("attachment_place") == {10: "Lisbon Lisboa Portugal", 11: "Sydney NSW Australia", 12: None}
    assert table("attachment_retry") == {13: window(3)}
    then = IndexStore(spark, root).snapshot()
    assert then.segments[0] == first.segments[0] and then.segments[1]["rows"] == 1  # only the window with the image is written
    body = {r.chunk_id: r.body_lexical for r in then.read("chunks").collect()}
    assert body[window(1)] == "look 1 [attachment Sydney NSW Australia ~/late.jpg]"
    assert "look 1" in find("sydney")

    build_index(spark, m, root, **more)  # nothing new
    assert IndexStore(spark, root).snapshot().segments == then.segments and table("attachment_retry") == {13: window(3)}
