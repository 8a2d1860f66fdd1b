import pytest
from pyspark.sql import functions as F

from convolens.functions import text as T
from convolens.functions.blobs import decode_rich_text, exif_position
from convolens.functions.names import fold_name, osa_at_most_one, osa_distance, porter_stem, weighted_ratio


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_times(spark):
    assert one(spark, T.unix_seconds(F.lit(700_000_000).cast("long"))) == 1678307200
    assert one(spark, T.unix_seconds(F.lit(700_000_000_500_000_000).cast("long"))) == pytest.approx(1678307200.5)


@pytest.mark.parametrize(
    "text,expected",
    [("see https://www.example.org/a?b=1 now", "see [link:example.org] now"), ("HTTP://Sub.Host.io", "[link:Sub.Host.io]"), ("none", "none")],
)
def test_urls(spark, text, expected):
    assert one(spark, T.collapse_urls(F.col("t")), t=text) == expected


def test_placeholder(spark):
    assert one(spark, T.strip_placeholder(F.col("t")), t=" ￼  hello ￼\n") == "hello"


def test_redaction(spark):
    assert one(spark, T.redact(F.col("t")), t="mail a.b+c@x-y.co.uk or +1 (555) 123-4567") == "mail [email] or [phone]"


def test_middle_drop(spark):
    assert one(spark, T.middle_drop(F.split("t", " "), 5), t="1 2 3 4 5 6 7 8") == ["1", "2", "6", "7", "8"]
    assert one(spark, T.middle_drop(F.split("t", " "), 8), t="1 2 3") == ["1", "2", "3"]


def test_terms_and_scores(spark):
    assert sorted(one(spark, T.query_terms(F.col("t")), t="What did the Cat's owner say, a cat?")) == ["cat", "cat's", "owner", "say"]
    assert one(spark, T.match_score(F.col("t"), F.array(F.lit("cat"), F.lit("dog"))), t="Dog and CAT and cat") == 2


def test_signals(spark):
    s = T.regex_signals(F.lit("Then Anna met Bob. Carl went. [link:x.org] 7 extraordinarilylong"))
    got = {k: one(spark, v) for k, v in s.items()}
    assert got == {"entity_count": 2, "has_url": 1, "has_number": 1, "has_long_token": 1, "token_count": 11}


@pytest.mark.parametrize("mime,uti,sticker,label", [("image/gif", None, 0, "GIF"), (None, "public.heic", 0, "Photo"), ("video/mp4", None, 0, "Video"), (None, None, 1, "Sticker"), (None, "com.adobe.pdf", 0, "PDF"), (None, None, 0, "Attachment"), ("audio/amr", None, 0, "Audio message"), ("text/vcard", "", None, "Contact card")])
def test_attachment_labels(spark, mime, uti, sticker, label):
    assert one(spark, T.attachment_label(F.lit(mime).cast("string"), F.lit(uti).cast("string"), F.lit(sticker).cast("int"))) == label


@pytest.mark.parametrize("raw,want", [("(555) 123-4567", "+15551234567"), ("1 555 123 4567", "+15551234567"), ("+44 20 7183 8750", "+442071838750"), ("A@B.org", "a@b.org"), ("123", "123")])
def test_e164(spark, raw, want):
    assert one(spark, T.e164(F.lit(raw))) == want


def test_degrees(spark):
    assert one(spark, T.dms_to_decimal(F.lit(40.0), F.lit(30.0), F.lit(36.0), F.lit("s"))) == pytest.approx(-40.51)


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("happy", "happi"), ("adoption", "adopt"), ("sky", "sky"), ("agreed", "agre"), ("is", "is")])
def test_stems(word, stem):
    assert porter_stem(word) == stem


def test_names(spark):
    assert fold_name("  José  O'Neil-Álvarez ") == "jose o neil alvarez"
    for a, b in (("kaay", "kaya"), ("kaya", "kaya"), ("kaya", "kay"), ("kaya", "maya")):
        assert osa_distance(a, b) <= 1 and one(spark, osa_at_most_one(F.lit(a), F.lit(b)))
    assert osa_distance("kaya", "yaka") == 2 and not one(spark, osa_at_most_one(F.lit("kaya"), F.lit("yaka")))
    assert weighted_ratio("Sam Lee", "lee sam") == 95.0 and weighted_ratio("Sam Lee", "Sam Lee") == 100.0 and weighted_ratio("abc", "xyz") == 0


def test_blobs():
    body = "héllo".encode()
    blob = b"\x04\x0bstreamtyped\x81\xe8\x03NSString\x01\x94\x84\x01+" + bytes([len(body)]) + body + b"\x86"
    assert decode_rich_text(blob) == "héllo"
    assert decode_rich_text(b"junk") is None and decode_rich_text(None) is None
    long = ("y" * 300).encode()
    assert decode_rich_text(b"NSString+\x81" + len(long).to_bytes(2, "little") + long) == "y" * 300
    import struct

    gps = struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, b"N\0\0\0") + struct.pack("<HHII", 2, 5, 3, 80) + struct.pack("<HHI4s", 3, 2, 2, b"W\0\0\0") + struct.pack("<HHII", 4, 5, 3, 104) + b"\0" * 4
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8825, 4, 1, 26) + b"\0" * 4 + gps
    tiff += struct.pack("<6I", 40, 1, 30, 1, 0, 1) + struct.pack("<6I", 8, 1, 15, 1, 0, 1)
    assert exif_position(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + tiff) == pytest.approx((40.5, -8.25))
    assert exif_position(b"nothing") is None and exif_position(tiff[:20]) is None


def test_accents_are_folded_alike_on_both_sides(spark):
    from convolens.operators import lexical

    docs = spark.createDataFrame([(1, "Škoda Łódź"), (2, "Ângström ǆ"), (3, "plain"), (4, "Řéka")], "id long, t string")
    index, stats = lexical.postings(docs, "id", "t"), lexical.doc_stats(docs, "id", "t")
    for word, found in (("Škoda", {1}), ("skoda", {1}), ("łódź", {1}), ("angstrom", {2}), ("řéka", {4}), ("PLAIN", {3})):
        assert {r.id for r in lexical.bm25(index, stats, lexical.parse_terms(word), "id").collect()} == found
