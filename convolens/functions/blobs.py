"""Binary inputs: rich-text blobs and image positions."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def decode_rich_text(blob: bytes | None) -> str | None:
    """The text of a serialised attributed string: the first counted byte run after the string class, as UTF-8; None if there is none."""
    if not blob:
        return None
    at = max((blob.find(name) + len(name) for name in (b"NSString", b"NSMutableString") if name in blob), default=-1)
    if at < 0 or (plus := blob.find(b"+", at)) < 0 or plus + 1 >= len(blob):
        return None
    n, at = blob[plus + 1], plus + 2
    if n == 0x81:
        n, at = int.from_bytes(blob[at : at + 2], "little"), at + 2
    elif n == 0x82:
        n, at = int.from_bytes(blob[at : at + 4], "little"), at + 4
    return blob[at : at + n].decode("utf-8", "replace") or None if 0 < n <= len(blob) - at else None


def exif_position(data: bytes | None) -> tuple[float, float] | None:
    """(latitude, longitude) from the GPS block of a JPEG or TIFF, by the public format; None without one."""
    if not data:
        return None
    try:
        at = data.find(b"Exif\x00\x00")
        tiff = data[at + 6 :] if at >= 0 else data
        end = {b"II": "<", b"MM": ">"}[tiff[:2]]

        def entries(offset: int) -> dict[int, tuple[int, int, bytes]]:
            (n,) = struct.unpack_from(end + "H", tiff, offset)
            out = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(end + "HHI", tiff, offset + 2 + 12 * i)
                out[tag] = (kind, count, tiff[offset + 10 + 12 * i : offset + 14 + 12 * i])
            return out

        (first,) = struct.unpack_from(end + "I", tiff, 4)
        gps = entries(struct.unpack(end + "I", entries(first)[0x8825][2])[0])

        def degrees(tag: int, ref: int) -> float:
            (where,) = struct.unpack(end + "I", gps[tag][2])
            v = struct.unpack_from(end + "6I", tiff, where)
            d = v[0] / v[1] + v[2] / v[3] / 60 + v[4] / v[5] / 3600
            return -d if gps[ref][2][:1] in (b"S", b"W") else d

        return degrees(2, 1), degrees(4, 3)
    except (KeyError, struct.error, ZeroDivisionError):
        return None


@F.pandas_udf(StringType())
def decode_rich_text_udf(s: pd.Series) -> pd.Series:
    return s.map(decode_rich_text)
