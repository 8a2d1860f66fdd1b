"""What Spark has no expression for: stemming, folding and name distances, in batches."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType


def _shape(w: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _ends_cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# The suffix rules of Porter's published algorithm, steps 2, 3 and 4.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


#: The rules with the longest suffix first, as the algorithm tries them.
LONG_FIRST = [sorted((r.split(":") for r in rules.split()), key=lambda r: -len(r[0])) for rules in (STEP2, STEP3)]
LONG_STEP4 = sorted(STEP4.split(), key=lambda e: -len(e))


@lru_cache(1 << 16)
def porter_stem(w: str) -> str:
    """Porter's stemmer (1980) for a lower-case word."""
    if len(w) <= 2 or not w.isascii():
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if "v" in _shape(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _ends_cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for pairs in LONG_FIRST:
        for end, to in pairs:
            if w.endswith(end):
                w = w[: -len(end)] + to if _measure(w[: -len(end)]) else w
                break
    for end in LONG_STEP4:
        if w.endswith(end):
            stem = w[: -len(end)]
            w = stem if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")) else w
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _ends_cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def fold_name(name: str) -> str:
    """No accents, no punctuation, lower case, single blanks."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w\s]|_", " ", plain).lower().split())


def osa_distance(a: str, b: str) -> int:
    """Edits, with two neighbours changed round as one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def _indel(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / both lengths."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def _partial(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    starts = {max(0, m.b - m.a) for m in SequenceMatcher(None, short, long, False).get_matching_blocks()}
    return max((_indel(short, long[s : s + len(short)]) for s in starts), default=0.0)


def weighted_ratio(a: str, b: str) -> float:
    """0 to 100: the best of whole, partial and token-wise similarity, each with the usual weight."""
    a, b = fold_name(a), fold_name(b)
    if not a or not b:
        return 0.0
    ta, tb = sorted(a.split()), sorted(b.split())
    both, only_a, only_b = sorted({*ta} & {*tb}), sorted({*ta} - {*tb}), sorted({*tb} - {*ta})
    join = lambda *x: " ".join(" ".join(p) for p in x if p)
    set_ratio = 100.0 if both and not (only_a and only_b) else max(_indel(join(both, only_a), join(both, only_b)), _indel(join(both), join(both, only_a)) if both else 0, _indel(join(both), join(both, only_b)) if both else 0)
    token = max(_indel(" ".join(ta), " ".join(tb)), set_ratio)
    length = max(len(a), len(b)) / min(len(a), len(b))
    if length < 1.5:
        return max(_indel(a, b), 0.95 * token)
    scale = 0.9 if length < 8 else 0.6
    partial_tokens = 100.0 if both else _partial(" ".join(ta), " ".join(tb))
    return max(_indel(a, b), scale * _partial(a, b), 0.95 * scale * partial_tokens)


@F.pandas_udf(StringType())
def stem_udf(s: pd.Series) -> pd.Series:
    return s.map(porter_stem, na_action="ignore")


@F.pandas_udf(StringType())
def fold_name_udf(s: pd.Series) -> pd.Series:
    return s.map(fold_name, na_action="ignore")


@F.pandas_udf(IntegerType())
def osa_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa_distance(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(DoubleType())
def weighted_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def osa_at_most_one(a, b):
    """OSA distance of 1 at most as a Column: an edit, or one pair of neighbours changed round."""
    n = F.length(a)
    turned = (n == F.length(b)) & F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b)
    return (F.levenshtein(a, b) <= 1) | turned
