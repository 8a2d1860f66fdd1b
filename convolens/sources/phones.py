"""Telephone numbers by region: the country by its longest code, validity by length and first digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public numbering plans: region, country code, trunk prefix, digits of a national number at least and at most, how it may begin.
PLAN = [
    ("US", "1", "1", 10, 10, "[2-9][0-9]{2}[2-9]"), ("CA", "1", "1", 10, 10, "[2-9][0-9]{2}[2-9]"),
    ("RU", "7", "8", 10, 10, "[3489]"), ("KZ", "7", "8", 10, 10, "[67]"),
    ("EG", "20", "0", 8, 10, "[1-9]"), ("ZA", "27", "0", 9, 9, "[1-8]"), ("GR", "30", "", 10, 10, "[2-9]"),
    ("NL", "31", "0", 9, 9, "[1-9]"), ("BE", "32", "0", 8, 9, "[1-9]"), ("FR", "33", "0", 9, 9, "[1-9]"),
    ("ES", "34", "", 9, 9, "[5-9]"), ("HU", "36", "06", 8, 9, "[1-9]"), ("IT", "39", "", 6, 11, "[0138]"),
    ("RO", "40", "0", 9, 9, "[2378]"), ("CH", "41", "0", 9, 9, "[2-9]"), ("AT", "43", "0", 7, 13, "[1-9]"),
    ("GB", "44", "0", 9, 10, "[1-9]"), ("DK", "45", "", 8, 8, "[2-9]"), ("SE", "46", "0", 7, 9, "[1-9]"),
    ("NO", "47", "", 8, 8, "[2-9]"), ("PL", "48", "", 9, 9, "[1-9]"), ("DE", "49", "0", 7, 11, "[1-9]"),
    ("PE", "51", "0", 8, 9, "[1-9]"), ("MX", "52", "", 10, 10, "[2-9]"), ("AR", "54", "0", 10, 11, "[1-9]"),
    ("BR", "55", "0", 10, 11, "[1-9][1-9]"), ("CL", "56", "", 9, 9, "[2-9]"), ("CO", "57", "", 10, 10, "[36]"),
    ("AU", "61", "0", 9, 9, "[2-478]"), ("ID", "62", "0", 8, 12, "[2-9]"), ("NZ", "64", "0", 8, 10, "[2-9]"),
    ("JP", "81", "0", 9, 10, "[1-9]"), ("KR", "82", "0", 8, 10, "[1-9]"), ("VN", "84", "0", 9, 10, "[2-9]"),
    ("CN", "86", "0", 10, 11, "[1-9]"), ("TR", "90", "0", 10, 10, "[2-5]"), ("IN", "91", "0", 10, 10, "[1-9]"), ("IR", "98", "0", 10, 10, "[1-9]"),
    ("MA", "212", "0", 9, 9, "[5-8]"), ("DZ", "213", "0", 8, 9, "[1-9]"), ("ET", "251", "0", 9, 9, "[1-9]"), ("KE", "254", "0", 9, 9, "[1-7]"), ("MZ", "258", "", 8, 9, "[28]"),
    ("PT", "351", "", 9, 9, "[2-9]"), ("IE", "353", "0", 7, 9, "[1-9]"), ("FI", "358", "0", 5, 10, "[1-9]"), ("UA", "380", "0", 9, 9, "[3-9]"), ("CZ", "420", "", 9, 9, "[2-9]"),
    ("JO", "962", "0", 8, 9, "[2-9]"), ("IQ", "964", "0", 8, 10, "[1-9]"), ("SA", "966", "0", 9, 9, "[1-9]"), ("AE", "971", "0", 8, 9, "[2-9]"), ("IL", "972", "0", 8, 9, "[2-9]"),
]
# What is dialled before a country code, where it is not 00.
ABROAD = {"US": "011", "CA": "011", "AU": "0011", "JP": "010", "RU": "810", "KZ": "810"}
MOST = 15


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _patterns() -> dict[str, str]:
    """A whole national number, by country code; regions of one code share it."""
    each: dict[str, list[str]] = {}
    for _, code, _, least, most, first in PLAN:
        each.setdefault(code, []).append(f"(?=[0-9]{{{least},{most}}}$){first}[0-9]*")
    return {code: "^(?:" + "|".join(dict.fromkeys(ps)) + ")$" for code, ps in each.items()}


def international(digits: Column) -> Column:
    """``+digits`` if they begin with a known country code, the longest one of three digits at most, and what follows is a number there; else null."""
    rules = _map(_patterns())
    fits = lambda n: F.when(digits.rlike("^[0-9]+$") & (F.length(digits) <= MOST), F.regexp_like(F.substring(digits, n + 1, MOST), rules[F.substring(digits, 1, n)]))
    known = lambda n: rules[F.substring(digits, 1, n)].isNotNull()
    ok = F.when(known(3), fits(3)).when(known(2), fits(2)).when(known(1), fits(1))
    return F.when(ok, F.concat(F.lit("+"), digits))


def normalised(raw: Column, region: Column) -> Column:
    """A handle in one form: an address in lower case, a valid number in E.164 form, anything else trimmed only; null stays null.

    ``region``: where numbers without a country code belong (upper case; null or one without a plan:
    only numbers with a code are read). A trunk prefix may be there or not, and a country code may be
    there without its sign if the number is valid in no other way.
    """
    raw = F.trim(raw)
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    codes, trunks = _map({r: c for r, c, *_ in PLAN}), _map({r: t for r, _, t, *_ in PLAN})
    abroad = F.when(codes[region].isNotNull(), F.coalesce(_map(ABROAD)[region], F.lit("00")))
    code, trunk = codes[region], trunks[region]
    after = lambda prefix: F.when(F.startswith(digits, prefix), F.substr(digits, F.length(prefix) + 1))
    signed = F.when(raw.rlike(r"^\(?\+"), F.lit(True)).otherwise(F.lit(False))
    national = F.when(trunk != "", after(trunk))
    tries = [international(F.concat(code, national)), international(F.concat(code, digits)), international(after(abroad)), international(F.when(F.startswith(digits, code), digits))]
    number = F.when(raw.rlike("[A-Za-z]"), None).when(signed, international(digits)).otherwise(F.coalesce(*tries))
    return F.when(raw.contains("@"), F.lower(raw)).otherwise(F.coalesce(number, raw))
