"""Text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds between 1970 and 2001, and the size from which a source time is in nanoseconds.
EPOCH_2001, NANOSECONDS_FROM = 978_307_200, 100_000_000_000

# Words too common to mark a message as matching, to compare questions by, and the words for media.
TERM_STOPWORDS = """a an and are as at be but by can did do does for from had has have he her him his
    how i if in into is it its me my no not of on or our so that the their them then there
    these they this to up was we were what when where which who will with would you your""".split()
OVERLAP_STOPWORDS = """the a an and or but is are was were be been to of in on at for with about we us i you
    did do does what where when who how that this it our their them he she his her me""".split()
MEDIA_WORDS = "photo photos picture pictures pic pics video videos screenshot screenshots image images".split()


def unix_seconds(v: Column) -> Column:
    """Seconds or nanoseconds since 2001, told apart by size, as unix seconds."""
    return F.when(v > NANOSECONDS_FROM, v / F.lit(1e9)).otherwise(v.cast("double")) + F.lit(EPOCH_2001)


def token_count(t: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(t, F.lit(r"\S+"))


def strip_placeholder(t: Column) -> Column:
    """Without object-replacement characters and what blank follows them, and trimmed."""
    return F.regexp_replace(F.regexp_replace(t, "￼\\s*", ""), r"^\s+|\s+$", "")


def collapse_urls(t: Column) -> Column:
    """URLs to ``[link:host]``, or ``[link:link]`` where no host follows."""
    hosts = F.regexp_replace(t, r"(?i)https?://(?:www\.)?([^/\s]+)\S*", r"[link:$1]")
    return F.regexp_replace(hosts, r"(?i)https?://\S+", "[link:link]")


# What counts as an e-mail address and as a telephone number.
EMAIL, PHONE = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+", r"\+?\d[\d\-\s().]{7,}\d"


def redact(t: Column) -> Column:
    """E-mail addresses, then telephone numbers, to placeholders."""
    return F.regexp_replace(F.regexp_replace(t, EMAIL, "[email]"), PHONE, "[phone]")


def middle_drop(tokens: Column, most: int) -> Column:
    """The first and last tokens, ``most`` in all, of a longer array."""
    head = most // 2
    return F.when(F.size(tokens) <= most, tokens).otherwise(F.concat(F.slice(tokens, 1, head), F.slice(tokens, F.size(tokens) - (most - head) + 1, most - head)))


def words(t: Column) -> Column:
    """Lower-case runs of word characters and apostrophes."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"(?U)[\w']+"), F.lit(0))


def query_terms(t: Column) -> Column:
    """Distinct words of a query that can mark a message."""
    kept = F.filter(words(F.coalesce(t, F.lit(""))), lambda w: ~w.isin(TERM_STOPWORDS) & (F.length(w) > 1))
    return F.array_distinct(kept)


def match_score(t: Column, terms: Column) -> Column:
    """How many of the terms a message has."""
    return F.coalesce(F.size(F.array_intersect(words(t), terms)), F.lit(0))


# What is counted in a chunk, or only looked for.
SIGNALS = {
    "entity_count": (r"(?U)(?<!^)(?<![.!?]\s)\b[A-Z][a-z]+\b", "count"),
    "has_url": (r"\[link:", "any"),
    "has_number": (r"(?U)\d", "any"),
    "has_long_token": (r"(?U)\b\w{15,}\b", "any"),
    "token_count": (r"(?U)\w+", "count"),
}


def regex_signals(t: Column) -> dict[str, Column]:
    """What makes a chunk worth a question: capitalised names inside sentences, links, numbers, long words, length."""
    return {name: F.regexp_count(t, F.lit(p)) if how == "count" else t.rlike(p).cast("int") for name, (p, how) in SIGNALS.items()}


def content_words(t: Column) -> Column:
    found = F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(OVERLAP_STOPWORDS) & (F.length(w) > 2)))


def vocabulary_overlap(question: Column, source: Column) -> Column:
    """Share of a question's content words that its source has; 0 without any."""
    q = content_words(question)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, content_words(source))) / F.size(q))


def _plain_letters() -> dict[int, str]:
    """Letters with marks in one code point, by the Unicode decomposition, to the letter alone."""
    bare = {c: "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x)[0] != "M") for c in range(0xC0, 0x2000)}
    return {c: x for c, x in bare.items() if len(x) == 1 and x != chr(c)}


PLAIN_LETTERS = _plain_letters()


def plain_terms(text: str) -> list[str]:
    """On the driver what ``index_terms`` is on a column: the two must agree, or a word is never found."""
    bare = "".join(c for c in text.lower().translate(PLAIN_LETTERS) if unicodedata.category(c)[0] != "M")
    return [w for w in re.split(r"[\W_]+", bare) if w]


def index_terms(t: Column) -> Column:
    """Terms of the inverted index, before stemming: lower case, without marks on letters, cut at anything but letters and digits."""
    plain = F.translate(F.lower(t), "".join(map(chr, PLAIN_LETTERS)), "".join(PLAIN_LETTERS.values()))
    return F.filter(F.split(F.regexp_replace(plain, r"\p{M}+", ""), r"[^\p{L}\p{N}]+"), lambda w: w != "")


# Labels of attachments, each with the types that it is for: whole media types, beginnings of media types,
# whole uniform type names, their beginnings, and parts of them. The first label that fits counts.
ATTACHMENTS = {
    "GIF": (("image/gif",), (), (), (), ("gif",)),
    "Photo": ((), ("image/",), ("public.jpeg", "public.png"), ("public.hei",), ()),
    "Video": ((), ("video/",), (), (), ("movie", "mpeg-4")),
    "Audio message": ((), ("audio/",), (), (), ("audio",)),
    "PDF": (("application/pdf",), (), ("com.adobe.pdf",), (), ()),
    "Contact card": (("text/vcard",), (), (), (), ("vcard",)),
}


def attachment_label(mime: Column, uti: Column, is_sticker: Column) -> Column:
    """What to call an attachment, by either of two type names that may be missing."""
    m, u = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(uti, F.lit("")))
    label = F.when(F.coalesce(is_sticker.cast("int"), F.lit(0)) != 0, "Sticker")
    for name, (types, openings, names, name_openings, parts) in ATTACHMENTS.items():
        fits = m.isin(*types) | u.isin(*names)
        for test in [*map(m.startswith, openings), *map(u.startswith, name_openings), *map(u.contains, parts)]:
            fits = fits | test
        label = label.when(fits, name)
    return label.otherwise("Attachment")


def joined_label(count: Column, kinds: Column, one: Column) -> Column:
    """One label, ``n labels`` for equal ones, ``n attachments`` for mixed ones."""
    return F.when(count == 1, one).when(kinds == 1, F.concat_ws(" ", count, F.concat(F.lower(one), F.lit("s")))).otherwise(F.concat_ws(" ", count, F.lit("attachments")))


def highlight(t: Column, terms: list[str]) -> Column:
    """Terms of three characters or more in ``<mark>``."""
    long = [w for w in terms if len(w) >= 3]
    quoted = "|".join(r"\Q" + w + r"\E" for w in long)
    return F.regexp_replace(t, f"(?i)({quoted})", "<mark>$1</mark>") if long else t


def typo(name: Column) -> Column:
    """The middle two letters of a name of four or more changed round."""
    n = F.length(name)
    m = F.floor(n / 2).cast("int")
    swapped = F.concat(F.substring(name, F.lit(1), m - 1), F.substring(name, m + 1, F.lit(1)), F.substring(name, m, F.lit(1)), F.substring(name, m + 2, n))
    return F.when(n >= 4, swapped).otherwise(name)


def surface_forms(name: Column) -> Column:
    """array<struct<form, text>>: the ways in which people write a name."""
    forms = {"plain": name, "lower": F.lower(name), "upper": F.upper(name), "possessive": F.concat(name, F.lit("'s")), "punctuated": F.concat(name, F.lit("?")), "quoted": F.concat(F.lit('"'), name, F.lit('"')), "typo": typo(name)}
    return F.array(*[F.struct(F.lit(k).alias("form"), v.alias("text")) for k, v in forms.items()])


def e164(raw: Column, country: str = "1") -> Column:
    """Handles in one form: addresses in lower case, ten-digit numbers with their country, others as they are."""
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    full = (F.when(raw.startswith("+") & F.length(digits).between(8, 15), F.concat(F.lit("+"), digits))
            .when((F.length(digits) == 10), F.concat(F.lit("+" + country), digits))
            .when((F.length(digits) == 10 + len(country)) & digits.startswith(country), F.concat(F.lit("+"), digits)))
    return F.when(raw.contains("@"), F.lower(raw)).otherwise(F.coalesce(full, raw))


def dms_to_decimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    return (d + m / 60 + s / 3600) * F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1)
