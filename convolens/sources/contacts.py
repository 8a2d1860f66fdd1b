"""Contacts and places: dimension tables that are resolved at read time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.functions import text as T
from convolens.functions.names import fold_name_udf
from convolens.sources.phones import normalised

# Names of countries by code; others show their code.
COUNTRIES = {
    "US": "United States", "GB": "United Kingdom", "CA": "Canada", "PT": "Portugal", "ES": "Spain", "FR": "France", "IT": "Italy", "DE": "Germany",
    "MX": "Mexico", "JP": "Japan", "AU": "Australia", "NL": "Netherlands", "IE": "Ireland", "CH": "Switzerland", "BR": "Brazil",
}


def normalise_contacts(raw: DataFrame, region: str | None = None) -> DataFrame:
    """``raw``: identifier, nickname, given, family, handles. The nickname or the full name shows; nameless rows go.

    With a ``region`` numbers are read by its numbering plan and must be valid; without one by their number of digits.
    """
    full = F.trim(F.concat_ws(" ", "given", "family"))
    name = F.coalesce(F.when(F.trim("nickname") != "", F.trim("nickname")), F.when(full != "", full))
    return raw.select("identifier", name.alias("display_name"), F.transform("handles", lambda h: normalised(h, F.lit(region)) if region else T.e164(h)).alias("handles")).filter("display_name is not null")


def handle_names(contacts: DataFrame) -> DataFrame:
    """(handle, display_name): the first contact by identifier that has a handle."""
    rows = contacts.select("identifier", "display_name", F.explode("handles").alias("handle"))
    return rows.groupBy("handle").agg(F.min_by("display_name", "identifier").alias("display_name"))


def fingerprint(contacts: DataFrame) -> int:
    """A hash that changes when any contact does, and not with their order."""
    return contacts.agg(F.bit_xor(F.xxhash64("identifier", "display_name", F.array_join("handles", "\x1f")))).first()[0] or 0


def exact_name(contacts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, identifier, handles): a folded full name, or a given name of three letters or more."""
    folded = contacts.withColumn("full", fold_name_udf("display_name")).withColumn("given", F.split("full", " ")[0])
    asked = names.withColumn("asked", fold_name_udf("name"))
    hit = (F.col("asked") == F.col("full")) | ((F.col("asked") == F.col("given")) & (F.length("asked") > 2))
    return asked.join(F.broadcast(folded), hit).select("name", "identifier", "handles").distinct()


def nearest_place(points: DataFrame, gazetteer: DataFrame, key: str, most_places: int = 500_000) -> DataFrame:
    """(key, place): ``City Admin Country`` of the nearest place by the great circle.

    The gazetteer is a fixed reference table; one with more than ``most_places`` rows is refused.
    A place in the nine cells of one degree around a point is taken only if it is nearer
    than their edge; every other point is compared with all places.
    """
    if gazetteer.limit(most_places + 1).count() > most_places:
        raise ValueError(f"the gazetteer has more than {most_places} places")
    rad = F.radians
    wrap = lambda lon: F.pmod(lon + 180, F.lit(360)) - 180
    g = gazetteer.select(F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"), "city", "admin", "country_code")
    g = g.withColumn("cy", F.floor("g_lat")).withColumn("cx", wrap(F.floor("g_lon")))
    at = [key, "lat", "lon"]
    asked = points.filter("lat is not null and lon is not null").select(*at).distinct()
    # to the edge: by latitude, or across the meridian at the edge; any way out of the cells is as long as one of the two
    up = F.least(F.col("lat") - F.floor("lat") + 1, F.floor("lat") + 2 - F.col("lat"))
    side = F.least(F.col("lon") - F.floor("lon") + 1, F.floor("lon") + 2 - F.col("lon"))
    edge = F.least(F.pow(F.sin(rad(up) / 2), 2), (1 - F.sqrt(1 - F.pow(F.cos(rad("lat")) * F.sin(rad(side)), 2))) / 2)
    around = asked.select(*at, edge.alias("edge"), F.explode(F.sequence(F.floor("lat") - 1, F.floor("lat") + 1)).alias("cy"), F.floor("lon").alias("c")).select("*", F.explode(F.sequence(F.col("c") - 1, F.col("c") + 1)).alias("x")).withColumn("cx", wrap(F.col("x")))
    a = F.pow(F.sin((rad("g_lat") - rad("lat")) / 2), 2) + F.cos(rad("lat")) * F.cos(rad("g_lat")) * F.pow(F.sin((rad("g_lon") - rad("lon")) / 2), 2)
    names = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    label = F.concat_ws(" ", "city", "admin", F.coalesce(names[F.col("country_code")], F.col("country_code")))
    # at the edge itself a place outside may be as near, so a hit is well inside it
    near = around.join(F.broadcast(g), ["cy", "cx"]).select(*at, label.alias("place"), a.alias("d"), "edge").filter(F.col("d") < F.col("edge") * (1 - 1e-9))
    done = near.select(*[F.col(c).alias(f"__{c}") for c in at]).distinct()
    open_points = asked.join(done, (F.col(key).eqNullSafe(F.col(f"__{key}"))) & (F.col("lat") == F.col("__lat")) & (F.col("lon") == F.col("__lon")), "left_anti")
    rest = open_points.join(F.broadcast(g)).select(key, label.alias("place"), a.alias("d"))
    return near.select(key, "place", "d").unionByName(rest).groupBy(key).agg(F.min_by("place", F.struct("d", "place")).alias("place"))
