"""Gazetteer tables and the resolution of free-text locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posttide import schemas
from posttide.operators.joins import lookup_join
from posttide.session import materialize


def merge_gazetteer(places: DataFrame, states: DataFrame, null_safe: bool = True) -> DataFrame:
    """Join cities to their states on country and state name.

    With `null_safe` a missing name matches a missing name. Columns both tables
    have beside the keys get the suffixes `_x` and `_y`.
    """
    keys = ["country_name", "state_name"]
    shared = (set(places.columns) & set(states.columns)) - set(keys)
    left = places.select(*[F.col(c).alias(f"{c}_x" if c in shared else c) for c in places.columns])
    right = states.select(*[F.col(c).alias(f"_{c}" if c in keys else f"{c}_y" if c in shared else c)
                            for c in states.columns])
    match = F.lit(True)
    for k in keys:
        match = match & (left[k].eqNullSafe(right[f"_{k}"]) if null_safe else left[k] == right[f"_{k}"])
    return left.join(right, match, "inner").drop(*[f"_{k}" for k in keys])


def project_gazetteer(df: DataFrame) -> DataFrame:
    """The eleven gazetteer columns in order; a missing one is an error."""
    return df.select(*schemas.GAZETTEER_COLUMNS)


def _place(city: Column, state: Column, country: Column, lat: Column, lon: Column) -> Column:
    fields = zip((city, state, country, lat, lon), schemas.PLACE_TYPE.fields)
    return F.struct(*[c.cast(f.dataType).alias(f.name) for c, f in fields])


def place_entries(gaz: DataFrame, dedupe: bool = False) -> DataFrame:
    """Every name a gazetteer row can be found under: (key, row_id, pos, place).

    Five entries per row, in this order: state code, country code, city, state
    name, country name. Keys are lower case, rows without a key are skipped.
    `dedupe` keeps the first of entries that name the same place.
    """
    none, col = F.lit(""), F.col
    city = _place(col("city_name"), col("state_name"), col("country_name"),
                  col("city_latitude"), col("city_longitude"))
    state = _place(none, col("state_name"), col("country_name"),
                   col("state_latitude"), col("state_longitude"))
    country = _place(none, none, col("country_name"),
                     col("country_latitude"), col("country_longitude"))
    named = [("state_code", state), ("country_code", country), ("city_name", city),
             ("state_name", state), ("country_name", country)]
    entries = gaz.select(
        "row_id",
        F.posexplode(F.array(*[F.struct(F.lower(col(k)).alias("key"), p.alias("place"))
                               for k, p in named])).alias("pos", "entry"),
    ).select("entry.key", "row_id", "pos", "entry.place").where(col("key").isNotNull())
    if dedupe:
        entries = (entries.groupBy("key", "place")
                   .agg(F.min(F.struct("row_id", "pos")).alias("first"))
                   .select("key", "first.row_id", "first.pos", "place"))
    return entries


def _empty_fields(place: str = "place") -> Column:
    return sum((F.when(F.col(f"{place}.{f}") == "", 1).otherwise(0)
                for f in ("city", "state", "country")), F.lit(0))


def build_place_index(gaz: DataFrame, dedupe: bool = False,
                      case_insensitive: bool = False) -> DataFrame:
    """The lookup table behind `resolve_location`.

    A key with one entry has one row with NULL `element`. A key with several has
    one row per field value (`element`) that can tell its entries apart, holding
    the best entry with that value: fewest empty fields, then gazetteer order.
    Entries are only ever aggregated per (key, element), never gathered. Write
    the index once with `session.materialize` when several jobs use it.
    """
    entries = place_entries(gaz, dedupe).withColumn("n_empty", _empty_fields())
    candidate = F.struct("n_empty", "row_id", "pos", "place")
    per_key = entries.groupBy("key").agg(F.count("*").alias("n"), F.min(candidate).alias("best"))
    single = per_key.where("n = 1").select("key", F.lit(None).cast("string").alias("element"), "best.*")
    fields = F.array_distinct(F.array("place.city", "place.state", "place.country"))
    element = F.lower(F.col("element")) if case_insensitive else F.col("element")
    by_element = (entries.select("*", F.explode(fields).alias("element"))
                  .withColumn("element", element)
                  .where(F.col("element").isNotNull())
                  .groupBy("key", "element").agg(F.min(candidate).alias("best")))
    several = by_element.join(per_key.where("n > 1").select("key"), "key", "left_semi")
    return single.unionByName(several.select("key", "element", "best.*"))


def location_tokens(c: Column) -> Column:
    """Comma-separated parts without dots and outer white space; empty parts stay."""
    edges = r"(?U)^\s+|\s+$"
    parts = F.split(c, ",", -1)
    return F.transform(parts, lambda t: F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), edges, ""))


def resolve_distinct(locations: DataFrame, index: DataFrame,
                     case_insensitive: bool = False) -> DataFrame:
    """Best place per distinct location: (location, place), resolved ones only.

    A part that is a key with a single entry gives that place. A part whose key
    has several entries needs a later part naming one of their fields. Fewest
    empty fields wins, then the earliest part, then the earliest later part,
    then gazetteer order. One join on the key serves both cases: its fan-out is
    the number of distinct field values of a key, whatever the location holds.
    """
    tokens = location_tokens(F.col("location"))
    if case_insensitive:
        tokens = F.transform(tokens, lambda t: F.lower(t))
    distinct = locations.select("location").where(F.col("location").isNotNull()).distinct()
    # Exploded as an expression: a filter on the size of a named list would move
    # below the distinct and split the location of every post. The later parts are
    # read off the location again, only where a key was found.
    parts = distinct.select("location", F.posexplode(tokens).alias("i", "key"))
    later = F.slice(tokens, F.col("i") + 2, F.greatest(F.size(tokens), F.lit(1)))
    found = lookup_join(parts, index, ["key"], "inner").withColumn(
        "j", F.when(F.col("element").isNull(), F.lit(-1)).otherwise(
            F.col("i") + F.array_position(later, F.col("element"))))
    found = found.where(F.col("element").isNull() | (F.col("j") > F.col("i")))
    best = F.min(F.struct("n_empty", "i", "j", "row_id", "pos", "place")).alias("best")
    return found.groupBy("location").agg(best).select("location", "best.place")


def resolve_location(df: DataFrame, index: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """Add `place` (NULL where the location names none) to posts with a `location`.

    Locations repeat, so only distinct ones are resolved. The result is written
    once and measured: posts are shuffled only if it is too large to broadcast.
    """
    resolved = materialize(resolve_distinct(df, index, case_insensitive), "resolved-locations")
    return lookup_join(df, resolved, ["location"])
