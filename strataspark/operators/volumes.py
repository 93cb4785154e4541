"""Volume tables: roles, bounds, overlaps and containment as constraint queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.text import canonical_id
from strataspark.operators.extents import Split, following_rows


def overlapping_pairs(spans: DataFrame, key: str, span: str, exempt: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """(key, a, b): all pairs of spans of one key that overlap, a < b; touching is no overlap. Spans have start and end.

    Spans have size classes, and the buckets of a class are as wide as its longest span. Of a pair the longer one is dealt to
    the one or two buckets of its own class that it covers; the shorter is dealt, for each class of its key from its own on,
    to those of that class, at most two. So a span gives at most two rows for each class that its key has, whatever its
    length, and a pair meets in an equi-join on (key, class, bucket) and counts in the bucket where the later one starts.
    ``exempt`` gets both sides' columns and says which pairs may overlap."""
    size = F.ceil(F.log2(F.greatest(F.col("end") - F.col("start"), F.lit(1)))).cast("int")
    bucket = lambda x, c: F.floor(x / F.pow(F.lit(2.0), F.col(c))).cast("long")
    sized = spans.filter(F.col("end") > F.col("start")).withColumn("_class", size)
    spread = lambda df, c: df.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("start"), c), bucket(F.col("end") - 1, c))))
    long = spread(sized.withColumn("_at", F.col("_class")), "_at")
    classes = sized.select(F.col(key).alias("_k"), "_class").distinct().groupBy("_k").agg(F.collect_set("_class").alias("_classes"))  # at most 63 a key
    met = sized.join(classes, F.col(key) == F.col("_k")).withColumn("_at", F.explode(F.filter("_classes", lambda c: c >= F.col("_class")))).drop("_k", "_classes")
    short = spread(met, "_at")
    a, b = long.alias("a"), short.alias("b")
    later = F.floor(F.greatest("a.start", "b.start") / F.pow(F.lit(2.0), F.col("a._at"))).cast("long")
    once = (F.col("b._class") < F.col("a._class")) | (F.col(f"a.{span}") < F.col(f"b.{span}"))
    pairs = a.join(
        b,
        (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._at") == F.col("b._at")) & (F.col("a._bucket") == F.col("b._bucket")) & once & (F.col(f"a.{span}") != F.col(f"b.{span}"))
        & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.col("a._bucket") == later),
    )
    if exempt is not None:
        pairs = pairs.filter(~exempt(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")))
    return pairs.select(F.col(f"a.{key}").alias(key), F.least(f"a.{span}", f"b.{span}").alias("a"), F.greatest(f"a.{span}", f"b.{span}").alias("b"))


def partition_exempt(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Pairs of partitions that may overlap: a protective one with any, an extended one with its logical ones."""
    pair = lambda x, y: (x("role") == "Extended") & (y("role") == "Logical")
    return (a("role") == "Protective") | (b("role") == "Protective") | pair(a, b) | pair(b, a)


def out_of_bounds(spans: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """(the spans' columns, limit): spans (key, start, end) that end past their key's limit."""
    return spans.join(limits.select(key, "limit"), key).filter(F.col("end") > F.col("limit"))


def grouped_volumes(volumes: DataFrame, key: str, group: str, slot: str, role_bits: str, system: int, data: int) -> DataFrame:
    """(key, group, members, system_slot, data_slot): each group's members in slot order, and the first with either role bit."""
    first = lambda bit: F.min(F.when(F.col(role_bits).bitwiseAND(F.lit(bit)) != 0, F.col(slot)))
    return volumes.filter(F.col(group).isNotNull()).groupBy(key, group).agg(F.sort_array(F.collect_list(slot)).alias("members"), first(system).alias("system_slot"), first(data).alias("data_slot"))


def resolved_names(segments: DataFrame, physical: DataFrame, key: str, wanted: Column, own: str) -> DataFrame:
    """The segments with ``pv``: the physical volume of their key with the same id, compared by letters and digits alone, else
    the only one there is."""
    p = physical.select(F.col(key).alias("_key"), canonical_id(F.col(own)).alias("_id"), F.col(own).alias("_pv"))
    sole = p.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_pv").alias("_sole")).filter("_n = 1").select(F.col("_key").alias("_one"), "_sole")
    joined = segments.withColumn("_wanted", canonical_id(wanted)).join(p, (F.col(key) == F.col("_key")) & (F.col("_wanted") == F.col("_id")), "left").join(sole, F.col(key) == F.col("_one"), "left")
    return joined.select(*segments.columns, F.coalesce("_pv", "_sole").alias("pv"))


def overlapping_neighbours(spans: DataFrame, key: str, span: str, split: Split | None = None) -> DataFrame:
    """(key, a, b): spans that reach past the start of the next one in start order."""
    following = following_rows(spans.select(key, F.col(span).alias("a"), "start", "end"), key, ["start", "a"], {"b": "a", "next_start": "start"}, split)
    return following.filter("next_start < end").select(key, "a", "b")


def not_contained(parts: DataFrame, wholes: DataFrame, key: str) -> DataFrame:
    """The parts, with start and end, that lie inside none of their key's wholes."""
    w = wholes.select(F.col(key).alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    return parts.join(w, (F.col(key) == F.col("_key")) & (F.col("start") >= F.col("_start")) & (F.col("end") <= F.col("_end")), "left_anti")


def with_roles(volumes: DataFrame, type_code: str, roles: dict[str, str], default: str) -> DataFrame:
    """Adds ``role`` by a constant map inside the projection: no join."""
    table = F.create_map(*(F.lit(x) for pair in roles.items() for x in pair))
    return volumes.withColumn("role", F.coalesce(F.try_element_at(table, F.col(type_code)), F.lit(default)))
