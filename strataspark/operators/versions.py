"""Which of several copies or versions is current: arg-max with a stated tie-break, always an aggregate with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_copy(copies: DataFrame, keys: list[str], rank: list[Column], carry: list[str]) -> DataFrame:
    """(keys, carry) of the row with the lexicographically largest rank; the rank's last part should be unique."""
    ranked = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(rank)))
    return copies.groupBy(*keys).agg(F.max(F.struct(ranked.alias("_rank"), *carry)).alias("_best")).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in carry))


def latest_versions(entries: DataFrame, keys: list[str], version: str, target: str, carry: list[str], tombstones: bool = False) -> DataFrame:
    """The newest entry per key. A deletion has target 0: by default deletions are dropped before ranking, so an older
    target comes back; with ``tombstones`` they are ranked too and then dropped."""
    seen = entries if tombstones else entries.filter(F.col(target) != 0)
    return best_copy(seen, keys, [F.col(version)], [version, target, *carry]).filter(F.col(target) != 0)


def single_kind(kinds: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, method): none, the one kind, or Mixed."""
    low, high = F.min(kind), F.max(kind)
    return kinds.groupBy(*keys).agg(F.when(low.isNull(), "None").when(low == high, low).otherwise("Mixed").alias("method"))


def newest_valid(copies: DataFrame, keys: list[str], version: str, valid: str, carry: list[str]) -> DataFrame:
    """(keys, carry, versions): the newest copy that is valid, and all versions seen, newest first, those of invalid copies
    included. Copies without a version cannot be listed."""
    best = F.max(F.when(F.col(valid), F.struct(F.col(version).alias("_v"), *carry))).alias("_best")
    found = copies.groupBy(*keys).agg(best, F.sort_array(F.collect_set(version), asc=False).alias("versions"))
    return found.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in carry), "versions")


#: Name spaces in the order in which their names are preferred.
NAME_SPACES = {1: 0, 3: 0, 0: 1, 2: 2}


def preferred_names(names: DataFrame, keys: list[str], space: str, ordinal: str, name: str) -> DataFrame:
    """(keys, name): the name in the preferred name space; of equals the first."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in NAME_SPACES.items() for x in kv)), F.col(space).cast("int")), F.lit(9))
    return names.groupBy(*keys).agg(F.min_by(name, F.struct(rank.alias("_r"), ordinal)).alias(name))


def first_that_parses(blocks: DataFrame, keys: list[str], ordinal: str, offset: str, parses: str, carry: list[str]) -> DataFrame:
    """(keys, carry) of the first block with an offset that parses."""
    good = F.min(F.when((F.col(offset) != 0) & F.col(parses), F.struct(F.col(ordinal).alias("_o"), *carry))).alias("_first")
    return blocks.groupBy(*keys).agg(good).filter("_first IS NOT NULL").select(*keys, *(F.col(f"_first.{c}").alias(c) for c in carry))


def active_snapshots(snapshots: DataFrame, depths: DataFrame, keys: list[str], node: str, parent: str) -> DataFrame:
    """(keys, active, ambiguous): of the snapshots that are no other's parent the deepest; two equally deep ones are
    ambiguous, and then there is none. ``depths`` has (node, depth), as ``ancestors_doubled`` gives it."""
    parents = snapshots.filter(F.col(parent).isNotNull()).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(parent).alias("_parent")).distinct()
    is_parent = F.col(node) == F.col("_parent")
    for k in keys:
        is_parent = is_parent & (F.col(k) == F.col(f"_{k}"))
    leaves = snapshots.join(parents, is_parent, "left_anti").join(depths.select(node, "depth"), node)
    deepest = leaves.groupBy(*keys, "depth").agg(F.count("*").alias("_n"), F.min(node).alias("_node")).groupBy(*keys).agg(F.max(F.struct("depth", "_n", "_node")).alias("_d"))
    return deepest.select(*keys, F.when(F.col("_d._n") == 1, F.col("_d._node")).alias("active"), (F.col("_d._n") > 1).alias("ambiguous"))
