"""Extent maps: where the bytes behind logical offsets are.

Windows are partitioned by object. Where one is needed over all of an object's rows, operators take ``split``, a
non-decreasing function of the order, and then work on parts of an object: what a part needs of those before or behind it, a
sum, a maximum, a first or last row, is aggregated for each part, and only those few rows pass a window over the whole object. So an object with a third of all extents does
not end in one task. ``range_parts`` derives such a split from the rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


Split = Callable[[Column], Column]
#: Rows that a task sorts or groups where an operator states its number of partitions.
TASK_ROWS = 250_000


def _max_before(rows: DataFrame, key: str, order: list[str], value: Column, split: Split | None, name: str) -> DataFrame:
    """Adds the largest value of the rows before, in ``order``, within ``key``; null for the first."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if split is None:
        return rows.withColumn(name, F.max(value).over(before(Window.partitionBy(key).orderBy(*order))))
    cut = rows.withColumn("_part", split(F.col(order[0])))
    carried = cut.groupBy(key, "_part").agg(F.max(value).alias("_most")).select(key, "_part", F.max("_most").over(before(Window.partitionBy(key).orderBy("_part"))).alias("_carried"))
    own = cut.withColumn("_own", F.max(value).over(before(Window.partitionBy(key, "_part").orderBy(*order))))
    return own.join(carried, [key, "_part"]).withColumn(name, F.greatest("_own", "_carried")).drop("_part", "_own", "_carried")


def _placed(rows: DataFrame, parts: int | None, *by: str) -> DataFrame:
    return rows if parts is None else rows.repartition(parts, *by)


def following_rows(rows: DataFrame, key: str, order: list[str], values: dict[str, str], split: Split | None = None, parts: int | None = None) -> DataFrame:
    """Adds columns with values of the next row, in ``order``, within ``key``; nulls for the last. ``parts`` states the number
    of partitions."""
    held = F.struct(*(F.col(c).alias(name) for name, c in values.items()))
    if split is None:
        seen = _placed(rows, parts, key).withColumn("_next", F.lead(held).over(Window.partitionBy(key).orderBy(*order)))
        return seen.select(*rows.columns, *(F.col(f"_next.{n}").alias(n) for n in values))
    cut = _placed(rows.withColumn("_part", split(F.col(order[0]))), parts, key, "_part")
    firsts = cut.groupBy(key, "_part").agg(F.min_by(held, F.struct(*order)).alias("_first"))
    carried = firsts.select(key, "_part", F.lead("_first").over(Window.partitionBy(key).orderBy("_part")).alias("_carried"))
    own = cut.withColumn("_own", F.lead(held).over(Window.partitionBy(key, "_part").orderBy(*order))).join(carried, [key, "_part"])
    return own.withColumn("_next", F.coalesce("_own", "_carried")).select(*rows.columns, *(F.col(f"_next.{n}").alias(n) for n in values))


def prefix_offsets(parts: DataFrame, key: str, order: list[str], length: str, split: Column | None = None) -> DataFrame:
    """Adds ``logical_offset``: the sum of the lengths before, in ``order``, within ``key``.

    ``split``, a non-decreasing function of the order, cuts a key into parts that are summed separately: parts' totals are
    aggregated first and only those, a few per key, pass a window over the whole key.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    if split is None:
        w = before(Window.partitionBy(key).orderBy(*order))
        return parts.withColumn("logical_offset", F.coalesce(F.sum(length).over(w), zero))
    cut = parts.withColumn("_part", split)
    totals = cut.groupBy(key, "_part").agg(F.sum(length).alias("_total"))
    firsts = totals.withColumn("_first", F.coalesce(F.sum("_total").over(before(Window.partitionBy(key).orderBy("_part"))), zero)).drop("_total")
    own = before(Window.partitionBy(key, "_part").orderBy(*order))
    summed = cut.withColumn("_own", F.coalesce(F.sum(length).over(own), zero)).join(firsts, [key, "_part"])
    return summed.withColumn("logical_offset", F.col("_first") + F.col("_own")).drop("_part", "_own", "_first")


def range_parts(rows: DataFrame, order: str, rows_each: int = 1_000_000) -> Split:
    """A split for ``rows``: ranges of ``order`` with about so many rows each, from approximate quantiles; constants in the plan."""
    n = rows.count()
    parts = min(10_000, n // rows_each)
    cuts = sorted(set(rows.stat.approxQuantile(order, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    if not cuts:
        return lambda c: F.lit(0)
    # How many cuts are not above a value: the largest step first, so 10,000 cuts take 14 comparisons a row. One constant.
    known = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")

    def search(c: Column) -> Column:
        fits = lambda n: (n <= len(cuts)) & (F.get(known, n - 1) <= c)
        steps = F.array(*(F.lit(1 << i) for i in range(len(cuts).bit_length() - 1, -1, -1)))
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))

    return search


def task_parts(*tables: DataFrame) -> int:
    """How many partitions bring some ``TASK_ROWS`` rows of these tables to each task, and at least one to each core. Spark's
    own number follows compressed bytes, of which extents need few, so tasks of it grow with the input."""
    rows = sum(t.count() for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def floor_join(points: DataFrame, starts: DataFrame, key: str, at: str, start: str, carry: list[str], split: Split | None = None, parts: int | None = None) -> DataFrame:
    """Each point with the ``carry`` columns of the last start at or before it; nulls where there is none. ``parts`` states the
    number of partitions.

    One union and one window instead of a range join: rows stay linear in points plus starts. With ``split`` the window is
    over parts of a key, and each part's last start is carried to the parts behind it.
    """
    held = F.struct(F.col(start).alias("_start"), *carry)
    right = starts.select(F.col(key), F.col(start).alias("_at"), F.lit(0).alias("_side"), held.alias("_held"), *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in (key,)))
    left = points.select(F.col(key), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema["_held"].dataType).alias("_held"), *(c for c in points.columns if c not in (key,)))
    both = right.unionByName(left)
    if split is None:
        w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
        found = _placed(both, parts, key).withColumn("_last", F.last("_held", ignorenulls=True).over(w)).filter("_side = 1")
    else:
        both = _placed(both.withColumn("_part", split(F.col("_at"))), parts, key, "_part")
        last = both.groupBy(key, "_part").agg(F.max_by("_held", F.when(F.col("_side") == 0, F.col("_at"))).alias("_end"))
        before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select(key, "_part", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
        w = Window.partitionBy(key, "_part").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
        own = both.withColumn("_own", F.last("_held", ignorenulls=True).over(w)).filter("_side = 1")
        found = own.join(carried, [key, "_part"]).withColumn("_last", F.coalesce("_own", "_carried"))
    return found.select(key, *(c for c in points.columns if c != key), F.col("_last._start").alias(start), *(F.col(f"_last.{c}").alias(c) for c in carry))


def covering_extent(points: DataFrame, extents: DataFrame, key: str, at: str, carry: list[str], split: Split | None = None) -> DataFrame:
    """Floor lookup with the end checked: points past the extent found lie in a hole and get nulls."""
    found = floor_join(points, extents, key, at, "logical_offset", ["length", *carry], split)
    inside = F.col(at) < F.col("logical_offset") + F.col("length")
    return found.withColumns({c: F.when(inside, F.col(c)) for c in ["logical_offset", "length", *carry]})


def fill_holes(extents: DataFrame, sizes: DataFrame, key: str, split: Split | None = None) -> DataFrame:
    """(key, logical_offset, length, is_hole): the extents and the holes before, between and after them, up to ``size``.

    A hole is what no extent covers: extents may overlap or lie within others."""
    end = F.col("logical_offset") + F.col("length")
    runs = _max_before(extents.select(key, "logical_offset", "length"), key, ["logical_offset", "length"], end, split, "past").withColumn("past", F.coalesce("past", F.lit(0).cast("long")))
    hole = F.struct(F.col("past").alias("logical_offset"), (F.col("logical_offset") - F.col("past")).alias("length"), F.lit(True).alias("is_hole"))
    own = F.struct(F.col("logical_offset"), F.col("length"), F.lit(False).alias("is_hole"))
    body = runs.select(key, F.inline(F.filter(F.array(hole, own), lambda x: x["length"] > 0)))
    ends = extents.groupBy(key).agg(F.max(end).alias("covered"))
    tail = sizes.join(ends, key, "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long"))).filter("size > covered")
    return body.unionByName(tail.select(key, F.col("covered").alias("logical_offset"), (F.col("size") - F.col("covered")).alias("length"), F.lit(True).alias("is_hole")))


def coalesce_runs(blocks: DataFrame, keys: list[str], block: str, split: Split | None = None) -> DataFrame:
    """(keys, first_block, n_blocks): consecutive blocks as one run, by gaps and islands.

    Copies of a block meet by the input partition they are in, so a block with many is not read by one task. With ``split``
    runs are made in parts of an object: only the first and the last of each part, which may go on in the parts beside it,
    pass a window over the whole object."""
    parts = task_parts(blocks)
    copies = blocks.select(*keys, block, F.spark_partition_id().alias("_from")).repartition(parts, *keys, block, "_from").distinct()
    cut, within = (copies, keys) if split is None else (copies.withColumn("_part", split(F.col(block))), [*keys, "_part"])
    w = Window.partitionBy(*within).orderBy(block)
    so_far = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.struct(F.col(block).alias("at"))  # tells no row from a null block
    goes_on = lambda x, y: x.eqNullSafe(y) | x.eqNullSafe(y - 1)
    seen = cut.drop("_from").repartition(parts, *within).withColumns({"_before": F.lag(held).over(w), "_after": F.lead(held).over(w)})
    begins = F.col("_before").isNull() | ~goes_on(F.col("_before.at"), F.col(block))
    ends = F.col("_after").isNull() | ~goes_on(F.col(block), F.col("_after.at"))
    # One row of a run is left, its last, which knows the last begin up to it.
    runs = seen.withColumns({"_first": F.max(F.when(begins, F.col(block))).over(so_far), "_least": F.first(block).over(so_far)}).filter(ends)
    outer = F.col("_after").isNull() | F.col("_first").eqNullSafe(F.col("_least"))
    runs = runs.select(*keys, F.col("_first").alias("first_block"), F.col(block).alias("_last"), outer.alias("_outer"))
    found = lambda df: df.select(*keys, "first_block", F.coalesce((F.col("_last") - F.col("first_block") + 1).cast("long"), F.lit(1).cast("long")).alias("n_blocks"))
    if split is None:
        return found(runs)
    outer = runs.filter("_outer").drop("_outer").repartition(parts, *keys)
    w = Window.partitionBy(*keys).orderBy("first_block")
    begins = F.when(F.lag("_last").over(w) + 1 == F.col("first_block"), 0).otherwise(1)
    joined = outer.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy(*keys, "_run").agg(F.min("first_block").alias("first_block"), F.max("_last").alias("_last"))
    return found(runs.filter("NOT _outer")).unionByName(found(joined))


def block_address(offset: Column, block_size: int, entries: int) -> dict[str, Column]:
    """Direct and two-level table indexes of an offset: arithmetic only, so joins on them are equi-joins."""
    block = F.floor(offset / block_size).cast("long")
    return {"block": block, "within": offset % block_size, "level1": F.floor(block / entries).cast("long"), "level2": block % entries}


def interleaved_slot(block: Column, ratio: int) -> Column:
    """The slot of a payload block where every ``ratio`` blocks are followed by one bitmap slot."""
    return F.floor(block / ratio).cast("long") * (ratio + 1) + block % ratio


def layered_read(layers: DataFrame, keys: list[str], layer: str, state: str, value: str, ties: list[str]) -> DataFrame:
    """(keys, layer, value): the topmost layer whose state is not ``absent``; an explicit ``zero`` masks what lies below.
    Keys with absent rows only read zero from no layer. An aggregate with map-side combine, not a window."""
    present = F.col(state) != "absent"
    top = F.min(F.when(present, F.struct(F.col(layer), *ties, F.when(F.col(state) == "zero", F.lit(0).cast("long")).otherwise(F.col(value)).alias("value"))))
    return layers.groupBy(*keys).agg(top.alias("_top")).select(*keys, F.col(f"_top.{layer}").alias(layer), F.coalesce("_top.value", F.lit(0).cast("long")).alias("value"))


def stripe_map(objects: DataFrame, key: str, size: str, chunk: int, stripes: int) -> DataFrame:
    """(key, chunk_index, stripe, row, length): chunk i goes to stripe i mod n, row i div n; the last chunk may be short."""
    count = F.ceil(F.col(size) / chunk).cast("long")
    index = F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("chunk_index")
    rows = objects.filter(F.col(size) > 0).select(key, F.col(size).alias("_size"), index)
    return rows.select(
        key, "chunk_index", (F.col("chunk_index") % stripes).alias("stripe"), F.floor(F.col("chunk_index") / stripes).cast("long").alias("row"),
        F.least(F.lit(chunk).cast("long"), F.col("_size") - F.col("chunk_index") * chunk).alias("length"),
    )


def last_writer(patches: DataFrame, keys: list[str], sequence: str, value: str) -> DataFrame:
    """(keys, sequence, value) of the patch with the largest sequence: an aggregate, whatever the number of patches."""
    return patches.groupBy(*keys).agg(F.max(F.struct(sequence, value)).alias("_last")).select(*keys, "_last.*")


def stored_sizes(chunks: DataFrame, key: str, order: list[str], offset: str, end: str, split: Split | None = None) -> DataFrame:
    """Adds ``stored_size``: the next chunk's offset, or the data's end for the last, minus this one's."""
    placed = following_rows(chunks, key, order, {"_offset": offset}, split)
    return placed.withColumn("stored_size", F.coalesce("_offset", F.col(end)) - F.col(offset)).drop("_offset")


def split_text(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, offset, piece): the text in pieces of ``size`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return df.select(key, F.col(text).alias("_text"), F.explode(starts).alias("offset")).select(key, "offset", F.substring("_text", F.col("offset") + 1, F.lit(size)).alias("piece"))


def join_pieces(pieces: DataFrame, key: str, name: str) -> DataFrame:
    """The pieces of each key in offset order as one text. A key's pieces are one text, so a row bounds the group."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("offset", "piece"))), lambda x: x["piece"])
    return pieces.groupBy(key).agg(F.array_join(ordered, "").alias(name))


def overlap_errors(extents: DataFrame, key: str, split: Split | None = None) -> DataFrame:
    """(key, logical_offset, length, reaches): the extents that start before an earlier one of their object ends; a map that
    must not overlap has none."""
    seen = _max_before(extents.select(key, "logical_offset", "length"), key, ["logical_offset", "length"], F.col("logical_offset") + F.col("length"), split, "reaches")
    return seen.filter(F.col("logical_offset") < F.col("reaches"))


def normal_extents(extents: DataFrame, sizes: DataFrame, key: str, block: int, split: Split | None = None) -> DataFrame:
    """(key, logical_offset, length, is_hole) with a trailing hole up to the size rounded up to whole blocks."""
    rounded = sizes.select(key, (F.ceil(F.col("size") / block) * block).cast("long").alias("size"))
    return fill_holes(extents, rounded, key, split)


def first_covering(points: DataFrame, extents: DataFrame, key: str, at: str, ordinal: str, carry: list[str]) -> DataFrame:
    """The points with ``carry`` of the extent that covers them; of several, as extents may overlap, the one with the least
    ordinal. Nulls in a hole.

    Extents are dealt to buckets by size class: one of length n covers at most two buckets of its class's width, so a point
    meets, in an equi-join on (key, class, bucket), only extents not much longer than its distance to them."""
    level = lambda n: F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int")
    bucket = lambda x, c: F.floor(x / F.pow(F.lit(2.0), c)).cast("long")
    e = extents.filter("length > 0").select(F.col(key).alias("_key"), F.col("logical_offset").alias("_from"), (F.col("logical_offset") + F.col("length")).alias("_to"), F.struct(ordinal, *carry).alias("_held"), level(F.col("length")).alias("_class"))
    e = e.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_from"), F.col("_class")), bucket(F.col("_to") - 1, F.col("_class")))))
    classes = e.select("_key", "_class").distinct().groupBy("_key").agg(F.collect_set("_class").alias("_classes"))  # at most 63 a key
    marked = points.withColumn("_row", F.monotonically_increasing_id())
    asked = marked.select("_row", F.col(key).alias("_k"), F.col(at).alias("_at")).join(classes, F.col("_k") == F.col("_key")).select("_row", "_k", "_at", F.explode("_classes").alias("_c"))
    asked = asked.withColumn("_b", bucket(F.col("_at"), F.col("_c")))
    met = asked.join(e, (F.col("_k") == F.col("_key")) & (F.col("_c") == F.col("_class")) & (F.col("_b") == F.col("_bucket")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    first = met.groupBy("_row").agg(F.min_by("_held", F.col(f"_held.{ordinal}")).alias("_first"))
    return marked.join(first, "_row", "left").select(*points.columns, *(F.col(f"_first.{c}").alias(c) for c in (ordinal, *carry)))


def two_level_lookup(blocks: DataFrame, level1: DataFrame, level2: DataFrame, key: str) -> DataFrame:
    """The blocks with the ``entry`` that their two tables give, null where either level has none: two equi-joins.

    ``blocks`` has (key, level1, level2) as ``block_address`` gives them; ``level1`` (key, level1, table_id) and ``level2``
    (table_id, level2, entry)."""
    return blocks.join(level1, [key, "level1"], "left").join(level2, ["table_id", "level2"], "left")


def qcow_state(entry: Column, cluster_bits: Column, version: Column, external: Column | None = None) -> Column:
    """A struct (state, host_offset, stored_size) of a second-level entry: Sparse, Zero, Standard or Compressed.

    Compressed entries hold an offset below and a size above a bit that follows from the cluster size; the size is in
    sectors after the first, in version 1 in bytes."""
    old = version == 1
    compressed = F.when(old, F.getbit(entry, F.lit(63)) == 1).otherwise(F.getbit(entry, F.lit(62)) == 1)
    low = F.when(old, 63 - cluster_bits).otherwise(70 - cluster_bits).cast("int")
    plain = F.when(old, entry.bitwiseAND(F.lit((1 << 63) - 1))).otherwise(entry.bitwiseAND(F.lit((1 << 62) - 1)))
    one = F.lit(1).cast("long")
    shift = lambda x, n, name: F.call_function(name, x, n)
    above = shift(plain, low, "shiftrightunsigned")
    stored = F.when(old, above).otherwise(512 * (above + 1))
    standard = entry.bitwiseAND(F.lit(0x00FFFFFFFFFFFE00))
    state = (
        F.when(entry == 0, "Sparse").when(compressed, "Compressed").when(standard > 0, "Standard").when(F.getbit(entry, F.lit(0)) == 1, "Zero")
        .when(F.coalesce(external, F.lit(False)) if external is not None else F.lit(False), "Standard").otherwise("Sparse")
    )
    at = F.when(state == "Compressed", plain.bitwiseAND(shift(one, low, "shiftleft") - 1)).when(state == "Standard", standard)
    return F.struct(state.alias("state"), at.alias("host_offset"), F.when(state == "Compressed", stored).otherwise(F.lit(None).cast("long")).alias("stored_size"))


#: Payload states of an allocation table by the entry's low three bits; 4 is none.
VHDX_STATES = {0: "NotPresent", 1: "Undefined", 2: "Zero", 3: "Unmapped", 5: "Unmapped", 6: "FullyPresent", 7: "PartiallyPresent"}


def vhdx_state(entry: Column) -> Column:
    """A struct (state, file_offset): null for a state that does not exist. Offsets are in units of a megabyte above bit 20."""
    bits = entry.bitwiseAND(F.lit(7))
    table = F.create_map(*(F.lit(x) for kv in VHDX_STATES.items() for x in kv))
    return F.struct(F.try_element_at(table, bits.cast("int")).alias("state"), F.try_multiply(F.call_function("shiftrightunsigned", entry, F.lit(20)), F.lit(1 << 20)).alias("file_offset"))


def bat_checks(entries: DataFrame, key: str, block_size: int, entry: str = "entry") -> DataFrame:
    """(key, index, state, file_offset, reason): the payload entries of allocation tables that break a rule.

    ``entries`` has (key, index, entry, disk_type, size)."""
    e = entries.select(key, "index", "disk_type", "size", vhdx_state(F.col(entry)).alias("_s")).select(key, "index", "disk_type", "size", "_s.*")
    stored = F.col("state").isin("FullyPresent", "PartiallyPresent")
    reason = (
        F.when(F.col("state").isNull(), "unknown state").when((F.col("disk_type") == "Fixed") & (F.col("state") != "FullyPresent"), "fixed image with a block that is not stored")
        .when((F.col("disk_type") == "Dynamic") & (F.col("state") == "PartiallyPresent"), "dynamic image with a partial block").when(stored & (F.col("file_offset") < (1 << 20)), "offset in the header")
        .when(stored & (F.col("file_offset") + block_size > F.col("size")), "block past the end").when(~stored & (F.col("file_offset") != 0), "offset of a block that is not stored")
    )
    return e.withColumn("reason", reason).filter("reason IS NOT NULL").select(key, "index", "state", "file_offset", "reason")


def bitmap_slot(chunk: Column, ratio: int) -> Column:
    """The slot of a chunk's bitmap block, which follows its ``ratio`` payload slots."""
    return (chunk + 1) * (ratio + 1) - 1


def sub_block_bit(bitmap: Column, index: Column, msb_first: bool = False) -> Column:
    """Whether a sub-block is set in a BINARY bitmap, bits counted from the lowest or the highest of each byte; null past its end."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(index / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = (index % 8).cast("int")
    return F.getbit(byte, 7 - bit if msb_first else bit) == 1


def coalesce_extents(extents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, logical_offset, length, physical_offset): runs of extents that continue each other in both address spaces, and
    of holes (null physical offsets) that continue each other."""
    w = Window.partitionBy(*keys).orderBy("logical_offset")
    joins = (F.lag(F.col("logical_offset") + F.col("length")).over(w) == F.col("logical_offset")) & F.when(
        F.col("physical_offset").isNull(), F.lag(F.col("physical_offset").isNull()).over(w)
    ).otherwise(F.lag(F.col("physical_offset") + F.col("length")).over(w) == F.col("physical_offset"))
    run = F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    dealt = extents.repartition(task_parts(extents), *keys)
    return dealt.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("logical_offset").alias("logical_offset"), F.sum("length").alias("length"), F.min("physical_offset").alias("physical_offset")).drop("_run")


def decode_runlists(lists: DataFrame, key: str, data: str, cluster_size: int) -> DataFrame:
    """(key, ordinal, logical_offset, length, physical_offset, ok): runs of packed lists, null physical offsets for holes.

    An element's first byte has the sizes of a count and of a signed difference to the last cluster, zero for a hole; a zero
    byte ends the list. An element past the end, an empty count or a negative cluster ends it with ``ok`` false."""
    state = "struct<at:int,cluster:bigint,going:boolean,runs:array<struct<clusters:bigint,cluster:bigint,ok:boolean>>>"
    d = F.col(data)

    def little(at: Column, size: Column) -> Column:
        """An unsigned little-endian number of up to 8 bytes."""
        return F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0).cast("long"), lambda v, i: F.when(i > size, v).otherwise(F.try_add(F.try_multiply(v, F.lit(256)), F.conv(F.hex(F.substring(d, at + 1 + size - i, F.lit(1))), 16, 10).cast("long"))))

    def step(s: Column, _: Column) -> Column:
        head = F.conv(F.hex(F.substring(d, s["at"] + 1, F.lit(1))), 16, 10).cast("int")
        n, m = head.bitwiseAND(F.lit(15)), F.shiftright(head, 4)
        clusters = little(s["at"] + 1, n)
        raw = little(s["at"] + 1 + n, m)
        sign = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(8 * m - 1, F.lit(0)))
        delta = F.when(m == 0, F.lit(0)).when(m > 7, raw).when(raw >= sign, raw - 2 * sign).otherwise(raw)
        cluster = F.try_add(s["cluster"], delta)
        sound = (n > 0) & (s["at"] + 1 + n + m <= F.length(d)) & (clusters > 0) & (cluster >= 0)
        run = lambda ok: F.struct(clusters.alias("clusters"), F.when(m > 0, cluster).alias("cluster"), ok.alias("ok"))
        moved = F.struct((s["at"] + 1 + n + m).alias("at"), cluster.alias("cluster"), F.lit(True).alias("going"), F.array_append(s["runs"], run(F.lit(True))).alias("runs"))
        ended = F.struct(s["at"].alias("at"), s["cluster"].alias("cluster"), F.lit(False).alias("going"), s["runs"].alias("runs"))
        broken = F.struct(s["at"].alias("at"), s["cluster"].alias("cluster"), F.lit(False).alias("going"), F.array_append(s["runs"], F.struct(F.lit(None).cast("long").alias("clusters"), F.lit(None).cast("long").alias("cluster"), F.lit(False).alias("ok"))).alias("runs"))
        return F.when(~s["going"], s).when(F.coalesce(head == 0, F.lit(True)), ended.cast(state)).when(sound, moved.cast(state)).otherwise(broken.cast(state))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("cluster"), F.lit(True).alias("going"), F.array().cast("array<struct<clusters:bigint,cluster:bigint,ok:boolean>>").alias("runs")).cast(state)
    runs = F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(d), F.lit(1)) - 1), start, step, lambda s: s["runs"])
    rows = lists.filter(d.isNotNull()).select(key, F.posexplode(runs).alias("ordinal", "_run"))
    w = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    length = F.try_multiply(F.col("_run.clusters"), F.lit(cluster_size))
    return rows.select(key, "ordinal", F.coalesce(F.sum(length).over(w), F.lit(0)).alias("logical_offset"), length.alias("length"), F.try_multiply(F.col("_run.cluster"), F.lit(cluster_size)).alias("physical_offset"), F.col("_run.ok").alias("ok"))


def area_offsets(requests: DataFrame, areas: DataFrame, key: str, at: str, split: Split | None = None) -> DataFrame:
    """The requests with ``area_ordinal`` and ``area_offset``: where an offset lies in the areas laid end to end; an area of
    size 0 has no end. Nulls past the last area. ``split`` cuts a volume with many requests into parts."""
    w = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    laid = areas.select(key, "ordinal", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long").alias("logical_offset"), F.when(F.col("size") == 0, F.lit((1 << 62) - 1)).otherwise(F.col("size")).cast("long").alias("length"), F.col("offset").alias("_area"))
    found = covering_extent(requests, laid, key, at, ["ordinal", "_area"], split)
    return found.select(*requests.columns, F.col("ordinal").alias("area_ordinal"), (F.col("_area") + F.col(at) - F.col("logical_offset")).alias("area_offset"))


def active_log(entries: DataFrame, key: str) -> DataFrame:
    """The entries of each log's active sequence: the one with the largest head sequence whose head names its start as tail.

    ``entries`` has (key, sequence_start, sequence, tail): a sequence is entries with one start, its head the last of them."""
    heads = entries.groupBy(key, "sequence_start").agg(F.max("sequence").alias("_head"), F.max_by("tail", "sequence").alias("_tail"))
    best = heads.filter(F.col("_tail") == F.col("sequence_start")).groupBy(key).agg(F.max_by("sequence_start", F.struct("_head", (-F.col("sequence_start")).alias("_s"))).alias("_active"))
    return entries.join(best, key).filter(F.col("sequence_start") == F.col("_active")).drop("_active")


def replayed_size(sizes: DataFrame, patches: DataFrame, key: str, offset: str, length: str) -> DataFrame:
    """(key, size): the declared size, or where the last patch ends if that is further."""
    ends = patches.groupBy(key).agg(F.max(F.col(offset) + F.col(length)).alias("_end"))
    return sizes.join(ends, key, "left").select(key, F.greatest(F.col("size"), F.coalesce("_end", F.lit(0))).cast("long").alias("size"))


def masked_offsets(reads: DataFrame, protected: DataFrame, key: str, at: str, header: int, relocated: int) -> DataFrame:
    """The reads with ``physical_offset`` (the first ``header`` bytes are kept at ``relocated``) and ``masked``: whether the
    place lies in a protected range, which reads as zeros. A source has few protected ranges (key, offset, length)."""
    moved = F.when(F.col(at) < header, F.col(at) + relocated).otherwise(F.col(at))
    ranges = protected.groupBy(key).agg(F.collect_list(F.struct("offset", "length")).alias("_ranges"))
    inside = F.exists("_ranges", lambda r: (F.col(at) >= r["offset"]) & (F.col(at) < r["offset"] + r["length"]))
    return reads.join(ranges, key, "left").select(*reads.columns, moved.alias("physical_offset"), F.coalesce(inside, F.lit(False)).alias("masked"))


def request_pieces(requests: DataFrame, extents: DataFrame, key: str, split: Split | None = None, dealt: int | None = None) -> DataFrame:
    """(request_id, piece_offset, length, physical_offset): each request cut at the extents that it crosses; null physical
    offsets in holes. ``requests`` has (key, request_id, offset, length), ``extents`` cover an object without overlap
    (key, logical_offset, length, physical_offset).

    Edges cut an object into stretches, each in one extent or hole, that know where they end: a request's first piece is in the
    stretch below its offset, the others begin at the edges inside it, and no request's pieces are brought together. ``split``
    cuts an object into parts. ``dealt`` is the number of partitions if the extents are already dealt by key to so many."""
    parts = dealt or task_parts(requests, extents)
    size = lambda c: F.ceil(F.log2(F.greatest(c, F.lit(1)))).cast("int")
    bucket = lambda x, c: F.floor(x / F.pow(F.lit(2.0), c)).cast("long")
    none = F.lit(None).cast("long")
    r = requests.filter("length > 0").select(key, "request_id", "offset", (F.col("offset") + F.col("length")).alias("_end"), size(F.col("length")).alias("_class"))
    # Extents of null keys are left out at once, not by one of the joins: what both need is then the same work, done once.
    known = F.col(key).isNotNull()
    # An object's classes as bits of a number, first for each input partition, as an object may have many requests.
    bits = r.filter(known).select(key, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_class")).alias("_bit"), F.spark_partition_id().alias("_from"))
    some = bits.repartition(parts, key, "_from").groupBy(key, "_from").agg(F.bit_or("_bit").alias("_bit"))
    classes = some.repartition(parts, key).groupBy(key).agg(F.bit_or("_bit").alias("_classes"))

    start = F.struct(F.col("logical_offset").cast("long").alias("_edge"), F.when(F.col("length") > 0, F.col("physical_offset")).cast("long").alias("_physical"))
    end = F.struct((F.col("logical_offset") + F.col("length")).cast("long").alias("_edge"), none.alias("_physical"))
    laid = extents.filter(known) if dealt or split else extents.filter(known).repartition(parts, key)
    edges = laid.select(key, F.inline(F.array(start, end)))
    edges = (edges.repartition(parts, key, "_edge") if split else edges).groupBy(key, "_edge").agg(F.max("_physical").alias("_physical"))
    stretches = following_rows(edges, key, ["_edge"], {"_next": "_edge"}, split, parts if split else None)

    # One more stretch lies ahead of an object's first edge.
    own, ahead = F.struct("_edge", "_physical", "_next"), F.struct(F.lit(-(1 << 62)).cast("long").alias("_edge"), none.alias("_physical"), F.col("_edge").alias("_next"))
    seen = _max_before(stretches, key, ["_edge"], F.col("_edge"), split, "_before")
    starts = seen.select(key, F.inline(F.when(F.col("_before").isNull(), F.array(ahead, own)).otherwise(F.array(own))))
    first = floor_join(r.drop("_class"), starts, key, "offset", "_edge", ["_physical", "_next"], split, parts)
    firsts = first.select("request_id", F.col("offset").alias("piece_offset"), "_end", "_next", (F.col("_physical") + (F.col("offset") - F.col("_edge"))).alias("physical_offset"))
    if split:  # parts meet by an equi-join on the key
        firsts = firsts.union(r.filter(~known).select("request_id", "offset", "_end", none, none))

    by = [key, "_class", "_bucket"]
    asked = r.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("offset"), F.col("_class")), bucket(F.col("_end") - 1, F.col("_class")))))
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda c: F.getbit("_classes", c) == 1)).alias("_class")
    met = stretches.join(classes, key).select(key, "_edge", "_next", "_physical", each).withColumn("_bucket", bucket(F.col("_edge"), F.col("_class")))
    inner = asked.repartition(parts, *by).join(met.repartition(parts, *by), by).filter((F.col("_edge") > F.col("offset")) & (F.col("_edge") < F.col("_end")))
    pieces = firsts.unionByName(inner.select("request_id", F.col("_edge").alias("piece_offset"), "_end", "_next", F.col("_physical").alias("physical_offset")))
    return pieces.select("request_id", "piece_offset", (F.least("_next", "_end") - F.col("piece_offset")).alias("length"), "physical_offset")


def inode_addresses(inodes: Column, inode_bits: int, block_bits: int, group_blocks: int, block_size: int, inode_size: int) -> dict[str, Column]:
    """The parts of an inode number: allocation group, block within it, place within the block, and the byte offset."""
    group = F.shiftright(inodes, inode_bits + block_bits).cast("long")
    block = F.shiftright(inodes, inode_bits).bitwiseAND(F.lit((1 << block_bits) - 1))
    place = inodes.bitwiseAND(F.lit((1 << inode_bits) - 1))
    return {"group": group, "block": block, "place": place, "byte_offset": (group * group_blocks + block) * block_size + place * inode_size}


def inodes_in_chunks(inodes: DataFrame, chunks: DataFrame, key: str, inode: str) -> DataFrame:
    """The inodes with ``exists``: whether one of their key's chunks of 64, which start at ``chunk_start``, has them.

    A chunk lies in one or two blocks of 64 numbers and a block meets 127 starts at most, so inodes meet their block's in an
    equi-join and a file system with all inodes is dealt like many."""
    block = lambda c: F.floor(c / 64).cast("long")
    held = chunks.select(F.col(key).alias("_key"), "chunk_start", F.explode(F.array_distinct(F.array(block(F.col("chunk_start")), block(F.col("chunk_start") + 63)))).alias("_block"))
    held = held.groupBy("_key", "_block").agg(F.collect_set("chunk_start").alias("_starts"))
    found = inodes.join(held, F.col(key).eqNullSafe(F.col("_key")) & (block(F.col(inode)) == F.col("_block")), "left")
    inside = F.exists("_starts", lambda s: (F.col(inode) >= s) & (F.col(inode) < s + 64))
    return found.select(*inodes.columns, F.coalesce(inside, F.lit(False)).alias("exists"))
