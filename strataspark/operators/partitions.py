"""Partition tables whose geometry must be found out: sector and block sizes, copies of headers, chains of tables.

Sources have (source_id, size, bytes). Every candidate geometry of a source is a row, its tables are read by expressions on
the bytes, its rules are columns, and the best candidate is an aggregate. Nothing fails on a bad table: it has no candidate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.text import utf16_text
from strataspark.operators import headers
from strataspark.operators.decode import MBR_EXTENDED, MBR_PROTECTIVE, UNUSED_GUID, field, guid, let, once, uint

#: Sector sizes that are tried, in order of preference, and the most logical partitions.
MBR_SECTORS = (512, 1024, 2048, 4096)
MAX_LOGICAL = 1024
MBR_HIDDEN_EXTENDED = ("15", "1F")
FAT_TYPES, NTFS_TYPES = ("01", "04", "06", "0B", "0C", "0E"), ("07", "17", "27")
#: Block sizes of the other table, and its types without user data.
GPT_SECTORS = (512, 1024, 2048, 4096, 8192, 16384, 32768, 65536)
GPT_METADATA = ("c12a7328-f81f-11d2-ba4b-00a0c93ec93b", "21686148-6449-6e6f-744e-656564454649", "e3c9e316-0b5c-4db8-817d-f92df00215ae")
APM_METADATA = (
    "Apple_partition_map", "Apple_Driver", "Apple_FWDriver", "Apple_Driver43", "Apple_Driver43_CD", "Apple_Driver_ATA", "Apple_Driver_ATAPI", "Apple_Driver_IOKit", "Apple_Driver_OpenFirmware", "Apple_Boot",
    "Apple_Boot_RAID", "Apple_Bootstrap", "Apple_Loader", "Apple_Patches",
)


def _magic(data: Column, at: Column, size: int) -> Column:
    """Bytes at an offset, empty where the source ends before."""
    return F.when(at < (1 << 31) - 4096, field(data, at.cast("int"), size)).otherwise(F.lit(b""))


def _entries(record: Column) -> Column:
    """The used entries of a boot record of 512 bytes: (type_code, start, sectors), in order."""
    one = lambda t: F.array(*(F.struct(F.hex(field(t, 16 * k + 4, 1)).alias("type_code"), uint(t, 16 * k + 8, 4).alias("start"), uint(t, 16 * k + 12, 4).alias("sectors")) for k in range(4)))
    entries = let(field(record, 446, 64), one).cast("array<struct<type_code:string,start:bigint,sectors:bigint>>")
    return F.filter(entries, lambda e: (e["type_code"] != "00") & (e["sectors"] > 0))


def _extended(type_code: Column) -> Column:
    return type_code.isin(*MBR_EXTENDED, *MBR_HIDDEN_EXTENDED)


def extended_chain(data: Column, first: Column, sector: Column) -> Column:
    """A struct of the logical partitions (type_code, start, sectors; absolute) of the chain of tables that begins at sector
    ``first``, and ``ok``: each table has one logical entry and one link at most, nothing is visited twice, 1,024 at most.

    Each reading of a source's bytes copies them all, so a step reads its record once and takes it apart afterwards."""
    part = "struct<type_code:string,start:bigint,sectors:bigint>"
    start = F.struct(first.cast("long").alias("at"), F.array().cast("array<bigint>").alias("seen"), F.array().cast(f"array<{part}>").alias("found"), F.lit(True).alias("going"), F.lit(True).alias("ok"))

    def step(s: Column, _: Column) -> Column:
        return F.when(~s["going"], s).otherwise(let(_magic(data, s["at"] * sector, 512), lambda record: let(_entries(record), lambda used: after(s, record, used))))

    def after(s: Column, record: Column, used: Column) -> Column:
        links, logical = F.filter(used, lambda e: _extended(e["type_code"])), F.filter(used, lambda e: ~_extended(e["type_code"]))
        sound = (F.hex(field(record, 510, 2)) == "55AA") & (F.size(logical) == 1) & (F.size(links) <= 1) & ~F.array_contains(s["seen"], s["at"])
        own = F.get(logical, F.lit(0))
        more = F.array_append(s["found"], F.struct(own["type_code"].alias("type_code"), (own["start"] + s["at"]).alias("start"), own["sectors"].alias("sectors")))
        following = F.struct(
            (first + F.get(links, F.lit(0))["start"]).cast("long").alias("at"), F.array_append(s["seen"], s["at"]).alias("seen"), more.cast(f"array<{part}>").alias("found"),
            (F.size(links) == 1).alias("going"), F.lit(True).alias("ok"),
        )
        broken = F.struct(s["at"].alias("at"), s["seen"].alias("seen"), s["found"].alias("found"), F.lit(False).alias("going"), F.lit(False).alias("ok"))
        return F.when(F.coalesce(sound, F.lit(False)), following).otherwise(broken)

    end = lambda s: F.struct(s["found"].alias("found"), (s["ok"] & ~s["going"]).alias("ok"))
    # No chain has more sound tables than the source has sectors: one step more finds it broken.
    steps = F.least(F.lit(MAX_LOGICAL), F.floor(F.length(data) / sector).cast("int") + 2)
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, end)


def _evidence(data: Column, p: Column) -> Column:
    """Points for what stands at a partition's start: 24 for its type's own signature, 4 for a boot signature."""

    def points(start: Column) -> Column:
        boot = F.hex(field(start, 510, 2)) == "55AA"
        fat = p["type_code"].isin(*FAT_TYPES) & boot & (field(start, 54, 8).isin(b"FAT12   ", b"FAT16   ") | (field(start, 82, 8) == b"FAT32   "))
        ntfs = p["type_code"].isin(*NTFS_TYPES) & boot & (field(start, 3, 8) == b"NTFS    ")
        ext = (p["type_code"] == "83") & (F.hex(field(start, 1024 + 56, 2)) == "53EF")
        hfs = (p["type_code"] == "AF") & field(start, 1024, 2).isin(b"BD", b"H+", b"HX")
        return F.when(fat | ntfs | ext | hfs, 24).when(boot, 4).otherwise(0)

    return let(_magic(data, p["byte_offset"], 1536), points)


def mbr_candidates(sources: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, sector, partitions, ok, evidence, logical, recognised): each sector size with the partitions that it gives.

    Partitions are (index, type_code, role, byte_offset, byte_size): primary entries first, then each chain's. A layout is ok
    if its chains are, everything ends within the source, logical partitions lie in an extended one and, those and the
    protective one apart, no two overlap."""
    data = F.col("bytes")
    head = sources.filter(F.hex(field(data, 510, 2)) == "55AA").select(key, "size", "bytes", _entries(field(data, 0, 512)).alias("primary"), F.explode(F.array(*map(F.lit, MBR_SECTORS))).alias("sector"))
    role = lambda t: F.when(t == MBR_PROTECTIVE, "Protective").when(_extended(t), "Extended").otherwise("Primary")
    chains = F.transform(F.filter("primary", lambda e: _extended(e["type_code"])), lambda e: extended_chain(F.col("bytes"), e["start"], F.col("sector")))
    walked = once(head, {"chains": chains})
    span = lambda e, r: F.struct(e["type_code"].alias("type_code"), r.alias("role"), (e["start"] * F.col("sector")).alias("byte_offset"), (e["sectors"] * F.col("sector")).alias("byte_size"))
    every = F.concat(F.transform("primary", lambda e: span(e, role(e["type_code"]))), F.transform(F.flatten(F.transform("chains", lambda c: c["found"])), lambda e: span(e, F.lit("Logical"))))
    laid = once(walked, {"partitions": F.transform(every, lambda p, i: F.struct(i.alias("index"), *(p[c].alias(c) for c in ("type_code", "role", "byte_offset", "byte_size"))))})
    end = lambda p: p["byte_offset"] + p["byte_size"]
    inside = F.forall("partitions", lambda p: end(p) <= F.col("size"))
    extended = F.filter("partitions", lambda p: p["role"] == "Extended")
    contained = F.forall("partitions", lambda p: (p["role"] != "Logical") | F.exists(extended, lambda x: (x["byte_offset"] <= p["byte_offset"]) & (end(p) <= end(x))))
    exempt = lambda a, b: a["role"].isin("Protective") | b["role"].isin("Protective") | ((a["role"] == "Extended") & (b["role"] == "Logical")) | ((b["role"] == "Extended") & (a["role"] == "Logical"))
    overlaps = F.exists(
        "partitions", lambda a: F.exists("partitions", lambda b: (a["index"] < b["index"]) & ~exempt(a, b) & (a["byte_offset"] < end(b)) & (b["byte_offset"] < end(a)))
    )
    logical = F.size(F.filter("partitions", lambda p: p["role"] == "Logical"))
    gpt = F.array(*(_magic(F.col("bytes"), F.lit(x), 8) for x in (512,)))
    score = F.transform(
        "partitions",
        lambda p: F.when(p["role"] == "Extended", F.when(logical > 0, 20).otherwise(0))
        .when(p["role"] == "Protective", F.when(gpt[0] == b"EFI PART", 40).otherwise(0))
        .otherwise(_evidence(F.col("bytes"), p)),
    )
    scored = laid.withColumn("ok", F.forall("chains", lambda c: c["ok"]) & inside & contained & ~overlaps).withColumn("logical", logical)
    scored = once(scored, {"_score": score})
    recognised = F.size(F.filter(F.arrays_zip("partitions", "_score"), lambda z: (z["_score"] > 0) & (z["partitions"]["role"] != "Extended")))
    evidence = F.aggregate("_score", F.lit(0), lambda s, x: s + x) + 2 * F.size("partitions") + 10 * F.col("logical")
    return scored.select(key, "sector", "partitions", "ok", evidence.alias("evidence"), "logical", recognised.alias("recognised"))


def mbr_layout(candidates: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, sector, partitions) of the candidate with most evidence, then logical partitions, recognised ones, and the smaller
    sector. An aggregate."""
    rank = F.struct("evidence", "logical", "recognised", (-F.col("sector")).alias("_sector"))
    return candidates.filter("ok").groupBy(key).agg(F.max_by(F.struct("sector", "partitions"), rank).alias("_best")).select(key, "_best.sector", "_best.partitions")


def mbr_volumes(layouts: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, index, byte_offset, byte_size, role, name, type_code)."""
    return layouts.select(key, F.inline("partitions")).select(key, "index", "byte_offset", "byte_size", "role", F.lit(None).cast("string").alias("name"), "type_code")


GPT_HEADER = headers.Layout(
    "volume.gpt",
    {
        "signature": (0, 8, "ascii"), "revision": (8, 4, "le"), "header_size": (12, 4, "le"), "header_crc": (16, 4, "le"), "current_lba": (24, 8, "le"), "backup_lba": (32, 8, "le"),
        "first_usable": (40, 8, "le"), "last_usable": (48, 8, "le"), "disk_guid": (56, 16, "guid"), "entries_lba": (72, 8, "le"), "n_entries": (80, 4, "le"), "entry_size": (84, 4, "le"),
        "entries_crc": (88, 4, "le"),
    },
    {
        "signature": "signature = 'EFI PART'", "revision": "revision = 65536", "header_size": "header_size BETWEEN 92 AND block", "entry_size": "entry_size >= 128", "location": "current_lba = at / block",
        "crc": lambda: F.crc32(F.expr("concat(substring(data, 1, 16), X'00000000', substring(data, 21, CAST(least(header_size, block) AS INT) - 20))")) == F.col("header_crc"),
    },
    needs=("block", "at"),
)


def gpt_headers(sources: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, block, location, fields, ok, entries_ok): both headers at every block size, for sources with a protective table."""
    data = F.col("bytes")
    protective = (F.hex(field(data, 510, 2)) == "55AA") & F.exists(_entries(field(data, 0, 512)), lambda e: e["type_code"] == MBR_PROTECTIVE)
    block = F.explode(F.array(*map(F.lit, GPT_SECTORS))).alias("block")
    ends = F.explode(F.array(F.struct(F.lit("Primary").alias("location"), F.col("block").cast("long").alias("at")), F.struct(F.lit("Backup").alias("location"), ((F.floor(F.col("size") / F.col("block")) - 1) * F.col("block")).alias("at"))))
    placed = sources.filter(protective).select(key, "size", "bytes", block).select("*", ends.alias("_e")).select(key, "size", "bytes", "block", "_e.location", "_e.at").filter("at > 0 AND at + block <= size")
    decoded = headers.decode_header(placed.withColumn("data", F.expr("substring(bytes, CAST(at + 1 AS INT), block)")), GPT_HEADER, "data", (key, "size", "bytes", "location", "block", "at"))
    bounded = F.expr("ok AND entries_lba * block + n_entries * entry_size <= size")
    entries = F.expr("crc32(substring(bytes, CAST(entries_lba * block + 1 AS INT), CAST(n_entries * entry_size AS INT)))")
    return decoded.withColumn("entries_ok", F.when(bounded, entries == F.col("entries_crc")).otherwise(F.lit(False)))


#: What the two headers of a pair must agree in: the primary's field and the backup's.
GPT_PAIR = {
    "current_is_backup": ("backup_lba", "current_lba"), "backup_is_current": ("current_lba", "backup_lba"), "header_size": ("header_size", "header_size"), "disk_guid": ("disk_guid", "disk_guid"),
    "usable_range": (("first_usable", "last_usable"), ("first_usable", "last_usable")), "entry_layout": (("n_entries", "entry_size"), ("n_entries", "entry_size")), "entries_crc": ("entries_crc", "entries_crc"),
}


def gpt_pair_checks(found: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, block, check_name, ok): seven rows for each block size at which both headers are sound."""
    names = sorted({x for pair in GPT_PAIR.values() for side in pair for x in ([side] if isinstance(side, str) else side)})
    one = found.filter("ok AND location = 'Primary'").select(key, "block", *(F.col(c).alias(f"p_{c}") for c in names))
    two = found.filter("ok AND location = 'Backup'").select(key, "block", *(F.col(c).alias(f"b_{c}") for c in names))
    side = lambda p, x: [F.col(f"{p}_{c}") for c in ([x] if isinstance(x, str) else x)]
    same = lambda a, b: reduce(lambda m, n: m & n, (x == y for x, y in zip(side("p", a), side("b", b), strict=True)))
    checks = F.array(*(F.struct(F.lit(name).alias("check_name"), same(a, b).alias("ok")) for name, (a, b) in GPT_PAIR.items()))
    return one.join(two, [key, "block"]).select(key, "block", F.inline(checks))


def gpt_volumes(found: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, block, location, index, byte_offset, byte_size, role, name, type_code, unique_guid): the entries in use of the
    first sound table: block sizes at which a signature stands go first, then smaller ones, the primary before the backup.
    A table is sound if its checksums are and its partitions lie in the usable range and overlap no neighbour."""
    rows = found.filter("ok AND entries_ok").select(key, "size", "bytes", "block", "location", "first_usable", "last_usable", "entries_lba", "entry_size", F.explode(F.expr("sequence(0L, n_entries - 1)")).alias("index"))
    at = F.expr("CAST(entries_lba * block + index * entry_size AS INT)")
    data = F.col("bytes")
    e = rows.select(
        key, "size", "block", "location", "first_usable", "last_usable", F.col("index").cast("int").alias("index"), uint(data, at + 32, 8).cast("long").alias("first"), uint(data, at + 40, 8).cast("long").alias("last"),
        utf16_text(field(data, at + 56, 72)).alias("name"), guid(data, at).alias("type_code"), guid(data, at + 16).alias("unique_guid"),
    ).filter(F.col("type_code") != UNUSED_GUID)
    w = Window.partitionBy(key, "block", "location").orderBy("first", "index")  # a table has few entries
    e = e.withColumn("_after", F.lead("first").over(w))
    bad = F.expr("first < first_usable OR last > last_usable OR (last + 1) * block > size OR _after <= last")
    broken = e.filter(bad).select(key, "block", "location").distinct()
    tables = found.filter("ok AND entries_ok").join(broken, [key, "block", "location"], "left_anti")
    signed = found.filter("location = 'Primary' AND signature = 'EFI PART'").select(key, "block", F.lit(0).alias("_unsigned"))
    ranked = tables.select(key, "block", "location").join(signed, [key, "block"], "left")
    best = ranked.groupBy(key).agg(F.min(F.struct(F.coalesce("_unsigned", F.lit(1)).alias("u"), "block", (F.col("location") == "Backup").alias("b"), "location")).alias("_best"))
    chosen = best.select(key, "_best.block", "_best.location")
    role = F.when(F.col("type_code").isin(*GPT_METADATA), "Metadata").otherwise("Primary")
    return e.join(chosen, [key, "block", "location"]).select(
        key, "block", "location", "index", (F.col("first") * F.col("block")).alias("byte_offset"), ((F.col("last") - F.col("first") + 1) * F.col("block")).alias("byte_size"), role.alias("role"), "name", "type_code", "unique_guid"
    )


def apm_entries(sources: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, index, fields, ok, byte_offset, byte_size, role): the map's entries, as many as the first one says."""
    device = headers.decode_header(sources, headers.APM_DRIVER, "bytes", (key, "size", "bytes")).filter("ok").select(key, "size", "bytes", "block_size", F.col("block_count").alias("device_blocks"))
    count = F.when(F.decode(field(F.col("bytes"), 512, 2), "ISO-8859-1") == "PM", uint(F.col("bytes"), 516, 4, big=True))
    rows = headers.table_entries(device.withColumn("_start", F.lit(512)).withColumn("_n", count).filter("_n * 512 <= size"), [key, "size", "block_size", "device_blocks"], "bytes", "_start", "_n", 512)
    decoded = headers.decode_header(rows, headers.APM_ENTRY, "entry", (key, "size", "block_size", "device_blocks", "index"))
    role = F.when(F.col("type_code").isin(*APM_METADATA), "Metadata").when(F.col("type_code") == "Apple_Free", "Unknown").otherwise("Primary")
    return decoded.withColumn("byte_offset", F.col("start_block") * F.col("block_size")).withColumn("byte_size", F.col("block_count") * F.col("block_size")).withColumn("role", role)


def apm_checks(entries: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, first_is_map, counts_agree, count_is_parsed, in_device, in_source, ok): one row for each map; an aggregate."""
    first = F.min_by(F.struct("type_code", "map_entries"), "index")
    end = F.col("start_block") + F.col("block_count")
    found = entries.groupBy(key).agg(
        (first["type_code"] == "Apple_partition_map").alias("first_is_map"), (F.min("map_entries") == F.max("map_entries")).alias("counts_agree"), (first["map_entries"] == F.count("*")).alias("count_is_parsed"),
        F.bool_and(F.coalesce(end <= F.col("device_blocks"), F.lit(False))).alias("in_device"), F.bool_and(F.coalesce(F.col("byte_offset") + F.col("byte_size") <= F.col("size"), F.lit(False))).alias("in_source"),
        F.bool_and("ok").alias("_ok"),
    )
    return found.withColumn("ok", F.expr("first_is_map AND counts_agree AND count_is_parsed AND in_device AND in_source AND _ok")).drop("_ok")


# --- views ---------------------------------------------------------------------------------------------------------


def views(volumes: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, view_id, kind, name, tags): volumes as views; tags are texts. Volumes have (key, index, byte_offset, byte_size, role, name)."""
    kind = F.when(F.col("role").isin("Primary", "Logical"), "Volume").otherwise("Partition")
    tags = F.create_map(*(x for c in ("index", "byte_offset", "byte_size", "role") for x in (F.lit(c), F.lower(F.col(c).cast("string")) if c == "role" else F.col(c).cast("string"))))
    return volumes.select(key, F.col("index").cast("long").alias("view_id"), kind.alias("kind"), "name", tags.alias("tags"))


def selected(view_rows: DataFrame, by: str, value: str | int, tag: str | None = None) -> DataFrame:
    """The views that a selector picks: ``id``, ``index`` (the tag, as a number), ``name``, or ``tag`` with its value."""
    test = {
        "id": lambda: F.col("view_id") == value,
        "index": lambda: F.expr("try_cast(tags['index'] AS BIGINT)") == value,
        "name": lambda: F.col("name") == value,
        "tag": lambda: F.try_element_at("tags", F.lit(tag)) == value,
    }
    return view_rows.filter(test[by]())


def open_view(view_rows: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, view_id, offset, length): of each source's selected views the first, as a range to slice."""
    first = view_rows.groupBy(key).agg(F.min_by(F.struct("view_id", "tags"), "view_id").alias("_v"))
    return first.select(key, "_v.view_id", F.expr("CAST(_v.tags['byte_offset'] AS BIGINT)").alias("offset"), F.expr("CAST(_v.tags['byte_size'] AS BIGINT)").alias("length"))
