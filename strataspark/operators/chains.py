"""Chains of pointers: cluster chains, lists of records, ladders of parents. Pointer doubling follows a chain of n links in
log2(n) joins, all chains at once; each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.sources.tables import Rounds


def follow_chains(starts: DataFrame, links: DataFrame, key: str, start: str, node: str, following: str) -> DataFrame:
    """(key, start, ordinal, node, looped): every node of each chain from its start, 0 first.

    ``links`` has (key, node, following), following null at a chain's end; a start or a following node that has no row ends
    its chain there. A chain that comes back to a node is ``looped`` and is given up to as many nodes as its key has, so
    each of its nodes occurs; rows are linear in the chains' lengths. Where ``starts`` has ``most``, and it is not null, no more
    nodes of that chain are followed, and whether it loops is not found out."""
    spark = links.sparkSession
    # All nodes with a row, and one without: what is longer has come back to a node.
    counts = links.groupBy(key).agg((F.count("*") + 1).alias("_limit"))
    heads = starts.select(key, F.col(start).alias("start"), F.col(start).alias("node"), F.lit(0).cast("long").alias("ordinal"), (F.col("most") if "most" in starts.columns else F.lit(None)).cast("long").alias("_most"))
    reach, jump = Rounds(spark), Rounds(spark)
    found = reach.write(heads.join(counts, key, "left").withColumn("_limit", F.coalesce("_limit", F.lit(1))))
    jumps = jump.write(links.filter(F.col(following).isNotNull()).select(key, F.col(node).alias("_from"), F.col(following).alias("_to")))
    step, seen = 1, -1
    while (now := found.count()) != seen:
        seen = now
        far = found.join(jumps, (found[key] == jumps[key]) & (found["node"] == jumps["_from"])).drop(jumps[key])
        far = far.select(key, "start", F.col("_to").alias("node"), (F.col("ordinal") + step).alias("ordinal"), "_most", "_limit")
        found = reach.write(found.union(far.filter("ordinal <= _limit AND (_most IS NULL OR ordinal < _most)")))
        after = jumps.select(F.col(key).alias("_k"), F.col("_from").alias("_mid"), F.col("_to").alias("_end"))
        jumps = jump.write(jumps.join(after, (F.col(key) == F.col("_k")) & (F.col("_to") == F.col("_mid"))).select(key, "_from", F.col("_end").alias("_to")))
        step *= 2
    loops = found.filter("ordinal = _limit AND _limit > 1").select(key, "start", F.lit(True).alias("looped")).distinct()
    out = found.filter("ordinal < _limit").join(loops, [key, "start"], "left")
    return out.select(key, F.col("start").alias(start), "ordinal", F.col("node").alias(node), F.coalesce("looped", F.lit(False)).alias("looped"))


#: Bits of an entry, the first value that ends a chain, and the mark of a bad cluster, for each variant.
FAT_ENDS = {"FAT12": (12, 0xFF8, 0xFF7), "FAT16": (16, 0xFFF8, 0xFFF7), "FAT32": (28, 0x0FFFFFF8, 0x0FFFFFF7)}


def fat_links(entries: DataFrame, key: str, variant: str) -> DataFrame:
    """(key, cluster, following, state): a table's entries (key, cluster, entry) as links; free and bad entries lead nowhere."""
    bits, end, bad = FAT_ENDS[variant]
    e = F.col("entry").bitwiseAND(F.lit((1 << bits) - 1))
    state = F.when(e == 0, "free").when(e == bad, "bad").when(e >= end, "end").when(e == 1, "bad").otherwise("next")
    return entries.select(key, "cluster", F.when(state == "next", e).alias("following"), state.alias("state"))


def cluster_chains(files: DataFrame, links: DataFrame, key: str, cluster_size: int) -> DataFrame:
    """(key, file_id, ordinal, cluster, logical_offset, ok): the clusters of each file, as many as its size needs.

    ``files`` has (key, file_id, first_cluster, size), a null size for directories, which end where their chain does. A file is
    not ok if its chain loops, ends early, or meets a free or bad entry before its end."""
    need = F.ceil(F.col("size") / cluster_size).cast("long")
    # Followed as far as the longest file needs that starts there, and to the end for a directory.
    starts = files.groupBy(key, "first_cluster").agg(F.when(F.count_if(need.isNull()) == 0, F.max(need)).alias("most"))
    chains = follow_chains(starts, links, key, "first_cluster", "cluster", "following")
    placed = files.withColumn("_need", need).join(chains, [key, "first_cluster"]).join(links.select(key, "cluster", "state"), [key, "cluster"], "left")
    used = placed.filter(F.col("_need").isNull() | (F.col("ordinal") < F.col("_need")))
    sound = used.groupBy(key, "file_id").agg(
        F.count("*").alias("_n"), F.max("_need").alias("_all"), F.bool_or("looped").alias("_loop"), F.bool_and(F.coalesce(F.col("state").isin("next", "end"), F.lit(False))).alias("_sane")
    )
    whole = F.col("_sane") & F.when(F.col("_all").isNull(), ~F.col("_loop")).otherwise(F.col("_n") == F.col("_all"))
    return used.join(sound.select(key, "file_id", whole.alias("ok")), [key, "file_id"]).select(key, "file_id", "ordinal", "cluster", (F.col("ordinal") * cluster_size).alias("logical_offset"), "ok")
