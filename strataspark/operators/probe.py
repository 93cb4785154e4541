"""Format probing: sources against signatures, ranked by confidence and registration order.

The signatures are a constant array inside the projection, in rank order, so a source's matches come out ranked without
a join, a shuffle or a sort, and column pruning reads the head alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidences in ascending order, and kinds in inventory order.
CONFIDENCE = ("Weak", "Likely", "Strong", "Exact")
KIND_ORDER = ("Archive", "Image", "VolumeSystem", "VolumeManager", "FileSystem", "Helper")


@dataclass(frozen=True)
class Signature:
    """A rule on a source: ``magic``, text or bytes as the head is, stands at ``offset`` of the head, or anywhere if offset is
    None. A negative offset counts from the source's end, in ``tail``. ``test`` instead is any condition on the source's
    columns. A ``variant`` is the same probe as the rule before it, with another outcome."""

    format_id: str
    kind: str
    magic: str | bytes
    confidence: str
    offset: int | None = 0
    test: Callable[[], Column] | None = None
    variant: bool = False


def inventory(signatures: list[Signature]) -> list[tuple[int, Signature]]:
    """Registration indexes: by kind, then id; several rules of one format keep the order given."""
    out, index = [], -1
    for s in sorted(signatures, key=lambda s: (KIND_ORDER.index(s.kind), s.format_id)):
        index += not s.variant
        out.append((index, s))
    return out


def _holds(head: Column, s: Signature) -> Column:
    if s.test is not None:
        return s.test()
    if s.offset is None:
        return F.contains(head, F.lit(s.magic))
    if s.offset < 0:
        return F.expr(f"substring(tail, greatest(0, length(tail) + {s.offset}) + 1, {len(s.magic)})") == s.magic
    return F.substring(head, s.offset + 1, len(s.magic)) == s.magic


def ranked_matches(head: Column, signatures: list[Signature], kind: str | None = None) -> Column:
    """An array of (registration_index, format_id, kind, confidence) structs, best first; ``kind`` restricts the registry."""
    entries = [(i, s) for i, s in inventory(signatures) if kind in (None, s.kind)]
    entries.sort(key=lambda x: (-CONFIDENCE.index(x[1].confidence), x[0]))
    found = [
        F.when(
            F.coalesce(_holds(head, s), F.lit(False)),
            F.struct(F.lit(i).alias("registration_index"), F.lit(s.format_id).alias("format_id"), F.lit(s.kind).alias("kind"), F.lit(s.confidence).alias("confidence")),
        )
        for i, s in entries
    ]
    return F.array_compact(F.array(*found))


def probe_all(sources: DataFrame, signatures: list[Signature], head: str = "head", kind: str | None = None) -> DataFrame:
    """All matches of each source with ``rank`` from 1; sources without a match give no rows. Bytes are not carried along."""
    rest = [c for c in sources.columns if c not in (head, "tail", "far")]
    found = sources.select(*rest, F.posexplode(ranked_matches(F.col(head), signatures, kind)).alias("at", "match"))
    return found.select(*rest, (F.col("at") + 1).alias("rank"), "match.*")


def probe_best(sources: DataFrame, signatures: list[Signature], head: str = "head", kind: str | None = None) -> DataFrame:
    """Each source once, with its best match or nulls."""
    rest = [c for c in sources.columns if c not in (head, "tail", "far")]
    best = sources.select(*rest, F.get(ranked_matches(F.col(head), signatures, kind), F.lit(0)).alias("match"))
    return best.select(*rest, "match.*")
