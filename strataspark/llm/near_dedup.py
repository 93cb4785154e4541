"""Near-duplicates by SetSketch registers: banding, joint likelihood estimate, verification on full shingle sets.

A document's set of word shingles is sketched by registers that are exponentially spaced, truncated minima: register i
is floor(1 - log_b x_i), x_i the least of the set's exponential variates, so registers of two sets merge by maximum and
agree with a probability near the sets' similarity. Four registers make a band; documents that share a band are
candidates. The similarity of a candidate pair is estimated jointly by maximum likelihood from the counts of larger,
smaller and equal registers and the known set sizes; pairs within the estimate's error of the threshold are verified on
the full sets.

No bucket is expanded into all its pairs:

1. Rows with equal sets are one class; one row per class goes on, under the class's number.
2. In each bucket all members are paired with its smallest one only. Verified links give first components.
3. A link that step 2 cannot have seen joins two different components within a bucket, so only buckets that still hold
   several components go on. From large ones go the members that cannot reach the threshold there, since too many of
   their shingles are in no other set.
4. Pivot rounds in buckets of more than a block's rows: each member outside the bucket's largest component meets one
   member of it, chosen by hash for each bucket. Rounds are linear, and go on while they join a fair share of what is left.
5. The rest of the large buckets is compared block by block on the full sets, members outside the largest component
   against all, each pair in the first band it shares only; a task's links leave it as a forest, so there are fewer than
   its rows. In small buckets a bit sketch discards pairs far below the threshold inside the join, and what passes is
   estimated and verified as before.
6. Components of all links; each row gets the smallest id of its class's component.

Step 5 is quadratic in those members of a large bucket that share most of their shingles and yet link with neither the
pivots nor each other: its comparisons, and beyond 2,048 rows or 16 MB the copies of their sets. Its output is not.

Full sets are rebuilt once, for candidates only. Joins on a hot key have written tables on both sides, so AQE splits
them. A pair at the threshold shares none of the 32 bands with probability 5e-8.

A class goes by a number of its own, so links do not depend on ids: texts that share an id are told apart, and rows
without id carry links like any others.

Defined results: a null or empty text, or one of white space only, has no shingles and is linked with nothing; rows
with equal sets are linked; a component has its smallest id, null if no row of it has one; an empty table gives an empty
result. Texts are read whole. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.chunked import blocks, small_batches, texts_of
from strataspark.llm.components import components
from strataspark.llm.storage import discard, materialise

REGISTERS, BAND_ROWS = 128, 4
BANDS = REGISTERS // BAND_ROWS
#: The sketch's base, rate and largest register value: 16-bit registers for sets up to 2^64.
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Pairs whose estimate is this many standard errors below the threshold are not verified.
ERRORS = 4.5
#: Buckets from this size on are compared block by block on the full sets; a block's most rows, and about its most bytes.
LARGE, BLOCK_ROWS, BLOCK_BYTES = 48, 2048, 16 << 20
#: About the most bytes of shingles in a part when shared ones are counted.
PART_BYTES = 16 << 20
#: Pivot rounds go on while they leave no more than this share of the members outside their bucket's largest component.
WORTH = 0.8
#: Characters hashed at once.
BLOCK = 500_000
#: Bits of a register in the bit sketch.
LANE = 4
WORDS = REGISTERS * LANE // 64

_SEED = np.random.default_rng(20_240_601)
_FACTORS = _SEED.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BYTES = _SEED.integers(0, 1 << 63, (256, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _SEED.integers(0, 1 << 63, 16, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in bytes, and where each starts. Words lie between white space."""
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    first = np.repeat(starts, lengths)
    at = np.flatnonzero(inside)
    place = at - first
    value = _BYTES[place & 255, data[at]]
    if int(lengths.max()) > 256:
        value = value * (2 * (place >> 8).astype(np.uint64) + np.uint64(1))
    sums = np.add.reduceat(value, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return mixed(sums + lengths.astype(np.uint64)), starts


def shingle_sets(texts: list[str], shingle: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes: ``shingle`` words in lower case (A-Z), or the whole of a shorter text."""
    for block in blocks(texts, BLOCK):
        parts = [x.encode("utf-8", "surrogatepass").lower() for x in block]
        data = np.frombuffer(b"\n".join(parts), np.uint8)
        words, starts = word_hashes(data)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in parts)]))
        n = max(0, len(words) - shingle + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(shingle):
            rolled += words[k : k + n] * _PLACES[k]
        rolled = mixed(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= shingle:
                yield np.unique(rolled[a : b - shingle + 1])
            elif b > a:
                short = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mixed(mixed(np.array([short], np.uint64)))
            else:
                yield np.zeros(0, np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set: truncated minima of exponential variates on a logarithmic scale."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * _FACTORS).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64.000001) / RATE
    # The largest value is for the smallest variate; the shift keeps sets of one element above zero.
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + 8192, 0, TOP).astype("<u2")


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def lanes(sketch: np.ndarray) -> np.ndarray:
    """A few mixed bits of each register, packed into 64-bit words: the distance of two follows the unequal registers."""
    bits = (mixed(sketch.astype(np.uint64) + np.arange(REGISTERS, dtype=np.uint64) * np.uint64(1 << 20)) >> np.uint64(40)).astype(np.uint8) & (2**LANE - 1)
    return np.packbits((bits[:, None] >> np.arange(LANE)) & 1).view("<i8")


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 200) -> np.ndarray:
    """Maximum-likelihood similarity of pairs, from their registers (rows of ``a`` and ``b``) and set sizes."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))

    def rate(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    for s in range(steps + 1):
        j = most * s / steps
        up, down = rate(u - v * j), rate(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            like = np.where(above > 0, above * np.log(up), 0) + np.where(below > 0, below * np.log(down), 0)
            like += np.where(above + below < a.shape[1], (a.shape[1] - above - below) * np.log(np.maximum(1 - up - down, 1e-300)), 0)
        better = like > best
        best, at = np.where(better, like, best), np.where(better, j, at)
    return at


def sketch_documents(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, text_sha256, n, digest, regs, s0…): set size, digest of the set, registers and bit sketch; from (id, body, text_sha256)."""
    names = [f"s{i}" for i in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n, digest, regs, bits = [], [], [], []
            for s in shingle_sets(texts_of(batch.column(1)), shingle):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketch = registers(s) if len(s) else None
                regs.append(sketch.tobytes() if len(s) else None)
                bits.append(lanes(sketch) if len(s) else np.zeros(WORDS, np.int64))
            packed = np.array(bits, np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary()), *(pa.array(packed[:, i]) for i in range(WORDS))],
                names=["id", "text_sha256", "n", "digest", "regs", *names],
            )

    return docs.mapInArrow(run, ", ".join(["id long, text_sha256 string, n long, digest binary, regs binary", *(f"{x} long" for x in names)]))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, hashes): the full set, as sorted 64-bit numbers; from (id, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [s.tobytes() for s in shingle_sets(texts_of(batch.column(1)), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "hashes"])

    return docs.mapInArrow(run, "id long, hashes binary")


def _estimated(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, n_a, n_b, regs_a, regs_b) whose joint estimate may reach the threshold."""
    j = percent / 100
    least = j - ERRORS * (j * (1 - j) / REGISTERS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2000):
            if batch.num_rows:
                n_a, n_b = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
                regs = [np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (4, 5)]
                batch = batch.filter(pa.array(joint_estimate(*regs, n_a, n_b) >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets reach the threshold. The hot side, a bucket's first member, is joined last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            batch = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])

    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("hashes_a")), "a")
    return both.select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The distinct candidate pairs (a, b) whose joint estimate may reach the threshold."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    return materialise(_estimated(pairs.join(side("b"), "b").join(side("a"), "a"), percent).distinct(), "likely-pairs")


def _sets_of(wanted: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The full set of each wanted class; merged whatever their number now, as the candidates grow with the corpus.

    A class's text is found by its row's id and text hash; of a row that occurs several times one is taken."""
    rows = materialise(wanted.distinct().join(reps.select("id", "row_id", "row_sha256", "copies"), "id"), "candidate-rows")
    body = docs.withColumnRenamed("id", "doc")
    same = F.col("doc").eqNullSafe(F.col("row_id")) & (F.col("text_sha256") == F.col("row_sha256"))
    held = lambda copies: body.join(rows.filter(copies).hint("merge"), same).select("id", "body")
    found = held("copies = 1")
    if not rows.filter("copies > 1").isEmpty():
        found = found.union(held("copies > 1").dropDuplicates(["id"]))
    return materialise(_sets(found, shingle), "candidate-sets")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``id``, ``text_sha256`` (null as the empty text), ``n`` (shingles), ``root`` (the component's
    number, null without shingles) and ``component`` (its smallest id)."""
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    body = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"), sha.alias("text_sha256"))
    sketches = materialise(sketch_documents(body, shingle), "sketches")
    # Numbered as it is written: whatever the numbers are, all later steps read the same.
    numbered = sketches.filter("n > 0").groupBy("digest").agg(F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id())
    classes = materialise(numbered, "classes")
    lane = [f"s{i}" for i in range(WORDS)]
    first = sketches.join(classes.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("rep")))
    one = first.groupBy("node").agg(F.count("*").alias("copies"), F.first(F.struct("text_sha256", "rep", "n", "regs", *lane)).alias("row"))
    reps = materialise(
        one.select(F.col("node").alias("id"), "copies", F.col("row.rep").alias("row_id"), F.col("row.text_sha256").alias("row_sha256"), "row.n", "row.regs", *(f"row.{x}" for x in lane)), "representatives"
    )
    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("regs", k * (2 * BAND_ROWS) + 1, 2 * BAND_ROWS)))
    bands = reps.select("id", F.posexplode(key).alias("band", "bucket"))
    full = materialise(bands.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("size")).filter("size > 1").select("bucket", "first"), "buckets")
    members = materialise(bands.join(full, "bucket"), "members")
    # The sets of all candidates, once: every verification below reads this table.
    sets = _sets_of(members.select("id"), reps, body, shingle)
    star = members.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    found = components(_verified(_likely(star, reps, percent), sets, percent))
    roots = _late_links(members.select("bucket", "band", "id"), found, reps, sets, percent).withColumnRenamed("root", "found")
    placed = materialise(classes.join(roots, "node", "left").select("digest", "rep", F.coalesce("found", "node").alias("root")), "class-roots")
    least = materialise(placed.groupBy("root").agg(F.min("rep").alias("component")), "component-ids")
    named = materialise(placed.join(least, "root").select("digest", "root", "component"), "class-components")
    linked = sketches.filter("n > 0").select("id", "text_sha256", "n", "digest").join(named, "digest").select("id", "text_sha256", "n", "root", "component")
    return linked.union(sketches.filter("n = 0").select("id", "text_sha256", "n", F.lit(None).cast("long").alias("root"), F.col("id").alias("component")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id`` (the smallest id reachable over links of at least
    ``percent`` similarity, itself included) and ``kept`` (whether that is its own id)."""
    return near_components(docs, id_col, text_col, shingle, percent).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


def _late_links(members: DataFrame, roots: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) with the links between members of one bucket that ``roots`` has in different components."""
    held = _open_members(members, roots)
    large = held.filter(F.col("size") >= LARGE)
    gone = _out_of_reach(large.select("id").distinct(), reps, sets, percent)
    # In a large bucket alone: elsewhere such a member may still have partners that are not among the large buckets' members.
    left_in = held.join(gone.withColumn("large", F.lit(True)), "id", "left").filter((F.col("size") < LARGE) | F.col("large").isNull())
    former, held = held, materialise(left_in.drop("large"), "open-members")
    discard(former)
    before = None
    while True:
        wide = held.filter(F.col("size") > BLOCK_ROWS)
        left = wide.filter("comp <> major").select("id").distinct().count()
        if not left or (before is not None and left > WORTH * before):
            break
        before = left
        links = _verified(_likely(_pivot_pairs(wide, before), reps, percent), sets, percent)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))
        former, held = held, _open_members(held, roots)
        discard(former)
    lane = [f"s{i}" for i in range(WORDS)]
    few = held.filter(F.col("size") < LARGE).join(reps.select("id", "n", *lane), "id")
    late = _verified(_likely(_met(few, percent), reps, percent), sets, percent)
    large = held.filter(F.col("size") >= LARGE)
    if not large.isEmpty():
        late = late.union(_block_links(large, reps, sets, percent))
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(late))


def _open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, band, id, comp, major, size): the members of buckets that hold several components, each with its own
    component, the bucket's largest component and its number of members."""
    placed = members.select("bucket", "band", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
    placed = materialise(placed.select("bucket", "band", "id", F.coalesce("root", "id").alias("comp")), "placed-members")
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    largest = F.max(F.struct("size", "comp"))["comp"].alias("major")
    several = sizes.groupBy("bucket").agg(largest, F.sum("size").alias("size"), F.count("*").alias("comps")).filter("comps > 1")
    several = materialise(several.drop("comps"), "open-buckets")
    held = materialise(placed.join(several, "bucket"), "open-members")
    discard(placed)
    discard(several)
    return held


def _pivot_pairs(large: DataFrame, seed: int) -> DataFrame:
    """The distinct pairs (a, b) of a bucket's pivot, a member of its largest component chosen by hash, and each member of
    another component. Every bucket has its own pivot, so a member meets up to one for each band."""
    of = F.min_by("id", F.xxhash64("id", "bucket", F.lit(seed))).alias("a")
    pivots = materialise(large.filter("comp = major").groupBy("bucket").agg(of), "pivots")
    return large.filter("comp <> major").select("bucket", F.col("id").alias("b")).join(pivots, "bucket").select("a", "b").distinct()


def _out_of_reach(wanted: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ids of ``wanted`` that reach the threshold with no other one of them: too many of their shingles are in no other set.

    Shingles are dealt out by hash to parts of bounded size; one that a batch holds twice leaves it once, without owner.
    """
    found = materialise(wanted.join(sets, "id"), "large-sets")
    total = found.agg(F.sum(F.length("hashes"))).first()[0] or 0
    parts = np.uint64(1 + 2 * total // PART_BYTES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            owner = np.repeat(batch.column(0).to_numpy(), [len(x) for x in lists])
            hashes, at, times = np.unique(np.concatenate([*lists, np.zeros(0, np.uint64)]), return_index=True, return_counts=True)
            owner = np.where(times > 1, -1, owner[at])
            part = (hashes % parts).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.diff(part[order], prepend=-1))
            cut = lambda x: pa.array([y.tobytes() for y in np.split(x[order], edge[1:])] if len(edge) else [], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part[order][edge], pa.int64()), cut(owner), cut(hashes)], names=["part", "owner", "hashes"])

    def own(table: pa.Table) -> pa.Table:
        owner, hashes = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(k)]) for k, kind in ((1, np.int64), (2, np.uint64)))
        _, at, times = np.unique(hashes, return_index=True, return_counts=True)
        single = owner[at][times == 1]
        ids, n = np.unique(single[single >= 0], return_counts=True)
        return pa.table({"id": pa.array(ids, pa.int64()), "own": pa.array(n, pa.int64())})

    counted = found.select("id", "hashes").mapInArrow(deal, "part long, owner binary, hashes binary").groupBy("part").applyInArrow(own, "id long, own long")
    owned = counted.groupBy("id").agg(F.sum("own").alias("own"))
    return materialise(owned.join(reps.select("id", "n"), "id").filter(100 * (F.col("n") - F.col("own")) < percent * F.col("n")).select("id"), "out-of-reach")


def _met(found: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) of members of one small bucket, of different components, that the bit sketch lets pass."""
    lane = [f"s{i}" for i in range(WORDS)]
    x = found.filter("comp <> major").select("bucket", *(F.col(c).alias(f"{c}_x") for c in ("id", "comp", "n", "major", *lane)))
    y = found.select("bucket", *(F.col(c).alias(f"{c}_y") for c in ("id", "comp", "n", *lane)))
    j = percent / 100
    # Unequal registers of a pair at the threshold, and of their bits on average half: mean and variance of the distance.
    unequal = REGISTERS * (1 - j)
    far = LANE / 2 * unequal + ERRORS * (unequal * LANE / 4 + (LANE / 2) ** 2 * unequal * j) ** 0.5
    distance = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in lane[1:]), F.bit_count(F.col("s0_x").bitwiseXOR(F.col("s0_y"))))
    once = (F.col("comp_y") == F.col("major_x")) | (F.col("id_x") < F.col("id_y"))
    sized = (100 * F.col("n_x") >= percent * F.col("n_y")) & (100 * F.col("n_y") >= percent * F.col("n_x"))
    met = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("comp_x") != F.col("comp_y")) & once & sized & (distance <= far))
    return met.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct()


def _block_links(large: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of large buckets: members outside the largest component against all, on the full sets, block by block.

    Both sides are dealt into blocks of bounded rows and bytes; a task holds one of each. A pair is compared in the first
    band it shares only, and links leave a task as a forest of components: fewer than the task's rows.
    """
    sized = large.join(reps.select("id", "n", "regs"), "id").withColumn("minor", F.col("comp") != F.col("major"))
    blocks = lambda rows: F.greatest(F.lit(1), F.ceil(F.count_if(rows) / BLOCK_ROWS), F.ceil(F.sum(F.when(rows, F.col("n"))) * 8 / BLOCK_BYTES)).cast("int")
    width = materialise(sized.groupBy("bucket").agg(blocks(F.col("minor")).alias("lefts"), blocks(F.lit(True)).alias("rights")), "bucket-blocks")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = sized.join(width, "bucket")
    rest = ("band", "id", "comp", "major", "regs")
    left = dealt.filter("minor").select("bucket", own("lefts").alias("i"), others("rights").alias("j"), F.lit(0).alias("side"), *rest)
    right = dealt.select("bucket", others("lefts").alias("i"), own("rights").alias("j"), F.lit(1).alias("side"), *rest)
    rows = left.union(right).join(sets, "id")

    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by("side")
        band, side, ids, comp, major = (table.column(c).to_numpy() for c in ("band", "side", "id", "comp", "major"))
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        size = np.array([len(h) for h in hashes])
        keys = np.frombuffer(b"".join(table.column("regs").to_pylist()), f"<u{2 * BAND_ROWS}").reshape(-1, BANDS)
        n = int((side == 0).sum())
        due = (comp[:n, None] != comp[None, n:]) & ((comp[n:] == major[n:])[None, :] | (ids[:n, None] < ids[None, n:]))
        for k in range(int(band[0])):
            due &= keys[:n, k][:, None] != keys[None, n:, k]
        due &= (100 * size[:n, None] >= percent * size[None, n:]) & (100 * size[None, n:] >= percent * size[:n, None])
        a, b = _similar(due, hashes, size, n, percent)
        return pa.table({"a": pa.array(ids[:n][a], pa.int64()), "b": pa.array(ids[n:][b], pa.int64())}).take(pa.array(_forest(comp[:n][a], comp[n:][b]), pa.int64()))

    return rows.select("bucket", "i", "j", "side", *rest, "hashes").groupBy("bucket", "i", "j").applyInArrow(links, "a long, b long")


def _similar(due: np.ndarray, hashes: list[np.ndarray], size: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The due pairs of the first ``n`` sets with the others that reach the threshold, by products of incidence matrices."""
    left, right = np.flatnonzero(due.any(axis=1)), np.flatnonzero(due.any(axis=0))
    if not len(left):
        return left, left
    held = [*(hashes[k] for k in left), *(hashes[n + k] for k in right)]
    owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
    values, numbers = np.unique(np.concatenate(held), return_inverse=True)
    ours = owner < len(left)
    shared = (np.bincount(numbers[ours], minlength=len(values)) > 0) & (np.bincount(numbers[~ours], minlength=len(values)) > 0)
    kept = shared[numbers]
    order = np.argsort(numbers[kept], kind="stable")
    owner, column, total = owner[kept][order], (np.cumsum(shared) - 1)[numbers[kept][order]], int(shared.sum())
    both = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, total, 2048):
        lo, hi = np.searchsorted(column, (first, first + 2048))
        part = np.zeros((len(held), min(2048, total - first)), np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        both += part[: len(left)] @ part[len(left) :].T
    union = size[:n][left][:, None] + size[n:][right][None, :] - both
    a, b = np.nonzero((100 * both >= percent * union) & due[np.ix_(left, right)])
    return left[a], right[b]


def _forest(one: np.ndarray, two: np.ndarray) -> list[int]:
    """Positions of links (one, two) that join what no earlier one joined: fewer than there are ends."""
    if not len(one):
        return []
    ends, numbers = np.unique(np.concatenate((one, two)), return_inverse=True)
    pairs = np.sort(numbers.reshape(2, -1), axis=0)
    first = np.unique(pairs[0] * len(ends) + pairs[1], return_index=True)[1]
    above, out = list(range(len(ends))), []

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for k in first.tolist():
        x, y = top(int(pairs[0, k])), top(int(pairs[1, k]))
        if x != y:
            above[y] = x
            out.append(k)
    return out
