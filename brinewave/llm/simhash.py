"""SimHash near-duplicates, with pivot distance tables.

Fingerprints: 64 bits, each set if more than half of the XXH64 (seed 42) of a text's word
shingles have it set. Equal fingerprints are one node. Two nodes within `radius` bits agree
on at least bands - radius of `bands` bit bands (pigeonhole), so nodes meet under
the bits of every such choice of bands. Where nodes meet, each carries its Hamming distances to
reference fingerprints; by the triangle inequality a pair whose distances to
any reference differ by more than the radius is discarded, and what is left is
verified on the fingerprints. This is exact, whatever the number of bands; that follows
the number of nodes, so that few meet by chance.

A meeting place with more than `CHUNK` nodes is cut into chunks, and each pair of chunks
is a task's work of its own: memory is bounded and no pair is lost. A task gives
its links as a spanning forest, not as pairs.

Nulls and texts without words have fingerprint zero and link like any other; null ids
never become a component's id unless it has no other. Repeated rows and repeated ids
stay rows. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from brinewave.llm.components import components, local_roots
from brinewave.llm.rows import named, packed, unpacked
from brinewave.session import cut_lineage

SEED = 42
PIVOTS = 16
CHUNK = 4096
#: A shingle batch in one call, so that long texts stay within some MB.
STEP = 1 << 16


def fingerprint(text: str | None, width: int) -> int:
    """The fingerprint as an unsigned number; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    stops = ends[width - 1 :] if len(words) >= width else ends[-1:]
    counts = np.zeros(64, "i8")
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        pairs = zip(starts[at : min(n, at + STEP)].tolist(), stops[at : at + STEP].tolist())
        h = np.array([digest(line[a:b], SEED) for a, b in pairs], ">u8")
        counts += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text") -> DataFrame:
    """The columns of docs with `fp`, the fingerprint as a signed long, for `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            fp = np.array([fingerprint(t.as_py(), width) for t in batch.column(at)], "u8").view("i8")
            yield batch.set_column(at, "fp", pa.array(fp))

    kept = docs.select(*[c for c in docs.columns if c != text], F.col(text).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text"] + ["fp long"])
    return kept.mapInArrow(run, schema)


def band_choices(n: int, radius: int) -> list[int]:
    """Bit masks: two fingerprints within `radius` agree on all bits of at least one of them.

    With b bands every choice of b - radius of them; the fewest bands whose choices
    hold enough bits for n nodes to meet 32 others by chance at most.
    """
    for bands in range(radius + 2, radius + 5):
        edges = [round(i * 64 / bands) for i in range(bands + 1)]
        parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        masks = [sum(c) for c in itertools.combinations(parts, bands - radius)]
        if n >> min(m.bit_count() for m in masks) <= 32:
            break
    return masks


def pivots(count: int) -> np.ndarray:
    """Reference fingerprints, the same at every call."""
    return np.random.default_rng(SEED).integers(0, 2**64, count, dtype="u8")


def linked(fp: np.ndarray, end: np.ndarray, side: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within runs of rows (each ends before end[i]): pairs of one side are left to other tasks unless side is 0."""
    heads, tails = [], []
    first = np.arange(len(fp))
    lag = 1
    while len(first := first[first + lag < end[first]]):
        for at in range(0, len(first), STEP):
            i = first[at : at + STEP]
            j = i + lag
            keep = (side[i] == 0) | (side[i] != side[j])
            i, j = i[keep], j[keep]
            for p in range(table.shape[1]):  # the pivot tables, one coordinate after the other
                near = np.abs(table[i, p] - table[j, p]) <= radius
                i, j = i[near], j[near]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
            heads.append(i[near])
            tails.append(j[near])
        lag += 1
        if len(heads) > 512:
            a, b = np.concatenate(heads), np.concatenate(tails)
            root = local_roots(a, b, len(fp))
            kept = np.flatnonzero(root != np.arange(len(fp)))
            heads, tails = [root[kept]], [kept]
    if not heads:
        return first[:0], first[:0]
    root = local_roots(np.concatenate(heads), np.concatenate(tails), len(fp))
    kept = np.flatnonzero(root != np.arange(len(fp)))
    return root[kept], kept


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole runs of equal place from sorted batches: place, fp, side. No run is longer than two chunks."""
    rest: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        rest.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "fp", "side")))
        place, fp, side = (np.concatenate(x) for x in zip(*rest))
        cut = np.searchsorted(place, place[-1])
        if cut:
            yield place[:cut], fp[:cut], side[:cut]
        rest = [(place[cut:], fp[cut:], side[cut:])]
    if rest:
        place, fp, side = (np.concatenate(x) for x in zip(*rest))
        if len(place):
            yield place, fp, side


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots(PIVOTS)
        for place, fp, side in _runs(batches):
            end = np.searchsorted(place, place, "right")
            bits = fp.view("u8")
            table = np.bitwise_count(bits[:, None] ^ refs).astype("i1")
            a, b = linked(bits, end, side, table, radius)
            if len(a):
                yield pa.record_batch({"a": fp[a], "b": fp[b]})

    return run


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """a, b: links that connect what lies within `radius` bits of each other; nodes has distinct `fp`."""
    masks = band_choices(nodes.count(), radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)])
    # an equal hash of two meeting places only means more pairs to discard
    met = nodes.select("fp", F.explode(keys).alias("key"))
    crowds = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
    chunks = F.ceil(F.coalesce("n", F.lit(1)) / CHUNK).cast("int")
    sized = met.join(crowds, "key", "left").withColumn("m", chunks)
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("m")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other")
    dealt = sized.withColumn("mine", mine).select("fp", "key", "mine", other)
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    # side 0: pairs within a chunk count; 1 and 2: only pairs of the two chunks
    side = F.when(low == high, 0).when(F.col("mine") == low, 1).otherwise(2)
    places = dealt.select(F.xxhash64("key", low, high).alias("place"), "fp", side.cast("int").alias("side"))
    return places.repartition("place").sortWithinPartitions("place").mapInArrow(_links(radius), "a long, b long")


def classes(docs: DataFrame, key: str, text: str, width: int, radius: int) -> DataFrame:
    """_key, _same (a hash of the text), fp, root (smallest fingerprint reachable) and component_id for every row."""
    rows = docs.select(named(key).alias("_key"), F.xxhash64(named(text)).alias("_same"), named(text).alias("text"))
    rows = cut_lineage(fingerprints(rows, width))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("_key").alias("_least")))
    roots = components(cut_lineage(links(nodes, radius)))
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("_least").alias("component_id"))
    return rows.join(cut_lineage(grouped.join(least, "root").select("fp", "root", "component_id")), "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """key, fp (signed) and component_id, the smallest key reachable, for every row."""
    return classes(docs, key, text, width, radius).select(F.col("_key").alias(key), "fp", "component_id")


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest key (nulls last), then of the smallest text hash."""
    found = cut_lineage(classes(docs, key, text, width, radius))
    order = F.struct(F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.col("_same").alias("s"))
    first = found.groupBy("root").agg(F.min(order).alias("_c"))
    same = found.join(first, "root").where(F.col("_key").eqNullSafe(F.col("_c.k")) & (F.col("_same") == F.col("_c.s")))
    chosen = cut_lineage(same.groupBy("_key", "_same").agg(F.count(F.lit(1)).alias("_n")))
    names = docs.columns
    rows = docs.select(packed(names), named(key).alias("_k"), F.xxhash64(named(text)).alias("_s"))
    on = F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_s") == F.col("_same"))
    one, more = chosen.where("_n = 1"), chosen.where("_n > 1")
    repeated = rows.join(more, on, "left_semi").dropDuplicates(["_k", "_s"])
    return rows.join(one, on, "left_semi").unionByName(repeated).select(*unpacked(names))
