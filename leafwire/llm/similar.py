"""SimHash near-dedup of texts by the similarity of their word shingles.

The general form of the SimHash operator, with a wider fingerprint: links are the pairs of texts whose sets of
``width``-word shingles have a Jaccard similarity of ``least`` or more, and SimHash finds them.

1. A text is its set of shingles, each a 64-bit hash; texts of one set are one class. Its fingerprint is
   the majority vote over several mixes of these hashes.
2. The fingerprint is cut into blocks, and covering masks of each block (:mod:`leafwire.llm.simhash`) make its
   tables: a pair shares a bucket if no more than ``radius`` bits of some block differ, and often if more do. The
   number of classes sets the bits of a block, so that a bucket holds about ``FILL`` unlike texts at any
   size, and :func:`tables` then takes as many blocks as keep the chance to miss a pair of
   similarity ``least`` below ``MISS``.
3. Within a bucket 128 other bits of the fingerprints are compared; what is near is linked by
   stars, never by all pairs, and the stars make rough components.
4. No link counts before the similarity of whole sets is computed. The classes of a rough component
   are first compared with its smallest one; what that leaves in more than one component is
   compared in pairs of blocks. A group of near copies is mostly one component by then.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import acos, ceil, comb, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwire.llm.common import keep, lookup, slices, texts
from leafwire.llm.simhash import BITS, components, first_of_components, masks, stars

WIDTH, LEAST = 5, 0.8
#: Of the covering masks of a block; unlike texts in a bucket; chance to miss a pair at the least similarity.
RADIUS, FILL, MISS = 2, 64, 5e-4
VOTES = BITS.astype(np.float64)


def differing(least: float) -> float:
    """Chance that a bit differs between two sets of that similarity; equal sizes are the worst case."""
    return acos(2 * least / (1 + least)) / pi


def caught(bits: int, radius: int, chance: float) -> float:
    """Chance that a block of two fingerprints shares a bucket of one of its masks: that the vectors of the
    differing positions do not span the whole space."""
    size = radius + 1
    ranks, total = [1.0] + [0.0] * size, 0.0
    for k in range(bits + 1):
        total += comb(bits, k) * chance**k * (1 - chance) ** (bits - k) * (1 - ranks[size])
        stay = [(2**r - 1) / (2**size - 1) for r in range(size + 1)]
        ranks = [ranks[r] * stay[r] + (ranks[r - 1] * (1 - stay[r - 1]) if r else 0.0) for r in range(size + 1)]
    return total


@dataclass(frozen=True)
class Tables:
    bits: int  # of a block
    blocks: int
    masks: tuple[tuple[int, ...], ...]  # positions of each table in the fingerprint
    words: int  # 64-bit words of the fingerprint; the last two are compared within buckets
    reach: int  # bits of these that may differ


def tables(classes: int, least: float = LEAST, radius: int = RADIUS, fill: int = FILL, miss: float = MISS) -> Tables:
    """Blocks and masks for so many classes."""
    chance = differing(least)
    need = max(8.0, log2(max(1, classes) / fill))
    bits = min(64, ceil(need * (2 ** (radius + 1) - 1) / 2**radius))
    blocks = ceil(log(miss) / log(1 - caught(bits, radius, chance)))
    at = [[b * bits + i for i in range(bits) if m >> i & 1] for b in range(blocks) for m in masks(radius, bits, seed=b)]
    words = -(-bits * blocks // 64) + 2
    reach = ceil(128 * chance + 3.6 * sqrt(128 * chance * (1 - chance)))
    return Tables(bits, blocks, tuple(map(tuple, at)), words, reach)


def shingles(data: bytes, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes; a text of fewer words is one shingle."""
    words = data.lower().split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, seed)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[x + 1 for x in ends[:-width]]]
    return np.unique(np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :])], np.uint64))


def name_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64))


def fingerprint(found: np.ndarray, words: int, piece: int = 4096) -> np.ndarray:
    """That many 64-bit words: the majority vote over the hashes, mixed anew for each word."""
    r = np.random.default_rng(5)
    odd = r.integers(0, 1 << 63, (2, words), np.uint64) * np.uint64(2) + np.uint64(1)
    lanes = np.arange(8 * words) * 256
    votes = np.zeros(2048 * words)
    for i in range(0, len(found), piece):
        h = found[i : i + piece, None] * odd[0]
        h = (h ^ h >> np.uint64(32)) * odd[1]
        h ^= h >> np.uint64(29)
        votes += np.bincount((h.view(np.uint8).reshape(-1, 8 * words) + lanes).ravel(), minlength=len(votes))
    bits = (votes.reshape(-1, 256) @ VOTES).ravel() * 2 > len(found)
    return np.packbits(bits, bitorder="little").view("<u8")


def buckets(prints: np.ndarray, plan: Tables) -> np.ndarray:
    """One signed 64-bit bucket for each table and fingerprint (a row of words)."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    out = np.empty((len(prints), len(plan.masks)), np.uint64)
    for t, at in enumerate(plan.masks):
        key = np.zeros(len(prints), np.uint64)
        for i in at:
            key = key << np.uint64(1) | bits[:, i]
        out[:, t] = key * np.uint64(len(plan.masks)) + np.uint64(t)
    return out.view(np.int64)


def signatures(docs: DataFrame, plan: Tables) -> DataFrame:
    """doc_id, node (hash of the shingle set), f0, f1 (words that are compared), buckets of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(x) for x in texts(batch)]
            prints = np.stack([fingerprint(x, plan.words) for x in sets])
            each = len(plan.masks)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * each), pa.array(buckets(prints, plan).ravel()))
            last = [pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in (-2, -1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([name_of(x) for x in sets], pa.int64()), *last, lists], ["doc_id", "node", "f0", "f1", "buckets"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, f0 long, f1 long, buckets array<long>")


def with_node(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the hash of each row's shingle set."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.append_column(name, pa.array([name_of(shingles(x)) for x in texts(batch)], pa.int64()))

    return docs.mapInArrow(run, f"{fields}, `{name}` long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node, items of the shingle set of every row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(x) for x in texts(batch)]
            offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([name_of(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], ["node", "items"])

    return docs.select("text").mapInArrow(run, "node long, items array<long>")


def linked(sets: list[np.ndarray], roots: np.ndarray, least: float = LEAST) -> list[tuple[int, int]]:
    """Pairs of ``least`` similarity that join what ``roots`` leaves apart."""
    sizes = np.array([len(x) for x in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(code, kind="stable")]
    first, at, label, out = np.cumsum(count) - count, np.cumsum(sizes) - sizes, roots.copy(), []
    for i in range(len(sets)):
        if (label == label[i]).all():
            break
        c = code[at[i] : at[i] + sizes[i]]
        n = count[c]
        shared = np.bincount(owners[np.repeat(first[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(sets))
        near = np.flatnonzero((shared / (sizes[i] + sizes - shared) >= least) & (label != label[i]))
        names, which = np.unique(label[near], return_index=True)
        out += [(i, int(j)) for j in near[which]]
        label[np.isin(label, names)] = label[i]
    return out


def rest_links(rows: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Edges (u, v) between the roots of the rows (k, node, root) of each rough component k that has several."""
    full = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("k", "n")
    rows = rows.join(full, "k").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "node", "root").join(sets, "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, roots, held = None, [], []

        def edges() -> pa.RecordBatch:
            found = linked(held, np.array(roots)) if held else []
            return pa.RecordBatch.from_arrays([pa.array([roots[i] for i, _ in found], pa.int64()), pa.array([roots[j] for _, j in found], pa.int64())], ["u", "v"])

        for batch in batches:
            items = batch.column("items")
            for i, (g, root) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("g", "root")))):
                if g != group:
                    yield edges()
                    group, roots, held = g, [], []
                roots.append(root)
                held.append(items[i].values.to_numpy())
        yield edges()

    return rows.select("g", "root", "items").repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long").distinct()


def rough(classes: DataFrame, plan: Tables, block: int = 2000) -> DataFrame:
    """(node, k): the rough component of each class that shares a bucket with one near it; k is its smallest node."""
    rows = classes.select(F.explode("buckets").alias("g"), "node", "f0", "f1")
    hot = lookup(rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > block))
    found = components(stars(rows.join(hot, "g", "left"), ["f0", "f1"], plan.reach, block))
    return keep(found.withColumnRenamed("root", "k"))


def near_copies(docs: DataFrame, block: int = 500, fill: int = FILL) -> DataFrame:
    """doc_id, fingerprint (hash of the shingle set), component_id of every row of ``docs`` that has an id.

    Components are those of the pairs whose shingle sets have a similarity of LEAST or more.
    Null and empty texts are one class. component_id is the smallest doc_id reachable.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    plan = tables(docs.count(), fill=fill)
    marked = keep(signatures(docs, plan))
    classes = marked.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("f0", "f1", "buckets")])
    named = keep(marked.groupBy("node").agg(F.min("doc_id").alias("rep")))
    rows = rough(classes, plan)
    wanted = lookup(named.join(rows, "node", "left_semi").select(F.col("rep").alias("_id")))
    sets = shingle_sets(docs.join(wanted, F.col("doc_id") == F.col("_id"), "left_semi"))
    sets = keep(sets.groupBy("node").agg(F.first("items").alias("items")))
    pairs = rows.where("node <> k").select(F.col("k").alias("u"), F.col("node").alias("v"))
    pairs = pairs.join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v").join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u")
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("a", "b")))
    near = F.col("shared") / (F.size("a") + F.size("b") - F.col("shared")) >= LEAST
    # k is the smallest of its rough component, so that its links are stars as they are
    judged = pairs.select(F.col("u").alias("k"), F.col("v").alias("node"), F.when(near, F.col("u")).otherwise(F.col("v")).alias("root"))
    found = keep(rows.where("node = k").select("k", "node", F.col("k").alias("root")).union(judged))
    more = keep(rest_links(found, sets, block))
    if not more.isEmpty():
        top = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = found.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    label = keep(named.join(found.select("node", "root"), "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")))
    lowest = label.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = label.join(lowest, "root").select("node", "component_id")
    return marked.select("doc_id", "node").join(label, "node").select("doc_id", F.col("node").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of its smallest id; all columns stay.

    Rows without an id go by their text alone. An empty table stays empty.
    """
    return first_of_components(docs, near_copies(docs), with_node)
