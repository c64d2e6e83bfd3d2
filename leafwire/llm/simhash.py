"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint is the majority vote over the XXH64 values of a text's word
shingles. Every bit position is given a fixed vector of ``radius + 1`` bits; each
non-zero vector v makes one mask of the positions whose vector is not orthogonal to v.
The vectors of up to ``radius`` differing positions span too small a space, so some v is
orthogonal to all of them and its mask holds none: each pair within the radius shares a
bucket of some table.

Equal fingerprints are one class before anything is compared. A bucket with more
classes than ``block`` is dealt out in pairs of blocks, and each task returns a star
for each group it has linked rather than its pairs, so no task or result grows with
the square of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwire.llm.common import keep, lookup, slices, texts, unused

BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
LANES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of a text; zero if it has no words."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(line, seed)]
    else:
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *[x + 1 for x in ends[: -width]]]
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :])]
    lanes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8) + LANES
    votes = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits(votes.ravel() * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (long) of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = pa.array([fingerprint(x, width, seed) for x in texts(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def masks(radius: int = 3, bits: int = 64, seed: int = 7) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks, as signed 64-bit integers.

    Positions get the non-zero vectors in turn, shuffled by ``seed``: any assignment
    covers, an even one keeps the masks equally selective.
    """
    top = 1 << (radius + 1)
    vectors = np.random.default_rng(seed).permutation(np.arange(bits) % (top - 1) + 1)
    out = []
    for v in range(1, top):
        odd = [bin(int(x) & v).count("1") & 1 for x in vectors]
        mask = sum(1 << i for i, o in enumerate(odd) if o)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n vertices reaches over the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def near_pairs(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges between the rows of each group (rows are sorted by group) in reach of each other.

    A fingerprint is a row of one or more 64-bit words.
    """
    fps = fps.reshape(len(fps), -1)
    left, right = [], []
    lag, live = 1, np.arange(len(fps))
    while len(live := live[live + lag < len(fps)]) and len(live := live[group[live] == group[live + lag]]):
        hit = live[np.bitwise_count(fps[live] ^ fps[live + lag]).sum(1, dtype=np.int32) <= radius]
        left.append(hit)
        right.append(hit + lag)
        if sum(map(len, left)) > 1 << 20:  # fold what is linked so far into stars
            label = smallest_labels(len(fps), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(label != np.arange(len(fps)))
            left, right = [moved], [label[moved]]
        lag += 1
    if not left:
        return live[:0], live[:0]
    label = smallest_labels(len(fps), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return moved, label[moved]


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = smallest_labels(len(names), at[: len(u)], at[len(u) :])
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def folded(edges: DataFrame) -> DataFrame:
    """As few edges (u, v) as connect the same nodes within each task, dealt by u: the many
    centres that a node has got in different buckets become one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, limit = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 1 << 20
        for batch in batches:
            us.append(batch.column("u").to_numpy())
            vs.append(batch.column("v").to_numpy())
            if sum(map(len, us)) > limit:
                u, v = contracted(np.concatenate(us), np.concatenate(vs))
                us, vs, limit = [u], [v], max(limit, 2 * len(u))
        u, v = contracted(np.concatenate(us), np.concatenate(vs))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.repartition("u").mapInArrow(run, "u long, v long")


def stars(rows: DataFrame, words: list[str], radius: int, block: int) -> DataFrame:
    """Edges (u, v) between nodes of ``rows`` (g, node, the fingerprint's words, n) that connect all
    nodes of a bucket g in reach of each other; n: the bucket's rows, null if they are at most ``block``."""
    rows = rows.withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block).cast("int"), F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.when(F.col("blocks") == 1, F.col("g")).otherwise(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")))
    rows = rows.select(pair.alias("g"), "node", *words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * (2 + len(words))

        def linked(g: np.ndarray, node: np.ndarray, *fps: np.ndarray) -> pa.RecordBatch:
            a, b = near_pairs(np.stack(fps, 1).view(np.uint64), g, radius)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["u", "v"])

        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, ("g", "node", *words))]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last group may go on
            if cut:
                yield linked(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield linked(*held)

    return folded(rows.repartition("g").sortWithinPartitions("g", "node").mapInArrow(run, "u long, v long"))


def links(classes: DataFrame, radius: int = 3, block: int = 2000) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect all in reach of each other.

    Buckets are named by a hash, which can only add comparisons. No order of rows, null or tie
    matters: ``classes`` (fp) has each fingerprint once.
    """
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks(radius))]))
    rows = classes.select("fp", tables.alias("b")).select(F.xxhash64("b.t", "b.k").alias("g"), F.col("fp").alias("node"), "fp")
    full = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    return stars(rows.join(full, "g"), ["fp"], radius, block)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (u, v).

    Alternates large-star and small-star steps until nothing moves. Edges go from the larger vertex, and only smaller
    neighbours decide where a vertex moves, so a root's many edges are never gathered: they are the
    plain side of an equi-join with the partial minima.
    """

    def large(e: DataFrame) -> DataFrame:
        """A vertex's larger neighbours move to the smallest one."""
        low = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        return e.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        """A vertex and its smaller neighbours move to the smallest one."""
        low = e.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        return low.select(F.inline(F.array(*[F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v")]))).where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    was, now = None, state(e)
    while now != was:
        e = keep(small(large(e)))
        was, now = now, state(e)
    return e.select(F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.col("v").alias("root")) for c in ("u", "v")]))).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 3, block: int = 2000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``.

    A null or empty text, or one of white space only, has fingerprint zero and links like
    any other. Texts of fewer than ``width`` words are one shingle. Rows that share a
    doc_id each keep their own fingerprint and row. component_id is the smallest non-null
    doc_id in reach. Other columns are ignored. An empty table gives an empty result.
    """
    fps = keep(fingerprints(docs, width, seed))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = keep(components(links(classes, radius, block)))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = named.join(lowest, "root").select("fp", "component_id")
    return fps.join(label, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def with_fingerprint(docs: DataFrame, name: str, width: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with each row's fingerprint as 16 hex digits."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [f"{fingerprint(x, width, seed) & (1 << 64) - 1:016x}" for x in texts(batch)]
            yield batch.append_column(name, pa.array(fps, pa.string()))

    return docs.mapInArrow(run, f"{fields}, `{name}` string")


def first_of_components(docs: DataFrame, judged: DataFrame, printed: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``docs`` with one row of each component of ``judged`` (doc_id, fingerprint, component_id).

    ``printed`` adds a row's fingerprint under a name; helper columns get names that ``docs`` does not have.
    """
    key, mark, own = unused("_id", docs), unused("_print", docs), unused("_own", docs)
    judged = keep(judged.where("doc_id is not null"))
    ids = keep(judged.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("component_id") == F.col("doc_id")).alias("stays")))
    gone = lookup(ids.where("not stays or n > 1").select(F.col("doc_id").alias(key)))
    plain = docs.where("doc_id is not null").join(gone, F.col("doc_id") == F.col(key), "left_anti")
    again = lookup(ids.where("stays and n > 1").select(F.col("doc_id").alias(key)))
    repeated = printed(docs.join(again, F.col("doc_id") == F.col(key), "left_semi"), own)
    first = judged.where("component_id = doc_id").select(F.col("doc_id").alias(key), F.col("fingerprint").alias(mark)).distinct()
    repeated = repeated.join(first, (F.col("doc_id") == F.col(key)) & (F.col(own) == F.col(mark)), "left_semi").dropDuplicates(["doc_id", own]).drop(own)
    return plain.unionByName(repeated).unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


def drop_near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each component, that of its smallest id; all columns stay.

    Rows without an id go by their text alone. Of rows that share an id those stay whose
    component it is the smallest id of, one for each fingerprint.
    """
    return first_of_components(docs, near_duplicates(docs, width, seed, radius), lambda some, name: with_fingerprint(some, name, width, seed))
