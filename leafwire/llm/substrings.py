"""Removal of repeated byte strings with suffix arrays of content-routed shards.

Every stretch of ``length`` bytes (a window) is routed by its anchor: the least of the
hashed 40-byte strings in it, the leftmost of equals. Equal windows have equal anchors at
equal offsets, so they meet. Windows in a row with the same anchor occurrence make one piece.

1. Anchors are counted. Those that occur twice or more set bits of a filter whose size follows from their
   number; a filter only spares work, since all later steps are exact by themselves. Where it would be
   too large to broadcast, a join on the anchors takes its place.
2. Pieces whose anchor may repeat are written, as 128-bit BLAKE2 digests of their bytes. Equal pieces become
   one class with its earliest place, all other places are repeats; partial minima keep a passage that very
   many documents share out of any single task.
3. Classes that share an anchor are cut from the texts again, by a second filter or join, and meet in a
   shard, which sorts the suffixes of its pieces by induction and finds equal windows of
   different pieces by their permuted common prefixes.
4. An anchor with very many classes would not fit a shard and is split by window instead: one row for each
   window of its classes, grouped by its bytes with partial minima.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from leafwire.llm.common import keep, remove, shared_folder, slices, texts, unused
from leafwire.llm.suffix import common_prefixes, suffix_array

GRAM = 40
SLICE = 1 << 20
PART = 2 << 20
#: Bits of a filter for each thing in it, and of the largest filter that is broadcast (128 MB).
EACH, MOST_BITS = 16, 30
#: Odd multipliers and the places of the bits that the position takes in a packed minimum.
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
LOW = np.uint64(24)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place where they fit."""
    word = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    n = len(data) - GRAM + 1
    h = word[:n] * M1
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += word[k : k + n]
        h *= M2
    h ^= h >> np.uint64(32)
    h *= M3
    h ^= h >> np.uint64(29)
    return h


def pieces_of(docs: list[bytes], length: int) -> dict[str, np.ndarray]:
    """doc (its index), start, count (of windows), anchor and at (place in the joined texts) of all pieces."""
    data = np.frombuffer(b"".join(docs), np.uint8)
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(sizes)
    if len(data) < length:
        return {k: np.empty(0, np.int64) for k in ("doc", "start", "count", "anchor", "at")}
    h = gram_hashes(data)
    least = (h >> LOW << LOW) | np.arange(len(h), dtype=np.uint64)
    grams, span = length - GRAM + 1, 1
    while 2 * span <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < grams:
        least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)  # of the anchor, for each window
    owner = np.repeat(np.arange(len(docs)), sizes)[: len(place)]
    valid = np.arange(len(place)) + length <= ends[owner]
    fresh = valid.copy()
    fresh[1:] &= (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(fresh)
    stop = np.append(begin[1:], len(place))
    stop = np.minimum(stop, ends[owner[begin]] - length + 1)
    return {"doc": owner[begin], "start": begin - (ends - sizes)[owner[begin]], "count": stop - begin, "anchor": h[place[begin]].view(np.int64), "at": begin}


def parts(docs: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(document, offset, bytes) so that no group is over PART bytes; long texts are cut with an overlap."""
    group: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    total = 0
    for i, x in enumerate(docs):
        for a in range(0, max(1, len(x) - length + 1), PART - length + 1):
            cut = x[a : a + PART]
            if total and total + len(cut) > PART:
                yield group
                group, total = ([], [], []), 0
            for to, value in zip(group, (i, a, cut)):
                to.append(value)
            total += len(cut)
    if group[0]:
        yield group


def repeated_windows(blobs: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, run) of the windows in ``blobs`` that also start earlier in another one of them."""
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    text = np.frombuffer(b"".join(b + b"\0" for b in blobs), np.uint8).astype(np.int64) + 2
    firsts = np.cumsum(sizes + 1) - sizes - 1
    text[firsts + sizes] = 1
    order = suffix_array(np.append(text, 0), 258)
    prefixes = common_prefixes(np.append(text, 0), order)
    order = order[1:]
    owner = np.repeat(np.arange(len(blobs)), sizes + 1)
    group = np.cumsum(prefixes[order] < length)
    fits = (order - firsts[owner[order]] + length) <= sizes[owner[order]]
    at, group = order[fits], group[fits]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(at) else np.empty(0, np.int64)
    many = np.repeat(np.diff(np.append(first, len(group))), np.diff(np.append(first, len(group)))) > 1
    at, group = at[many], group[many]
    if not len(at):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    which, offset = owner[at], at - firsts[owner[at]]
    d, s = doc[which], start[which] + offset
    by = np.lexsort((s, d, group))
    d, s, group, at = d[by], s[by], group[by], at[by]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(at)), 0))
    again = np.sort(at[(d != d[head]) | (s != s[head])])
    begin = np.concatenate([[True], again[1:] != again[:-1] + 1]) if len(again) else np.empty(0, bool)
    lead = np.flatnonzero(begin)
    run = np.diff(np.append(lead, len(again)))
    return owner[again[lead]], again[lead] - firsts[owner[again[lead]]], run


def mixed(*columns: np.ndarray) -> np.ndarray:
    """A hash of the columns' values, row by row."""
    h = np.full(len(columns[0]), M3, np.uint64)
    for c in columns:
        h ^= c.astype(np.int64).view(np.uint64)
        h *= M1
        h ^= h >> np.uint64(31)
    return h


class BitFilter:
    """Flags of a fixed number, of which those of the rows' hashes are set."""

    def __init__(self, flags: np.ndarray):
        self.flags = flags

    def holds(self, *columns: np.ndarray) -> np.ndarray:
        """Rows that may be in it: all that are, and few others while it is not full."""
        at = mixed(*columns) & np.uint64(8 * len(self.flags) - 1)
        return (self.flags[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)

    @classmethod
    def of(cls, rows: DataFrame, most_bits: int = MOST_BITS) -> BitFilter | None:
        """A filter of the rows, counted first; None if it would have to be larger than ``most_bits``.

        Each task sets the flags of its own part of the range, so what comes to the driver is the filter once.
        """
        rows = keep(rows)
        bits = max(10, int(EACH * rows.count()).bit_length())
        if bits > most_bits:
            return None
        chunk, names = min(15, bits), rows.columns

        def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = np.unique(mixed(*(batch.column(c).to_numpy() for c in names)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(b >> chunk)], ["b", "c"])

        def marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                b = np.unique(batch.column("b").to_numpy())
                cuts = np.flatnonzero(b[1:] >> chunk != b[:-1] >> chunk) + 1
                for part in np.split(b, cuts) if len(b) else ():
                    flags = held.setdefault(int(part[0] >> chunk), np.zeros(1 << chunk, bool))
                    flags[part & ((1 << chunk) - 1)] = True
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["c", "flags"])

        marked = rows.mapInArrow(hashed, "b long, c long").repartition("c").mapInArrow(marks, "c long, flags binary")
        out = np.zeros((1 << bits) // 8, np.uint8)
        parts_ = marked.toArrow()  # of the filter's size, in one job
        for c, flags in zip(parts_.column("c").to_pylist(), parts_.column("flags").to_pylist()):
            out[c << (chunk - 3) : (c + 1) << (chunk - 3)] |= np.frombuffer(flags, np.uint8)
        return cls(out)


def repeats(docs: DataFrame, length: int = 100, most_bits: int = MOST_BITS, shard_bytes: int = 1 << 19, hot: int = 4000) -> DataFrame:
    """kid, kh, start, len: byte spans of the rows of ``docs`` (kid long, kh, text) that repeat earlier ones; written.

    ``most_bits``: of a broadcast filter; ``shard_bytes``: of the pieces that are sorted together; ``hot``: classes of
    an anchor beyond which it is split by window. None of them changes the result.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/substrings-{uuid.uuid4().hex}"

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            got = [pieces_of(cut, length)["anchor"] for _, _, cut in parts(texts(batch), length)]
            names, n = np.unique(np.concatenate(got) >> 24, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.minimum(n, 2).astype(np.int32))], ["a", "n"])

    def pieces_in(rows: DataFrame, known: BitFilter | None, with_bytes: bool) -> DataFrame:
        """Pieces whose anchor, or with their bytes whose place, is in the filter or in a row's own ``starts``."""
        held = spark.sparkContext.broadcast(known)
        fields = ["anchor", "kid", "kh", "start", "count"] + (["bytes"] if with_bytes else ["p1", "p2"])

        def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in slices(batches, SLICE):
                ids, hashes = batch.column("kid"), batch.column("kh")
                own = batch.column("starts").to_pylist() if "starts" in batch.schema.names else None
                for docs_, offsets, cuts in parts(texts(batch), length):
                    p = pieces_of(cuts, length)
                    row, start = np.array(docs_)[p["doc"]], np.array(offsets)[p["doc"]] + p["start"]
                    if own is not None:
                        wanted = np.array([r << 40 | x for r in set(docs_) for x in own[r]], np.int64)
                        hit = np.isin(row.astype(np.int64) << 40 | start, wanted)
                    elif known is None:
                        hit = np.ones(len(row), bool)
                    elif with_bytes:
                        hit = known.holds(ids.to_numpy()[row], start)
                    else:
                        hit = known.holds(p["anchor"] >> 24)
                    some = np.flatnonzero(hit)
                    which, joined = pa.array(row[some]), b"".join(cuts)
                    ends = p["at"][some] + p["count"][some] + length - 1
                    blobs = [joined[x:y] for x, y in zip(p["at"][some].tolist(), ends.tolist())]
                    columns = [pa.array(p["anchor"][some]), ids.take(which), hashes.take(which), pa.array(start[some]), pa.array(p["count"][some].astype(np.int32))]
                    if with_bytes:
                        columns.append(pa.array(blobs, pa.binary()))
                    else:
                        digest = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in blobs), "<i8").reshape(-1, 2)
                        columns += [pa.array(np.ascontiguousarray(digest[:, i])) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays(columns, fields)

        return rows.mapInArrow(cut, "anchor long, kid long, kh long, start long, count int, " + ("bytes binary" if with_bytes else "p1 long, p2 long"))

    def write(rows: DataFrame, name: str) -> DataFrame:
        rows.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    twice = docs.select("text").mapInArrow(anchors, "a long, n int").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a")
    twice = write(twice, "anchors")
    known = BitFilter.of(twice, most_bits)
    pieces = pieces_in(docs, known, False)
    if known is None:
        pieces = pieces.join(twice, F.shiftright("anchor", 24) == F.col("a"), "left_semi")
    pieces = write(pieces, "pieces")
    # equal pieces
    name = ["anchor", "p1", "p2"]
    classes = pieces.groupBy(*name).agg(F.min(F.struct("kid", "start")).alias("f"), F.count("*").alias("n"))
    classes = write(classes.select(*name, "n", "f.*"), "classes")
    many = classes.where("n > 1").select(*name, F.col("kid").alias("k0"), F.col("start").alias("s0"))
    again = pieces.join(many, name).where("kid > k0 or start > s0")
    equal = again.select("kid", "kh", "start", (F.col("count") + (length - 1)).cast("long").alias("len"))
    # different pieces around one anchor
    shared = classes.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    lead = keep(classes.join(shared, "anchor").select("anchor", "kid", "start", "m").distinct())
    total = lead.count() * (length + 40)
    shards = max(1, -(-total // shard_bytes))
    places = BitFilter.of(lead.select("kid", "start"), most_bits)
    if places is None:
        near = pieces_in(docs.join(lead.groupBy("kid").agg(F.collect_set("start").alias("starts")), "kid"), None, True)
    else:
        near = pieces_in(docs, places, True)
    near = near.select("anchor", "kid", "kh", "start", "bytes").join(lead, ["anchor", "kid", "start"])

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kid", "start", "kh"], ignore_index=True)
        which, offset, run = repeated_windows(list(pdf.bytes), pdf.kid.to_numpy(), pdf.start.to_numpy(), length)
        return pd.DataFrame({"kid": pdf.kid.to_numpy()[which], "kh": pdf.kh.to_numpy()[which], "start": pdf.start.to_numpy()[which] + offset, "len": run + length - 1})

    schema = "kid long, kh long, start long, len long"
    cool = near.where(F.col("m") <= hot).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    partly = cool.select("shard", "kid", "kh", "start", "bytes").groupBy("shard").applyInPandas(sort, schema)

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                rows = batch.slice(i, 2000)
                blobs = rows.column("bytes").to_pylist()
                n = np.array([len(x) - length + 1 for x in blobs])
                which = np.repeat(np.arange(len(blobs)), n)
                offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                take = pa.array(which)
                each = pa.array([blobs[w][o : o + length] for w, o in zip(which.tolist(), offset.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([each, rows.column("kid").take(take), rows.column("kh").take(take), pa.array(rows.column("start").to_numpy()[which] + offset)], ["window", "kid", "kh", "start"])

    each = near.where(F.col("m") > hot).select("kid", "kh", "start", "bytes").mapInArrow(windows, "window binary, kid long, kh long, start long")
    first = each.groupBy("window").agg(F.min(F.struct("kid", "start")).alias("f"), F.count("*").alias("n")).where("n > 1").select("window", F.col("f.kid").alias("k0"), F.col("f.start").alias("s0"))
    single = each.join(first, "window").where("kid > k0 or start > s0").select("kid", "kh", "start", F.lit(length).cast("long").alias("len"))
    found = equal.unionByName(partly).unionByName(single)
    spans = keep(found.groupBy("kid", "kh").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans")))
    remove(spark, folder)
    return spans


#: Columns that the operator adds.
ADDED = ("n_bytes", "n_removed", "n_spans", "kept")


def without_repeats(docs: DataFrame, length: int = 100, most_bits: int = MOST_BITS, **options: int) -> DataFrame:
    """The rows of ``docs`` with n_bytes, n_removed, n_spans, kept (binary: what remains of the text).

    Each byte is removed that lies in a string of ``length`` bytes which also starts earlier: in
    a smaller doc_id, or earlier in the same one. Ids are integers; a null id comes before all others. Rows
    that share an id count as one document, so only an earlier start is earlier; a row that
    repeats another one whole has the same result. Null texts are empty. Texts shorter than
    ``length`` stay whole. Columns of ``docs`` with the names of those that are added are replaced; all
    others stay, of whatever name.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be of an integer type, which has an order")
    docs = docs.drop(*ADDED)
    kid, kh, may, held_spans = (unused(x, docs) for x in ("kid", "kh", "may", "spans"))
    keyed = docs.withColumns({"text": F.coalesce("text", F.lit("")), kid: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))})
    keyed = keyed.withColumn(kh, F.xxhash64("text"))
    spans = repeats(keyed.select(F.col(kid).alias("kid"), F.col(kh).alias("kh"), "text"), length, most_bits, **options)
    spans = spans.withColumnsRenamed({"kid": kid, "kh": kh, "spans": held_spans})
    held = docs.sparkSession.sparkContext.broadcast(BitFilter.of(spans.select(kid, kh), most_bits))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [c for c in docs.columns if c != "text"]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {c: [] for c in ADDED}
            spans_of = batch.column(held_spans).to_pylist() if held_spans in batch.schema.names else [None] * batch.num_rows
            for x, spans_ in zip(texts(batch), spans_of):
                kept, at, n = [], 0, 0
                for span in spans_ or ():
                    a, b = span["start"], span["start"] + span["len"]
                    if a > at or not n:  # a new run, also one that begins with the text
                        n += 1
                        kept.append(x[at:a])
                    at = max(at, b)
                kept.append(x[at:])
                rest = b"".join(kept)
                for k, v in zip(out, (len(x), len(x) - len(rest), n, rest)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(out[k], pa.int64()) for k in ADDED[:3]), pa.array(out["kept"], pa.binary())], [*names, *out])

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filter_ = held.value
            found = np.ones(batch.num_rows, bool) if filter_ is None else filter_.holds(batch.column(kid).to_numpy(), batch.column(kh).to_numpy())
            yield batch.append_column(may, pa.array(found))

    # only texts that may have spans go through the shuffle to them
    flagged = keyed.select(*names, "text", kid, kh).mapInArrow(marked, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"text string, {kid} long, {kh} long, {may} boolean"]))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "n_bytes long, n_removed long, n_spans long, kept binary"])
    joined = flagged.where(F.col(may)).join(spans, [kid, kh], "left").select(*names, "text", held_spans)
    return joined.mapInArrow(cut, schema).unionByName(flagged.where(~F.col(may)).select(*names, "text").mapInArrow(cut, schema))
