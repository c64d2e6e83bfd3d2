"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, filters of eight bytes slide over every position, and each chunk of
512 bytes (one starts every 256) keeps the largest response of each filter. A text's
features are the mean and the largest value over its chunks; a logistic layer makes one
probability of them. Training is on a bounded sample of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwire.llm.common import remainder, slices, texts

WIDTH, DIM, FILTERS, STRIDE = 8, 4, 24, 256


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    shift: np.ndarray  # 1


def fresh(seed: int = 0) -> Network:
    r = np.random.default_rng(seed)
    f = np.float32
    return Network(r.normal(0, 0.5, (256, DIM)).astype(f), r.normal(0, 0.3, (WIDTH * DIM, FILTERS)).astype(f), np.zeros(FILTERS, f), r.normal(0, 0.1, 2 * FILTERS).astype(f), np.zeros(1, f))


def padded(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in blocks of STRIDE bytes, eight zeros at least after each, and each one's number of blocks."""
    blocks = [(len(x) + WIDTH) // STRIDE + 1 for x in docs]
    joined = b"".join(x.ljust(n * STRIDE, b"\0") for x, n in zip(docs, blocks))
    return np.frombuffer(joined, np.uint8), np.array(blocks)


def phases(net: Network, data: np.ndarray) -> list[np.ndarray]:
    """The embedded windows that start at each place modulo WIDTH: views of one array."""
    flat = np.take(net.embed, np.concatenate([data, np.zeros(WIDTH, np.uint8)]), axis=0).ravel()
    n, size = len(data) // WIDTH, WIDTH * DIM
    return [flat[p * DIM : p * DIM + n * size].reshape(n, size) for p in range(WIDTH)]


def block_max(net: Network, data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each block; ``last``: the blocks that end a text."""
    n = len(data) // WIDTH
    ends = (last + 1) * (STRIDE // WIDTH) - 1
    best = None
    for phase, x in enumerate(phases(net, data)):
        y = x @ net.filters
        if phase:
            y[ends] = -np.inf  # would reach into the next text
            np.maximum(best, y, out=best)
        else:
            best = y
    return best.reshape(-1, STRIDE // WIDTH, FILTERS).max(1) + net.bias


def features(net: Network, docs: list[bytes]) -> np.ndarray:
    data, blocks = padded(docs)
    ends = np.cumsum(blocks)
    top = np.maximum(block_max(net, data, ends - 1), 0)
    chunks = np.maximum(top, np.concatenate([top[1:], top[-1:]]))
    chunks[ends - 1] = top[ends - 1]
    starts = ends - blocks
    return np.concatenate([np.add.reduceat(chunks, starts) / blocks[:, None], np.maximum.reduceat(chunks, starts)], axis=1)


def scores(net: Network, docs: list[bytes]) -> np.ndarray:
    if not docs:
        return np.empty(0)
    z = features(net, docs).astype(np.float64) @ net.out.astype(np.float64) + float(net.shift[0])
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 0, blocks: int = 16) -> Network:
    """Adam on the logistic loss, both labels weighing half; long texts show ``blocks`` blocks an epoch."""
    net, r = fresh(seed), np.random.default_rng(seed)
    if not len(docs):
        return net
    names = ("embed", "filters", "bias", "out", "shift")
    moment = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    ones = max(1, int(labels.sum()))
    weight = np.where(labels == 1, len(labels) / (2 * ones), len(labels) / (2 * max(1, len(labels) - ones)))
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(docs))
        for a in range(0, len(order), batch):
            chosen = order[a : a + batch]
            shown = []
            for i in chosen:
                x = docs[i]
                if len(x) > blocks * STRIDE:
                    at = r.integers(0, len(x) - blocks * STRIDE)
                    x = x[at : at + blocks * STRIDE]
                elif labels[i] == 1 and len(x) > 20 and r.random() < 0.15:  # a part of a good text is good
                    size = int(r.integers(20, min(len(x), 300) + 1))
                    at = r.integers(0, len(x) - size + 1)
                    x = x[at : at + size]
                shown.append(x)
            grads = gradients(net, shown, labels[chosen], weight[chosen])
            step += 1
            lr = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for k in names:
                m, v = moment[k]
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                getattr(net, k)[...] -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def gradients(net: Network, docs: list[bytes], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    data, blocks = padded(docs)
    ends = np.cumsum(blocks)
    starts, n = ends - blocks, len(data) // WIDTH
    spread = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    last = ends * (STRIDE // WIDTH) - 1
    all_y = np.empty((WIDTH, n, FILTERS), np.float32)
    for phase, x in enumerate(phases(net, data)):
        np.matmul(x, net.filters, out=all_y[phase])
        if phase:
            all_y[phase, last] = -np.inf
    flat = all_y.transpose(1, 0, 2).reshape(-1, STRIDE, FILTERS)
    arg = flat.argmax(1)  # block x filter, the position in the block
    top = np.maximum(np.take_along_axis(flat, arg[:, None], 1)[:, 0] + net.bias, 0)
    after = np.concatenate([top[1:], top[-1:]])
    after[ends - 1] = top[ends - 1]
    chunks = np.maximum(top, after)
    source = np.arange(len(top))[:, None] + (after > top)
    mean = np.add.reduceat(chunks, starts) / blocks[:, None]
    high = np.maximum.reduceat(chunks, starts)
    doc = np.repeat(np.arange(len(docs)), blocks)
    p = 1 / (1 + np.exp(-np.clip(np.concatenate([mean, high], 1) @ net.out + net.shift, -40, 40)))
    dz = ((p - labels) * weight / len(docs)).astype(np.float32)
    g_out = np.concatenate([mean, high], 1).T @ dz
    d_chunk = (dz / blocks)[doc, None] * net.out[:FILTERS]
    ties = chunks == high[doc]  # a block is in two chunks, so the largest value often is as well
    d_chunk = d_chunk + ties / np.add.reduceat(ties, starts, dtype=np.float32)[doc] * (dz[doc, None] * net.out[FILTERS:])
    d_top = np.zeros_like(top)
    np.add.at(d_top, (source, np.arange(FILTERS)[None]), d_chunk)
    d_top *= top > 0
    b, f = np.nonzero(d_top)
    at = b * STRIDE + arg[b, f]
    near = spread[at[:, None] + np.arange(WIDTH)]  # the eight bytes under each chosen response
    x = net.embed[near].reshape(len(at), -1)
    g = d_top[b, f]
    g_filters = np.stack([g[f == k] @ x[f == k] for k in range(FILTERS)])
    back = (net.filters.T[f] * g[:, None]).reshape(-1, DIM)
    g_embed = np.stack([np.bincount(near.ravel(), back[:, d], 256) for d in range(DIM)], 1).astype(np.float32)
    return {"embed": g_embed, "filters": np.ascontiguousarray(g_filters.T), "bias": d_top.sum(0), "out": g_out.astype(np.float32), "shift": np.array([dz.sum()], np.float32)}


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, seed: int = 0, steps: int = 1500, stretch: int = 1 << 16) -> Network:
    """A network trained on at most ``rows`` labelled texts, those of the smallest hash of their id.

    Only rows whose crc32 of the id modulo 4 is not 2 take part, with whole texts; of one of more than
    ``stretch`` characters so many from a place that the id's hash picks, and each epoch shows another part of that.
    Scores are always over whole texts. Rows that are null in id, text or label are left out; conflicting
    labels of an id count as label 0.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows_ = docs.where("text is not null").where(remainder("doc_id", 4) != 2).select("doc_id", "text").join(known, "doc_id")
    # each label has half of the sample; the hash is cut off so that tasks send few rows more than are kept
    rows_ = rows_.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    counts = {r["quality"]: r["count"] for r in rows_.groupBy("quality").count().collect()}
    picked = []
    for label in (0, 1):
        share = min(1.0, 1.2 * (rows // 2) / max(1, counts.get(label, 0)) + 1e-6)
        part = rows_.where((F.col("quality") == label) & (F.col("h") <= int(share * (1 << 30)))).orderBy("h", "doc_id")
        begin = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - stretch + 1, F.lit(1)).cast("long")).cast("int") + 1
        picked.append(part.select("doc_id", F.substring(F.col("text"), begin, F.lit(stretch)).alias("text"), "quality").limit(rows // 2))
    sample = picked[0].union(picked[1]).collect()
    epochs = min(60, max(1, round(steps * 32 / max(1, len(sample)))))
    return train([x["text"].encode() for x in sample], np.array([x["quality"] for x in sample], np.float32), epochs=epochs, seed=seed)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(net, texts(batch)), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null and empty texts get the score of an empty text. Rows that share a doc_id are
    scored one by one. Without labelled rows the untrained network scores.
    """
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    net = fit(docs, labels)
    schema, names = docs.schema, docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            yield batch.filter(pa.array(scores(net, texts(batch)) >= threshold))

    return docs.mapInArrow(run, schema).select(*names)
