"""Hidden Markov language model over word classes, trained by Baum-Welch.

Words: white-space runs with A-Z lowered, then one end token. Each of the ``common`` most
frequent training words, and the end, is a class of its own; all other words share
``rare`` classes by hash. A latent state emits a class, and a class its words in
proportion to their smoothed counts, so that the probabilities of all words sum to one.
A text's likelihood is the scaled forward recursion.

Each text is split once and written as class ids. Every round of Baum-Welch reads these for every token
of every training document. Expected counts are summed across partitions by Spark and make the next parameters.

Counts of the common words are broadcast (their number is a parameter); a rare word's
count reaches its documents by an equi-join on the word, which cannot be
skewed, because rare words are rare.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwire.llm.common import keep, remainder, remove, shared_folder, slices, texts

#: Steps of the recursion after which rows are scaled; as many emissions in a row stay far above the least double.
SCALED = 8


@dataclass
class Setting:
    states: int = 6
    common: int = 8000
    rare: int = 192
    #: Share of the training documents, by a hash of the id, that each round of Baum-Welch reads: all of them
    #: unless a caller asks for less.
    shares: tuple[float, ...] = (1.0,) * 8


@dataclass
class Model:
    setting: Setting
    total: int  # N
    distinct: int  # V
    ends: int  # count of the end token
    words: dict[bytes, int]  # class of a common word
    counts: np.ndarray  # of the common words
    mass: np.ndarray  # log10 of the smoothed unigram mass of each class
    start: np.ndarray = field(default_factory=lambda: np.empty(0))
    move: np.ndarray = field(default_factory=lambda: np.empty(0))
    emit: np.ndarray = field(default_factory=lambda: np.empty(0))  # class x state

    @property
    def denominator(self) -> float:
        return self.total + (self.distinct + 1)

    @property
    def end(self) -> int:
        return len(self.words)

    @property
    def classes(self) -> int:
        return len(self.words) + 1 + self.setting.rare

    @property
    def width(self) -> str:
        """How a class id is written."""
        return "<u2" if self.classes <= 1 << 16 else "<u4"


def split(data: bytes) -> list[bytes]:
    return data.lower().split()


def rare_class(word: bytes, rare: int) -> int:
    return zlib.crc32(word) % rare


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of ``docs``; each batch adds up its own words first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            runs: list[bytes] = []
            for x in texts(batch):
                runs += split(x)
            found = pa.array(runs, pa.binary()).value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, n: int) -> list:
    """The n rows of the largest counts; a histogram of the counts' sizes first leaves out most others."""
    size = F.floor(16 * F.log2("n")).cast("int")
    left, floor = n, 0
    for row in sorted(counts.groupBy(size.alias("b")).count().collect(), key=lambda r: -r["b"]):
        floor, left = row["b"], left - row["count"]
        if left <= 0:
            break
    return counts.where(size >= floor).orderBy(F.desc("n"), "word").limit(n).collect()


def classes_of(model: Model, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Class of each token with the ends, tokens of each text, the distinct words and each token's word (-1: end)."""
    runs: list[bytes] = []
    sizes = np.empty(len(docs), np.int64)
    for i, x in enumerate(docs):
        got = split(x)
        sizes[i] = len(got) + 1
        runs += got
    found = pa.array(runs, pa.binary()).dictionary_encode()
    words, codes = found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)
    base, rare = model.end + 1, model.setting.rare
    known = pc.index_in(found.dictionary, value_set=pa.array(list(model.words), pa.binary())).fill_null(-1).to_numpy()
    own = np.append(np.fromiter(model.words.values(), np.int64, len(model.words)), -1)[known]
    other = np.flatnonzero(known < 0)
    own[other] = base + np.fromiter((rare_class(words[i], rare) for i in other.tolist()), np.int64, len(other))
    ends = np.cumsum(sizes) - 1
    inner = np.ones(int(sizes.sum()), bool)
    inner[ends] = False
    word = np.full(len(inner), -1, np.int64)
    word[inner] = codes
    kind = np.full(len(inner), model.end, np.int64)
    kind[inner] = own[codes]
    return kind, sizes, words, word


def forward(model: Model, kind: np.ndarray, sizes: np.ndarray, back: bool = False):
    """log10 of each text's class sequence; with ``back`` also the expected counts.

    Texts go side by side, longest first: step t handles all that have a token t, and its rows follow those of
    step t - 1 in every array. Rows are scaled to sum to one at each SCALED-th step only.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    longest = int(sizes.max())
    live = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), side="right")
    bounds = np.concatenate([[0], np.cumsum(live)])
    step = np.repeat(np.arange(longest), live)
    row = np.arange(len(step)) - bounds[step]
    own = kind[starts[row] + step]
    classes, states = model.emit.shape
    emit, move = model.emit[own], model.move
    alpha, ones = np.empty_like(emit), np.ones(states)
    ends = bounds.tolist()
    scales: dict[int, np.ndarray] = {}
    logs = np.zeros(len(sizes))
    np.multiply(model.start, emit[: ends[1]], out=alpha[: ends[1]])
    for t in range(1, longest):
        x, y = ends[t], ends[t + 1]
        now = alpha[x:y]
        np.matmul(alpha[ends[t - 1] : ends[t - 1] + y - x], move, out=now)
        now *= emit[x:y]
        if not t % SCALED:
            scales[t] = now @ ones
            now /= scales[t][:, None]
            logs[: y - x] += np.log10(scales[t])
    last = bounds[sizes[order] - 1] + np.arange(len(sizes))
    tail = alpha[last] @ ones
    out = np.empty(len(sizes))
    out[order] = logs + np.log10(tail)
    if not back:
        return out
    beta = np.empty_like(emit)
    beta[last] = 1 / tail[:, None]
    for t in range(longest - 1, 0, -1):  # emit becomes what moves lead to
        x, y = ends[t], ends[t + 1]
        now = emit[x:y]
        now *= beta[x:y]
        if t in scales:
            now /= scales[t][:, None]
        np.matmul(now, move.T, out=beta[ends[t - 1] : ends[t - 1] + y - x])
    first = ends[1]
    moves = alpha[bounds[step[first:] - 1] + row[first:]].T @ emit[first:]
    beta *= alpha
    beta /= (beta @ ones)[:, None]
    emits = np.stack([np.bincount(own, beta[:, i], classes) for i in range(states)], 1)
    return out, beta[:first].sum(0), moves * move, emits


def parameters(model: Model, first: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> None:
    """Maximization; expected counts are smoothed by each class's smoothed unigram share."""
    states = len(first)
    model.start = (first + 1) / (first.sum() + states)
    model.move = (moves + 1) / (moves.sum(1, keepdims=True) + states)
    share = 10**model.mass
    emits = emits + 4 * share[:, None] * model.classes / states
    model.emit = emits / emits.sum(0, keepdims=True)


def statistics(docs: DataFrame, setting: Setting | None = None) -> tuple[Model, DataFrame]:
    """A model that knows the word counts of ``docs`` but no states yet, and the counts, checkpointed."""
    s = setting or Setting()
    counts = keep(word_counts(docs))
    ends = docs.count()
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, s.common)
    words = {bytes(r["word"]): i for i, r in enumerate(top)}
    common = np.array([r["n"] for r in top] + [ends], np.float64)
    model = Model(s, n + ends, v + (ends > 0), ends, words, common, np.empty(0))
    # mass of the rare classes: smoothed counts of their words, and an unseen word's share each
    rare = s.rare

    def by_class(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(rare)
        for b in batches:
            for w, c in zip(b.column("word").to_pylist(), b.column("n").to_numpy()):
                if w not in words:
                    out[rare_class(w, rare)] += c + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rare)), pa.array(out)], ["k", "m"])

    sums = {r["k"]: r["m"] for r in counts.mapInArrow(by_class, "k long, m double").groupBy("k").agg(F.sum("m").alias("m")).collect()}
    rest = np.array([sums.get(k, 0.0) + 1 / rare for k in range(rare)])
    model.mass = np.log10(np.concatenate([common + 1, rest]) / model.denominator)
    share = 10**model.mass
    r = np.random.default_rng(0)
    k = s.states
    model.start = np.full(k, 1 / k)
    model.move = np.full((k, k), 0.1 / max(1, k - 1)) if k > 1 else np.ones((1, 1))
    np.fill_diagonal(model.move, 0.9 if k > 1 else 1.0)
    model.emit = share[:, None] * r.uniform(0.5, 1.5, (len(share), k))
    model.emit /= model.emit.sum(0)
    return model, counts


def encoded(docs: DataFrame, model: Model, folder: str) -> DataFrame:
    """``docs`` (doc_id, held_out, text) written once and read again as row (a number of its own), doc_id, held_out,
    h (hash in 0 to 1), kinds (class ids), n_tokens, known and base (of common words), bag and tf (rare words)."""
    kind_ = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        logs = np.log10((m.counts + 1) / m.denominator)
        for batch in slices(batches):
            kind, sizes, words, word = classes_of(m, texts(batch))
            ends = np.cumsum(sizes)
            starts = ends - sizes
            own = kind <= m.end
            common = np.minimum(kind, m.end)
            base = np.add.reduceat(np.where(own, logs[common], 0.0), starts)
            known = np.add.reduceat((own & (m.counts[common] > 0)).astype(np.int64), starts)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            rare = np.flatnonzero(~own)
            pair, tf = np.unique(doc[rare] * (len(words) + 1) + word[rare], return_counts=True)
            row, which = pair // (len(words) + 1), pair % (len(words) + 1)
            offsets = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32))
            bag = pa.array(words, pa.binary()).take(pa.array(which))
            ids = kind.astype(m.width).tobytes()
            step = np.dtype(m.width).itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), batch.column("h"), pa.array([ids[a * step : b * step] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()), pa.array(sizes), pa.array(known), pa.array(base), pa.ListArray.from_arrays(offsets, bag), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))],
                ["doc_id", "held_out", "h", "kinds", "n_tokens", "known", "base", "bag", "tf"],
            )

    hashed = docs.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30))
    rows = hashed.mapInArrow(run, f"doc_id {kind_}, held_out boolean, h double, kinds binary, n_tokens long, known long, base double, bag array<binary>, tf array<int>")
    rows.withColumn("row", F.monotonically_increasing_id()).sortWithinPartitions("n_tokens").write.option("compression", "zstd").parquet(folder)  # sorted, so that texts of a batch take about as many steps
    return docs.sparkSession.read.parquet(folder)


def read_kinds(model: Model, batches: Iterable[pa.RecordBatch], tokens: int = 1 << 20):
    """Batches of about so many tokens with their class ids and each text's number of them."""
    step = np.dtype(model.width).itemsize
    for batch in slices(batches, tokens * step, "kinds"):
        kinds = batch.column("kinds").to_pylist()
        yield batch, np.frombuffer(b"".join(kinds), model.width).astype(np.int64), np.array([len(x) // step for x in kinds])


def train(rows: DataFrame, model: Model) -> None:
    """Baum-Welch over ``rows`` (h, kinds); each round reads its share of them, all by default."""
    k = model.setting.states
    for share in model.setting.shares if model.ends else ():
        held = rows.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            m = held.value
            first, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
            for _, kind, sizes in read_kinds(m, batches):
                _, a, b, c = forward(m, kind, sizes, back=True)
                first += a
                moves += b
                emits += c
            flat = np.concatenate([first, moves.ravel(), emits.ravel()])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["i", "x"])

        part = rows if share >= 1 else rows.where(F.col("h") < share)
        got = part.select("kinds").mapInArrow(expect, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # a number for each parameter
        if not got.num_rows:  # no document in so small a share
            continue
        flat = np.zeros(k + k * k + model.emit.size)
        flat[got.column("i").to_numpy()] = got.column("x").to_numpy()
        parameters(model, flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(model.emit.shape))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, held_out, n_tokens, known, base of ``rows`` and path: what the states add to a text's base score."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch, kind, sizes in read_kinds(m, batches):
            path = forward(m, kind, sizes) - np.add.reduceat(m.mass[kind], np.cumsum(sizes) - sizes)  # what words have within classes is in their base
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(path)], [*names, "path"])

    kind_ = rows.schema["doc_id"].dataType.simpleString()
    return rows.select(*names, "kinds").mapInArrow(run, f"row long, doc_id {kind_}, held_out boolean, n_tokens long, known long, base double, path double")


def fit(docs: DataFrame, setting: Setting | None = None) -> tuple[Model, DataFrame]:
    """The trained model of all ``docs`` (doc_id, text) and the counts of all their words, checkpointed.

    A null text is its end token alone; rows that repeat an id all count. Without rows the model has no
    words and equal states.
    """
    model, counts = statistics(docs, setting)
    folder = f"{shared_folder(docs.sparkSession)}/language-{uuid.uuid4().hex}"
    train(encoded(docs.select("doc_id", F.lit(False).alias("held_out"), "text"), model, folder), model)
    remove(docs.sparkSession, folder)
    return model, counts


def language_scores(docs: DataFrame, setting: Setting | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    A null or empty text is its end token. Rows that share a doc_id are scored one by one.
    Rows whose crc32 of the id modulo 7 is 2 are held out; if all are, every count is zero.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "text")
    model, counts = statistics(docs.where("not held_out"), setting)
    folder = f"{shared_folder(spark)}/language-{uuid.uuid4().hex}"
    rows = encoded(docs, model, folder)
    train(rows.where("not held_out"), model)
    bags = rows.select("row", F.explode(F.arrays_zip("bag", "tf")).alias("x")).select("row", F.col("x.bag").alias("word"), F.col("x.tf").alias("tf"))
    c = F.coalesce("n", F.lit(0))
    rare = bags.join(counts, "word", "left").select("row", F.when(c > 0, F.col("tf")).otherwise(0).alias("seen"), (F.col("tf") * F.log10((c + 1) / F.lit(float(model.denominator)))).alias("log"))
    rare = keep(rare.groupBy("row").agg(F.sum("seen").alias("seen"), F.sum("log").alias("log")))
    done = keep(scored(rows, model))
    remove(spark, folder)
    base = F.col("base") + F.coalesce("log", F.lit(0.0))
    known = F.col("known") + F.coalesce("seen", F.lit(0))
    return done.join(rare, "row", "left").select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("path") + base).alias("score"))
