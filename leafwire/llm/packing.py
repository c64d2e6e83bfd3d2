"""Hierarchical multi-length packing of tokenized documents.

Each task tokenizes its rows and packs them in shards of a bounded number of tokens, so
no ids cross the network. In a shard, whole long windows are cut off first; what is left
of each document goes to the tier of its length. A piece of the longest tier opens a long
window, whose gap is filled from the shorter tiers, whole pieces first and one cut piece
last. What then remains in a tier is packed into windows of that tier's size; the
last open windows go down the tiers and finally into powers of two, which need no padding.
Sequences are dealt to step groups by length so that groups hold like numbers of tokens.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from leafwire.llm.common import slices, texts

TIERS = (2048, 1024, 512, 256)
END = 1
PUNCTUATION = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""


class Encoder:
    """Token ids by a public tokenizer, with the ids of each white-space run kept once.

    The tokenizer drops white space before it splits, so a text's ids are those of its runs
    in turn; a run of letters with punctuation after it has the ids of one and then the
    other. New words of letters are encoded many at a time: each ends with the one id that
    is marked as a word's end. ASCII letters are lowered first, which the tokenizer does
    anyway, except where a special token's text or a combining mark might be told apart by
    case.
    """

    most = 250_000
    batch = 500

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        ends = np.zeros(max(self.whole.get_vocab().values()) + 1, bool)
        ends[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        self.is_end = ends
        self.clear()

    def clear(self) -> None:
        #: A run's entry, and 2**32 times the entry of its punctuation; entry 0 is empty.
        self.known: dict[bytes, int] = {}
        self.ids = np.empty(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.used, self.entries = 0, 1

    def store(self, words: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        n, m = self.entries, len(words)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + m > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + m] = sizes
        self.known.update(zip(words, range(n, n + m)))
        self.used += len(flat)
        self.entries += m

    def store_each(self, words: list[bytes]) -> None:
        got = [x.ids for x in self.whole.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.store(words, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes)

    def add(self, words: list[bytes]) -> None:
        letters, other, joint = {}, {}, []
        for w in words:
            stem = w.rstrip(PUNCTUATION)
            text = stem.decode()
            if not (text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha())):
                other[w] = None
                continue
            if stem not in self.known:
                letters[stem] = None
            if len(stem) < len(w):
                tail = w[len(stem) :]
                joint.append((w, stem, tail))
                if tail not in self.known:
                    other[tail] = None
        new = list(letters)
        lines = [new[i : i + self.batch] for i in range(0, len(new), self.batch)]
        for line, got in zip(lines, self.whole.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False)):
            flat = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(self.is_end[flat])
            if len(ends) == len(line):
                self.store(line, flat, np.diff(ends, prepend=-1))
            else:  # letters that are split once they are normalized
                self.store_each(line)
        self.store_each(list(other))
        self.known.update((w, self.known[stem] + (self.known[tail] << 32)) for w, stem, tail in joint)

    def encode(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and how many of them each text has."""
        if len(self.known) > self.most:
            self.clear()
        runs, counts, direct = [], np.zeros(len(docs), np.int64), {}
        for i, x in enumerate(docs):
            if b"<|" in x:
                direct[i] = np.array(self.whole.encode(x.decode(), add_special_tokens=False).ids, np.uint32)
                continue
            got = (x if b"\xcc" in x or b"\xcd" in x else x.lower()).split()
            counts[i] = len(got)
            runs += got
        found = pa.array(runs, pa.binary()).dictionary_encode()
        words, codes = found.dictionary.to_pylist(), found.indices.to_numpy()
        del runs
        if new := [w for w in words if w not in self.known]:
            self.add(new)
        both = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        # the ids of each distinct run side by side, then those of every run
        pairs = np.stack([both & 0xFFFFFFFF, both >> 32], 1).ravel()
        own = self.gather(self.starts[pairs], self.sizes[pairs], self.ids)
        sizes = self.sizes[pairs].reshape(-1, 2).sum(1)
        flat = self.gather((np.cumsum(sizes) - sizes)[codes], sizes[codes], own)
        bounds = np.concatenate([[0], np.cumsum(sizes[codes])])[np.concatenate([[0], np.cumsum(counts)])]
        totals = np.diff(bounds)
        if direct:
            parts = [direct.get(i, flat[a:b]) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            flat, totals = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return flat, totals

    @staticmethod
    def gather(starts: np.ndarray, sizes: np.ndarray, source: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        at = np.repeat(starts - ends + sizes, sizes)
        at += np.arange(len(at))
        return source[at]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def plan(totals: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) of documents with ``totals`` ids.

    Each id lies in one piece; a sequence holds ``tiers[0]`` ids or a power of two of them.
    """
    longest = tiers[0]
    out: list[list[tuple[int, int, int]]] = []
    queues: dict[int, deque] = {t: deque() for t in tiers}
    tier_of = {}

    def put(doc: int, start: int, n: int) -> None:
        if n not in tier_of:
            tier_of[n] = min(t for t in tiers if t >= n)
        queues[tier_of[n]].append((doc, start, n))

    for doc, n in enumerate(totals):
        whole = n // longest
        out += [[(doc, k * longest, longest)] for k in range(whole)]
        if n % longest:
            put(doc, whole * longest, n % longest)

    def fill(sequence: list[tuple[int, int, int]], gap: int, allowed: tuple[int, ...]) -> int:
        """Whole pieces that fit, longest tier first, then one that is cut; returns the gap left."""
        for t in allowed:
            while queues[t] and queues[t][0][2] <= gap:
                sequence.append(queues[t].popleft())
                gap -= sequence[-1][2]
        for t in reversed(allowed):
            if gap and queues[t]:
                doc, start, n = queues[t].popleft()
                sequence.append((doc, start, gap))
                put(doc, start + gap, n - gap)
                return 0
        return gap

    for size in tiers:
        shorter = tuple(t for t in tiers if t < size)
        while queues[size]:
            sequence = [queues[size].popleft()]
            gap = fill(sequence, size - sequence[0][2], shorter if size == longest else (size, *shorter))
            if gap and size == longest:
                gap = fill(sequence, gap, (size,))
            if not gap:
                out.append(sequence)
                continue
            while sequence:  # nothing is left to fill with: powers of two
                room, part = 1 << (sum(x[2] for x in sequence).bit_length() - 1), []
                while room:
                    doc, start, n = sequence.pop(0)
                    take = min(n, room)
                    part.append((doc, start, take))
                    room -= take
                    if n > take:
                        sequence.insert(0, (doc, start + take, n - take))
                out.append(part)
    return out


def step_groups(sizes: list[int], tokens: int) -> list[int]:
    """A group for each sequence, longest first to the lightest, so that groups hold about ``tokens``."""
    heap = [(0, g) for g in range(max(1, -(-sum(sizes) // tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return out


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, shard_tokens: int = 1 << 20, step_tokens: int = 1 << 14, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, step_group.

    ``path`` names the tokenizer file; ``with_ids`` adds the ids themselves. A null or empty
    text is its end id alone. Rows that share a doc_id, or have none, are documents of
    their own. Other columns are ignored; an empty table gives an empty result. Sequences
    and step groups are numbered within the task's partition, so a task that runs again
    gives the same rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "step_group"]
    schema = f"doc_id {kind}, " + ", ".join(f"{x} long" for x in fields[1:]) + (", ids array<int>" if with_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        base = {"sequence": part << 33, "group": part << 33}
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def shard() -> pa.RecordBatch:
            names = pa.concat_arrays([x[0] for x in held])
            flat = np.concatenate([x[1] for x in held])
            totals = np.concatenate([x[2] for x in held])
            ends = np.cumsum(totals)
            begins = (ends - totals).tolist()
            sequences = plan(totals.tolist(), tiers)
            groups = step_groups([sum(x[2] for x in s) for s in sequences], step_tokens)
            rows = defaultdict(list)
            raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
            for k, sequence in enumerate(sequences):
                offset = 0
                for doc, start, n in sequence:
                    a = begins[doc] + start
                    rows["doc"].append(doc)
                    rows["start"].append(start)
                    rows["length"].append(n)
                    rows["crc"].append(zlib.crc32(raw[4 * a : 4 * (a + n)]))
                    rows["sequence"].append(base["sequence"] + k)
                    rows["offset"].append(offset)
                    rows["group"].append(base["group"] + groups[k])
                    if with_ids:
                        rows["ids"].append(flat[a : a + n].astype(np.int32))
                    offset += n
            base["sequence"] += len(sequences)
            base["group"] += max(groups, default=0) + 1
            held.clear()
            doc = np.array(rows["doc"], np.int64)
            columns = [pc.take(names, pa.array(doc)), *(pa.array(rows[x], pa.int64()) for x in ("start", "length", "crc")), pa.array(totals[doc], pa.int64()), *(pa.array(rows[x], pa.int64()) for x in ("sequence", "offset", "group"))]
            if with_ids:
                columns.append(pa.array(rows["ids"], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, fields + ["ids"] * with_ids)

        tokens = 0
        for batch in slices(batches, 2 << 20):
            flat, totals = enc.encode(texts(batch))
            ends = np.cumsum(totals)
            held.append((batch.column("doc_id"), np.insert(flat, ends, END), totals + 1))
            tokens += len(flat) + len(totals)
            if tokens >= shard_tokens:
                yield shard()
                tokens = 0
        if held:
            yield shard()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
