"""Nearest neighbours by cosine with a vantage-point tree for each shard.

Equal vectors are one class with its smallest ids, so a vector that very many rows share
is one entry. Classes are unit vectors, whose Euclidean distance is a metric and orders like the cosine.
A bounded sample of them are the vantage points of the top level: each class goes to the cell of the
nearest one, and a cell of more than ``shard_rows`` classes is dealt into several shards. Each shard
becomes a vantage-point tree.

A query first searches its own cell, then each cell whose lower bound by the triangle inequality is not
over its k-th best distance times ``factor``; the sides of a tree's nodes are skipped by the same rule.
Factor 1 is exact, less prunes more. Shards that follow each other make a tile; queries come in blocks
to the tiles that they look in, and a block walks a tree together. The driver holds the vantage points and a
row for each cell, and a task one tile and one piece of the queries, all of bounded size.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwire.llm.common import keep

LEAF = 256
#: Distances are rounded; what ties within this is decided by the exact cosine and the id.
SLACK = 1e-6
#: Distances to the top level's points that are held at a time, and tiles there are at least if shards suffice.
ROOM, TILES = 1 << 20, 64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def units(full: np.ndarray) -> np.ndarray:
    unit = full / np.abs(full).max(1, keepdims=True)  # first, so that squares neither vanish nor overflow
    return unit / np.sqrt((unit**2).sum(1, keepdims=True))


def build(unit: np.ndarray, seed: int = 0, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A tree as arrays. Rows are put in order; a node has a range of rows, the row of its
    vantage point, the middle that splits the rest, and the distance bounds of both sides."""
    r = np.random.default_rng(seed)
    order = np.arange(len(unit))
    nodes: list[list[float]] = []  # first, last, left, right, low and high of either side

    def grow(a: int, b: int) -> int:
        me = len(nodes)
        nodes.append([a, b, -1, -1, 0, 0, 0, 0])
        if b - a > leaf:
            pick = r.integers(a, b)
            order[a], order[pick] = order[pick], order[a]
            rest = order[a + 1 : b]
            far = distances(unit[rest], unit[order[a]][None])[:, 0]
            by = np.argsort(far, kind="stable")
            order[a + 1 : b] = rest[by]
            far = far[by]
            half = len(far) // 2
            nodes[me][4:] = [far[0], far[half - 1], far[half], far[-1]]
            nodes[me][2] = grow(a + 1, a + 1 + half)
            nodes[me][3] = grow(a + 1 + half, b)
        return me

    if len(unit):
        grow(0, len(unit))
    return {"order": order, "nodes": np.array(nodes, np.float64).reshape(-1, 8)}


def search(unit: np.ndarray, tree: dict[str, np.ndarray], queries: np.ndarray, k: int, factor: float = 1.0, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all that the walk found no further than the k-th nearest, ties included.

    ``start``: a distance for each query beyond which nothing is wanted.
    """
    order, nodes = tree["order"], tree["nodes"]
    rows = unit[order]
    best = np.full((len(queries), k), np.inf)
    cut = np.full(len(queries), np.inf) if start is None else start.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(q: np.ndarray, a: int, b: int) -> None:
        far = distances(queries[q], rows[a:b])
        some = far.min(1) <= cut[q] + SLACK
        q, far = q[some], far[some]
        if not len(q):
            return
        use = min(k, b - a)
        near = np.partition(far, use - 1, axis=1)[:, :use]
        best[q] = np.sort(np.concatenate([best[q], near], 1), axis=1)[:, :k]
        cut[q] = np.minimum(cut[q], best[q, -1])
        i, j = np.nonzero(far <= cut[q][:, None] + SLACK)
        found.append((q[i], order[a + j], far[i, j]))

    def visit(node: int, q: np.ndarray) -> None:
        a, b, left, right, l0, l1, r0, r1 = nodes[node]
        a, b, left, right = int(a), int(b), int(left), int(right)
        if left < 0:
            offer(q, a, b)
            return
        offer(q, a, a + 1)
        far = distances(queries[q], rows[a : a + 1])[:, 0]
        inner = np.abs(far - np.clip(far, l0, l1)) <= np.abs(far - np.clip(far, r0, r1))
        for near, sides in ((True, ((left, l0, l1), (right, r0, r1))), (False, ((right, r0, r1), (left, l0, l1)))):
            mine = inner == near
            for child, low, high in sides:
                gap = np.maximum(0, np.maximum(low - far[mine], far[mine] - high))
                go = q[mine][gap <= factor * cut[q[mine]] + SLACK]
                if len(go):
                    visit(child, go)

    if len(nodes) and len(queries):
        visit(0, np.arange(len(queries)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    q, row, far = (np.concatenate(x) for x in zip(*found))
    fine = far <= cut[q] + SLACK
    return q[fine], row[fine]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with the row of b, by the same sums for every pair."""
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def packed(full: np.ndarray, **arrays: np.ndarray) -> bytes:
    """Vectors that single precision holds exactly take half the room."""
    with np.errstate(over="ignore"):
        half = full.astype(np.float32)
    out = io.BytesIO()
    np.savez(out, full=half if (half == full).all() else full, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    out = dict(np.load(io.BytesIO(data)))
    return out | {"full": out["full"].astype(np.float64)}


class Cells:
    """The vantage points of the top level by vector length, the bounds of their cells, and the tiles of shards.

    The shards of a length are numbered cell after cell, and ``per_tile`` of them in a row are a tile.
    """

    def __init__(self, points: list[np.ndarray]) -> None:
        self.points = {w: units(np.stack([x for x in points if len(x) == w])) for w in {len(x) for x in points}}
        self.low: dict[int, np.ndarray] = {}
        self.high: dict[int, np.ndarray] = {}
        self.first: dict[tuple[int, int], int] = {}  # number of a cell's first shard
        self.per_tile: dict[int, int] = {}
        self.tiles: dict[int, dict[int, list[int]]] = {}  # cells of each tile

    def fill(self, stats: list[tuple[int, int, int, float, float]], shard_rows: int, tile_bytes: int) -> None:
        """``stats``: width, cell, rows, least and largest distance to the cell's point."""
        for w in {row[0] for row in stats}:
            own = sorted(row for row in stats if row[0] == w)
            self.low[w], self.high[w] = (np.full(len(self.points.get(w, ())), x) for x in (np.inf, -np.inf))
            total = sum(-(-n // shard_rows) for _, _, n, _, _ in own)
            each = self.per_tile[w] = max(1, min(tile_bytes // (shard_rows * 8 * w), total // TILES))
            at, tiles = 0, self.tiles.setdefault(w, {})
            for _, cell, n, low, high in own:
                if cell >= 0:
                    self.low[w][cell], self.high[w][cell] = low, high
                self.first[w, cell] = at
                for tile in range(at // each, (at - (-n // shard_rows) - 1) // each + 1):
                    tiles.setdefault(tile, []).append(cell)
                at += -(-n // shard_rows)

    def far(self, full: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Distances to all points of the length, some rows at a time, so that they take bounded memory."""
        points = self.points[full.shape[1]]
        step = max(1, ROOM // len(points))
        for a in range(0, len(full), step):
            yield slice(a, a + step), distances(units(full[a : a + step]), points)

    def place(self, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell (-1 where there are no vantage points of the length) and distance to its point."""
        cell, least = np.full(len(full), -1), np.zeros(len(full))
        if full.shape[1] in self.points:
            for at, far in self.far(full):
                cell[at], least[at] = far.argmin(1), far.min(1)
        return cell, least

    def wanted(self, q: dict[str, np.ndarray], factor: float) -> Iterator[tuple[int, np.ndarray]]:
        """Each tile with the queries that look in it: their own cell at first, and with bounds all
        other cells whose lower bound of the distance is not over a query's own."""
        full, home = q["full"], q["home"]
        w = full.shape[1]
        need = None
        if "bound" in q and w in self.points:
            need = np.zeros((len(full), len(self.points[w])), bool)
            for at, far in self.far(full):
                gap = np.maximum((far - q["least"][at, None]) / 2, np.maximum(far - self.high[w], self.low[w] - far))
                need[at] = gap <= factor * q["bound"][at, None] + SLACK
            need[np.arange(len(full)), home] = False
        for tile, cells in self.tiles.get(w, {}).items():
            if "bound" not in q:
                hit = np.isin(home, cells)
            elif need is None:
                continue  # there is no other cell
            else:
                hit = need[:, cells].any(1)
            if hit.any():
                yield tile, hit

    def open(self, q: dict[str, np.ndarray], cell: int, factor: float) -> np.ndarray:
        """The queries that look in a cell."""
        w = q["full"].shape[1]
        if "bound" not in q or cell < 0:
            return (q["home"] == cell) & ("bound" not in q)
        far = distances(q["unit"], self.points[w][cell][None])[:, 0]
        gap = np.maximum((far - q["least"]) / 2, np.maximum(far - self.high[w][cell], self.low[w][cell] - far))
        return (gap <= factor * q["bound"] + SLACK) & (q["home"] != cell)


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5, factor: float = 0.2, shard_rows: int = 2048, block: int = 512, most_cells: int = 4096, tile_bytes: int = 64 << 20, ask_bytes: int = 64 << 20) -> DataFrame:
    """query_id, rank, vec_id, score for each row of ``embeddings`` (vec_id, embedding) that is a query.

    Candidates are all rows but those of the query's own id. Vectors that are null, empty, zero, or
    hold a null or non-finite component, rows without an id and vectors of another length than
    the query's take no part. Ties go to the smaller id, also between scaled copies. Rows that repeat an id
    and vector count once; an id with several vectors is a candidate by its nearest one and asks with
    each. Other columns are ignored; an empty table gives an empty result. ``most_cells`` bounds what
    the driver holds of the top level; more rows make more shards of a cell, never fewer candidates.
    ``tile_bytes`` and ``ask_bytes`` bound the vectors and the queries that a task holds at once; they change no row.
    """
    v = F.col("embedding").cast("array<double>")
    size = F.array_max(F.transform(v, F.abs))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (size > 0)
    rows = embeddings.select("vec_id", "embedding").where(F.coalesce(usable, F.lit(False))).select("vec_id", v.alias("v")).withColumn("key", F.xxhash64("v"))
    # only a class's smallest ids can be among the nearest; the group limit keeps the rest out of the shuffle
    single = keep(rows.dropDuplicates(["key", "v", "vec_id"]))
    ids = single.withColumn("n", F.expr("row_number() over (partition by key, v order by vec_id)")).where(F.col("n") <= k + 1)
    classes = keep(ids.groupBy("key", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    total = classes.count()
    each = single.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    wide = (k + 1) * each  # classes that hold k + 1 different ids
    wanted = min(most_cells, -(-total // shard_rows))
    share = int(min(1.0, 1.5 * wanted / max(1, total)) * (1 << 30))
    hashed = classes.select("v", F.pmod(F.xxhash64("key"), F.lit(1 << 30)).alias("h")).where(F.col("h") <= share)
    cells = Cells([np.array(r["v"]) for r in hashed.orderBy("h", "v").limit(wanted).collect()])

    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for width, part in pdf.groupby(pdf.v.map(len)):
                cell, far = cells.place(np.stack(part.v.to_list()))
                yield part.assign(width=width, cell=cell, far=far)

    placed = keep(classes.mapInPandas(assign, "key long, v array<double>, ids array<long>, width int, cell int, far double"))
    stats = placed.groupBy("width", "cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()
    cells.fill([tuple(r) for r in stats], shard_rows, tile_bytes)
    spark = embeddings.sparkSession
    numbered = [(r["width"], r["cell"], -(-r["n"] // shard_rows), cells.first[r["width"], r["cell"]], cells.per_tile[r["width"]]) for r in stats]
    parts = F.broadcast(spark.createDataFrame(numbered, "width int, cell int, parts int, first long, each int"))  # a row for each cell

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        full = np.stack(pdf.v.to_list())
        ids = np.full((len(pdf), k + 1), np.iinfo(np.int64).max)
        for i, x in enumerate(pdf.ids):
            ids[i, : len(x)] = x
        return pd.DataFrame([(pdf.width.iloc[0], pdf.cell.iloc[0], pdf.tile.iloc[0], packed(full, ids=ids, **build(units(full))))], columns=["width", "cell", "tile", "tree"])

    shards = placed.join(parts, ["width", "cell"]).withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")))
    shards = shards.withColumn("tile", F.floor((F.col("first") + F.col("part")) / F.col("each")).cast("int")).drop("parts", "first", "each")
    trees = keep(shards.groupBy("width", "cell", "part").applyInPandas(index, "width int, cell int, tile int, tree binary"))
    asked = keep(single.where(is_query).mapInPandas(assign, "vec_id long, v array<double>, key long, width int, cell int, far double"))
    held = asked.agg(F.coalesce(F.sum(F.col("width") * 8 + 40), F.lit(0))).first()[0]
    pieces = max(1, -(-held // ask_bytes))  # into which the queries are dealt once they look in all cells

    def send(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of queries for each tile that some of them look in."""
        for pdf in batches:
            for width, some in pdf.groupby("width"):
                for a in range(0, len(some), block):
                    part = some.iloc[a : a + block]
                    q = dict(ids=part.vec_id.to_numpy(np.int64), keys=part.key.to_numpy(np.int64), home=part.cell.to_numpy(), least=part.far.to_numpy(), full=np.stack(part.v.to_list()))
                    if "bound" in part:
                        q["bound"] = part.bound.to_numpy(np.float64)
                    piece = int(part.key.iloc[0]) % pieces if "bound" in part else 0
                    for tile, hit in cells.wanted(q, factor):
                        yield pd.DataFrame([(width, tile, piece, packed(**{name: x[hit] for name, x in q.items()}))], columns=["width", "tile", "piece", "asked"])

    names = ["query_id", "query_key", "vec_id", "score"]

    def look(shards: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of a tile for each query of a piece."""
        if shards.empty or asks.empty:
            return pd.DataFrame({name: pd.Series(dtype=float if name == "score" else np.int64) for name in names})
        held = [(cell, t, units(t["full"])) for cell, t in zip(shards.cell, map(unpacked, shards.tree))]
        best = []
        for data in asks.asked:
            q = unpacked(data)
            q["unit"] = units(q["full"])
            found = []
            for cell, t, unit in held:
                live = np.flatnonzero(cells.open(q, cell, factor))
                query, row = search(unit, t, q["unit"][live], wide, factor, q["bound"][live] if "bound" in q else None)
                query = live[query]
                score = cosines(q["full"][query], t["full"][row])
                ids = t["ids"][row]
                i, j = np.nonzero((ids != np.iinfo(np.int64).max) & (ids != q["ids"][query][:, None]))
                found.append(pd.DataFrame({"query_id": q["ids"][query[i]], "query_key": q["keys"][query[i]], "vec_id": ids[i, j], "score": score[i]}))
            out = pd.concat(found).sort_values(names[:2] + ["score", "vec_id"], ascending=[True, True, False, True]).drop_duplicates(names[:3])
            best.append(out.groupby(names[:2]).head(k))
        return pd.concat(best)

    def looked(queries: DataFrame, pieces: int = 1) -> DataFrame:
        by = ["width", "tile", "piece"]
        ask = queries.mapInPandas(send, "width int, tile int, piece int, asked binary")
        dealt = trees.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        return dealt.groupBy(*by).cogroup(ask.groupBy(*by)).applyInPandas(look, "query_id long, query_key long, vec_id long, score double")

    own = keep(looked(asked))
    best = own.groupBy("query_id", "query_key", "vec_id").agg(F.max("score").alias("score"))
    best = best.withColumn("rank", F.expr("row_number() over (partition by query_id, query_key order by score desc)")).where(F.col("rank") <= k)
    best = best.groupBy("query_id", "query_key").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    bound = best.select(F.col("query_id").alias("vec_id"), F.col("query_key").alias("key"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))).alias("bound"))
    rest = looked(asked.join(bound, ["vec_id", "key"], "left").withColumn("bound", F.coalesce("bound", F.lit(4.0))), pieces)
    found = own.unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
