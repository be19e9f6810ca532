"""Approximate nearest neighbours by inner product, from a few stable projections indexed by kd-trees.

Vectors get one more coordinate that brings them to one norm M, so that the largest inner product is the least
Euclidean distance. A few Gaussian (2-stable) projections map them to a low dimension, where squared distances are the
true ones times a chi-square variable. Rows are put into blocks along a kd-tree over the projections (fitted to a
bounded sample; every row is indexed), and a block has a kd-tree of its own. For a query, leaves are taken in the order
of projected distance and their vectors verified in the full space, until a chi-square test holds: were there a nearer
vector than the k-th found, it would have been projected nearer than the next leaf with probability of at least
`confidence`. The same test decides which blocks a query goes on to after its own.

Cells grow in number with the rows. Queries and blocks meet in groups of bounded size: a block is copied only for queries
that visit it. A cell that holds very many equal vectors is several blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor those of
another length than most have; equal scores are ranked by the smaller id; a query has as many rows as there are other
vectors, if these are fewer than k; rows that repeat an id are candidates of their own, but never of a query with that
id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialise

PROJECTIONS = 8
CONFIDENCE = 0.97
#: Rows of a block, queries that meet it at once, rows of a leaf, leaves that are verified between two tests.
BLOCK_ROWS, QUERY_ROWS, LEAF_ROWS, LEAVES = 8192, 8192, 64, 8
#: The upper tree is fitted to a sample of about so many rows at least, and so many for each of its cells; at most to the third.
SAMPLE_ROWS, SAMPLE_PER_CELL, MOST_SAMPLED = 4096, 4, 1_000_000
#: Scores this near, of the largest that norms allow, are summed again, always in the same order, before they are compared.
_NEAR = 1e-9
_STEPS = 1 << 30


def chi_square(x: np.ndarray) -> np.ndarray:
    """Distribution function with PROJECTIONS (an even number) degrees of freedom."""
    half = np.asarray(x, float) / 2
    return 1 - np.exp(-half) * sum(half**k / math.factorial(k) for k in range(PROJECTIONS // 2))


class Projection:
    def __init__(self, dim: int, top: float, seed: int) -> None:
        self.matrix, self.top = np.random.default_rng(seed).standard_normal((dim + 1, PROJECTIONS)), top

    def stored(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", x, x), 0))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def query(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix[:-1]


class Tree:
    """A kd-tree over points: split at the median of the widest dimension."""

    def __init__(self, points: np.ndarray, leaf_rows: int, max_leaves: int = 1 << 30) -> None:
        self.dims: list[int] = []
        self.cuts: list[float] = []
        self.children: list[tuple[int, int]] = []
        self.leaves: list[np.ndarray] = []
        self.max_leaves = max_leaves
        self.root = self._build(points, np.arange(len(points)), leaf_rows, max_leaves)

    def _build(self, points: np.ndarray, rows: np.ndarray, leaf_rows: int, most: int) -> int:
        """The node's number; leaves are -1, -2, ..."""
        own = points[rows]
        spread = np.ptp(own, axis=0) if len(rows) else np.zeros(1)
        if len(rows) > leaf_rows and most > 1 and spread.max() > 0:
            dim = int(spread.argmax())
            cut = float(np.median(own[:, dim]))
            low = own[:, dim] <= cut
            if low.all():
                low = own[:, dim] < cut
                cut = np.nextafter(cut, -np.inf)
            node = len(self.dims)
            self.dims.append(dim), self.cuts.append(cut), self.children.append((0, 0))
            self.children[node] = self._build(points, rows[low], leaf_rows, most // 2), self._build(points, rows[~low], leaf_rows, most - most // 2)
            return node
        self.leaves.append(rows)
        return -len(self.leaves)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            low = points[rows, self.dims[node]] <= self.cuts[node]
            todo += [(self.children[node][0], rows[low]), (self.children[node][1], rows[~low])]
        return out


def _apart(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point to boxes."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return np.einsum("ij,ij->i", gap, gap)


def _stack(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), float)


class Block:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: Projection) -> None:
        projected = projection.stored(vectors)
        tree = Tree(projected, LEAF_ROWS)
        order = np.concatenate(tree.leaves)
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order].T)
        self.ends = np.cumsum([len(leaf) for leaf in tree.leaves])
        self.starts = self.ends - [len(leaf) for leaf in tree.leaves]
        self.low = np.array([projected[leaf].min(0) for leaf in tree.leaves])
        self.high = np.array([projected[leaf].max(0) for leaf in tree.leaves])
        self.projection = projection

    def nearest(self, own: int, vector: np.ndarray, k: int, worst: float, confidence: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k, found by taking leaves outwards; worst: the k-th score found elsewhere."""
        reach = _apart(self.projection.query(vector[None])[0], self.low, self.high)
        leaves = np.argsort(reach, kind="stable")
        base = float(vector @ vector) + self.projection.top
        slack = _NEAR * math.sqrt(float(vector @ vector) * self.projection.top)
        at, score = np.zeros(0, np.int64), np.zeros(0)
        for step in range(0, len(leaves), LEAVES):
            bound = base - 2 * worst
            next_ = reach[leaves[step]]
            if next_ > 0 and (bound <= 0 or chi_square(next_ / bound) >= confidence):
                break
            rows = np.concatenate([np.arange(self.starts[x], self.ends[x]) for x in leaves[step : step + LEAVES]])
            rows = rows[self.ids[rows] != own]
            at, score = np.concatenate((at, rows)), np.concatenate((score, vector @ self.vectors[:, rows]))
            if len(score) >= k:
                worst = max(worst, float(np.partition(score, len(score) - k)[len(score) - k]))
            near = score >= worst - slack
            at, score = at[near], score[near]
        exact = np.zeros(len(at))
        for j, x in enumerate(vector):
            exact += x * self.vectors[j, at]
        best = np.lexsort((self.ids[at], -exact))[:k]
        return self.ids[at[best]], exact[best]


_FOUND = "query_id long, vec_id long, score double"


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    confidence: float = CONFIDENCE,
    seed: int = 29,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, the k other rows of largest inner product."""
    spark = vectors.sparkSession
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    base = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    valid = base.where(v.isNotNull() & F.col("i").isNotNull()).where((F.size(v) > 0) & finite).where(F.exists(v, lambda x: x != 0)).withColumn("d", F.size(v))
    dims = valid.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = materialise(valid.where(F.col("d") == dims["d"]).select("i", "v", "q", F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("norm")), "vectors")
    n, top = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
    projection = Projection(dims["d"], float(top), seed)
    wanted = -(-n // block_rows)
    share = min(1.0, min(MOST_SAMPLED, max(SAMPLE_ROWS, SAMPLE_PER_CELL * wanted)) / n)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = projection.stored(np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([pa.array(list(points), pa.list_(pa.float64()))], ["p"])

    some = rows.where(F.pmod(F.xxhash64("i", F.lit(7)), F.lit(_STEPS)) < math.ceil(share * _STEPS)).select("v")
    sample = np.array([r["p"] for r in some.mapInArrow(project, "p array<double>").collect()], float).reshape(-1, PROJECTIONS)
    # The order in which rows arrive must not matter.
    upper = Tree(sample[np.lexsort(sample.T)], 1, min(max(1, len(sample)), wanted))
    columns = [f"p{j}" for j in range(PROJECTIONS)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = projection.stored(np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upper.leaf_of(points)), *(pa.array(p) for p in points.T)], [*batch.schema.names, "cell", *columns])

    schema = rows.select("i", "v", "q").schema.add("cell", "long")
    for c in columns:
        schema = schema.add(c, "double")
    placed = materialise(rows.select("i", "v", "q").mapInArrow(place, schema), "placed")
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(f"l{c}") for c in columns), *(F.max(c).alias(f"h{c}") for c in columns)).orderBy("cell").collect()
    cells = {b["cell"]: k for k, b in enumerate(boxes)}
    low = np.array([[b[f"l{c}"] for c in columns] for b in boxes])
    high = np.array([[b[f"h{c}"] for c in columns] for b in boxes])
    parts = [-(-b["n"] // (2 * block_rows)) for b in boxes]
    # A cell of very many rows (equal ones can't be told apart by a tree) is several blocks.
    first = np.concatenate(([0], np.cumsum(parts)))
    places = spark.createDataFrame([(int(c), int(first[k]), int(parts[k])) for c, k in cells.items()], "cell long, first long, parts long")
    block = F.col("first") + F.pmod(F.xxhash64("i"), F.col("parts"))
    blocked = materialise(placed.select("i", "v", "q", "cell").join(F.broadcast(places), "cell").select("i", "v", "q", block.alias("block")), "blocked")
    asked = blocked.where("q").select("i", "v", "block")

    def meet(queries: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(stored):
            block = Block(stored["i"].to_numpy(np.int64), _stack(stored["v"]), projection)
            for own, vector, worst in zip(queries["i"], _stack(queries["v"]), queries["worst"], strict=True):
                ids, scores = block.nearest(own, vector, k, worst, confidence)
                out.append(pd.DataFrame({"query_id": np.full(len(ids), own), "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    def found(queries: DataFrame) -> DataFrame:
        """What blocks give the queries (i, v, block, worst): a block is copied once for each QUERY_ROWS queries that visit it."""
        chunks = materialise(queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("chunks")), "chunks")
        own = queries.join(chunks, "block").select("i", "v", "block", F.pmod(F.xxhash64(F.lit(1), "i"), F.col("chunks")).alias("chunk"), "worst")
        copies = blocked.join(chunks, "block").select("i", "v", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).toDF("i", "v", "block", "chunk")
        return own.groupBy("block", "chunk").cogroup(copies.groupBy("block", "chunk")).applyInPandas(meet, _FOUND)

    home = materialise(found(asked.withColumn("worst", F.lit(float("-inf")))), "home")
    kth = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(float("-inf")).alias("worst"))

    def onwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            for k, (point, own, worst) in enumerate(zip(projection.query(x), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                bound = float(x[k] @ x[k]) + projection.top - 2 * worst
                reach = _apart(point, low, high)
                go = (reach == 0) | ((bound > 0) & (chi_square(reach / bound if bound > 0 else reach) < confidence))
                to = np.array([b for c in np.flatnonzero(go) for b in range(first[c], first[c + 1]) if b != own], np.int64)
                one = batch.slice(k, 1).take(pa.array(np.zeros(len(to), np.int64)))
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array(to), one.column(3)], batch.schema.names)

    known = asked.join(kth.withColumnRenamed("query_id", "i"), "i", "left").select("i", "v", "block", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
    further = found(materialise(known.mapInArrow(onwards, known.schema), "onwards"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return home.unionByName(further).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
