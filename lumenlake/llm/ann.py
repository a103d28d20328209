"""Approximate nearest neighbours by a forest of random-projection trees and exact reranking.

Each tree splits at random hyperplanes through the median of a bounded sample; every vector is then routed to
one leaf per tree. A query walks all trees at once through one priority queue: the unexplored side that
lies nearest to the query, in whichever tree, is opened next, until enough leaves are found. Queries meet
the members of their leaves by a shuffle on the leaf, in blocks of bounded size, and are scored exactly
there; each block returns its best, from which the best over all are taken.

Equal vectors are searched as one class and put in again afterwards, so a vector that many rows share
fills no leaf.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, checkpoint

#: Trees, their depth at least, rows per leaf above which they get deeper, and vectors in the sample they are fitted to.
TREES, DEPTH, LEAF, SAMPLE = 8, 5, 4096, 8192
#: The share of all leaves that a query opens. Vectors without any structure, as in the test tables, need
#: a constant share for the recall asked for; for vectors with few inherent dimensions it can be far smaller.
SHARE = 0.17
#: Members and queries of a leaf in one block.
MEMBERS, QUERIES = 8192, 8192


class Forest:
    """Hyperplanes (unit normals and thresholds) of trees in heap order: node n has children 2n+1 and 2n+2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 1):
        random = np.random.default_rng(seed)
        self.trees, self.depth, self.inner = trees, depth, (1 << depth) - 1
        normals = random.normal(size=(trees, self.inner, sample.shape[1]))
        self.normals = normals / np.linalg.norm(normals, axis=2, keepdims=True)
        self.thresholds = np.zeros((trees, self.inner))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for n in range(self.inner):
                here = np.flatnonzero(node == n)
                along = sample[here] @ self.normals[t, n]
                self.thresholds[t, n] = np.median(along) if len(here) else 0.0
                node[here] = 2 * n + 1 + (along > self.thresholds[t, n])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector and tree its leaf, numbered over all trees."""
        out = np.zeros((len(vectors), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", vectors, self.normals[t, node]) if self.inner else node
                node = 2 * node + 1 + (along > self.thresholds[t, node])
            out[:, t] = node - self.inner + (t << self.depth)
        return out

    def search(self, query: np.ndarray, count: int) -> list[int]:
        """The ``count`` leaves that one queue over all trees opens first, by the smallest margin on the way there."""
        queue = [(-math.inf, t, 0) for t in range(self.trees)]
        found: list[int] = []
        while queue and len(found) < count:
            reach, t, n = heapq.heappop(queue)
            while n < self.inner:
                margin = float(self.normals[t, n] @ query - self.thresholds[t, n])
                near, far = (2 * n + 2, 2 * n + 1) if margin > 0 else (2 * n + 1, 2 * n + 2)
                heapq.heappush(queue, (max(reach, abs(margin)), t, far))
                if queue[0][0] < reach:  # another side is nearer now
                    heapq.heappush(queue, (reach, t, near))
                    break
                n = near
            else:
                found.append(n - self.inner + (t << self.depth))
        return found


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and the vector as doubles, of rows that take part (see ``nearest``)."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(finite & F.exists(v, lambda x: x != 0))


def _best(queries: np.ndarray, members: np.ndarray, ids: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row of the query, id of the member, score: of each query its ``count`` best members, and any as good as the last."""
    for at in range(0, len(queries), 512):
        part = queries[at : at + 512]
        scores = part @ members.T
        if len(ids) > count:
            least = np.partition(scores, len(ids) - count, axis=1)[:, len(ids) - count]
            q, m = np.nonzero(scores >= least[:, None] - 1e-9)
        else:
            q, m = np.indices(scores.shape).reshape(2, -1)
        yield at + q, ids[m], (part[q] * members[m]).sum(axis=1)  # one order of addition wherever a pair meets


def nearest(vectors: DataFrame, is_query: Column, count: int = 20, column: str = "embedding", trees: int = TREES, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``count`` rows found nearest to each query row, itself left out.

    Nearest is the largest inner product in double precision, ties to the smaller vec_id. Rows with a null id, a
    vector that is null, zero, or holds a null or non-finite component, or whose length is not the most common one
    (of equally common ones the largest) take no part. Rows are told apart by vec_id: repeated ones
    count as one. An empty table gives no rows.
    """
    empty = "query_id long, rank int, vec_id long, score double"
    session = vectors.sparkSession
    rows = usable(vectors, column)
    lengths = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if lengths is None:
        return session.createDataFrame([], empty)
    size, total = lengths["size"], lengths["n"]
    rows = rows.filter(F.size("vector") == size)
    classes = checkpoint(rows.groupBy("vector").agg(F.min("vec_id").alias("class")))
    members = checkpoint(rows.join(classes, "vector").select("vec_id", "class").distinct())
    sample = classes.select("vector").orderBy(F.xxhash64("class"), "class").limit(SAMPLE).toPandas()["vector"]  # SAMPLE rows at most
    depth = max(DEPTH, math.ceil(math.log2(max(1, total / LEAF)))) if total > 2 * LEAF else max(0, math.ceil(math.log2(total / 256)))
    forest = Forest(np.stack(sample.to_numpy()), trees, depth)
    opened = max(trees, math.ceil(share * (trees << depth)))

    def route(batches: Batches) -> Batches:
        for batch in batches:
            leaves = forest.leaves(_matrix(batch.column("vector"), size)) if batch.num_rows else np.zeros((0, trees), np.int64)
            yield _routed(batch, [*leaves])

    def look(batches: Batches) -> Batches:
        for batch in batches:
            yield _routed(batch, [np.array(forest.search(q, opened)) for q in _matrix(batch.column("vector"), size)])

    def _routed(batch: pa.RecordBatch, leaves: list[np.ndarray]) -> pa.RecordBatch:
        packed = [x.tobytes() for x in _matrix(batch.column("vector"), size)]
        times = [len(x) for x in leaves]
        row = np.repeat(np.arange(len(leaves)), times)
        return pa.record_batch(
            {
                "leaf": pa.array(np.concatenate(leaves) if leaves else [], pa.int64()),
                "class": batch.column("class").take(pa.array(row)),
                "packed": pa.array(packed, pa.binary()).take(pa.array(row)),
            }
        )

    routed = "leaf long, class long, packed binary"
    asked = members.filter(is_query).select("class").distinct()
    placed = classes.select("class", "vector").mapInArrow(route, routed)
    asking = checkpoint(classes.join(asked, "class", "left_semi").select("class", "vector")).mapInArrow(look, routed)
    most = lambda df: (df.groupBy("leaf").count().agg(F.max("count")).first()[0] or 0)
    rows_of, queries_of = math.ceil(most(placed.select("leaf")) / MEMBERS), math.ceil(most(asking.select("leaf")) / QUERIES)
    rows_of, queries_of = max(1, rows_of), max(1, queries_of)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    own = lambda n, name: F.pmod(F.xxhash64("class"), F.lit(n)).cast("int").alias(name)
    left = asking.select("*", own(queries_of, "q"), every(rows_of, "m"))
    right = placed.select("*", own(rows_of, "m"), every(queries_of, "q"))

    def rerank(key: tuple, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query": [], "class": [], "score": []})
        vectors_of = lambda x: np.frombuffer(b"".join(x["packed"]), np.float64).reshape(-1, size)
        found = _best(vectors_of(queries), vectors_of(candidates), candidates["class"].to_numpy(), count + 1)
        ids = queries["class"].to_numpy()
        return pd.concat([pd.DataFrame({"query": ids[q], "class": c, "score": s}) for q, c, s in found])

    keys = ["leaf", "m", "q"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rerank, "query long, class long, score double")
    pairs = scored.groupBy("query", "class").agg(F.max("score").alias("score"))
    ranked = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    pairs = pairs.withColumn("n", ranked("query", F.desc("score"), "class")).filter(F.col("n") <= count + 1).drop("n")
    some = members.withColumn("n", ranked("class", "vec_id")).filter(F.col("n") <= count + 1)
    some = checkpoint(some.groupBy("class").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))  # count + 1 at most
    single = checkpoint(pairs).join(some, "class").select("query", "score", F.explode("ids").alias("vec_id"))
    single = single.withColumn("n", ranked("query", F.desc("score"), "vec_id")).filter(F.col("n") <= count + 1)
    answers = checkpoint(single.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found")))
    out = members.filter(is_query).join(answers, F.col("class") == F.col("query")).select(
        F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")), 1, count).alias("found")
    )
    return out.select("query_id", F.posexplode("found")).select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", "col.score")
