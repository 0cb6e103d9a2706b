"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample (SAMPLE vectors); every row of the table is then indexed
in every tree. A query walks all trees through one priority queue, widest margin first, until its
leaves hold the share of the rows at which searches of the sample itself reach RECALL of their
neighbours; queries and rows of a leaf meet in a shuffle, and candidates are ranked by their exact
inner products. Vectors are lifted to equal length by one more component,
so that the largest inner product is the nearest. Equal vectors are indexed once, with the few ids
that can appear in a result, and equal queries are searched once, so copies never crowd a leaf.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import cut

SAMPLE, LEAF, TREES = 20_000, 800, 4
# Of the neighbours in the sample, over the searches of its first MEASURED vectors.
RECALL, MEASURED = 0.96, 400
NEIGHBOURS, EVERY = 20, 20
# Rows and queries that meet in one task.
ROWS_TOGETHER, QUERIES_TOGETHER = 20_000, 20_000
SEED = 11


@dataclass
class Tree:
    """Inner nodes as hyperplanes; a child below zero is the leaf ~child."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    shares: np.ndarray


def fitted(points: np.ndarray, leaf: int, chance: np.random.Generator) -> Tree:
    normals, offsets, children, sizes = [], [], [], []

    def grow(own: np.ndarray, depth: int) -> int:
        for _ in range(3):
            if len(own) <= leaf or depth > 40:
                break
            a, b = points[chance.choice(own, 2, replace=False)]
            normal = a - b
            norm = np.linalg.norm(normal)
            if norm == 0:
                continue
            normal /= norm
            margin = points[own] @ normal
            offset = float(np.median(margin))
            right = margin > offset
            if not right.any():
                continue
            node = len(normals)
            normals.append(normal)
            offsets.append(offset)
            children.append([0, 0])
            children[node] = [grow(own[~right], depth + 1), grow(own[right], depth + 1)]
            return node
        sizes.append(len(own))
        return ~(len(sizes) - 1)

    grow(np.arange(len(points)), 0)
    width = points.shape[1]
    return Tree(
        np.array(normals).reshape(-1, width),
        np.array(offsets),
        np.array(children, dtype=np.int64).reshape(-1, 2),
        np.array(sizes) / max(1, len(points)),
    )


def leaves(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    at = np.zeros(len(points), dtype=np.int64)
    if not len(tree.normals):
        return at
    going = np.arange(len(points))
    while len(going):
        node = at[going]
        side = np.einsum("ij,ij->i", points[going], tree.normals[node]) > tree.offsets[node]
        at[going] = tree.children[node, side.astype(np.int64)]
        going = going[at[going] >= 0]
    return ~at


def probes(forest: list[Tree], point: np.ndarray, share: float) -> list[tuple[int, int]]:
    """(tree, leaf) in order of the shared queue until their rows add up to ``share``."""
    margins = [t.normals @ point - t.offsets for t in forest]
    queue = [(-np.inf, n, 0 if len(t.normals) else ~0) for n, t in enumerate(forest)]
    found, seen = [], 0.0
    while queue and seen < share:
        width, n, node = heapq.heappop(queue)
        if node < 0:
            found.append((n, ~node))
            seen += forest[n].shares[~node]
            continue
        margin = margins[n][node]
        left, right = forest[n].children[node]
        heapq.heappush(queue, (max(width, -margin), n, int(right)))
        heapq.heappush(queue, (max(width, margin), n, int(left)))
    return found


def measured_share(
    forest: list[Tree], points: np.ndarray, rows: int, most: int, recall: float = RECALL
) -> float:
    """The share of rows, counted once per tree, at which ``recall`` of the nearest neighbours of the
    sample's first points have been reached. As many neighbours in the sample count as the ``most``
    nearest of all ``rows`` have there, one at least."""
    if len(points) < 2:
        return 1.0
    vectors = points[:, :-1]
    asked = vectors[:MEASURED]
    scores = asked @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    near = min(max(1, -(-most * len(points) // max(rows, 1))), len(points) - 1)
    placed = np.array([leaves(t, points) for t in forest])
    reached = []
    for point, row in zip(asked, scores):
        before, seen = {}, 0.0
        for n, leaf in probes(forest, np.append(point, 0.0), np.inf):
            before[n, leaf] = seen
            seen += forest[n].shares[leaf]
        for i in np.argsort(-row, kind="stable")[:near]:
            reached.append(min(before[n, int(leaf)] for n, leaf in enumerate(placed[:, i])))
    enough = float(np.quantile(reached, recall, method="higher"))
    # Leaves that begin at this share are still to be searched.
    return max(enough + 1e-9, max(float(t.shares.max()) for t in forest))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lifted(points: np.ndarray, longest: float) -> np.ndarray:
    more = np.sqrt(np.maximum(0.0, longest - (points**2).sum(axis=1)))
    return np.column_stack([points, more])


def _chunks(forest: list[Tree], rows: int, queries: int, share: float):
    """Parts into which the rows and the queries of a leaf are dealt, from its share of rows and
    the part of a tree that a query visits."""
    per_leaf = queries * min(1.0, share / len(forest))
    return [
        [
            (
                max(1, round(float(s) * rows / ROWS_TOGETHER)),
                max(1, round(per_leaf / QUERIES_TOGETHER)),
            )
            for s in t.shares
        ]
        for t in forest
    ]


def _placer(forest, longest, chunks, share: float | None):
    """Rows of (id, v) with their places (tree, leaf, row part, query part): for rows the leaf in
    each tree, for queries (``share`` given) the leaves of the search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, points = batch.column(0).to_numpy(), _matrix(batch.column(1))
            index, places = [], []
            if share is None:
                lifted = _lifted(points, longest)
                for n, tree in enumerate(forest):
                    for i, leaf in enumerate(leaves(tree, lifted).tolist()):
                        own, others = chunks[n][leaf]
                        for q in range(others):
                            index.append(i)
                            places.append((n, leaf, int(ids[i]) // EVERY % own, q))
            else:
                for i, point in enumerate(np.column_stack([points, np.zeros(len(points))])):
                    for n, leaf in probes(forest, point, share):
                        own, others = chunks[n][leaf]
                        for r in range(own):
                            index.append(i)
                            places.append((n, leaf, r, int(ids[i]) // EVERY % others))
            step = 200_000
            for a in range(0, len(index), step):
                part = batch.take(pa.array(index[a : a + step]))
                columns = [pa.array(c, pa.int32()) for c in zip(*places[a : a + step])]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *columns], ["id", "v", "tree", "leaf", "r", "q"]
                )

    return run


def _ranker(most: int):
    """The ``most`` best rows of a leaf for each query, by exact products."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            ids, points = rows.column("id").to_numpy(), _matrix(rows.column("v"))
            asked, wanted = queries.column("id").to_numpy(), _matrix(queries.column("v"))
            k = min(most, len(ids))
            step = max(1, 4_000_000 // len(ids))
            for a in range(0, len(asked), step):
                scores = wanted[a : a + step] @ points.T
                edge = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                # Products may differ in the last bits here; what is near the edge is ranked anew.
                slack = 1e-9 * (1 + np.abs(edge))
                for j in range(len(scores)):
                    near = np.flatnonzero(scores[j] >= edge[j] - slack[j])
                    exact = (points[near] * wanted[a + j]).sum(axis=1)
                    order = np.lexsort((ids[near], -exact))[:k]
                    found.append((asked[a + j], ids[near][order], exact[order]))
        sizes = [len(x[1]) for x in found]
        one = lambda k, t: np.concatenate([x[k] for x in found]) if found else np.zeros(0, t)
        return pa.table(
            {
                "query": pa.array(np.repeat([x[0] for x in found], sizes).astype(np.int64)),
                "vec_id": pa.array(one(1, np.int64).astype(np.int64)),
                "score": pa.array(one(2, np.float64)),
            }
        )

    return run


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of rows with an id and a vector of finite numbers that are not all zero."""
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(embedding).alias("v"),
    ).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    neighbours: int = NEIGHBOURS,
    every: int = EVERY,
    share: float | None = None,
    recall: float = RECALL,
    trees: int = TREES,
    leaf: int = LEAF,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row whose id ``every`` divides.

    A search ends when its leaves hold ``share`` of the rows, counted once per tree; where it is not
    given it is measured, as the share that reaches ``recall`` within the sample.

    Scores are inner products in double precision; equal ones are ranked by id, and a query's own
    id is no result of it. Defined cases: rows without an id, with a null or zero vector, with a
    null or non-finite component, or of another length than most take no part; of repeated ids
    every row is a candidate and a query of its own vector; other columns are ignored; fewer
    candidates than asked are all returned; an empty table gives an empty table.
    """
    usable = _usable(vectors, vec_id, embedding)
    lengths = usable.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    common = lengths.orderBy(F.desc("rows"), "n").first()
    usable = usable.filter(F.size("v") == (common["n"] if common else 0))
    most = neighbours + 1
    copies = Window.partitionBy("v").orderBy("vec_id")
    rows = cut(
        usable.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= most).drop("copy")
    )
    queries = usable.filter(F.col("vec_id") % every == 0)
    asked = queries.groupBy("v").agg(F.min("vec_id").alias("asked"))
    square = F.aggregate(
        "v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    facts = rows.agg(F.max(square).alias("longest"), F.count(F.lit(1)).alias("n")).first()
    longest, n = facts["longest"] or 0.0, facts["n"]
    seen = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).toArrow()
    points = _lifted(_matrix(seen.column("v")), longest) if seen.num_rows else np.zeros((0, 1))
    chance = np.random.default_rng(seed)
    forest = [fitted(points, leaf, chance) for _ in range(trees)]
    if share is None:
        share = measured_share(forest, points, n, neighbours, recall)
    parts = _chunks(forest, n, max(1, n // every), share)
    kind = usable.schema["v"].dataType.simpleString()
    places = f"id long, v {kind}, tree int, leaf int, r int, q int"
    stored = rows.select(F.col("vec_id").alias("id"), "v").mapInArrow(
        _placer(forest, longest, parts, None), places
    )
    searched = asked.select(F.col("asked").alias("id"), "v").mapInArrow(
        _placer(forest, longest, parts, share), places
    )
    key = ("tree", "leaf", "r", "q")
    found = (
        stored.groupBy(*key)
        .cogroup(searched.groupBy(*key))
        .applyInArrow(_ranker(most), "query long, vec_id long, score double")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    top = once.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most)
    members = queries.join(asked.withColumnRenamed("v", "same"), F.col("v") == F.col("same")).select(
        F.col("vec_id").alias("query_id"), "asked"
    )
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        members.join(top, F.col("asked") == F.col("query"))
        .filter(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(own))
        .filter(F.col("rank") <= neighbours)
        .select("query_id", "rank", "vec_id", "score")
    )
