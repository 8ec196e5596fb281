"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Equal vectors share one node, which keeps the smallest ids that can be asked for, so that a vector
with very many copies is one node. Nodes are dealt to shards of a fixed size by a hash of their id;
each shard's graph is built in one task and stored as flat neighbour arrays, one row for each node.
Every query visits every shard, and the shards' results are merged; a shard's graph is never copied. Within a shard, a node is
linked as by insertion in random order: to near and diverse nodes among the earlier ones, whose
links back are pruned in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARD_ROWS = 16384
#: Links of a node (twice as many in the lowest layer), candidates for them, and breadth of the search.
LINKS, CANDIDATES, BREADTH = 16, 64, 128


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]
    return np.maximum(out, 0)


def _diverse(x: np.ndarray, near: np.ndarray, far: np.ndarray, most: int) -> list[int]:
    """Of candidates `near` (nearest first, at distances `far`), those nearer to the node than to one taken before."""
    apart = _squared(x[near], x[near])
    taken: list[int] = []
    least = np.full(len(near), np.inf)
    for k in range(len(near)):
        if far[k] < least[k]:
            taken.append(k)
            if len(taken) == most:
                break
            np.minimum(least, apart[k], out=least)
    return near[taken].tolist()


def build(x: np.ndarray, seed: int = 0) -> list[list[list[int]]]:
    """For each node, its neighbours by layer from 0; x: (nodes, dimensions)."""
    rng = np.random.default_rng(seed)
    n = len(x)
    level = np.minimum((-np.log(rng.uniform(1e-12, 1, n)) / np.log(LINKS)).astype(int), 8)
    order = rng.permutation(n)
    links: list[list[list[int]]] = [[[] for _ in range(top + 1)] for top in level]
    for layer in range(level.max(initial=-1) + 1):
        here = order[level[order] >= layer]
        most = LINKS * (2 if layer == 0 else 1)
        back: dict[int, list[int]] = {}
        for first in range(0, len(here), 512):
            rows = here[first : first + 512]
            far = _squared(x[rows], x[here[: first + len(rows)]])
            for k, node in enumerate(rows):
                earlier = first + k
                if not earlier:
                    continue
                d = far[k, :earlier]
                best = np.argpartition(d, CANDIDATES)[:CANDIDATES] if earlier > CANDIDATES else np.arange(earlier)
                best = best[np.argsort(d[best], kind="stable")]
                chosen = _diverse(x, here[best], d[best], LINKS)
                links[node][layer] = chosen
                for other in chosen:
                    back.setdefault(other, []).append(int(node))
        for node, more in back.items():
            every = np.array(links[node][layer] + more)
            if len(every) > most:
                d = _squared(x[node][None], x[every])[0]
                by = np.argsort(d, kind="stable")
                links[node][layer] = _diverse(x, every[by], d[by], most)
            else:
                links[node][layer] = every.tolist()
    return links


class Graph:
    """A shard's graph for searching: flat arrays of neighbours, and where each node's layers start."""

    def __init__(self, x: np.ndarray, flat: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        self.x = x
        self.layers = [np.split(f, np.cumsum(s)[:-1]) for f, s in zip(flat, sizes, strict=True)]
        self.top = max(map(len, self.layers)) - 1
        self.enter = next(k for k, layers in enumerate(self.layers) if len(layers) == self.top + 1)

    def _far(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        d = self.x[nodes] - q
        return np.einsum("ij,ij->i", d, d)

    def search(self, q: np.ndarray, breadth: int) -> list[tuple[float, int]]:
        """(squared distance, node), nearest first."""
        now = (float(self._far(q, np.array([self.enter]))[0]), self.enter)
        for layer in range(self.top, 0, -1):
            while len(near := self.layers[now[1]][layer]):
                d = self._far(q, near)
                k = int(d.argmin())
                if d[k] >= now[0]:
                    break
                now = (float(d[k]), int(near[k]))
        seen, todo, best = {now[1]}, [now], [(-now[0], now[1])]
        while todo:
            far, node = heappop(todo)
            if len(best) >= breadth and far > -best[0][0]:
                break
            near = [k for k in self.layers[node][0].tolist() if k not in seen]
            if not near:
                continue
            seen.update(near)
            for d, k in zip(self._far(q, np.array(near)).tolist(), near, strict=True):
                if len(best) < breadth or d < -best[0][0]:
                    heappush(todo, (d, k))
                    heappush(best, (-d, k))
                    if len(best) > breadth:
                        heappop(best)
        return sorted((-d, k) for d, k in best)


def index(vectors: DataFrame, keep: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """vectors (vec_id, embedding) as rows of graphs: shard, dims, ids, vector, at, flat, sizes; and the number of shards.

    A node stands for all equal vectors; ids: their `keep` smallest ids. flat: its neighbours
    (places in the shard by order of `at`), layer after layer; sizes: how many each layer has.
    """
    rows = vectors.where(usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).groupBy("vector", "vec_id").agg(F.lit(1).alias("one"))
    scratch = Scratch(vectors.sparkSession)
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("place") <= keep)
    nodes = scratch.cut(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, -(-nodes.count() // shard_rows))
    nodes = nodes.select(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int").alias("shard"), F.size("vector").alias("dims"), "ids", "vector")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ids", key=lambda ids: ids.str[0], ignore_index=True)
        links = build(np.stack(rows["vector"].to_numpy()).astype(np.float64))
        rows["at"] = np.arange(len(rows), dtype=np.int32)
        rows["flat"] = [np.array([k for layer in layers for k in layer], dtype=np.int32) for layers in links]
        rows["sizes"] = [np.array([len(layer) for layer in layers], dtype=np.int32) for layers in links]
        return rows

    graphs = nodes.groupBy("shard", "dims").applyInPandas(run, "shard int, dims int, ids array<long>, vector array<double>, at int, flat array<int>, sizes array<int>")
    return scratch.cut(graphs), shards


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, breadth: int = BREADTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision) of each query's k nearest.

    Both have vec_id and embedding. A query's own id is no candidate. Vectors that are null, zero
    or hold a null or non-finite component take no part, as query or candidate; vectors of other
    lengths than the query's are no candidates. Ties go to the smaller vec_id; a row repeated with
    id and vector counts once. Fewer candidates than k: all of them. Other columns are ignored.
    """
    graphs, shards = index(vectors, k + 1, shard_rows)
    asked = queries.where(usable(F.col("embedding"))).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")).dropDuplicates(["query_id"])
    nodes = graphs.select("shard", "dims", F.lit(0).alias("kind"), "at", "ids", "vector", "flat", "sizes", F.lit(None).cast("long").alias("query_id"))
    empty = {c: F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ("at", "ids", "flat", "sizes")}
    asked = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("vector").alias("dims"), F.lit(1).alias("kind"), empty["at"], empty["ids"], "vector", empty["flat"], empty["sizes"], "query_id"
    )

    def matrix(column: pa.Array, dims: int) -> np.ndarray:
        return column.flatten().to_numpy().reshape(-1, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, graph, ids = None, [], None, []
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("shard", "dims", "kind")])
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                shard, dims, kind = place[:, first].tolist() if last > first else (None, None, None)
                if kind is None:
                    continue
                part = batch.slice(first, last - first)
                if (shard, dims) != here:
                    here, parts, graph = (shard, dims), [], None
                if kind == 0:
                    parts.append(part)
                    continue
                if graph is None and parts:
                    table = pa.Table.from_batches(parts)
                    ids, parts = table.column("ids").to_pylist(), []
                    flat, sizes = ([np.array(v, dtype=np.int32) for v in table.column(c).to_pylist()] for c in ("flat", "sizes"))
                    graph = Graph(matrix(table.column("vector").combine_chunks(), dims), flat, sizes)
                if graph is not None:
                    yield answers(graph, ids, part.column("query_id").to_pylist(), matrix(part.column("vector"), dims))

    def answers(graph: Graph, ids: list[list[int]], query_ids: list[int], queries: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[int, int, float]] = []
        for query_id, q in zip(query_ids, queries, strict=True):
            found = [node for _, node in graph.search(q, breadth)]
            exact = np.sqrt(((graph.x[found] - q) ** 2).sum(1)).tolist()
            rows = sorted((d, int(i)) for d, node in zip(exact, found, strict=True) for i in ids[node] if i != query_id)
            out += [(query_id, i, d) for d, i in rows[:k]]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    # a task meets a shard's nodes first and holds their graph, then its queries pass by in batches
    dealt = nodes.unionByName(asked).repartition("shard", "dims").sortWithinPartitions("shard", "dims", "kind", "at")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the ten nearest of each hundredth vector of embeddings."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
