"""Approximate nearest neighbours with robust-pruned directed graphs, one per shard.

Nearness is the largest inner product. A shard holds vectors of about one length (within `BAND`), lifted by one more
component to equal length, so the order by inner product is the order by distance and the graph works on distances.
Without the bands, short vectors would lie far from where any query is.

Equal vectors are one node; per node only the smallest ids are kept that can be in a result (k + 1, as a query may
be one of them), so a vector that a third of all rows hold is one node. Nodes of a band are dealt at random into shards of
bounded size; neighbouring bands of few nodes share one. In each shard the graph is built in rounds of doubling size: a greedy search for every new node on the
graph so far proposes neighbours; relaxed pruning keeps the nearest and drops every candidate that is clearly
nearer to a kept one than to the node (factor `alpha`), so edges point in diverse directions; reverse edges are added and
pruned alike. What can't be reached from the middle gets entries of its own. Queries go to every shard, which searches them with a beam, batch by
batch, and the best of all shards win; the index is shuffled once, however many queries there are. Every row is
in a graph; the beam decides what is found, and found scores are the exact inner products in double precision.

Vectors that are null, zero, of another dimension than most, or hold a null or non-finite component take no part; nor
do rows without an id. Of repeated rows with one id and one vector, one takes part; an id with several vectors asks with
each, and stands at its best score. Ties go to the smaller id. Fewer candidates than asked for are all returned, as a beam holds more
nodes than a result. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicegrid.functions.text import once
from voicegrid.session import materialize

NEAREST = 20
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2
SHARD_NODES = 20_000
QUERY_BLOCK = 512
ROUND = 1024
# Lengths in a shard differ by this factor at most, but for bands that fit a beam together.
BAND = 1.1


def _distances(points: np.ndarray, rows: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Squared distances of targets[i] to points[rows[i, :]]; all points have one length, so the product says it."""
    return 2.0 - 2.0 * np.einsum("qrd,qd->qr", points[rows], targets)


def beam_search(
    points: np.ndarray, graph: np.ndarray, entry: int | np.ndarray, targets: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) of the `beam` nearest found for every target, nearest first; -1 where there are fewer.

    `entry` is one node or several.

    All targets step together: each opens its nearest unopened node and merges that node's neighbours into its beam.
    """
    count = len(targets)
    nodes = np.full((count, beam), -1, dtype=np.int64)
    far = np.full((count, beam), np.inf, dtype=np.float32)
    opened = np.ones((count, beam), dtype=bool)
    entries = np.broadcast_to(np.atleast_1d(entry), (count, np.size(entry)))
    begun = _distances(points, entries, targets)
    nearest = np.argsort(begun, axis=1, kind="stable")[:, :beam]
    nodes[:, :nearest.shape[1]] = np.take_along_axis(entries, nearest, axis=1)
    far[:, :nearest.shape[1]] = np.take_along_axis(begun, nearest, axis=1)
    opened[:, :nearest.shape[1]] = False
    active = np.arange(count)
    while len(active):
        waiting = np.where(opened[active], np.inf, far[active])
        at = waiting.argmin(axis=1)
        go = np.isfinite(waiting[np.arange(len(active)), at])
        active, at = active[go], at[go]
        if not len(active):
            break
        opened[active, at] = True
        fresh = graph[nodes[active, at]]
        known = (fresh[:, :, None] == nodes[active][:, None, :]).any(axis=2) | (fresh < 0)
        d = np.where(known, np.inf, _distances(points, np.maximum(fresh, 0), targets[active])).astype(np.float32)
        all_nodes = np.concatenate([nodes[active], np.where(known, -1, fresh)], axis=1)
        all_far = np.concatenate([far[active], d], axis=1)
        all_opened = np.concatenate([opened[active], known], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        nodes[active] = np.take_along_axis(all_nodes, order, axis=1)
        far[active] = np.take_along_axis(all_far, order, axis=1)
        opened[active] = np.take_along_axis(all_opened, order, axis=1)
    return nodes, far


def robust_prune(points: np.ndarray, owners: np.ndarray, options: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most `degree` diverse neighbours of each owner out of its row of `options` (-1 for none)."""
    options = np.where(options == owners[:, None], -1, options)
    own = np.where(options < 0, np.inf, _distances(points, np.maximum(options, 0), points[owners]))
    order = np.argsort(own, axis=1, kind="stable")
    options, own = np.take_along_axis(options, order, axis=1), np.take_along_axis(own, order, axis=1)
    repeated = np.zeros(options.shape, dtype=bool)
    by_node = np.argsort(options, axis=1, kind="stable")
    same = np.take_along_axis(options, by_node, axis=1)
    np.put_along_axis(repeated, by_node[:, 1:], same[:, 1:] == same[:, :-1], axis=1)
    own[repeated] = np.inf
    coordinates = points[np.maximum(options, 0)]
    kept = np.full((len(owners), degree), -1, dtype=np.int64)
    lines = np.arange(len(owners))
    for n in range(degree):
        at = own.argmin(axis=1)
        good = np.isfinite(own[lines, at])
        if not good.any():
            break
        kept[good, n] = options[lines, at][good]
        between = 2.0 - 2.0 * np.einsum("ocd,od->oc", coordinates, coordinates[lines, at])
        own[(alpha * between <= own) & good[:, None]] = np.inf
        own[lines, at] = np.inf
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Neighbours of every node (-1 for none), and the node where searches begin (nearest to the mean)."""
    count = len(points)
    graph = np.full((count, degree), -1, dtype=np.int64)
    entry = int((points @ points.mean(axis=0)).argmax())
    order = np.random.default_rng(count).permutation(count)
    order = np.concatenate([[entry], order[order != entry]])
    done = 1
    while done < count:
        new = order[done:min(count, done + min(done, ROUND))]
        found, _ = beam_search(points, graph, entry, points[new], beam)
        # The round's own nodes are options too, by plain comparison with each other.
        near = points[new] @ points[new].T
        np.fill_diagonal(near, -np.inf)
        fellows = new[np.argsort(-near, axis=1)[:, :8]]
        graph[new] = robust_prune(points, new, np.concatenate([found, fellows], axis=1), degree, alpha)
        sources, targets = np.repeat(new, degree), graph[new].ravel()
        there = targets >= 0
        _add_reverse(points, graph, sources[there], targets[there], degree, alpha)
        done += len(new)
    return graph, entry


def _add_reverse(points: np.ndarray, graph: np.ndarray, sources: np.ndarray, targets: np.ndarray, degree: int, alpha: float) -> None:
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    owners, first, counts = np.unique(targets, return_index=True, return_counts=True)
    # In passes of `degree` new edges a node, so a node that many point to needs no wide table.
    for low in range(0, int(counts.max(initial=0)), degree):
        some = counts > low
        rows, width = owners[some], np.minimum(counts[some] - low, degree)
        more = np.full((len(rows), degree), -1, dtype=np.int64)
        line = np.repeat(np.arange(len(rows)), width)
        column = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        more[line, column] = sources[np.repeat(first[some] + low, width) + column]
        for at in range(0, len(rows), ROUND):
            part = slice(at, at + ROUND)
            both = np.concatenate([graph[rows[part]], more[part]], axis=1)
            # The graph's own edges come first, so a node that has room keeps all of them.
            graph[rows[part]] = robust_prune(points, rows[part], both, degree, alpha)


def entries(graph: np.ndarray, entry: int) -> np.ndarray:
    """Nodes to begin searches from: `entry`, and one for each part of the graph that it and the ones before don't reach."""
    reached = np.zeros(len(graph), dtype=bool)
    begun, at = [entry], entry
    while True:
        reached[at] = True
        front = np.array([at])
        while len(front):
            ahead = np.unique(graph[front])
            front = ahead[(ahead >= 0) & ~reached[np.maximum(ahead, 0)]]
            reached[front] = True
        if reached.all():
            return np.array(begun)
        at = int(np.flatnonzero(~reached)[0])
        begun.append(at)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors divided by their greatest component, so that their squares neither vanish nor overflow."""
    return vectors / np.abs(vectors).max()


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors of one more component; their order by distance to a query is that by inner product."""
    vectors = _scaled(vectors)
    squares = np.einsum("nd,nd->n", vectors, vectors)
    vectors, squares = vectors / np.sqrt(squares.max()), squares / squares.max()
    return np.concatenate([vectors, np.sqrt(np.maximum(0.0, 1.0 - squares))[:, None]], axis=1).astype(np.float32)


def usable(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, vector as array<double>, length) of the rows that take part; the length's logarithm, in fact."""
    rows = table.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).first()
    return rows.filter(F.size("vector") == (size["size"] if size else 0)).select("vec_id", "vector", _log_length("vector").alias("length"))


def _log_length(vector: str) -> Column:
    def of(top: Column) -> Column:
        return F.log(top) + F.log(F.aggregate(vector, F.lit(0.0), lambda s, x: s + (x / top) * (x / top))) / 2

    return once(F.array_max(F.transform(vector, F.abs)), of)


def _bands(counts: dict[int, int], shard_nodes: int, few: int) -> list[tuple[int, int, int]]:
    """(band, first shard, number of shards) of every band: neighbours of `few` nodes together share one."""
    out, shard, held = [], -1, few + 1
    for band in sorted(counts):
        if held + counts[band] <= few:
            held += counts[band]
        else:
            shard += out[-1][2] if out else 1
            held = counts[band]
        out.append((band, shard, max(1, -(-counts[band] // shard_nodes))))
    return out


def build_index(
    table: DataFrame, k: int = NEAREST, id_column: str = "vec_id", vector: str = "embedding", shard_nodes: int = SHARD_NODES,
    degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, band: float = BAND,
) -> tuple[DataFrame, float]:
    """Stored index (shard, node, entry, ids, vector, edges) with one row per different vector, and the greatest length."""
    rows = usable(table, id_column, vector)
    # The smallest k + 1 ids of a vector: taken inside each map task first, so copies don't meet in one task.
    smallest = W.partitionBy("vector").orderBy("vec_id")
    ranked = rows.distinct().withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1)
    nodes = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("length").alias("length"))
    nodes = materialize(nodes, "ann-nodes")
    longest = nodes.agg(F.max("length")).first()[0]
    schema = "shard int, node int, entry boolean, ids array<bigint>, vector array<double>, edges array<int>"
    if longest is None:
        return nodes.sparkSession.createDataFrame([], schema), 1.0
    # At most some thousand bands, as doubles end somewhere: their counts are on the driver.
    banded = nodes.withColumn("band", F.floor((F.lit(longest) - F.col("length")) / math.log(band)).cast("int"))
    counts = {r["band"]: r["count"] for r in banded.groupBy("band").count().collect()}
    dealt = _bands(counts, shard_nodes, SEARCH_BEAM // 2)
    listed = nodes.sparkSession.createDataFrame(dealt, "band int, first int, parts int")

    def grown(frame: pd.DataFrame) -> pd.DataFrame:
        # By the smallest id, so that a task that is run again builds the same graph.
        frame = frame.iloc[np.argsort([ids[0] for ids in frame["ids"]], kind="stable")].reset_index(drop=True)
        points = _lifted(np.stack(frame["vector"].to_numpy()))
        graph, middle = build_graph(points, degree, beam, alpha)
        begun = np.isin(np.arange(len(frame)), entries(graph, middle))
        return frame.assign(node=np.arange(len(frame)), entry=begun, edges=[g[g >= 0].tolist() for g in graph])[
            ["shard", "node", "entry", "ids", "vector", "edges"]
        ]

    shard = (F.col("first") + F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("parts"))).cast("int")
    placed = banded.join(F.broadcast(listed), "band").select(shard.alias("shard"), "ids", "vector")
    return materialize(placed.groupBy("shard").applyInPandas(grown, schema), "ann-index"), math.exp(min(longest, 709.0))


class _Shard:
    """One shard's graph inside a task, and its answers."""

    def __init__(self, rows: list[tuple], degree: int):
        self.ids = [r[1] for r in rows]
        self.vectors = np.array([r[2] for r in rows])
        self.points = _lifted(self.vectors)
        self.graph = np.full((len(rows), degree), -1, dtype=np.int64)
        for n, r in enumerate(rows):
            self.graph[n, :len(r[3])] = r[3]
        self.begin = np.flatnonzero([r[0] for r in rows])

    def answers(self, asked: list[int], own: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        turned = own / np.abs(own).max(axis=1)[:, None]
        turned /= np.sqrt(np.einsum("nd,nd->n", turned, turned))[:, None]
        targets = np.concatenate([turned, np.zeros((len(own), 1))], axis=1).astype(np.float32)
        found, _ = beam_search(self.points, self.graph, self.begin, targets, beam)
        for query, nodes, target in zip(asked, found, own):
            nodes = nodes[nodes >= 0]
            listed = [(i, s) for n, s in zip(nodes, map(_exact_sum, self.vectors[nodes] * target)) for i in self.ids[n] if i != query]
            listed.sort(key=lambda x: (-x[1], x[0]))
            yield from ((query, i, s) for i, s in listed[:k])


def _exact_sum(products: np.ndarray) -> float:
    try:
        return math.fsum(products)
    except (OverflowError, ValueError):  # past the doubles, or both infinities
        total = float(products.sum())
        return -math.inf if math.isnan(total) else total


def search(
    index: DataFrame, longest: float, queries: DataFrame, k: int = NEAREST, beam: int = SEARCH_BEAM,
    degree: int = DEGREE, block_rows: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for `queries` (vec_id, vector): the k nearest found but the query itself."""
    spark = index.sparkSession
    shards = [r["shard"] for r in index.select("shard").distinct().collect()]  # numbers only, one per bounded shard
    if not shards:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = queries.select("vec_id", "vector").distinct().select(
        F.explode(F.array(*[F.lit(s) for s in shards])).alias("shard"), F.lit(1).alias("kind"), F.lit(0).alias("node"),
        F.lit(False).alias("entry"), F.array("vec_id").alias("ids"), "vector", F.array().cast("array<int>").alias("edges"),
    )
    held = index.select("shard", F.lit(0).alias("kind"), "node", "entry", "ids", "vector", "edges")
    # A shard's nodes come first, its queries behind them: the task holds one shard and one block of queries.
    lined = held.unionByName(asked).repartition(len(shards), "shard").sortWithinPartitions("shard", "kind", "node")

    def answered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, nodes, shard, waiting = None, [], None, []

        def reply() -> pa.RecordBatch:
            out = list(shard.answers([q for q, _ in waiting], np.array([v for _, v in waiting]), k, beam))
            waiting.clear()
            columns = list(zip(*out)) if out else [[], [], []]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "vec_id", "score"])

        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if row[0] != number:
                    if waiting:
                        yield reply()
                    number, nodes, shard = row[0], [], None
                if row[1] == 0:
                    nodes.append(row[3:])
                    continue
                if shard is None:
                    shard, nodes = _Shard(nodes, degree), []
                waiting.append((row[4][0], row[5]))
                if len(waiting) == block_rows:
                    yield reply()
        if waiting:
            yield reply()

    answers = lined.mapInArrow(answered, "query_id bigint, vec_id bigint, score double")
    # An id may stand for several vectors, and may ask with several.
    scored = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(table: pd.DataFrame, queries: Iterator[int], k: int = NEAREST) -> dict[int, list[int]]:
    """Brute force over a small table (vec_id, embedding), to measure recall."""
    vectors = np.stack(table["embedding"].to_numpy()).astype(float)
    ids = table["vec_id"].to_numpy()
    out = {}
    for q in queries:
        scores = vectors @ vectors[np.flatnonzero(ids == q)[0]]
        order = np.lexsort((ids, -scores))
        out[q] = [int(ids[i]) for i in order if ids[i] != q][:k]
    return out
