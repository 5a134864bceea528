"""Approximate nearest neighbours by cosine over robust-pruned directed graphs, one for each shard.

Vectors that are equal are one node, which keeps the few smallest ids of its copies: more can't be among the nearest.
Nodes are dealt to shards of bounded size by hash.  In every shard, greedy beam searches from the node nearest the
centre propose neighbours of each vector; pruning goes from the nearest on and drops a candidate that is much nearer to
an edge already kept (relaxed by `slack`), which keeps edges in all directions; edges are added both ways.  Queries, in
blocks, run a beam search in every shard, and the shards' best are ranked by the exact cosine in double precision.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, take no part, as query or
candidate; vectors of different lengths are never compared; ties go to the smaller id; a row without an id takes no
part; rows that repeat an id and its vector are one; with fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.shared import stored


@dataclass(frozen=True)
class Graph:
    """Edges of a node, beam widths, pruning slack; nodes of a shard and queries of a block."""

    edges: int = 24
    build_beam: int = 48
    search_beam: int = 128
    slack: float = 1.2
    shard: int = 4096
    block: int = 4096
    together: int = 128
    seed: int = 5


def usable(vector: np.ndarray | list | None) -> np.ndarray | None:
    """The vector in double precision, if it can take part."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    own = np.asarray(vector, float)
    return own if np.isfinite(own).all() and own.any() else None


def nodes(vectors: DataFrame, k: int) -> DataFrame:
    """(vector, ids, copies): distinct usable vectors as bytes with their k + 1 smallest ids; stored."""

    def gather(held: dict[bytes, set[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array([sorted(x)[: k + 1] for x in held.values()], pa.list_(pa.int64()))],
            ["vector", "ids"])

    def run(batches):
        held: dict[bytes, set[int]] = {}
        for batch in batches:
            for name, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                own = usable(vector)
                if own is not None and name is not None:
                    ids = held.setdefault((own + 0.0).tobytes(), set())  # no negative zeros
                    ids.add(name)
                    if len(ids) > 64:
                        ids.intersection_update(sorted(ids)[: k + 1])
            if len(held) > 20_000:
                yield gather(held)
                held = {}
        yield gather(held)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    parts = rows.mapInArrow(run, "vector binary, ids array<long>")
    # each task has sent k + 1 ids of a vector at most
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return stored(parts.groupBy("vector").agg(merged.alias("ids")), "nodes")


class Index:
    """A directed graph over the unit vectors of one shard."""

    def __init__(self, unit: np.ndarray, options: Graph, edges: np.ndarray | None = None, entry: int | None = None):
        self.unit, self.options = unit.astype(np.float32), options
        self.entry = int((self.unit @ self.unit.mean(0)).argmax()) if entry is None else entry
        self.edges = edges if edges is not None else self.build()

    def beam(self, queries: np.ndarray, width: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Beam searches in step: ids and closeness of the beams (best first, -1: none), and the nodes expanded."""
        n = len(queries)
        ids = np.full((n, width), -1)
        near = np.full((n, width), -np.inf, np.float32)
        done = np.ones((n, width), bool)
        ids[:, 0], near[:, 0], done[:, 0] = self.entry, queries @ self.unit[self.entry], False
        seen = np.zeros((n, len(self.unit)), bool)
        seen[:, self.entry] = True
        path: list[list[np.ndarray]] = []
        live = np.arange(n)
        while len(live):
            todo = np.where(done[live], -np.inf, near[live])
            best = todo.argmax(1)
            go = np.isfinite(todo[np.arange(len(live)), best])
            live, best = live[go], best[go]
            if not len(live):
                break
            done[live, best] = True
            here = ids[live, best]
            path.append([live, here])
            there = edges[here]
            fresh = there >= 0
            fresh &= ~seen[live[:, None], np.maximum(there, 0)]
            rows, columns = np.nonzero(fresh)
            seen[live[rows], there[rows, columns]] = True
            close = np.full(there.shape, -np.inf, np.float32)
            close[rows, columns] = (queries[live[rows]] * self.unit[there[rows, columns]]).sum(1)
            all_near = np.concatenate((near[live], close), 1)
            keep = np.argsort(-all_near, 1, kind="stable")[:, :width]
            near[live] = np.take_along_axis(all_near, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate((ids[live], there), 1), keep, 1)
            done[live] = np.take_along_axis(np.concatenate((done[live], ~fresh), 1), keep, 1)
        ids[~np.isfinite(near)] = -1
        who = np.concatenate([p[0] for p in path])
        what = np.concatenate([p[1] for p in path])
        order = np.argsort(who, kind="stable")
        expanded = np.split(what[order], np.searchsorted(who[order], np.arange(1, n)))
        return ids, near, expanded

    def prune(self, node: int, candidates: np.ndarray) -> np.ndarray:
        """Kept edges of a node: from the nearest on, without those that a kept one is nearer to by the slack."""
        candidates = np.unique(candidates[(candidates >= 0) & (candidates != node)])
        if not len(candidates):
            return candidates
        vectors = self.unit[candidates]
        away = np.maximum(0, 2 - 2 * vectors @ self.unit[node])
        order = np.argsort(away, kind="stable")
        candidates, vectors, away = candidates[order], vectors[order], away[order]
        between = self.options.slack**2 * np.maximum(0, 2 - 2 * vectors @ vectors.T)
        alive = np.ones(len(candidates), bool)
        kept = []
        at = 0
        while len(kept) < self.options.edges:
            kept.append(at)
            alive &= between[at] > away
            alive[: at + 1] = False
            if not alive.any():
                break
            at = int(alive.argmax())
        return candidates[kept]

    def build(self) -> np.ndarray:
        o = self.options
        n = len(self.unit)
        rng = np.random.default_rng(o.seed)
        if n <= o.edges + 1:  # few: each points at all others
            edges = np.full((n, o.edges), -1)
            for i in range(n):
                others = np.delete(np.arange(n), i)
                edges[i, : len(others)] = others
            return edges
        edges = np.full((n, o.edges), -1)
        edges[:, : o.edges // 2] = rng.integers(0, n, (n, o.edges // 2))  # replaced as nodes get their own
        order = rng.permutation(n)
        for at in range(0, n, o.together):
            part = order[at : at + o.together]
            ids, _, expanded = self.beam(self.unit[part], o.build_beam, edges)
            back: dict[int, list[int]] = {}
            for row, node in enumerate(part.tolist()):
                own = self.prune(node, np.concatenate((expanded[row], ids[row], edges[node])))
                edges[node] = -1
                edges[node, : len(own)] = own
                for other in own.tolist():
                    back.setdefault(other, []).append(node)
            for other, new in back.items():
                now = edges[other][edges[other] >= 0]
                joint = np.union1d(now, new)
                if len(joint) > o.edges:
                    joint = self.prune(other, joint)
                edges[other] = -1
                edges[other, : len(joint)] = joint
        return edges


def built(points: DataFrame, options: Graph) -> DataFrame:
    """(shard, node, vector, ids, edges, entry) for every node, each shard a graph; stored."""
    count = points.count()
    size = F.octet_length("vector")
    shards = max(1, -(-count // options.shard))
    dealt = points.select(
        "vector", "ids", F.concat_ws(":", size.cast("string"), F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("string")).alias("shard"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vector", ignore_index=True)
        whole = np.array([np.frombuffer(v) for v in frame["vector"]])
        index = Index(whole / np.sqrt((whole**2).sum(1, keepdims=True)), options)
        frame["node"] = np.arange(len(frame))
        frame["edges"] = list(index.edges)
        frame["entry"] = index.entry
        return frame[["shard", "node", "vector", "ids", "edges", "entry"]]

    schema = "shard string, node int, vector binary, ids array<long>, edges array<int>, entry int"
    return stored(dealt.groupBy("shard").applyInPandas(run, schema), "graphs")


def search(graphs: DataFrame, queries: DataFrame, k: int, options: Graph) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query (columns query_id, vector)."""
    blocks = max(1, -(-queries.count() // options.block))
    shards = stored(graphs.select("shard", F.octet_length("vector").alias("size")).distinct(), "shards")
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).join(
        shards, F.octet_length(F.col("vector")) == F.col("size")).select("shard", "block", "query_id", "vector")
    there = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(key: tuple, asked: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(graph) and len(asked):
            graph = graph.sort_values("node", ignore_index=True)
            whole = np.array([np.frombuffer(v) for v in graph["vector"]])
            size = np.sqrt((whole**2).sum(1))
            unit = whole / size[:, None]
            index = Index(unit, options, np.array(graph["edges"].tolist()), int(graph["entry"].iloc[0]))
            ids = graph["ids"].tolist()
            vectors = np.array([np.frombuffer(v) for v in asked["vector"]])
            own = np.sqrt((vectors**2).sum(1))
            names = asked["query_id"].tolist()
            for at in range(0, len(names), options.together):
                part = vectors[at : at + options.together]
                found, _, _ = index.beam(
                    (part / own[at : at + options.together, None]).astype(np.float32), max(options.search_beam, 2 * k), index.edges)
                for row in range(len(part)):
                    near = found[row][found[row] >= 0]
                    score = (whole[near] @ part[row]) / (size[near] * own[at + row])
                    name = names[at + row]
                    # one of the nodes may be the query's own: all that reach the score of the one after the k-th, ties too
                    least = -np.partition(-score, min(k, len(score) - 1))[min(k, len(score) - 1)] if len(score) else 0.0
                    best = np.flatnonzero(score >= least)
                    rows = sorted((-score[b], v) for b in best.tolist() for v in ids[near[b]] if v != name)[:k]
                    out["query_id"] += [name] * len(rows)
                    out["score"] += [-s for s, _ in rows]
                    out["vec_id"] += [v for _, v in rows]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    hits = asked.groupBy("shard", "block").cogroup(there.groupBy("shard", "block")).applyInPandas(
        run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, wanted: Column, k: int = 5, options: Graph = Graph()) -> DataFrame:
    """The k nearest other rows of each wanted row of vectors (columns vec_id, embedding)."""
    points = nodes(vectors, k)
    graphs = built(points, options)

    def own(batches):
        for batch in batches:
            rows = [
                (name, (v + 0.0).tobytes()) for name, x in zip(batch.column("query_id").to_pylist(), batch.column("embedding").to_pylist())
                if (v := usable(x)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["query_id", "vector"])

    queries = stored(
        vectors.where(wanted & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("query_id"), "embedding")
        .mapInArrow(own, "query_id long, vector binary").distinct(), "queries")
    return search(graphs, queries, k, options)
