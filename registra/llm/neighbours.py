"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample, down to leaves of a few sample vectors; every vector is then put into its leaf. A query
walks the tree with a priority queue of branches by the distance to their centres and visits leaves in that order. How many leaves
a search visits is widened until the wished recall, measured against brute force over all rows for a sample of queries, is reached;
a query whose leaves hold fewer than k other rows then goes on until they do.

Leaves that lie side by side in the tree are packed into bins of a bounded number of rows, and a leaf with more rows is dealt over
several bins. A query goes once to each bin that has leaves it visits, and a bin meets its queries in parts of bounded size, so a bin's rows
are copied only when very many queries ask for them.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import splits
from .common import settle, ship, table

FIT = 20_000  #: vectors that the tree is fitted on at most
BRANCH, LEAF, DEPTH = 8, 24, 16  #: children of a node, sample vectors from which a node is split, levels (against many equal vectors)
BIN = 5_000  #: vectors that are compared in one task
QUERIES = 20_000  #: queries that meet one bin in one task
ASK = 200  #: queries that recall is measured with
RECALL = 0.96  #: wished recall at k on those queries
TOP = 5


def unit_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors as doubles, without nulls, zero vectors and those with a null or non-finite component."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).dropna().filter(fine)


def _unit(m: np.ndarray) -> np.ndarray:
    scale = np.abs(m).max(axis=1, keepdims=True)
    m = m / scale
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosine(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``q`` (or one vector) with the rows of ``m``, in double precision and the same for equal pairs wherever they stand."""
    q = np.broadcast_to(q, m.shape)
    q, m = q / np.abs(q).max(axis=1, keepdims=True), m / np.abs(m).max(axis=1, keepdims=True)
    return (m * q).sum(axis=1) / (np.sqrt((m * m).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))


class Tree:
    """Centres by node; children by node (none: a leaf)."""

    def __init__(self, sample: np.ndarray, seed: int = 11) -> None:
        self.centre, self.children, self.leaf = [], [], []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self._grow(_unit(sample) if len(sample) else sample, rng, 0)
        self.centres = np.array(self.centre, float).reshape(len(self.centre), -1) if len(sample) else np.zeros((1, 1))
        self.squares = (self.centres * self.centres).sum(axis=1)

    def _grow(self, m: np.ndarray, rng: np.random.Generator, depth: int) -> int:
        node = len(self.centre)
        self.centre.append(m.mean(axis=0) if len(m) else None)
        self.children.append([])
        self.leaf.append(-1)
        groups = self._means(m, rng) if len(m) > LEAF and depth < DEPTH else None
        if groups is None:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
        else:
            self.children[node] = [self._grow(m[groups == g], rng, depth + 1) for g in np.unique(groups)]
        return node

    @staticmethod
    def _means(m: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
        centres = m[rng.choice(len(m), BRANCH, replace=False)]
        for _ in range(10):
            own = (m @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
            centres = np.stack([m[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(BRANCH)])
        return own if len(np.unique(own)) > 1 else None

    def assign(self, m: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest child at each node."""
        m, out = _unit(m), np.zeros(len(m), np.int64)
        todo = [(0, np.arange(len(m)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                c = self.children[node]
                best = (m[rows] @ self.centres[c].T - self.squares[c] / 2).argmax(axis=1)
                todo += [(child, rows[best == g]) for g, child in enumerate(c)]
        return out

    def visits(self, queries: np.ndarray) -> Iterator[Iterator[int]]:
        """For each query its leaves, best bin first."""
        for at in range(0, len(queries), 256):
            far = self.squares - 2 * (_unit(queries[at : at + 256]) @ self.centres.T)
            for row in far:
                yield self._walk(row.tolist())

    def _walk(self, far: list[float]) -> Iterator[int]:
        queue = [(0.0, 0)]
        while queue:
            node = heapq.heappop(queue)[1]
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            for child in self.children[node]:
                heapq.heappush(queue, (far[child], child))


class Best:
    """The k largest cosines of each query among the rows it has met, ties to smaller ids; rows with the query's id are left out."""

    def __init__(self, query_id: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> None:
        self.query_id, self.q, self.ids, self.m, self.k = query_id, q, ids, m, k
        self.qu, self.mu = _unit(q), _unit(m)
        self.floor = np.full(len(q), -np.inf)  # nothing below can be among the best
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def meet(self, queries: np.ndarray, rows: np.ndarray) -> None:
        """Compares queries with rows (both by number)."""
        for part in np.array_split(queries, max(1, len(queries) * len(rows) // 2_000_000)):
            rough = self.qu[part] @ self.mu[rows].T
            rough[self.query_id[part][:, None] == self.ids[rows][None]] = -np.inf
            if len(rows) >= self.k:
                least = np.partition(rough, len(rows) - self.k, axis=1)[:, len(rows) - self.k] - 1e-9
                self.floor[part] = np.maximum(self.floor[part], least)
            i, j = np.nonzero((rough >= self.floor[part][:, None]) & np.isfinite(rough))
            self.found.append((part[i], rows[j]))
            self.held += len(i)
        if self.held > 500_000:
            self._tidy()

    def _tidy(self) -> np.ndarray:
        i, j = (np.concatenate([x[n] for x in self.found] or [np.zeros(0, np.int64)]) for n in (0, 1))
        score = np.concatenate([cosine(self.q[i[at : at + 100_000]], self.m[j[at : at + 100_000]]) for at in range(0, len(i), 100_000)] or [np.zeros(0)])
        order = np.lexsort((self.ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, score = (x[rank < self.k] for x in (i, j, score))
        self.found, self.held = [(i, j)], len(i)
        last = np.flatnonzero(np.concatenate([i[1:] != i[:-1], [True]])) if len(i) else np.zeros(0, np.int64)
        full = last[np.bincount(i, minlength=len(self.q))[i[last]] == self.k]
        self.floor[i[full]] = np.maximum(self.floor[i[full]], score[full] - 1e-9)
        return score

    def rows(self) -> pd.DataFrame:
        score = self._tidy()
        i, j = self.found[0]
        return pd.DataFrame({"query_id": self.query_id[i], "vec_id": self.ids[j], "score": score})


FOUND = "query_id long, vec_id long, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def brute_force(vectors: DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Exact neighbours of a bounded set of queries: each task sends its own k best."""
    shared = ship(vectors.sparkSession, queries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = pickle.loads(shared.value)
        for rows in batches:
            if len(rows) and len(asked):
                best = Best(asked.query_id.to_numpy(), np.stack(asked.q.to_numpy()), rows.id.to_numpy(), np.stack(rows.v.to_numpy()), k)
                best.meet(np.arange(len(asked)), np.arange(len(rows)))
                yield best.rows()

    return _top(vectors.mapInPandas(run, FOUND), k).toPandas()


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = TOP, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (a condition on ``id``) its k nearest other rows.

    Vectors that are null, zero or hold null or non-finite components take no part. Vectors of different lengths have no cosine: each
    length is searched by itself, with a tree of its own. Rows that share an id are one another's self. Fewer than k
    candidates are all returned; no vectors give no rows. Other columns play no part.
    """
    rows = settle(unit_vectors(vectors, key, vector).withColumn("length", F.size("v")))
    lengths = [r.length for r in rows.select("length").distinct().orderBy("length").collect()]
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n in lengths:
        out = out.union(_search(rows.filter(F.col("length") == n).select("id", "v"), is_query, n, k, recall))
    return out


def _search(rows: DataFrame, is_query: Column, length: int, k: int, recall: float) -> DataFrame:
    """``nearest`` for the rows (id, v) of a written table, all of one length."""
    spark = rows.sparkSession
    total = rows.count()
    drawn = rows.withColumn("h", F.pmod(F.xxhash64("id", F.lit("tree")), F.lit(1 << 40)))
    sample = [r.v for r in drawn.filter(F.col("h") < int(min(1.0, 0.9 * FIT / max(total, 1)) * (1 << 40))).orderBy("h", "id").limit(FIT).select("v").toLocalIterator()]
    tree = Tree(np.array(sample, float).reshape(len(sample), length if sample else 1))
    queries = rows.filter(is_query)
    asked = queries.withColumn("h", F.xxhash64("id", F.lit("ask"))).orderBy("h").limit(ASK).select(F.col("id").alias("query_id"), F.col("v").alias("q")).toPandas()
    shared = ship(spark, tree)

    def leaf_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pickle.loads(shared.value)
        for part in batches:
            if len(part):
                yield part.assign(leaf=t.assign(np.stack(part.v.to_numpy())))

    placed = settle(rows.mapInPandas(leaf_of, "id long, v array<double>, leaf long"))
    sizes = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf of the tree
    visits = _calibrated(tree, asked, placed, k, recall)
    # leaves in the order of the tree, one after the other: the first bin of each and how many bins it reaches into
    laid, at = {}, 0
    for leaf in sorted(sizes):
        laid[leaf] = (at // BIN, (at + sizes[leaf] - 1) // BIN - at // BIN + 1)
        at += sizes[leaf]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pickle.loads(shared.value)
        for part in batches:
            out = []
            for qid, q, own, walk in zip(part.id, part.v, part.own, t.visits(np.stack(part.v.to_numpy())) if len(part) else ()):
                bins: dict[int, list[int]] = {}
                met = held = 0
                for leaf in walk:
                    if met >= visits and held >= k + own:
                        break
                    met += 1
                    if leaf in laid:
                        held += sizes[leaf]
                        first, n = laid[leaf]
                        for b in range(first, first + n):
                            bins.setdefault(b, []).append(leaf)
                out += [(qid, q, b, leaves) for b, leaves in bins.items()]
            yield pd.DataFrame(out, columns=["query_id", "q", "bin", "leaves"])

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["query_id", "vec_id", "score"])
        best = Best(left.query_id.to_numpy(), np.stack(left.q.to_numpy()), right.id.to_numpy(), np.stack(right.v.to_numpy()), k)
        leaf = right.leaf.to_numpy()
        by_leaf = dict(zip(np.unique(leaf).tolist(), splits(leaf)))
        asks = np.concatenate(left.leaves.to_list())
        who = np.repeat(np.arange(len(left)), left.leaves.map(len))
        for number, at in zip(np.unique(asks).tolist(), splits(asks)):
            if number in by_leaf:
                best.meet(who[at], by_leaf[number])
        return best.rows()

    # rows that share the query's id are none of its neighbours
    own = queries.groupBy("id").agg(F.count("*").alias("own"))
    sent = settle(queries.join(own, "id").mapInPandas(ask, "query_id long, q array<double>, bin long, leaves array<long>"))
    parts = sent.groupBy("bin").agg(F.ceil(F.count("*") / F.lit(QUERIES)).alias("parts"))
    first = spark.createDataFrame([(int(x), *laid[x]) for x in laid], "leaf long, first long, n long")
    dealt = placed.join(F.broadcast(first), "leaf")  # a row for each leaf of the tree
    dealt = dealt.withColumn("bin", F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("n"))).join(parts, "bin")
    dealt = dealt.select("id", "v", "leaf", "bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    sent = sent.join(parts, "bin").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")))
    found = sent.groupBy("bin", "part").cogroup(dealt.groupBy("bin", "part")).applyInPandas(meet, FOUND)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _calibrated(tree: Tree, asked: pd.DataFrame, placed: DataFrame, k: int, recall: float) -> int:
    """The least number of leaves with the wished recall on the asked queries, by the leaf that each true neighbour is in."""
    if not len(asked):
        return 1
    truth = brute_force(placed.select("id", "v"), asked, k)
    if not len(truth):
        return tree.leaves
    where = placed.filter(F.col("id").isin([int(x) for x in truth.vec_id.unique()])).select("id", "leaf").toPandas()
    leaf = dict(zip(where.id, where.leaf))
    order = {qid: {x: i + 1 for i, x in enumerate(walk)} for qid, walk in zip(asked.query_id, tree.visits(np.stack(asked.q.to_numpy())))}
    needed = np.sort([order[q][leaf[v]] for q, v in zip(truth.query_id, truth.vec_id)])
    return int(needed[min(len(needed), int(np.ceil(recall * len(needed)))) - 1])


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of each row of ``embeddings`` whose vec_id is divisible by 50, by cosine over all other rows; see ``nearest`` for odd rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
