"""Nearest neighbours by inner product with one vantage-point tree per shard.

The largest inner product is turned into the least distance by one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm (0 for a query). A shard's vectors form a
vantage-point tree with leaves of a few dozen vectors. A leaf is left out for a query when
its triangle-inequality bound times ``factor`` exceeds the distance of the query's current
k-th neighbour: factor 1 is exact, larger factors visit fewer leaves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class VantageTree:
    """Tree over the rows of ``x`` (n x d) with lift coordinates ``lift``."""

    def __init__(self, x: np.ndarray, lift: np.ndarray, leaf: int, seed: int = 7):
        self.x, self.lift = x, lift
        self.norms = (x * x).sum(axis=1)
        self.vantage: list[int] = []
        #: per leaf: rows, and (vantage number, least distance, largest distance) of all nodes above
        self.leaves: list[tuple[np.ndarray, list[tuple[int, float, float]]]] = []
        rng = np.random.default_rng(seed)
        stack: list[tuple[np.ndarray, list]] = [(np.arange(len(x)), [])]
        while stack:
            rows, path = stack.pop()
            if len(rows) <= leaf:
                if len(rows):
                    self.leaves.append((rows, path))
                continue
            point = int(rows[rng.integers(len(rows))])
            d = self._between(point, rows)
            order = np.argsort(d, kind="stable")
            half = len(rows) // 2
            number = len(self.vantage)
            self.vantage.append(point)
            for part in (order[:half], order[half:]):
                stack.append((rows[part], [*path, (number, float(d[part].min()), float(d[part].max()))]))

    def _between(self, point: int, rows: np.ndarray) -> np.ndarray:
        squared = self.norms[rows] + self.norms[point] - 2 * (self.x[rows] @ self.x[point]) + (self.lift[rows] - self.lift[point]) ** 2
        return np.sqrt(np.maximum(squared, 0))

    def search(self, q: np.ndarray, top_norm: float, k: int, factor: float):
        """Yield (queries, rows): pairs of which no one scores clearly below the query's k-th best.

        All rows that tie with the k-th are there, in chunks of queries that bound the pairs at once.
        """
        n = len(q)
        base = (q * q).sum(axis=1) + top_norm**2
        best = np.full((n, k), -np.inf)
        bound = np.zeros((n, len(self.leaves)))
        if self.vantage:
            d = np.sqrt(np.maximum(base[:, None] - 2 * (q @ self.x[self.vantage].T), 0))
            for at, (_, path) in enumerate(self.leaves):
                for v, low, high in path:
                    np.maximum(bound[:, at], np.maximum(low - d[:, v], d[:, v] - high), out=bound[:, at])

        def visit(at: int, who: np.ndarray) -> None:
            members = self.leaves[at][0]
            score = np.concatenate((best[who], q[who] @ self.x[members].T), axis=1)
            best[who] = np.partition(score, score.shape[1] - k, axis=1)[:, -k:]

        done = np.zeros(bound.shape, np.bool_)
        first = np.argsort(bound, axis=1, kind="stable")[:, :2]
        for wave in range(first.shape[1]):
            for at in np.unique(first[:, wave]):
                who = np.flatnonzero(first[:, wave] == at)
                visit(int(at), who)
                done[who, at] = True
        for at in np.argsort(bound.mean(axis=0), kind="stable"):
            kth = best.min(axis=1)
            reach = np.sqrt(np.maximum(base - 2 * kth, 0)) + 1e-7 * np.sqrt(base)  # more than roots of rounded squares are off
            who = np.flatnonzero(~done[:, at] & (bound[:, at] * factor <= reach))
            if len(who):
                visit(int(at), who)
                done[who, at] = True
        floor = best.min(axis=1) - 1e-12 * base  # sums in another order may be this far apart
        for lo in range(0, n, 256):
            pairs = []
            for at, (members, _) in enumerate(self.leaves):
                who = lo + np.flatnonzero(done[lo : lo + 256, at])
                i, j = np.nonzero(q[who] @ self.x[members].T >= floor[who, None])
                pairs.append((who[i], members[j]))
            if pairs:
                yield tuple(np.concatenate(side) for side in zip(*pairs, strict=True))


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values]) if len(values) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components, not all of them zero."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), v.alias("embedding")).filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    )


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.15, leaf: int = 64, shard_rows: int = 16_384, block_rows: int = 4_096
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest, all candidates if fewer.

    Both frames have vec_id and embedding. Null, zero and non-finite vectors take no part;
    a query's candidates are the vectors of its own width. A query's own vec_id is no candidate. Equal vectors of a shard are one tree
    entry that lists its k + 1 smallest ids, so a large group of copies costs one comparison.
    Ties go to the smallest ids, of copies and of different vectors with one inner product. Rows that repeat a vec_id count once each.
    Queries meet shards in blocks; a task holds one shard and one block.
    """
    vectors, queries = usable(vectors), usable(queries)
    stats = vectors.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()
    n_queries = queries.count()
    shards, blocks = max(1, -(-stats[0] // shard_rows)), max(1, -(-n_queries // block_rows))
    top_norm = float(np.sqrt(stats[1] or 0.0)) * (1 + 1e-12)

    def run(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(shard) or not len(block):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in zip(names, ("int64", "int64", "float64"), strict=True)})
        shard, block = shard.sort_values("vec_id", kind="stable"), block.sort_values("vec_id", kind="stable")
        x, at = np.unique(_matrix(shard["embedding"]), axis=0, return_inverse=True)
        at = at.ravel()
        ids: list[list[int]] = [[] for _ in range(len(x))]
        for i, v in zip(at.tolist(), shard["vec_id"].tolist(), strict=True):
            if len(ids[i]) <= k:
                ids[i].append(v)
        q = _matrix(block["embedding"])
        lift = np.sqrt(np.maximum(top_norm**2 - (x * x).sum(axis=1), 0))
        smallest = np.array([i[0] for i in ids])
        asked = block["vec_id"].to_numpy()
        out_q, out_v, out_s = [], [], []
        # the query itself may take a place: search one more
        for who, rows in VantageTree(x, lift, leaf).search(q, top_norm, k + 1, factor):
            score = np.empty(len(who))
            for lo in range(0, len(who), 65_536):
                part = slice(lo, lo + 65_536)
                score[part] = np.einsum("ij,ij->i", x[rows[part]], q[who[part]])  # the same order of additions in every row
            order = np.lexsort((smallest[rows], -score, who))
            who, rows, score = who[order], rows[order], score[order]
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
            for lo, hi in zip(starts.tolist(), np.r_[starts[1:], len(who)].tolist(), strict=True):
                query_id = int(asked[who[lo]])
                # an entry outside the first k + 1 is behind k + 1 ids: its own cannot be among the first k
                first = zip(score[lo : min(hi, lo + k + 1)].tolist(), rows[lo : min(hi, lo + k + 1)].tolist(), strict=True)
                mine = sorted((-s, v) for s, r in first for v in ids[r] if v != query_id)[:k]
                out_q += [query_id] * len(mine)
                out_v += [v for _, v in mine]
                out_s += [-s for s, _ in mine]
        return pd.DataFrame({"query_id": out_q, "vec_id": out_v, "score": out_s}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    sharded = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    keys = (F.size("embedding").alias("width"), "shard", "block")
    found = sharded.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
