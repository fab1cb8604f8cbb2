"""Nearest neighbours by collision counting over query-centred windows.

Unit vectors are projected on PROJECTIONS random directions, and each projection is kept as one sorted
array. A query puts a window around its own projection in every array; a vector that lies in at least
THRESHOLD of the windows is verified by its cosine. Windows start narrow and are widened together
(virtual rehashing: no array is ever rebuilt, and only what a wider window adds is counted): half their width is WIDTH times a radius, and a
vector within the radius falls into each window with the chance of a normal variable below WIDTH. The search
ends when the k-th best verified distance is within the radius, so that each true neighbour had that
chance; until then the radius grows by GROWTH, or to the k-th best distance if that is less.

Vectors are sharded by hash; each shard's arrays are built once and stored. Queries are cut into blocks; a task holds one shard and one
block. How many vectors are verified depends on how much nearer the k-th neighbour is than others, and is told with each result. Measured on 2,000 and
10,256 vectors of 64 dimensions, whose fifth neighbours lie at a distance of 1.14 and 1.06 on average and most others at 1.41: 49 % and
44 % of a shard's vectors on average, with a recall of 0.985 and 0.994. Projections of so near distances hardly differ, so fewer would cost recall.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .vectors import cosines, matrix, norms, safe, usable, with_rows

PROJECTIONS, WIDTH, GROWTH, RADIUS = 64, 2.0, 1.3, 0.4
#: Share of true neighbours within the radius that reach the threshold in normal approximation: 1.65 deviations below the mean.
_P = math.erf(WIDTH / math.sqrt(2))
THRESHOLD = math.floor(PROJECTIONS * _P - 1.65 * math.sqrt(PROJECTIONS * _P * (1 - _P)))
SHARD, BLOCK = 8192, 8192


class Index:
    """Sorted projections of a shard's vectors."""

    def __init__(self, x: np.ndarray, seed: int = 1) -> None:
        self.x, self.norm = x, norms(x)
        self.axes = self.directions(x.shape[1], seed)
        p = (x / self.norm[:, None]) @ self.axes
        self.order = np.argsort(p, axis=0).T.astype(np.int32).copy()
        self.values = np.take_along_axis(p, self.order.T, axis=0).T.copy()
        self.line_up()

    def line_up(self) -> None:
        """All arrays one behind the other, so that one search finds a place in each."""
        self.apart = np.arange(PROJECTIONS) * 1e4
        self.line = (np.clip(self.values, -4e3, 4e3) + self.apart[:, None]).ravel()
        self.begin = np.arange(PROJECTIONS) * len(self.x)

    def places(self, at: np.ndarray, side: str) -> list[int]:
        """Where values, one for each array, belong in them."""
        return (np.searchsorted(self.line, np.clip(at, -4.5e3, 4.5e3) + self.apart, side) - self.begin).tolist()

    @staticmethod
    def directions(dim: int, seed: int = 1) -> np.ndarray:
        return np.random.default_rng(seed).standard_normal((dim, PROJECTIONS))

    @classmethod
    def load(cls, x: np.ndarray, order: bytes, values: bytes) -> "Index":
        """An index from its stored arrays."""
        self = cls.__new__(cls)
        self.x, self.norm, self.axes = x, norms(x), cls.directions(x.shape[1])
        self.order, self.values = np.frombuffer(order, np.int32).reshape(PROJECTIONS, -1), np.frombuffer(values).reshape(PROJECTIONS, -1)
        self.line_up()
        return self

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of verified vectors among which the k nearest are; `own` is left out (-1: none)."""
        n, nq = len(self.x), float(norms(q[None])[0])
        p = (q / nq) @ self.axes
        score = np.full(n, np.nan)
        count = np.zeros(n, np.int64)
        most = min(k, n - (own >= 0))
        low = high = self.places(p, "left")
        radius = RADIUS
        while most > 0:
            half = WIDTH * radius
            wider = self.places(p - half, "left"), self.places(p + half, "right")
            parts = [part for o, a, b, c, d in zip(self.order, wider[0], low, high, wider[1]) for part in (o[a:b], o[c:d])]
            count += np.bincount(np.concatenate(parts), minlength=n)
            low, high = wider
            new = np.flatnonzero((count >= THRESHOLD) & np.isnan(score))
            new = new[new != own]
            score[new] = cosines(self.x[new], self.norm[new], q, nq)
            found = np.flatnonzero(~np.isnan(score))
            if radius > 2 * len(self.axes):  # every window holds everything
                break
            if len(found) < most:
                radius *= GROWTH
                continue
            last = math.sqrt(max(0.0, 2 - 2 * float(np.partition(score[found], len(found) - most)[len(found) - most])))
            if last <= radius:
                break
            radius = min(radius * GROWTH, max(last, radius * 1.02))
        return (found, score[found]) if most > 0 else (np.zeros(0, np.int64), np.zeros(0))


def search(table: DataFrame, queries: Column, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, query_row, rank from 1, vec_id, score, verified): the k nearest found of each row where `queries` (on vec_id) holds.

    Candidates are all usable rows (see usable()) of the query's dimension but the query's own row; score is the cosine in
    double precision, ties go to the smaller vec_id. Rows that repeat an id are candidates each, and queries each, told apart by query_row.
    A query with fewer candidates gets all it has, one that isn't usable none. `verified` is the share of its candidates whose
    cosine was worked out. Other columns are ignored, an empty table gives no rows.
    """
    rows = stored(usable(with_rows(table)), "vectors")
    count = rows.agg(F.count("*").alias("n"), F.count(F.when(queries, 1)).alias("q")).first()
    shards, blocks = max(1, -(-count["n"] // shard)), max(1, -(-count["q"] // block))
    split = lambda n, seed: F.pmod(F.xxhash64("row_", F.lit(seed)), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("row_")
        dim = t.column("dim")[0].as_py()
        index = Index(safe(matrix(t.column("embedding"), dim)))
        packed = [t.column("row_").to_numpy(), t.column("vec_id").to_numpy(), index.x, index.order, index.values]
        cols = [pa.array([dim], pa.int32()), t.column("shard").slice(0, 1), *(pa.array([a.tobytes()], pa.binary()) for a in packed)]
        return pa.table(cols, ["dim", "shard", "rows", "ids", "x", "order", "values"])

    data = rows.select("dim", split(shards, 1).alias("shard"), "row_", "vec_id", "embedding")
    index = data.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, rows binary, ids binary, x binary, order binary, values binary")
    index = stored(index, "index").withColumn("block", spread(blocks))
    asked = rows.where(queries).select("dim", spread(shards).alias("shard"), split(blocks, 2).alias("block"), "row_", "vec_id", "embedding")

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        if index.num_rows and asked.num_rows:
            dim = asked.column("dim")[0].as_py()
            held = {c: index.column(c)[0].as_buffer() for c in ("rows", "ids", "x", "order", "values")}
            rows, ids = np.frombuffer(held["rows"], np.int64), np.frombuffer(held["ids"], np.int64)
            found_in = Index.load(np.frombuffer(held["x"]).reshape(-1, dim), held["order"], held["values"])
            for row, q, v in zip(asked.column("row_").to_numpy(), asked.column("vec_id").to_numpy(), safe(matrix(asked.column("embedding"), dim))):
                at = int(np.searchsorted(rows, row))
                found, score = found_in.search(v, at if at < len(rows) and rows[at] == row else -1, k)
                best = np.lexsort((ids[found], -score))[:k]
                for c, values in zip(out, ([q] * len(best), [row] * len(best), ids[found[best]].tolist(), score[best].tolist(), [len(found)] * len(best), [len(rows)] * len(best))):
                    c += values
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["query_id", "query_row", "vec_id", "score", "tried", "of"])

    keys = ["dim", "shard", "block"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, query_row long, vec_id long, score double, tried long, of long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "query_row", "rank", "vec_id", "score", (F.col("tried") / F.col("of")).alias("verified"))
