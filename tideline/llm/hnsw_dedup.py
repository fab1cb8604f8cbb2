"""Near-duplicates of vectors by navigable small-world graphs, one per shard.

Equal vectors are one node. Nodes are sharded by hash; each shard builds a hierarchical navigable
small-world graph, in batches: a batch's nodes search the graph of those before them, choose diverse
neighbours among what they find and each other, and are linked both ways. Every node then queries
every shard, a batch of queries moving in lockstep. A query whose beam is full of links gets a wider
one. Every beam width is audited in each task: of the queries that it would answer, random ones are scanned against all of the shard until AUDIT_LINKS
links are seen, or else all of them; if less than AUDIT of those links were found, all these queries get a wider beam too. Scanned queries keep the exact links. Beyond
WIDEST the rest is done exactly, by a scan of the shard. Links are verified by cosine in double
precision; each task sends on a spanning forest of its links, whose union gives the components.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored
from .components import components
from .vectors import matrix, norms, safe, usable, with_rows

log = logging.getLogger(__name__)
SIMILAR = 0.9
DEGREE, BUILD_BEAM, BATCH = 12, 32, 512
BEAM, WIDEST, AUDIT, AUDIT_LINKS, SAMPLE = 24, 192, 0.995, 1000, 64
#: Nodes of a shard and queries of a block at most, and bytes of either; so many shards at least, if a shard then has LEAST nodes.
SHARD, BYTES, SHARDS, LEAST = 131_072, 256 << 20, 6, 512
LAYER = 16


class Graph:
    """Nodes in order of insertion; the first n // LAYER**l of them form layer l, the top layer is scanned whole."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.n = len(x)
        self.tops = [max(1, min(self.n, 64))]
        while self.tops[-1] * LAYER < self.n:
            self.tops.append(self.tops[-1] * LAYER)
        self.tops.append(self.n)
        self.links = [np.full((t, 2 * DEGREE), -1, np.int32) for t in self.tops[1:]]
        at = self.tops[0]
        self.connect_all(at)
        while at < self.n:
            size = min(BATCH, at, self.n - at)
            self.insert(at, size)
            at += size

    def connect_all(self, n: int) -> None:
        s = self.x[:n] @ self.x[:n].T
        np.fill_diagonal(s, -np.inf)
        near = np.argsort(-s, axis=1)[:, : min(DEGREE, n - 1)]
        for links in self.links:
            links[:n, : near.shape[1]] = near

    def diverse(self, nodes: np.ndarray, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Of each node's candidates (best first, -1 for none) those nearer to it than to any chosen before; then the nearest others."""
        v = self.x[cand]
        among = v @ v.transpose(0, 2, 1)
        b, c = cand.shape
        chosen, closest = np.zeros((b, c), bool), np.full((b, c), -np.inf, np.float32)
        for k in range(c):
            take = (cand[:, k] >= 0) & (closest[:, k] < sim[:, k]) & (chosen.sum(axis=1) < most)
            chosen[:, k] = take
            closest[take] = np.maximum(closest[take], among[take, k])
        rank = np.argsort(np.where(cand < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(cand, rank, axis=1)

    def insert(self, at: int, size: int) -> None:
        new = np.arange(at, at + size)
        q = self.x[at : at + size]
        found, sims = self.search(q, BUILD_BEAM, limit=at)
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        k = min(8, size - 1)
        if k:
            near = np.argpartition(-own, k - 1, axis=1)[:, :k]
            found = np.concatenate([found, near + at], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(own, near, axis=1)], axis=1)
        for l, links in enumerate(self.links):
            members = new < len(links)
            if not members.any():
                continue
            ok = found < len(links)
            s = np.where(ok & (found >= 0), sims, -np.inf)[members]
            order = np.argsort(-s, axis=1, kind="stable")
            s = np.take_along_axis(s, order, axis=1)
            f = np.where(np.isinf(s), -1, np.take_along_axis(found[members], order, axis=1))
            chosen = self.diverse(new[members], f, s, DEGREE)
            links[new[members], : chosen.shape[1]] = chosen
            self.back(links, new[members], chosen)

    def back(self, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
        """Links from the chosen back to the new nodes; a full list keeps a diverse part."""
        to, frm = chosen.ravel(), np.repeat(new, chosen.shape[1])
        to, frm = to[to >= 0], frm[to >= 0]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        most = min(int(count.max(initial=0)), 4 * DEGREE)
        add = np.full((len(nodes), most), -1, np.int64)
        nth = np.arange(len(to)) - np.repeat(first, count)
        keep = nth < most
        add[np.repeat(np.arange(len(nodes)), count)[keep], nth[keep]] = frm[keep]
        add[(add[:, :, None] == links[nodes][:, None, :]).any(axis=2)] = -1
        both = np.concatenate([links[nodes], add], axis=1)
        full = (both >= 0).sum(axis=1) > links.shape[1]
        order = np.argsort(both < 0, axis=1, kind="stable")
        both = np.take_along_axis(both, order, axis=1)
        links[nodes[~full]] = both[~full, : links.shape[1]]
        for k in range(0, int(full.sum()), 1024):
            n, b = nodes[full][k : k + 1024], both[full][k : k + 1024]
            s = np.einsum("ijk,ik->ij", self.x[b], self.x[n])
            s[b < 0] = -np.inf
            order = np.argsort(-s, axis=1, kind="stable")
            links[n] = self.diverse(n, np.take_along_axis(b, order, axis=1), np.take_along_axis(s, order, axis=1), links.shape[1])

    def search(self, q: np.ndarray, beam: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Up to `beam` nodes near each query, best first, with their similarities; -1 where there are none."""
        limit = self.n if limit is None else limit
        top = min(self.tops[0], limit)
        s = q @ self.x[:top].T
        k = min(beam, 8, top)
        ids = np.argsort(-s, axis=1)[:, :k]
        sims = np.take_along_axis(s, ids, axis=1)
        for l, links in enumerate(self.links):
            last = l == len(self.links) - 1 or len(links) >= limit
            ids, sims = self.beam(q, links, ids, sims, beam if last else 8)
            if last:
                break
        return ids, sims

    def beam(self, q: np.ndarray, links: np.ndarray, ids: np.ndarray, sims: np.ndarray, beam: int):
        b = len(q)
        pad = beam - ids.shape[1]
        ids = np.pad(ids.astype(np.int64), ((0, 0), (0, max(0, pad))), constant_values=-1)[:, :beam]
        sims = np.pad(sims.astype(np.float32), ((0, 0), (0, max(0, pad))), constant_values=-np.inf)[:, :beam]
        done = ids < 0
        seen = np.zeros((b, self.n + 1), bool)
        seen[np.arange(b)[:, None], ids] = True
        live = np.arange(b)
        while len(live):
            open_ = np.where(done[live], -np.inf, sims[live])
            pick = open_.argmax(axis=1)
            going = open_[np.arange(len(live)), pick] > -np.inf
            live, pick = live[going], pick[going]
            if not len(live):
                break
            done[live, pick] = True
            near = links[ids[live, pick]].astype(np.int64)
            old = seen[live[:, None], near] | (near < 0)
            seen[live[:, None], near] = True
            s = np.einsum("ijk,ik->ij", self.x[near], q[live])
            s[old] = -np.inf
            better = s.max(axis=1) > sims[live].min(axis=1)
            row = live[better]
            if len(row):
                i2 = np.concatenate([ids[row], near[better]], axis=1)
                s2 = np.concatenate([sims[row], s[better]], axis=1)
                d2 = np.concatenate([done[row], old[better]], axis=1)
                at = np.argpartition(-s2, beam - 1, axis=1)[:, :beam]
                ids[row], sims[row], done[row] = (np.take_along_axis(a, at, axis=1) for a in (i2, s2, d2))
                empty = np.isinf(sims[row])
                ids[row] = np.where(empty, -1, ids[row])
                done[row] |= empty
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def exact(x: np.ndarray, nx: np.ndarray, q: np.ndarray, nq: np.ndarray, similar: float):
    """(query, node) of all links, by a scan in blocks."""
    out = []
    step = max(1, 8_000_000 // max(1, len(x)))
    for k in range(0, len(q), step):
        s = (q[k : k + step] @ x.T) / (nq[k : k + step, None] * nx)
        i, j = np.nonzero(s >= similar - 1e-9)
        out.append((i + k, j))
    return np.concatenate([i for i, _ in out]) if out else np.zeros(0, int), np.concatenate([j for _, j in out]) if out else np.zeros(0, int)


def audit(x: np.ndarray, nx: np.ndarray, q: np.ndarray, nq: np.ndarray, similar: float, own: np.ndarray, asked: np.ndarray, known: np.ndarray):
    """Whether `known` (query * nodes + node) has enough links of the queries `asked`; the queries scanned, all their links, and (true, found) links."""
    need = got = at = 0
    size, truth = SAMPLE, []
    while at < len(asked) and need < AUDIT_LINKS:
        part = asked[at : at + size]
        i, j = exact(x, nx, q[part], nq[part], similar)
        i = part[i]
        truth.append((i, j))
        pairs = (i.astype(np.int64) * len(x) + j)[own[i] != j]
        need += len(pairs)
        got += int(np.isin(pairs, known).sum())
        at, size = at + len(part), size * 2
    return got >= AUDIT * need, asked[:at], truth, (need, got)


def links_of(graph: Graph, x: np.ndarray, nx: np.ndarray, q: np.ndarray, nq: np.ndarray, similar: float, own: np.ndarray | None = None, seen: list | None = None):
    """(query, node) of verified links of every query with the shard. `own` has each query's own node or -1: finding it is no merit.
    `seen` gets the (true, found) links of each audit that was passed."""
    qf = (q / nq[:, None]).astype(np.float32)
    own = np.full(len(q), -1) if own is None else own
    rng = np.random.default_rng(len(q))
    beam, wanted = BEAM, np.arange(len(q))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(wanted) and beam <= WIDEST:
        full = np.zeros(len(wanted), bool)
        hits = []
        for k in range(0, len(wanted), BATCH):
            part = wanted[k : k + BATCH]
            ids, sims = graph.search(qf[part], beam)
            hit = sims >= similar - 1e-5
            full[k : k + BATCH] = hit.all(axis=1) & (beam < graph.n)
            i, j = np.nonzero(hit & ~full[k : k + BATCH, None])
            hits.append((part[i], ids[i, j]))
        i, j = (np.concatenate(c) for c in zip(*hits))
        good, scanned, truth, counted = audit(x, nx, q, nq, similar, own, rng.permutation(wanted[~full]), i.astype(np.int64) * len(x) + j)
        found += truth
        if good:
            found.append((i, j))
            if seen is not None:
                seen.append(counted)
        wanted = wanted[full] if good else wanted[~np.isin(wanted, scanned)]
        beam *= 2
    if len(wanted):
        i, j = exact(x, nx, q[wanted], nq[wanted], similar)
        found.append((wanted[i], j))
    i, j = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    pair = np.unique(i.astype(np.int64) * max(1, len(x)) + j)
    i, j = pair // max(1, len(x)), pair % max(1, len(x))
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 65536):
        a, b = i[k : k + 65536], j[k : k + 65536]
        keep[k : k + 65536] = (x[b] * q[a]).sum(axis=1) / (nx[b] * nq[a]) >= similar
    return i[keep], j[keep]


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links a-b."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist()):
        p, q = find(u), find(v)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((u, v))
    return out


def near_duplicates(table: DataFrame, similar: float = SIMILAR, shards: int | None = None) -> DataFrame:
    """One row per row of `table` with a vec_id: vec_id, n_links (other rows linked directly), component_id (least vec_id reachable), kept.

    Links hold between vectors of one dimension with a cosine of at least `similar`. What isn't usable (see
    usable()) links with nothing. Rows that repeat an id are vectors of their own: they link by their cosine, not by the id,
    and count as links. Rows with null ids are left out. Other columns are ignored. An empty
    table gives an empty one. Labels play no part. The recall of all audits that were passed, over all tasks, is logged, and is `_recall` of the result.
    """
    every = with_rows(table)
    rows = usable(every).withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(7), "embedding")})
    rows = stored(rows, "vectors")
    key = ["dim", "k1", "k2"]
    nodes = stored(rows.groupBy(*key).agg(F.min("row_").alias("node"), F.count("*").alias("weight"), F.min("vec_id").alias("least")), "nodes")
    n, widest = nodes.agg(F.count("*"), F.max("dim")).first()
    most = max(LEAST, min(SHARD, BYTES // (8 * (widest or 1) + 8 * DEGREE + 64)))
    s = shards or max(-(-n // most), min(SHARDS, max(1, n // LEAST)))
    blocks = max(1, -(-n // most))
    vec = rows.join(nodes.select("node", "weight"), F.col("row_") == F.col("node")).select("node", "weight", "dim", "embedding")
    vec = vec.withColumns({"shard": F.pmod(F.xxhash64("node", F.lit(1)), F.lit(s)).cast("int"), "order_": F.xxhash64("node", F.lit(3))})
    vec = stored(vec, "vectors")

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by([("order_", "ascending"), ("node", "ascending")])
        dim = t.column("dim")[0].as_py()
        x = safe(matrix(t.column("embedding"), dim))
        g = Graph((x / norms(x)[:, None]).astype(np.float32))
        pack = lambda a: [a.tobytes()]
        cols = [[dim], [t.column("shard")[0].as_py()], pack(t.column("node").to_numpy()), pack(t.column("weight").to_numpy()), pack(x), [[a.tobytes() for a in g.links]]]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())))], ["dim", "shard", "nodes", "weights", "x", "links"])

    graphs = vec.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, nodes binary, weights binary, x binary, links array<binary>")
    graphs = stored(graphs, "graphs")

    def ask(g: pa.Table, q: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        seen: list[tuple[int, int]] = []
        if g.num_rows and q.num_rows:
            dim = g.column("dim")[0].as_py()
            row = {c: g.column(c)[0].as_py() for c in ("nodes", "weights", "x", "links")}
            ids, weights = (np.frombuffer(row[c], np.int64) for c in ("nodes", "weights"))
            x = np.frombuffer(row["x"]).reshape(-1, dim)
            nx = norms(x)
            graph = Graph.__new__(Graph)
            graph.x, graph.n = (x / nx[:, None]).astype(np.float32), len(x)
            graph.links = [np.frombuffer(b, np.int32).reshape(-1, 2 * DEGREE) for b in row["links"]]
            graph.tops = [max(1, min(len(x), 64)), *map(len, graph.links)]
            v = safe(matrix(q.column("embedding"), dim))
            own = q.column("node").to_numpy()
            order = np.argsort(ids)
            at = order[np.minimum(np.searchsorted(ids, own, sorter=order), len(ids) - 1)]
            i, j = links_of(graph, x, nx, v, norms(v), similar, np.where(ids[at] == own, at, -1), seen)
            other = own[i] != ids[j]
            i, j = i[other], j[other]
            total = np.bincount(i, weights[j], len(own)).astype(np.int64)
            some = np.flatnonzero(total)
            edges = forest(own[i], ids[j])
            out = [[*own[some].tolist(), *[a for a, _ in edges]], [*[None] * len(some), *[b for _, b in edges]], [*total[some].tolist(), *[None] * len(edges)]]
        # What audits have seen: a row without a node, with the true links and those found.
        for column, value in zip(out, (None, sum(n for n, _ in seen), sum(n for _, n in seen))):
            column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["node", "other", "links"])

    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = graphs.withColumn("block", spread(blocks))
    right = vec.select("node", "dim", "embedding", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", spread(s))
    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(ask, "node long, other long, links long")
    found = answers = stored(found, "links")
    true, got = found.where("node is null").agg(F.sum("other"), F.sum("links")).first()
    log.info("recall of audited beams: %s of %s links", got or 0, true or 0)
    found = found.where("node is not null")
    count = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.where("other is not null"), "node", "other").withColumnRenamed("id", "node")
    nodes = nodes.join(count, "node", "left").join(label, "node", "left").withColumn("group_", F.coalesce("component", "node"))
    nodes = stored(nodes.withColumn("links", F.coalesce("links", F.lit(0)) + F.col("weight") - 1).drop("component"), "labels")
    least = nodes.groupBy("group_").agg(F.min("least").alias("component_id"))
    linked = rows.select("row_", *key).join(nodes, key).join(least, "group_").select("row_", "links", "component_id")
    drop_stored(graphs, vec, answers)
    out = every.where("vec_id is not null").select("row_", F.col("vec_id").cast("long").alias("vec_id")).join(linked, "row_", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    out._recall = (got or 0) / true if true else 1.0
    return out
