"""N-gram Jaccard join: size-aware, with subsets of small sets and inverted lists for large ones.

A document's set holds the 64-bit hashes of its distinct five-word shingles. All hashes have one
total order: shingles known to be frequent last, the others by hash. Two sets with a Jaccard
similarity of at least t share at least ceil(t*n) elements, n the size of either, so

* their prefixes of n - ceil(t*n) + 1 elements share an element (inverted lists), and
* their prefixes of n - ceil(t*n) + 2 elements share a pair (fixed-size subsets).

Sets up to a boundary size are matched among themselves by the pairs, sets above it against
all others by lists. A cost model over the histogram of sizes chooses the boundary. Equal sets
are one class from the start; what shares a signature is verified on whole sets.

Pairs are verified in two rounds. The first takes for each set only the partner with which it
meets most often as head of a list; groups of near copies become one component here without
all their pairs. The second takes every remaining pair of a list whose sides lie in different
components, so no link that could join two components is left out. Of two prefixes the one that
ends first in the total order has all common elements up to there in both, so a pair's overlap is at
most the number of lists it shares plus what one set has beyond its prefix. A pair therefore needs some
number of common lists, and is looked for only in as many of each side's lists, rarest first, as
must hold one of them; long lists of texts that share a passage drop out here.

Lists of any length are worked off in one way: a list is cut into blocks of about TILE sets by hash, and each pair
of its blocks is a unit of work of its own, so a task's memory is bounded and a hot list is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordHasher, drop_stored, groups_of, hashed, mix, stored, text_bytes, tidy, word_bounds
from .components import components

WORDS = 5
#: Similarity 75 / 100, as integers.
NUM, DEN = 75, 100
#: Sets of a list's block.
TILE = 2048
#: Frequent shingles that are ordered last: at most so many, each seen at least so often in one block of documents.
HEAVY, SEEN = 100_000, 3
BLOCK = 2 << 20
SUBSET = np.uint64(1 << 63)


def shingle_hashes(h: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """For each text (words h[first[i]:first[i + 1]]) the sorted distinct hashes of its shingles."""
    c = [np.uint64(pow(0xA24BAED4963EE407, k + 1, 2**64)) for k in range(WORDS)]
    s = np.zeros(0, np.uint64)
    if len(h) >= WORDS:
        m = len(h) - WORDS + 1
        s = mix(sum(h[k : k + m] * c[k] for k in range(WORDS)))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            yield np.unique(s[a : b - WORDS + 1])
        elif b > a:
            yield mix(np.array([sum(int(h[a + k]) * int(c[k]) for k in range(b - a)) + (b - a) & (2**64 - 1)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def sets_of(batches, hasher: WordHasher):
    """(ids, list of sets) for blocks of documents of about BLOCK bytes; batches have columns doc_id, text."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offs = text_bytes(batch.column(1))
        for i, j in groups_of(np.diff(offs), BLOCK):
            part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            starts, ends, first = word_bounds(part, o)
            yield ids[i:j], list(shingle_hashes(hasher(part, starts, ends), first))


def keys_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: equal ones mean equal sets."""
    k1 = np.array([int(np.bitwise_xor.reduce(mix(s + np.uint64(11)))) if len(s) else 0 for s in sets], np.uint64)
    k2 = np.array([int(np.add.reduce(mix(s * np.uint64(3) + np.uint64(5)))) & (2**64 - 1) if len(s) else 0 for s in sets], np.uint64)
    return k1.view(np.int64), k2.view(np.int64)


def describe(batches):
    """A row for each document (doc_id, n, k1, k2: 128 bits of its set) and one for each frequent shingle of a block."""
    hasher = WordHasher()
    for ids, sets in sets_of(batches, hasher):
        n = np.array([len(s) for s in sets], np.int64)
        k1, k2 = keys_of(sets)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n), pa.array(k1), pa.array(k2), pa.nulls(len(ids), pa.int64())], ["doc_id", "n", "k1", "k2", "sig"])
        if n.sum():
            u, c = np.unique(np.concatenate(sets), return_counts=True)
            u, c = u[c >= SEEN].view(np.int64), c[c >= SEEN]
            z = pa.nulls(len(u), pa.int64())
            yield pa.record_batch([z, pa.array(c.astype(np.int64)), z, z, pa.array(u)], ["doc_id", "n", "k1", "k2", "sig"])


def needed(n: int) -> int:
    """Least overlap of a set of n elements with any partner."""
    return -(-NUM * n // DEN)


def boundary(sizes: dict[int, int], spread: float) -> int:
    """Largest size of sets matched by subsets: the one of least total cost, rows written plus list rows scanned.

    sizes: how many sets there are by size, of all sizes up to a bound; spread: mean length of a list.
    """

    def light(n: int) -> int:
        p = n - needed(n) + 2
        return p * (p - 1) // 2

    def heavy(n: int) -> float:
        return (n - needed(n) + 1) * (1 + spread)

    def cost(x: int) -> float:
        return sum(k * ((light(n) if n <= x else 0) + (heavy(n) if n > x or NUM * x < DEN * n else 0)) for n, k in sizes.items())

    return min(range(2, max([2, *sizes]) + 1), key=cost)


def prefixes(heavy, x: int):
    """Rows (sig, k1) of every set: its pairs up to size x, its single elements from 0.75 * x on."""

    def run(batches):
        common, rank = heavy.value
        hasher = WordHasher()
        known: set[tuple[int, int]] = set()
        for _, sets in sets_of(batches, hasher):
            sigs, own = [], []
            for s, k1, k2 in zip(sets, *(k.tolist() for k in keys_of(sets))):
                n = len(s)
                if n < 3:  # such a set has no partner but its equals
                    continue
                if (k1, k2) in known:  # an equal set of this task has written the same rows
                    continue
                if len(known) > 500_000:
                    known.clear()
                known.add((k1, k2))
                p = n - needed(n) + 2
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    last = common[at] == s
                    if last.any():
                        s = np.concatenate([s[~last], s[last][np.argsort(rank[at[last]], kind="stable")]])
                if n <= x:
                    i, j = np.triu_indices(p, 1)
                    sigs.append(mix(s[i] * np.uint64(0xD1342543DE82EF95) + s[j] * np.uint64(0xAF251AF3B0F025B5)) | SUBSET)
                    own.append(np.full(len(i), k1))
                if n > x or NUM * x < DEN * n:
                    sigs.append(s[: p - 1] & ~SUBSET)
                    own.append(np.full(p - 1, k1))
            if sigs:
                yield pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(own).astype(np.int64))], ["sig", "k1"])

    return run


def paired(x: int):
    """Pairs (a, b) of the tiles in rows (sig, tile, side, node, n, c: component, k: rank of this list among the node's, m: how
    many it has), sorted by list and tile, that may be links. Side -1: a block with itself; else only nodes of both sides pair."""

    def run(batches):
        rest = np.zeros((8, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
            last = np.flatnonzero((rows[:2] != rows[:2, -1:]).any(axis=0)) if rows.shape[1] else rows[1]
            cut = int(last[-1]) + 1 if len(last) else 0  # the last tile may go on in the next batch
            rest = rows[:, cut:]
            yield from pairs_of(rows[:, :cut])
        yield from pairs_of(rest)

    def pairs_of(rows: np.ndarray):
        sig, tile, side, node, n, c, k, m = rows
        found = [np.zeros((2, 0), np.int64)]
        at, d = np.arange(len(sig)), 0
        while len(at):
            d += 1
            at = at[at + d < len(sig)]
            at = at[(sig[at] == sig[at + d]) & (tile[at] == tile[at + d])]
            i, j = at, at + d
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            need = -(-NUM * (low + high) // (NUM + DEN)) + (-NUM * high // DEN) + 1
            need = np.where(sig[i] < 0, 1, np.maximum(1, need))
            ok = (c[i] != c[j]) & (DEN * low >= NUM * high) & ((sig[i] < 0) | (high > x)) & (k[i] <= m[i] - need + 1) & (k[j] <= m[j] - need + 1)
            ok &= (side[i] < 0) | (side[i] != side[j])
            i, j = i[ok], j[ok]
            found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]))
            if sum(f.shape[1] for f in found) > 1 << 20 or d % 64 == 0:
                found = [np.unique(np.concatenate(found, axis=1), axis=1)]
                if found[0].shape[1] > 1 << 19:
                    yield table(found.pop())
                    found = [np.zeros((2, 0), np.int64)]
        if (pairs := np.concatenate(found, axis=1)).shape[1]:
            yield table(np.unique(pairs, axis=1))

    def table(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def tiles(far: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows (sig, tile, side, node, n, c, k, m) of all pairs of blocks of each list in `far`, whose lengths are in `length`."""
    blocks = F.ceil(F.col("length") / tile).cast("long")
    far = far.withColumn("of", blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(9)), F.col("of")))
    far = far.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, -1).when(F.col("own") == low, 0).otherwise(1).cast("long")
    out = far.select("sig", (low * F.col("of") + high).alias("tile"), side.alias("side"), "node", "n", "c", "k", "m")
    return out.repartition("sig", "tile").sortWithinPartitions("sig", "tile")


def shingled(batches):
    """(doc_id, shingles) of rows (doc_id, text, k1, k2) whose set has that key: the whole set as sorted 64-bit integers in a binary value."""
    hasher = WordHasher()
    seen: set[int] = set()  # rows of one id come to one task; of those that repeat one is enough
    for batch in batches:
        want = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        at = 0
        for ids, sets in sets_of([batch], hasher):
            k1, k2 = keys_of(sets)
            rows = []
            for d, s, p, q in zip(ids.tolist(), sets, k1.tolist(), k2.tolist()):
                if (p, q) == (want[0][at], want[1][at]) and d not in seen:
                    rows.append((d, s.tobytes()))
                    seen.add(d)
                at += 1
            yield pa.record_batch([pa.array([d for d, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], ["doc_id", "shingles"])


def overlapping(batches):
    """Of pairs (a, b, sa, sb) those whose sets have a Jaccard similarity of at least NUM / DEN."""
    for batch in batches:
        sa, sb = (batch.column(k) for k in (2, 3))
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            p, q = (np.frombuffer(x[i].as_buffer(), np.uint64) for x in (sa, sb))
            both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
            keep[i] = DEN * both >= NUM * (len(p) + len(q) - both)
        yield batch.select([0, 1]).filter(pa.array(keep))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar, by their whole texts. `nodes` has (node, k1, k2)."""
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = stored(ids.join(nodes, "node").select(F.col("node").alias("doc_id"), "k1", "k2"), "ids")
    sets = docs.join(hashed(ids), "doc_id").select("doc_id", "text", "k1", "k2").mapInArrow(tidy(shingled), "doc_id long, shingles binary")
    sets = stored(sets, "sets")
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    out = stored(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(tidy(overlapping), "a long, b long"), "links")
    drop_stored(sets, ids)
    out._pairs = pairs
    return out


def jaccard_join(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links).

    Links hold between two documents whose sets have 100 * intersection >= 75 * union; a document
    without words (null and empty texts too) links with nothing. Fewer than five words make one
    shingle. Rows that repeat a doc_id are one document, whose text is the one of the smallest set (ties by the set's key); the other
    texts of that id play no part. A null doc_id is dropped. Other columns are ignored. An empty table gives an empty one.
    Equal sets share a class from their 128-bit sum; elements are 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    seen = stored(docs.mapInArrow(tidy(describe), "doc_id long, n long, k1 long, k2 long, sig long"), "shingles")
    narrow = seen.where("sig is null").groupBy("doc_id").agg(F.min(F.struct("n", "k1", "k2")).alias("s")).select("doc_id", "s.*")
    common = seen.where("sig is not null").groupBy("sig").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "sig").limit(HEAVY).toPandas()
    common = common.assign(h=common["sig"].to_numpy(np.int64).view(np.uint64)).sort_values("h")
    heavy = spark.sparkContext.broadcast((common["h"].to_numpy(np.uint64), common["c"].to_numpy(np.int64)))
    sizes = {r["s"]: r["k"] for r in seen.where("sig is null and n between 3 and 64").groupBy(F.col("n").alias("s")).agg(F.count("*").alias("k")).collect()}
    total = seen.agg(F.sum(F.when(F.col("sig").isNull(), F.col("n"))).alias("all"), F.sum(F.when(F.col("sig").isNotNull(), F.col("n"))).alias("often")).first()
    spread = 1 + 2 * (total["often"] or 0) / max(1, total["all"] or 0)
    x = boundary(sizes, spread)

    # Classes of equal sets; node: the smallest document of a class. Only one text of a document is in a class.
    key = ["n", "k1", "k2"]
    nodes = stored(narrow.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("node")), "nodes")
    members = stored(narrow.join(nodes, key, "left").select("doc_id", "n", F.coalesce("node", "doc_id").alias("node")), "members")
    drop_stored(seen)

    # Lists with at least two sets. What a task has of a list is reduced before the shuffle, however long it is.
    rows = stored(docs.mapInArrow(tidy(prefixes(heavy, x)), "sig long, k1 long"), "prefixes")
    shared = rows.groupBy("sig").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low < high").select("sig")
    lists = stored(rows.join(shared, "sig").distinct().join(nodes.select("node", "n", "k1"), "k1").select("sig", "node", "n"), "lists")
    drop_stored(rows)

    close = lambda p, q: DEN * F.least(p, q) >= NUM * F.greatest(p, q)
    whole = lambda n, a, b: F.floor((n * a + b - 1) / F.lit(b))  # noqa: E731  n * a / b rounded up
    least = lambda p, q: whole(p + q, NUM, NUM + DEN)  # noqa: E731  overlap that a link needs
    enough = lambda c, p, q: c + whole(F.greatest(p, q), NUM, DEN) - 1 >= least(p, q)

    # First round: for each node the head (least document) of a list that it meets most often.
    heads = lists.groupBy("sig").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("sig", "head")
    best = lists.join(heads, "sig").where("node <> head").groupBy("head", "node", "n").agg(F.count("*").alias("c"), F.min("sig").alias("s"))
    best = best.join(nodes.select(F.col("node").alias("head"), F.col("n").alias("head_n")), "head")
    best = best.where(close(F.col("n"), F.col("head_n")) & ((F.col("s") < 0) | enough(F.col("c"), F.col("n"), F.col("head_n"))))
    best = best.groupBy("node").agg(F.max(F.struct("c", (-F.col("head")).alias("h"))).alias("m"))
    best = best.select((-F.col("m.h")).alias("h"), "node").select(F.least("h", "node").alias("a"), F.greatest("h", "node").alias("b")).distinct()
    first = verified(best, docs, nodes)
    label = stored(components(first), "labels")

    # Second round: what still lies in different components.
    far = lists.join(label.withColumnRenamed("id", "node"), "node", "left").select("sig", "node", "n", F.coalesce("component", "node").alias("c"))
    far = stored(far, "far")
    member = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"x{seed}") for seed in (1, 2)]
    open_ = far.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("length"), *member).where("low < high")
    # Lists with the same members (texts that share a passage have one for each of its shingles) give the same pairs. Of these the one
    # of least signature is the first for every member, so it alone finds all.
    alike = ["length", "x1", "x2", F.col("sig") < 0]
    open_ = open_.select("sig", "length", (F.col("sig") == F.min("sig").over(Window.partitionBy(*alike))).alias("first"))
    # A pair needs c_min common lists; of each side's lists, rarest first, one of the first (all - c_min + 1) is common.
    own = Window.partitionBy("node").orderBy("length", "sig")
    listed = far.join(open_, "sig").withColumns({"k": F.row_number().over(own), "m": F.count("*").over(Window.partitionBy("node"))}).where("first")
    pairs = stored(tiles(listed, tile).mapInArrow(tidy(paired(x)), "a long, b long").distinct(), "candidates")
    second = verified(pairs.join(first._pairs, ["a", "b"], "left_anti"), docs, nodes)
    drop_stored(pairs)
    out = stored(components(first.unionByName(second)), "labels")
    drop_stored(lists, far, label, nodes, first._pairs, first, second._pairs, second)
    return members.join(out.withColumnRenamed("id", "node"), "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")
    )
