"""Mixing sources to target weights by the cube method.

A source's target over its size is how often each of its documents is taken on average: the whole
part is taken as it is, the fraction is an inclusion probability. The flight phase moves those
probabilities of three documents at a time along the null space of the two balancing constraints
(documents and words of the source), until one of them is 0 or 1; at most two documents of a block
keep a fraction. Blocks are shares of a source by hash, so a source of any size is spread; what
is left of all blocks is gathered and flown again, level by level, until one block of a source is
left. There LANDING documents of all sizes stay aside; with the two that the flight leaves they are
the landing problem, solved by trying every rounding for the one nearest to the source's words and
number. Everything follows from hashes of ids and the rows' places in their files, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, hashed, numbered, stored

#: Weights of sources in the order of their names' code points, null last, repeating.
WEIGHTS = (5, 2, 1)
#: All targets sum to so many times all sizes; none is above CAP times its source's size.
SHARE, CAP = 1.5, 2
#: Documents that a block of the flight phase holds on average.
BLOCK = 4096
#: Documents of a source that stay out of its last flight.
LANDING = 12
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _weighted(sizes: DataFrame) -> DataFrame:
    """sizes with w, the weight of each source by its rank: sources are sorted by ranges, and a range's first rank is the
    number of sources in those before it, so that no task sees all of them."""
    order = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    part = sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "nth": inside})
    part = stored(part, "sources")
    first = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    first = part.groupBy("part").agg(F.count("*").alias("n")).select("part", first.alias("first"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("first") + F.col("nth")) % len(WEIGHTS) + 1).cast("int"))
    return part.join(F.broadcast(first), "part").select("source", "source_size", weight.cast("double").alias("w"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Targets are proportional to weights up to CAP times a source's size, and the excess is shared by weight until
    none is above: each round adds up the caps of the sources that are full and the weights of the others, and gives
    the level that the others get; a round's level is never below the last one's, so it ends.
    """
    t = stored(_weighted(sizes).withColumn("cap", (CAP * F.col("source_size")).cast("double")), "weights")
    level, full = 0.0, -1
    while True:
        capped = F.col("cap") < F.lit(level) * F.col("w")
        sums = t.agg(F.sum("source_size"), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w"))), F.count(F.when(capped, 1))).first()
        if sums[3] == full or not sums[2]:
            break
        level, full = (SHARE * sums[0] - (sums[1] or 0.0)) / sums[2], sums[3]
    return t.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def fly(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Flight phase: fractions moved to 0 or 1 but for two at most, with the sums of pi and pi * size kept."""
    pi, size = pi.tolist(), size.tolist()
    keep: list[int] = []
    for k in range(len(pi)):
        if not 0 < pi[k] < 1:
            continue
        keep.append(k)
        if len(keep) < 3:
            continue
        a, b, c = keep
        # The null space of the rows (1, 1, 1) and (sizes): their cross product. Equal sizes leave a second direction.
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for i, v in zip(keep, u):
            if v > 0:
                up, down = min(up, (1 - pi[i]) / v), min(down, pi[i] / v)
            elif v < 0:
                up, down = min(up, pi[i] / -v), min(down, (1 - pi[i]) / -v)
        # Either end of the segment, with the chances that keep every expectation, from a hash of where it stands.
        step = up if (k * 0x9E3779B97F4A7C15 + int(size[c]) * 0xBF58476D1CE4E5B9 >> 11) % 1_000_003 / 1_000_003 * (up + down) < down else -down
        keep = []
        for i, v in zip((a, b, c), u):
            p = pi[i] + step * v
            p = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
            pi[i] = p
            if 0 < p < 1:
                keep.append(i)
    return np.array(pi)


STATE = "source string, row_ long, size long, h long, pi double"


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.iloc[np.lexsort((pdf["row_"].to_numpy(), pdf["h"].to_numpy(), -pdf["size"].to_numpy()))]


def _level(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (source, row_, size, h, pi) with pi after a flight of each group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        return pdf.assign(pi=fly(pdf["pi"].to_numpy(float), pdf["size"].to_numpy(float)))[["source", "row_", "size", "h", "pi"]]

    return rows.groupBy(*keys).applyInPandas(run, STATE)


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rounding of a few fractions that changes sum(pi * size) and sum(pi) least, a document counting as a word."""
    n = len(pi)
    x = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    off = x - pi
    return x[np.argmin(np.abs(off @ size) + np.abs(off.sum(axis=1)))].astype(float)


def fly_and_land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whole numbers for all fractions."""
    pi = pi.copy()
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    aside = np.unique(open_[np.linspace(0, len(open_) - 1, min(LANDING, len(open_))).astype(int)]) if len(open_) else open_
    rest = np.setdiff1d(open_, aside)
    pi[rest] = fly(pi[rest], size[rest])
    last = np.flatnonzero((pi > 0) & (pi < 1))
    pi[last] = land(pi[last], size[last])
    return pi


def _plan(rows: DataFrame) -> DataFrame:
    """(row_, doc_id, source, size, source_size, target, copies) of rows (row_, doc_id, source, text)."""
    sized = rows.select("row_", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    sized = stored(sized, "sizes")
    goal = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    largest = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # A whole number within rounding errors is whole.
    near = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    rates = goal.select(F.col("source").alias("source_"), "source_size", "target", F.floor(near).alias("whole"), (near - F.floor(near)).alias("part"))
    with_rate = lambda df: df.join(rates, df["source"].eqNullSafe(rates["source_"])).drop("source_")

    state = with_rate(sized).select("source", "row_", "size", F.xxhash64("doc_id", "size").alias("h"), F.col("part").alias("pi"))
    done = []
    n = largest
    while n > BLOCK:
        n_blocks = -(-n // BLOCK)
        flown = stored(_level(state.withColumn("block", F.pmod(F.xxhash64("h", "row_", F.lit(len(done))), F.lit(n_blocks))), ["source", "block"]), "flight")
        done.append(flown.where("pi in (0, 1)"))
        state, n = flown.where("pi not in (0, 1)"), 2 * n_blocks

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        return pdf.assign(pi=fly_and_land(pdf["pi"].to_numpy(float), pdf["size"].to_numpy(float)))[["source", "row_", "size", "h", "pi"]]

    out = state.groupBy("source").applyInPandas(finish, STATE)
    for d in done:
        out = out.unionByName(d)
    out = out.select("row_", "pi").join(with_rate(sized), "row_")
    return out.select("row_", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("pi")).cast("int").alias("copies"))


def choose(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies int): one row per row of docs (doc_id, source, text).

    copies is 0, 1 or 2. A null or wordless text has size 0; a source without words has target 0 and is not
    taken. A null source is a source, last in order; a null doc_id is taken like others. Equal rows are
    separate documents. An empty table gives an empty one. Where a source has many documents, its copies come
    within a few words of its target; where it has few, as near as the roundings of the last allow.
    """
    rows, row = numbered(docs.select("doc_id", "source", "text"))
    return _plan(rows.withColumnRenamed(row, "row_")).drop("row_")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of docs, each as often as choose() takes it; columns stay as they are, whatever their names."""
    rows, row = numbered(docs)
    copies, nth = free_name("copies_", rows), free_name("copy_", rows)
    taken = _plan(rows.select(F.col(row).alias("row_"), "doc_id", "source", "text")).where("copies > 0").select(F.col("row_").alias(row), F.col("copies").alias(copies))
    taken = stored(taken, "taken")
    both = rows.join(hashed(taken), row)
    return both.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: words that the mix takes of each row."""
    return choose(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
