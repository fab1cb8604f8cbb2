"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
over the counts of all vote patterns (at most 3 to the number of labellers, whatever the input)
estimates how each labeller votes on good and on bad documents; the posterior of a document's
pattern is its label. Posterior labels of a bounded sample train a linear scorer on hashed words and
word shapes, which then scores every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DoubleType, StructField, StructType

from .common import SPACE, WordHasher, groups_of, mix, stored, text_bytes, tidy, word_bounds

#: The scorer learns from so many different documents at most, none longer than so many bytes.
TRAIN_ROWS, TRAIN_LONGEST = 4000, 60_000
HASH_BITS, EPOCHS, RATE, DECAY = 18, 12, 0.5, 1e-6
KEEP = 0.5
BLOCK = 1 << 20
LABELLERS = ("words", "symbols", "lines", "variety", "commonest", "capitals", "word_length", "marks", "digits", "repeats")

_UPPER, _DIGIT, _SYMBOL, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_SYMBOL[list(b"*%&$#|<>{}\\~^=@")] = True
_MARK[list(b"!?*%&$#|")] = True
_WIDE_UPPER = np.zeros(256, bool)
_WIDE_UPPER[0x80:0x9F] = True  # the second byte of a Latin-1 capital


def _per(sums_of: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(sums_of, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text how many different hashes it has, and how often its commonest occurs; for each hash if it came before in its text."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((h, owner))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    again = np.zeros(len(h), bool)
    again[order] = ~new
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(h)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[order[at]], run)
    return np.bincount(owner[order[at]], minlength=n), most, again


def votes(data: np.ndarray, offs: np.ndarray, bounds, h: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Votes (texts x LABELLERS): 1 good, -1 bad, 0 nothing; and which words came before in their text."""
    starts, ends, first = bounds
    words = np.diff(first)
    size = np.maximum(1, np.diff(offs) - _per(SPACE[data], offs))
    distinct, most, again = _distinct(h, first)
    line = data != 10
    begin, stop = line.copy(), line.copy()
    head = np.zeros(len(data) + 1, bool)
    head[offs] = True
    if len(data):
        begin[1:] &= ~line[:-1] | head[1:-1]
        stop[:-1] &= ~line[1:] | head[1:-1]
    ls, le = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    lf = np.searchsorted(ls, offs)
    lines = np.diff(lf)
    unlike = _distinct(hasher(data, ls, le), lf)[0]
    upper = _UPPER[data].copy()
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[lead + 1 < len(data)]
    upper[lead] = _WIDE_UPPER[data[lead + 1]]
    share = lambda what: _per(what, offs) / size
    n = np.maximum(words, 1)
    marked = np.concatenate([[0], np.cumsum(_MARK[data[ends - 1]] if len(ends) else [], dtype=np.int64)])
    marked = (marked[first[1:]] - marked[first[:-1]]) / n
    mean = size / n
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][words > 0]] = 0
    same = _per(same, first) / n
    say = lambda bad, good: np.where(bad, -1, np.where(good, 1, 0))
    return np.stack(
        [
            say(words < 1, words >= 30),
            say(share(_SYMBOL[data]) > 0.04, share(_SYMBOL[data]) < 0.01),
            say((lines >= 2) & (unlike < 0.7 * lines), (lines >= 3) & (unlike >= 0.95 * lines)),
            say((words >= 20) & (distinct < 0.35 * n), (words >= 20) & (distinct > 0.5 * n)),
            say((words >= 10) & (most > 0.25 * n), (words >= 20) & (most < 0.15 * n)),
            say(share(upper) > 0.3, share(upper) < 0.1),
            say((mean < 2.5) | (mean > 14), (mean > 3.5) & (mean < 9)),
            say(marked > 0.2, marked < 0.05),
            say(share(_DIGIT[data]) > 0.5, share(_DIGIT[data]) < 0.1),
            say((words >= 8) & (same > 0.15), (words >= 8) & (same < 0.05)),
        ],
        axis=1,
    ).astype(np.int8), again


def features(data: np.ndarray, bounds, h: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Three hashed features of each word: itself, its shape, and its shape with whether it came before."""
    starts, ends, _ = bounds
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    size, a, z = ends - starts, data[starts].astype(np.uint64), data[ends - 1].astype(np.uint64)
    kind = lambda c: np.where((c >= 97) & (c < 123), 0, np.where((c >= 65) & (c < 91), 1, np.where((c >= 48) & (c < 58), 2, np.where(c >= 128, 3, c)))).astype(np.uint64)
    shape = kind(a) << np.uint64(20) | kind(z) << np.uint64(8) | np.minimum(np.log2(size + 1).astype(np.uint64), np.uint64(15))
    out = np.stack([h, mix(shape + np.uint64(1 << 40)), mix(shape << np.uint64(1) | again.astype(np.uint64) | np.uint64(1 << 50))], axis=1)
    return (out >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _blocks(column, hasher: WordHasher):
    data, offs = text_bytes(column)
    for i, j in groups_of(np.diff(offs), BLOCK):
        part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        bounds = word_bounds(part, o)
        h = hasher(part, bounds[0], bounds[1])
        yield part, o, bounds, h, *votes(part, o, bounds, h, hasher)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior of good, table (labeller, class, vote -1 or 1) and posterior of each pattern, by expectation-maximisation.

    It starts with patterns that hold a bad vote as bad, so `good` is the class on which labellers rarely vote -1:
    kinds of bad text differ, and each is seen by few labellers.
    """
    n = np.maximum(counts.astype(float), 1e-9)
    post = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    hot = (patterns[:, :, None] == np.array([-1, 1])).astype(float)  # no vote says nothing
    for _ in range(rounds):
        weight = np.stack([(1 - post) * n, post * n], axis=1)
        prior = (weight[:, 1].sum() + 1) / (n.sum() + 2)
        table = np.einsum("pjv,pc->jcv", hot, weight) + 0.1
        table /= table.sum(axis=2, keepdims=True)
        log = np.einsum("pjv,jcv->pc", hot, np.log(table)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        moved = np.abs(new - post).max(initial=0)
        post = new
        if moved < 1e-9:
            break
    return float(prior), table, post


def train(rows: list[tuple[np.ndarray, float]], seed: int = 1) -> np.ndarray:
    """Weights of the hashed features, the last the bias: logistic regression on soft labels, each text a mean of its words'."""
    w = np.zeros((1 << HASH_BITS) + 1)
    square = np.full_like(w, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            f, y = rows[k]
            n = max(1, len(f))
            u, c = np.unique(f, return_counts=True)
            c = c * (8.0 / n)
            p = 1 / (1 + np.exp(-np.clip(w[u] @ c + w[-1], -50, 50)))
            g = (p - y) * c + DECAY * w[u]
            square[u] += g * g
            w[u] -= RATE * g / np.sqrt(square[u])
            square[-1] += (p - y) ** 2
            w[-1] -= RATE * (p - y) / np.sqrt(square[-1])
    return w


def classify(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, votes (array of -1, 0, 1 as in LABELLERS), weak_label (posterior of good), score (of
    the scorer, 0 to 1), keep (either is at least KEEP: what goes is bad by both).

    Only doc_id and text are read. A null text counts as empty, an empty one is voted on like any other;
    repeated rows get equal results, null ids too. If there are no rows the model knows nothing and the result is
    empty. The votes of all documents go into the estimate; the scorer learns from a sample of TRAIN_ROWS by hash of id and text.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")

    def vote(batches):
        hasher = WordHasher()
        for batch in batches:
            parts = [v for *_, v, _ in _blocks(batch.column(1), hasher)]
            v = np.concatenate(parts) if parts else np.zeros((0, len(LABELLERS)), np.int8)
            cols = [batch.column(0), pa.array(v.tolist(), pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "votes"])

    cast = StructType([docs.schema["doc_id"], StructField("votes", ArrayType(ByteType()))])
    seen = stored(docs.mapInArrow(tidy(vote), cast), "votes")
    counted = seen.groupBy("votes").count().toPandas()
    patterns = np.array(counted["votes"].tolist(), np.int8).reshape(-1, len(LABELLERS))
    _, table, post = estimate(patterns, counted["count"].to_numpy())
    n = max(1, int(counted["count"].sum()))

    # Rows are drawn by a hash of all they hold, so neither null nor repeated ids come in crowds; of rows that repeat one is drawn.
    key = F.xxhash64(F.lit(5), "doc_id", "text")
    sample = docs.withColumn("key_", key).where(F.abs(F.col("key_") / 2.0**63) < 1.2 * TRAIN_ROWS / n).where(F.octet_length("text") <= TRAIN_LONGEST)
    sample = sample.dropDuplicates(["key_"]).orderBy("key_").limit(TRAIN_ROWS).toPandas()
    known = {tuple(p): y for p, y in zip(patterns.tolist(), post.tolist())}
    rows = []
    for data, _, bounds, h, v, again in _blocks(pa.array(sample["text"].tolist(), pa.string()), WordHasher()):
        f = features(data, bounds, h, again)
        rows += [(f[a:b].ravel(), known.get(tuple(x), 0.5)) for a, b, x in zip(bounds[2][:-1], bounds[2][1:], v.tolist())]
    shared = spark.sparkContext.broadcast((train(rows), np.log(table) if len(table) else table, known))

    def score(batches):
        w, _, by = shared.value
        hasher = WordHasher()
        for batch in batches:
            out: list[list] = [[], [], []]
            for data, _, bounds, h, v, again in _blocks(batch.column(1), hasher):
                f = features(data, bounds, h, again)
                total = np.concatenate([[0], np.cumsum(w[f].sum(axis=1))])
                first = bounds[2]
                n = np.maximum(1, 3 * np.diff(first))
                z = 8 * (total[first[1:]] - total[first[:-1]]) / n + w[-1]
                out[0] += v.tolist()
                out[1] += [by.get(tuple(x), 0.5) for x in v.tolist()]
                out[2] += (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()
            types = [pa.list_(pa.int8()), pa.float64(), pa.float64()]
            keep = pa.array([max(y, s) >= KEEP for y, s in zip(*out[1:])], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, types)], keep], ["doc_id", "votes", "weak_label", "score", "keep"])

    fields = [StructField("weak_label", DoubleType()), StructField("score", DoubleType()), StructField("keep", BooleanType())]
    return docs.mapInArrow(tidy(score), StructType([*cast.fields, *fields]))
