"""Language identification by cross-parsing entropy.

For each language a suffix automaton of its labelled text is built. A text is parsed from left
to right into the longest phrases that occur in that text, one automaton step per character;
the language that needs the fewest phrases, normalised by log2 of its training length and the
text's own length (bits per character), wins.

The edges of all automata are stored in one array, whose size follows the training text and not the
number of letters, of which none are merged; where a state has no edge, a new phrase begins with
that character. Languages are parsed in step, with one look-up for each character and language. Texts are parsed in blocks of BLOCK characters, thousands
of blocks of all lengths at a time; a phrase never crosses a block's end, so memory is bounded for
texts of any length and results don't depend on batches.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import slices, tidy

#: Labelled rows and characters per language that training reads at most, and characters of one row.
TRAIN_ROWS, TRAIN_CHARS, TRAIN_LONGEST = 400, 40_000, 20_000
BLOCK = 2048
SLICE = 2 << 20
#: Languages in which texts are parsed at a time.
AT_ONCE = 16
#: A text whose best language needs more bits per character than this is in none of them.
MOST_BITS = 6.0
#: Shorter texts have too few phrases for that: of these only characters count that a language's training text lacks.
SHORT = 128
#: A language with fewer characters of labelled text (a run of non-letters is one) isn't learned: a phrase would cost
#: no more than MOST_BITS, so that its model took every text.
LEAST_CHARS = 65


def classes(training: dict[str, str]) -> np.ndarray:
    """Code of each code point: 0 for what isn't a letter, 1 for letters not in the training text, own ones for all others."""
    from collections import Counter

    count: Counter = Counter()
    for text in training.values():
        count.update(c for c in text.lower() if c.isalpha())
    code = np.zeros(0x110000, np.min_scalar_type(len(count) + 1))
    code[[k for k in range(0x110000) if chr(k).isalpha()]] = 1
    for k, (c, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))):
        code[ord(c)] = k + 2
    return code


def encode(text: str, code: np.ndarray) -> np.ndarray:
    """Codes of a text's lower-cased characters; a run of non-letters is one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = code[points]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def placed(edges: list[dict[int, int]], width: int) -> np.ndarray:
    """A number above 0 for each state, all different, so that no two edges have one sum of their state's number and their character."""
    number = np.zeros(len(edges), np.int64)
    filled, named = bytearray(width), bytearray(b"\1") + bytearray(width - 1)
    at, many = 0, 3
    for p in sorted(range(len(edges)), key=lambda p: -len(edges[p])):
        own = list(edges[p])
        if len(own) < many:  # states of two edges, then those of one, fill what gaps the others left
            at, many = 0, len(own)
        while named[at] or any(filled[at + c] for c in own):
            at += 1
            if at + width > len(filled):
                filled += bytes(at + width)
                named += bytes(at + width)
        number[p], named[at] = at, 1
        for c in own:
            filled[at + c] = 1
    return number


#: The lower half of an entry of Edges.
HALF = (1 << 32) - 1


class Edges:
    """The edges of one suffix automaton a language in one array, by row displacement.

    A state's number is its row's place: its edge for c is at state + c, and has that state in its upper half and the next one in the
    lower. No two states have one number, so an entry tells whose it is. `fresh` has for each automaton the state after a new
    phrase begins with c: that of the first character, or `begin`, which has no edges, where the training text lacks c; texts start there too.
    """

    def __init__(self, automata: Iterable[list[dict[int, int]]], width: int) -> None:
        self.begin, size, parts, fresh = 0, 0, [], []
        for edges in automata:
            number = placed(edges, width)
            at = number[[p for p, known in enumerate(edges) for _ in known]] + size
            to = number[[q for known in edges for q in known.values()]] + size
            part = np.full(int(number.max()) + width, -1, np.int64)
            part[at - size + np.array([c for known in edges for c in known], np.int64)] = at << 32 | to
            first = np.full(width, self.begin, np.int64)
            for c, q in edges[0].items():
                first[c] = number[q] + size
            parts.append(part)
            fresh.append(first)
            size += len(part)
        self.edge = np.concatenate([np.full(width, -1, np.int64), *parts][bool(parts) :])
        self.fresh = np.array(fresh, np.int64).reshape(-1, width)

    def step(self, state: np.ndarray, c: np.ndarray, some: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Next states of some automata (a row each), and where a new phrase begins."""
        edge = self.edge.take(state + c)
        new = (edge >> 32) != state
        edge &= HALF
        np.copyto(edge, self.fresh[some].take(c, axis=1), where=new)
        return edge, new


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """The suffix automaton of a text: each state's edges, from the first state on."""
    edges, link, length = [{}], [-1], [0]
    last = 0
    for c in codes.tolist():
        cur = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
        last = cur
    return edges


class Model:
    """Languages, their automata and the log2 of their training lengths. With `even`, texts are cut to the shortest; fit() leaves them whole."""

    def __init__(self, training: dict[str, str], even: bool = True) -> None:
        self.languages = sorted(training)
        self.code = classes(training)
        codes = [encode(training[k], self.code) for k in self.languages]
        if even:
            least = min((len(c) for c in codes), default=0)
            codes = [c[: max(least, 1)] for c in codes]
        width = int(self.code.max()) + 1
        self.edges = Edges((automaton(c) for c in codes), width)
        self.known = np.zeros((len(codes), width), bool)
        for k, c in enumerate(codes):
            self.known[k, c] = True
        self.known[:, 0] = True
        self.bits = np.array([np.log2(max(2, len(c))) for c in codes])

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each text in each language."""
        lengths = np.array([len(c) for c in coded], np.int64)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(coded)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        size = np.minimum(lengths[owner] - nth * BLOCK, BLOCK)
        begin = (np.cumsum(lengths) - lengths)[owner] + nth * BLOCK
        order = np.argsort(-size, kind="stable")
        owner, size, begin = owner[order], size[order], begin[order]
        flat = np.concatenate(coded).astype(np.int64) if len(coded) else np.zeros(0, np.int64)
        still = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        out = np.zeros((len(coded), len(self.languages)))
        for k in range(0, len(self.languages), AT_ONCE):
            some = slice(k, k + AT_ONCE)
            state = np.full((len(self.languages[some]), len(size)), self.edges.begin, np.int64)
            count = np.zeros(state.shape, np.int64)
            for t, n in enumerate(still.tolist()):
                state, new = self.edges.step(state[:, :n], flat[begin[:n] + t], some)
                count[:, :n] += new
            np.add.at(out[:, some], owner, count.T)
        return out

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (index, -1 for none), score and bits per character of each text (see SHORT)."""
        best, score, least = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.languages:
            return best, score, least
        coded = [encode(t or "", self.code) for t in texts]
        able = [i for i, c in enumerate(coded) if (c > 0).any() or any(map(str.isalpha, texts[i] or ""))]
        for i, j in _slices([len(coded[i]) for i in able]):
            own = able[i:j]
            bits = self.phrases([coded[k] for k in own]) * self.bits
            n = np.array([len(coded[k]) for k in own])
            best[own] = np.argmin(bits, axis=1)
            low = bits.min(axis=1)
            # Weight of the best among all, by how many more bits the others need.
            score[own] = 1 / np.exp2(-np.minimum(bits - low[:, None], 1000) / 4).sum(axis=1)
            for k in np.flatnonzero(n < SHORT).tolist():
                low[k] = ((~self.known[:, coded[own[k]]]).sum(axis=1) * self.bits).min()
            least[own] = low / n
        return best, score, least


def _slices(sizes: list[int]):
    i = total = 0
    for j, n in enumerate(sizes):
        if total and total + n > SLICE:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


def bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; bucket 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def _size(text: str) -> int:
    """Characters of a text but that a run of non-letters is one, and none at the ends."""
    return len(" ".join("".join(c if c.isalpha() else " " for c in text).split()))


def fit(labelled: DataFrame) -> Model:
    """Learn from rows (doc_id, text, lang). Of each language about TRAIN_ROWS different rows are read, those of least hash of id and text, of each
    the first TRAIN_LONGEST characters, and TRAIN_CHARS characters in all. Only languages of less than LEAST_CHARS are left out."""
    labelled = labelled.where("lang is not null and text is not null").select("lang", F.substring("text", 1, TRAIN_LONGEST).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    count = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    # One row for each language, of each of which the model is to hold a whole automaton.
    rows = labelled.join(F.broadcast(count), "lang").where(F.abs(F.col("h") / 2.0**63) < F.lit(TRAIN_ROWS) / F.col("n")).dropDuplicates(["lang", "h"])
    before = Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    rows = rows.where(F.col("before") < TRAIN_CHARS).select("lang", "text", "h").toPandas().sort_values("h")
    training = {k: "\n".join(g["text"])[:TRAIN_CHARS] for k, g in rows.groupby("lang")}
    return Model({k: t for k, t in training.items() if _size(t) >= LEAST_CHARS}, even=False)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred string, score double (0 to 1) and lang_bits double (bits per character) added.

    Only `text` is read. A text that is null or without any letter gets `und`, score 0; so does every
    text if the model has learned nothing. Ties go to the smaller language code. Rows stay as they are,
    repeated ones and null ids too; columns of the new names are replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    new = ["lang_pred", "score", "lang_bits"]
    docs = docs.drop(*new)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch, at, SLICE):
                best, score, bits = m.predict(part.column(at).to_pylist())
                names = np.array([*m.languages, "und"], object)[best]
                cols = [pa.array(names, pa.string()), pa.array(score), pa.array(bits)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, *new])

    schema = StructType([*docs.schema.fields, StructField(new[0], StringType()), *(StructField(k, DoubleType()) for k in new[1:])])
    return docs.mapInArrow(tidy(run), schema)


def detect_languages(docs: DataFrame) -> DataFrame:
    """identify() with a model of all rows outside the held-out bucket: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~F.coalesce(bucket(F.col("doc_id")) == 2, F.lit(False))))
    held = F.coalesce(bucket(F.col("doc_id")) == 2, F.lit(False))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "lang_bits")
