"""Personal data: four kinds by pattern, secrets by a linear-chain conditional random field.

The field labels the words of a text O, K (names a secret: `token`, `=`) or S (is one) from the shapes
of a word and its neighbours. It is trained on the driver from a small labelled table, and decoded
by Viterbi for whole batches at once. A word whose O outweighs every other label by more than two
transitions can gain is O on the best path whatever stands beside it; such words cut a batch into
short independent segments, which are decoded in lockstep. That is exact, for texts of any length.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import LOWER, slices, text_bytes, tidy, word_bounds

KINDS = ("email", "ip", "card", "phone", "secret")
#: The last kind is the field's, the others are the patterns'.
BASE_KINDS = KINDS[:-1]
BLOCK = 1 << 20
LABELS = 3  # O, K, S

# ---------------------------------------------------------------- patterns
# Possessive repeats and look-behinds only keep a search from starting again inside a run; they match
# what the plain patterns match. All are ASCII, so they work on UTF-8 bytes.

_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(rb"[0-9]")


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def patterns(data: bytes, a: int, b: int):
    """(kind, start, end) in bytes of the matches in data[a:b], by kind and start."""
    at, low = data.find(b"@", a, b), a
    while at >= 0:
        run = data[low:at]
        local = len(run) - len(run.rstrip(_LOCAL))
        if local and (m := _DOMAIN.match(data, at, b)):
            yield 0, at - local, m.end()
            low = m.end()
        else:
            low = at + 1
        at = data.find(b"@", at + 1, b) if low <= at + 1 else data.find(b"@", low, b)
    # Searches end at b; look-behinds may see the text before a, so each text stands after a separator.
    for m in _IP.finditer(data, a, b):
        if all(len(x.lstrip(b"0")) < 4 and int(x[-3:]) < 256 for x in m[0].split(b".")):
            yield 1, m.start(), m.end()
    for m in _CARD.finditer(data, a, b):
        if m.end() - m.start() <= 37:
            digits = b"".join(_DIGIT.findall(m[0]))
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield 2, m.start(), m.end()
    for m in _PHONE.finditer(data, a, b):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield 3, m.start(), m.end()


# ---------------------------------------------------------------- word shapes

#: Words that announce a secret.
KEYS = ("token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "key", "access_key", "auth", "credential")
_BINS = (1, 2, 4, 8, 14, 24)
_CLASSES = ("upper", "lower", "digit", "equals", "quote", "mark", "wide")
N_SHAPES = len(_BINS) + 12


def _class_table() -> np.ndarray:
    t = np.full(256, 5, np.uint8)
    t[65:91], t[97:123], t[48:58], t[128:] = 0, 1, 2, 6
    t[ord("=")], t[ord(":")] = 3, 3
    t[ord('"')], t[ord("'")] = 4, 4
    return t


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Shape features of words as bits of an integer."""
    size = ends - starts
    if not len(starts):
        return np.zeros(0, np.int64)
    kinds = _class_table()[data]
    out = np.zeros(len(starts), np.int64)
    for k, least in enumerate(_BINS):
        out |= (size >= least).astype(np.int64) << k
    n = len(_BINS)
    counts = []
    for k in range(len(_CLASSES)):
        sums = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)])
        counts.append(sums[ends] - sums[starts])
    upper, lower, digit, equals, quote, mark, wide = counts
    bits = [
        upper > 1, lower > 0, digit > 0, equals > 0, quote > 0, mark > 0, wide > 0,
        digit * 5 >= size, (upper > 2) & (digit > 0) & (lower == 0), (size == 1) & (equals == 1), (digit > 3) & (lower > 0) & (mark == 0),
    ]
    for k, bit in enumerate(bits):
        out |= bit.astype(np.int64) << (n + k)
    # The last bit: the word begins with one of KEYS, up to its end or to a mark.
    low = LOWER[data]
    for key in KEYS:
        k = np.frombuffer(key.encode(), np.uint8)
        at = np.flatnonzero(size >= len(k))
        for i, c in enumerate(k):
            at = at[low[starts[at] + i] == c]
            if not len(at):
                break
        if len(at):
            nxt = starts[at] + len(k)
            done = (size[at] == len(k)) | np.isin(kinds[np.minimum(nxt, len(data) - 1)], (3, 4, 5))
            out[at[done]] |= 1 << (n + 11)
    return out


# ---------------------------------------------------------------- the field


def labelled_table(rows: int = 600, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """The labelled table: short word sequences with secrets of usual forms, and what only looks like one."""
    r = random.Random(seed)
    letters, hexs = "abcdefghijklmnopqrstuvwxyzäéñç", "0123456789abcdef"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 11)))
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def secret():
        key = r.choice(KEYS)
        if r.random() < 0.2:
            key = key.upper()
        value = r.choice([some(hexs, 16, 40), some(hexs + upper, 16, 40), some(upper + "0123456789", 16, 24), some(letters[:26] + upper + "0123456789", 14, 40)])
        value = value[:3] + r.choice("0123456789") + value[3:] + r.choice("0123456789")
        quote = r.choice(["", '"', "'"])
        form = r.randrange(4)
        if form == 0:
            return [(f"{key}{r.choice('=:')}{quote}{value}{quote}", 2)]
        if form == 1:
            return [(key, 1), (r.choice(["=", ":"]), 1), (f"{quote}{value}{quote}", 2)]
        if form == 2:
            return [(key + r.choice("=:"), 1), (f"{quote}{value}{quote}", 2)]
        return [(r.choice(["AKIA", "ASIA", "GHP", "SK"]) + some(upper + "0123456789", 16, 18).replace("A", "7", 1), 2)]

    def other():
        n = r.randrange(12)
        if n < 3:
            return word().capitalize() + r.choice(["", ".", ",", "!!"])
        if n == 3:
            return word().upper() + r.choice(["", "!!"])
        if n == 4:
            return word() + r.choice(["***", "%%%", "&&&", "###", "$$$", ",***"])
        if n == 5:
            return r.choice(["|", "=", "-", "*", "=="])
        if n == 6:
            return r.choice([some("0123456789", 1, 20), f"{r.randint(1, 300)}.{r.randint(1, 300)}.7.9", f"+{r.randint(1, 99)}", "(555)", f"{r.randint(100, 999)}-{r.randint(1000, 9999)}", "20%", "3.14", "2024-05-01", "v2.0.1"])
        if n == 7:
            return r.choice([f"{word()}.{r.randint(10, 99)}@mail{r.randint(1, 9)}.example.com", f"https://{word()}.org/{word()}?id={r.randint(1, 999)}", "CC", "BY-NC", "4.0.", "GNU", "MIT", "Apache-2.0"])
        if n == 8:
            return r.choice([*KEYS, "Key", "tokens", "keys", "secretly"])
        if n == 9:
            return word() + word() + word()
        return word()

    table = []
    for _ in range(rows):
        words = [(other() if r.random() < 0.6 else word(), 0) for _ in range(r.randint(3, 12))]
        if r.random() < 0.6:
            k = r.randint(0, len(words))
            words[k:k] = secret()
        table.append(([w for w, _ in words], [y for _, y in words]))
    return table


def _features(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([(codes[:, None] >> np.arange(N_SHAPES)) & 1, np.ones((len(codes), 1), np.int64)], axis=1).astype(float)


@functools.cache
def trained(steps: int = 400, rate: float = 0.15, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (place -1, 0, +1 of a word; feature; label) and transitions, by gradient ascent of the conditional likelihood."""
    table = labelled_table()
    n, t = len(table), max(len(w) for w, _ in table)
    x = np.zeros((n, t + 2, N_SHAPES + 1))
    y, there = np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (words, labels) in enumerate(table):
        text = " ".join(words).encode()
        data = np.frombuffer(text, np.uint8)
        s, e, _ = word_bounds(data, np.array([0, len(data)]))
        x[i, 1 : len(words) + 1] = _features(shapes(data, s, e))
        y[i, : len(words)], there[i, : len(words)] = labels, True
    hot = np.eye(LABELS)
    gold, gold_t = hot[y] * there[..., None], (hot[y[:, :-1], :][..., None] * hot[y[:, 1:], :][:, :, None, :] * there[:, 1:, None, None]).sum((0, 1))
    w, trans = np.zeros((3, N_SHAPES + 1, LABELS)), np.zeros((LABELS, LABELS))
    mean, square = [0.0, 0.0], [0.0, 0.0]
    lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)) .squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    for step in range(1, steps + 1):
        em = sum(x[:, k : k + t] @ w[k] for k in range(3))
        fw, bw = np.zeros_like(em), np.zeros_like(em)
        fw[:, 0] = em[:, 0]
        for k in range(1, t):
            fw[:, k] = np.where(there[:, k, None], em[:, k] + lse(fw[:, k - 1, :, None] + trans, 1), fw[:, k - 1])
        for k in range(t - 2, -1, -1):
            bw[:, k] = np.where(there[:, k + 1, None], lse(trans + (em[:, k + 1] + bw[:, k + 1])[:, None, :], 2), 0)
        z = lse(fw[:, -1], 1)
        p = np.exp(fw + bw - z[:, None, None]) * there[..., None]
        pair = fw[:, :-1, :, None] + trans + (em[:, 1:] + bw[:, 1:])[:, :, None, :] - z[:, None, None, None]
        pair = (np.exp(np.minimum(pair, 0)) * there[:, 1:, None, None]).sum((0, 1))
        grads = [np.stack([np.einsum("ntf,ntl->fl", x[:, k : k + t], gold - p) for k in range(3)]) / n - decay * w, (gold_t - pair) / n - decay * trans]
        for k, (g, v) in enumerate(zip(grads, (w, trans))):
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            v += rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8) * (1 - step / (steps + 1))
    return w, trans


def viterbi(em: np.ndarray, trans: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best labels of independent segments (rows begin[i] : begin[i] + size[i] of em), all in lockstep."""
    out = np.zeros(len(em), np.int8)
    if not len(begin):
        return out
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    still = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    back = np.zeros(em.shape, np.int8)
    score = em[begin].copy()
    for t in range(1, size[0]):
        n = still[t]
        paths = score[:n, :, None] + trans
        back[begin[:n] + t] = paths.argmax(axis=1)
        score[:n] = paths.max(axis=1) + em[begin[:n] + t]
    label = score.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        n = still[t]
        out[begin[:n] + t] = label[:n]
        label[:n] = back[begin[:n] + t, label[:n]]
    return out


def decode(codes: np.ndarray, first: np.ndarray, w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Labels of all words; first: index of each text's first word, and the number of words."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int8)
    kinds, which = np.unique(codes, return_inverse=True)
    f = _features(kinds)
    here, prev, nxt = f @ w[1], f @ w[0], f @ w[2]
    em = here[which]
    head = np.zeros(n + 1, bool)
    head[first] = True
    inner = ~head[1:n]  # word i + 1 has word i before it in its text
    em[1:][inner] += prev[which[:-1][inner]]
    em[:-1][inner] += nxt[which[1:][inner]]
    gain = 2 * (trans.max() - trans.min())
    open_ = em[:, 0] - em[:, 1:].max(axis=1) < gain
    # A word beside an open one stands in its segment as O, as its transition counts; the rest are O.
    edge = open_.copy()
    edge[:-1] |= open_[1:] & inner
    edge[1:] |= open_[:-1] & inner
    em[edge & ~open_, 1:] = -1e9
    begins = edge.copy()
    begins[1:] &= ~(edge[:-1] & inner)
    begin = np.flatnonzero(begins)
    stops = edge.copy()
    stops[:-1] &= ~(edge[1:] & inner)
    return viterbi(em, trans, begin, np.flatnonzero(stops) + 1 - begin)


_STRIP = b"\"'`.,;:!?()[]{}<>*%&#$"


def spans_of(data: np.ndarray, offs: np.ndarray, model) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (kind, start, end) in code points, by kind and start."""
    starts, ends, first = word_bounds(data, offs)
    raw = data.tobytes()
    labels = decode(shapes(data, starts, ends), first, *model)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    some = np.concatenate([[0], np.cumsum((data == 64) | ((data >= 48) & (data < 58)))])
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
    for i in np.flatnonzero(some[offs[1:]] > some[offs[:-1]]).tolist():
        a, b = int(offs[i]), int(offs[i + 1])
        text = raw[a:b]
        out[i] = [(k, int(points[a + s] - points[a]), int(points[a + e] - points[a])) for k, s, e in patterns(text, 0, len(text))]
    for k in np.flatnonzero(labels == 2).tolist():
        i = int(np.searchsorted(first, k, side="right")) - 1
        s, e = int(starts[k]), int(ends[k])
        word = raw[s:e]
        cut = max(word.rfind(b"="), word.rfind(b":")) + 1
        if cut and word[cut:].strip(_STRIP):
            s += cut
        s += len(raw[s:e]) - len(raw[s:e].lstrip(_STRIP))
        e -= len(raw[s:e]) - len(raw[s:e].rstrip(_STRIP))
        if s < e:
            a = points[offs[i]]
            out[i].append((len(BASE_KINDS), int(points[s] - a), int(points[e] - a)))
    return out


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _with_arrow(docs: DataFrame, make, field: StructField | None = None) -> DataFrame:
    """docs with what make(texts, spans) gives: a new last column `field`, or else in place of the texts."""
    docs = docs.drop(field.name) if field else docs
    at, model = docs.columns.index("text"), trained()

    def run(batches):
        for batch in batches:
            for part in slices(batch, at, BLOCK):
                texts = part.column(at)
                new = make(texts, spans_of(*text_bytes(texts), model))
                if field:
                    cols, names = [*part.columns, new], [*part.schema.names, field.name]
                else:
                    cols, names = [*part.columns[:at], new, *part.columns[at + 1 :]], part.schema.names
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, *([field] if field else [])]))


def find(docs: DataFrame) -> DataFrame:
    """docs with `pii`, an array of (kind, start, end): code points, end exclusive, by kind as in KINDS and start.

    Every whole text is searched. Patterns of one kind don't overlap; spans of different kinds may, and
    all stay. A null or empty text has an empty array. Repeated rows get equal arrays; ids aren't read.
    A column `pii` that docs brings is replaced. An empty table stays empty.
    """
    make = lambda _, found: pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in f] for f in found], SPANS_ARROW)
    return _with_arrow(docs, make, StructField("pii", SPANS))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span, and each run of overlapping spans, replaced by its first kind in capitals: [EMAIL].

    Everything else of a text stays as it is; a null text stays null.
    """

    def make(column, found):
        out = []
        for k, spans in enumerate(found):
            if spans:
                text = column[k].as_py()
                parts, at = [], 0
                for s, e, kind in sorted((s, e, kind) for kind, s, e in spans):
                    if s >= at:
                        parts += [text[at:s], f"[{KINDS[kind].upper()}]"]
                    at = max(at, e)
                out.append("".join([*parts, text[at:]]))
        return pc.replace_with_mask(column, pa.array([bool(f) for f in found], pa.bool_()), pa.array(out, column.type))

    return _with_arrow(docs, make)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: find()'s spans as counts, a digest and text."""
    found = find(docs.select("doc_id", "text"))
    text = lambda keep: F.array_join(F.transform(F.filter("pii", keep), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(text(lambda s: s["kind"] != KINDS[-1]), 256).alias("base_sha256"), text(lambda s: F.lit(True)).alias("spans"), count(KINDS[-1])
    )
