"""Token files in canonical, length-limited Huffman code.

Counts of all ids give code lengths of at most LIMIT bits (package-merge); the code is canonical, so
the lengths are the whole code book. Documents are ordered by id over the whole input, and gathered
into blocks of about BLOCK ids. A block stores its documents' ids and lengths, its bits, and the bit
offset of every STEP-th id, so any block, and any stretch of one, decodes by itself: the stretches of a
block, and of several blocks, are decoded in lockstep with one lookup of LIMIT bits for each id.

Files are Parquet tables in the folder given: `book` (id, bits) and `blocks`.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stored, groups_of, slices, stored, tidy, work_dir
from .tokens import default_path, encoder

LIMIT = 18
BLOCK = 1 << 16
STEP = 256
END_ID = 1
#: Bytes of texts that are encoded at once.
SLICE = 2 << 20
#: Blocks that are compressed before they are handed on, and that are decoded in lockstep.
AT_ONCE = 16

# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for symbols with these counts (0: no code), by package-merge.

    Packages of a level are neighbours of the level before, merged with the symbols; how often a symbol
    is in the first 2n - 2 of the last level is its length. Only how many symbols each level's used part
    holds is kept.
    """
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit into codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    level, leaf = weight, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        leaf.append(at < n)
    take = 2 * n - 2
    for is_leaf in reversed(leaf):
        k = int(is_leaf[:take].sum())
        out[order[:k]] += 1
        take = 2 * (take - k)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words: by length, then symbol, counting upwards."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        if n := int(lengths[s]):
            code <<= n - before
            codes[s], before = code, n
            code += 1
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
    """The bits of ids, highest first, and the bit offset of every step-th id."""
    size = lengths[ids]
    ends = np.cumsum(size)
    begin = ends - size
    words = np.zeros((int(ends[-1]) if len(ends) else 0) // 32 + 3, np.uint64)
    shift = (64 - (begin & 31) - size).astype(np.uint64)  # a code has at most 32 bits and begins in a word's first half
    value = codes[ids] << shift
    at = begin >> 5
    # Codes that begin in the same 32 bits don't overlap, so their sum is their union.
    for part, k in ((value >> np.uint64(32), 0), (value & np.uint64(0xFFFFFFFF), 1)):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        if len(first):
            words[at[first] + k] += np.add.reduceat(part, first)
    return words.astype(">u4").tobytes(), begin[::step].astype(np.int64)


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For every `limit` bits the symbol they begin with, times 256, and its length."""
    codes = canonical(lengths)
    table = np.ones(1 << limit, np.int64)
    used = np.lexsort((np.arange(len(lengths)), lengths))
    used = used[lengths[used] > 0]
    room = np.int64(1) << (limit - lengths[used])
    table[: int(room.sum())] = np.repeat(used << 8 | lengths[used], room)
    assert not len(used) or int(codes[used[0]]) == 0
    return table


def unpack_bits(bits: list, marks: list[np.ndarray], sizes: list[int], table: np.ndarray, limit: int = LIMIT, step: int = STEP) -> list[np.ndarray]:
    """The ids of blocks, so many (`sizes`) of each; the stretches of all blocks are decoded in lockstep.

    A block's last stretch is decoded beyond its end, into the next block or the padding, and cut.
    """
    words = np.frombuffer(b"".join([*bits, bytes(4 * (step * limit // 32 + 3))]), ">u4").astype(np.uint64)
    wide = words[:-1] << np.uint64(32) | words[1:]
    begin = 8 * np.cumsum([0, *map(len, bits)])
    at = np.concatenate([np.zeros(0, np.int64), *[m + o for m, o in zip(marks, begin.tolist())]])
    out = np.zeros((step, len(at)), np.int32)
    for t in range(min(step, max(sizes, default=0))):
        window = wide.take(at >> 5)
        window <<= (at & 31).view(np.uint64)
        window >>= np.uint64(64 - limit)
        entry = table.take(window.view(np.int64))
        out[t] = entry >> 8
        at += entry & 255
    ids, first = out.T.reshape(-1), step * np.cumsum([0, *map(len, marks)])
    return [ids[i : i + n] for i, n in zip(first.tolist(), sizes)]


# ---------------------------------------------------------------- files


def encoded(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Blocks (part, block, doc_ids, sizes, ids): documents in ascending order of doc_id, nulls first, over parts."""
    path = path or default_path()

    def run(batches):
        from pyspark import TaskContext

        part, encode, end = TaskContext.get().partitionId(), encoder(path).encode, int(end_id).to_bytes(4, "little")
        block, docs_, sizes, chunks, total = 0, [], [], [], 0

        def flush():
            arrays = [pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([docs_], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(chunks)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["part", "block", "doc_ids", "sizes", "ids"])

        for batch in batches:
            for some in slices(batch, 1, SLICE):
                for doc, ids in zip(some.column(0).to_pylist(), encode(some.column(1))):
                    docs_.append(doc)
                    sizes.append(len(ids) + 1)
                    chunks += (ids.tobytes(), end)
                    total += sizes[-1]
                    if total >= BLOCK:
                        yield flush()
                        block, docs_, sizes, chunks, total = block + 1, [], [], [], 0
        if docs_:
            yield flush()

    # Where one id, or one text of it, has very many rows, ranges cut through them; the beginning of a text orders as the text does.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 64), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(tidy(run), "part long, block long, doc_ids array<bigint>, sizes array<bigint>, ids binary")


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text and write the token files.

    A document is its ids and end_id; a null text counts as empty. Order is by doc_id, nulls first, equal
    ones by text. Repeated rows are written again. Other columns are ignored. An empty table gives
    files without rows. Ids are counted over all documents; a task sends one row for each id it met.
    """
    spark = docs.sparkSession
    blocks = stored(encoded(docs, path, end_id), "ids")

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                c = np.bincount(np.frombuffer(ids.as_buffer(), "<u4"))
                total = np.pad(total, (0, max(0, len(c) - len(total))))
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    # One row for each id of the vocabulary, so the table is small whatever the input.
    counted = blocks.select("ids").mapInArrow(tidy(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"]] = counted["n"]
    lengths = code_lengths(counts)
    book = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def compress(batches):
        lens, codes = book.value
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(k, AT_ONCE)
                rows = [pack_bits(np.frombuffer(ids.as_buffer(), "<u4").astype(np.int64), lens, codes) for ids in some.column(4)]
                cols = [*some.columns[:4], pa.array([b for b, _ in rows], pa.binary()), pa.array([m for _, m in rows], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["part", "block", "doc_ids", "sizes", "bits", "marks"])

    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in used], "id long, bits long").coalesce(1).write.parquet(f"{folder}/book")
    blocks.mapInArrow(tidy(compress), "part long, block long, doc_ids array<bigint>, sizes array<bigint>, bits binary, marks array<bigint>").write.parquet(f"{folder}/blocks")
    drop_stored(blocks)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, decoded from the files; ids are packed 32-bit integers."""
    rows = spark.read.schema("id long, bits long").parquet(f"{folder}/book").toPandas()
    lengths = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    lengths[rows["id"]] = rows["bits"]
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema("part long, block long, doc_ids array<bigint>, sizes array<bigint>, bits binary, marks array<bigint>").parquet(f"{folder}/blocks")
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = blocks.select("part", "block", size.alias("n"))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    before = lambda *o: Window.orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part").select("part", "block", (F.col("own") + F.col("base")).alias("begin"))

    def decode(batches):
        table = decode_table(shared.value)
        for batch in batches:
            sizes = [x.values.to_numpy() for x in batch.column(3)]
            totals = np.array([x.sum() for x in sizes], np.int64)
            for i, j in groups_of(totals, AT_ONCE * BLOCK):
                bits, marks = ([x.as_buffer() for x in batch.column(4)[i:j]], [x.values.to_numpy() for x in batch.column(5)[i:j]])
                for k, ids in zip(range(i, j), unpack_bits(bits, marks, totals[i:j].tolist(), table)):
                    part, block, docs = (batch.column(c)[k] for c in range(3))
                    ids, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes[k])
                    own = [ids[4 * a : 4 * b] for a, b in zip((ends - sizes[k]).tolist(), ends.tolist())]
                    n = len(own)
                    cols = [pa.array([part.as_py()] * n, pa.int64()), pa.array([block.as_py()] * n, pa.int64()), docs.values, pa.array(ends - sizes[k]), pa.array(sizes[k]), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    cols += [pa.array(own, pa.binary())] * with_ids
                    yield pa.RecordBatch.from_arrays(cols, ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    rows = blocks.mapInArrow(tidy(decode), "part long, block long, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return rows.join(begins, ["part", "block"]).select("doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the files to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    folder = f"{work_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, path)
    return read(docs.sparkSession, folder, with_ids=False)
