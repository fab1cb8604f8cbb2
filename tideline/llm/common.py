"""What the operators share: stored intermediate tables, and word hashes of whole Arrow batches."""

from __future__ import annotations

import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- stored tables


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a machine's own folder serves executors of that machine
    only, so it is taken (and set) for a local master alone; a cluster has to set spark.checkpoint.dir."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: With this set, the shuffle files of a query go as soon as it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation.

    Nothing reads the shuffle files of the write any more, so they are deleted when it ends; a later step finds the disk free.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(FREE)
    spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A task of a hash join holds about so many rows of the smaller side at most; beyond that rows are sorted and merged, which can spill.
HASHED = 4_000_000


def hashed(df: DataFrame) -> DataFrame:
    """A stored, narrow table as the smaller side of a join with texts: hashed where a task's share of it is sure to fit, so that the
    texts needn't be sorted. Both ways give the same rows."""
    spark = df.sparkSession
    return df.hint("shuffle_hash") if df.count() <= HASHED * int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def free_name(name: str, *tables: DataFrame) -> str:
    """`name`, longer by underscores if a table has such a column, in any case of letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a long that tells its rows apart, the same in every scan (a row's file and its place in it), and that column's name.

    What isn't read straight from files is written first. The files' numbers are one row a file, which
    the driver's list of files holds already, so that table is broadcast.
    """
    name, file, place, number = (free_name(n, df) for n in ("row_", "file_", "place_", "number_"))
    where = [F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)]
    # Only below these do rows keep the place they have in their file.
    plain = {"Project", "Filter", "Relation", "SubqueryAlias", "View"}
    plan = df._jdf.queryExecution().analyzed().toString()
    at = df if set(re.findall(r"^[ :+-]*(\w+)", plan, re.M)) <= plain else stored(df, "rows")
    at = at.select("*", *where)
    files = sorted(r[0] for r in at.select(file).distinct().collect())
    files = df.sparkSession.createDataFrame([(f, k) for k, f in enumerate(files)], f"`{file}` string, `{number}` long")
    row = (F.shiftleft(number, 36) + F.col(place)).alias(name)
    return at.join(F.broadcast(files), file).select(*[F.col(f"`{c}`") for c in df.columns], row), name


# ---------------------------------------------------------------- memory of Python workers


def tidy(run):
    """run (batches to batches) that hands free memory back when its task ends: idle workers count in an executor's memory."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


def slices(batch: pa.RecordBatch, at: int, most: int):
    """A batch in runs of rows whose texts (column `at`) have about `most` bytes together."""
    _, offs = text_bytes(batch.column(at))
    for i, j in groups_of(np.diff(offs), most):
        yield batch.slice(i, j - i)


# ---------------------------------------------------------------- bytes and words

#: Word separators: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

PIECE = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one byte array, and n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (n + 1 of them)."""
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    begins, ends = solid.copy(), solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1] | first[1:-1]
        ends[:-1] &= ~solid[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offs)


#: Bytes of a word whose values are looked up; those further on are worked out.
NEAR = 64


def _value(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A 64-bit value for a byte at a place of its word, as if drawn at random."""
    at = place.astype(np.uint64) << np.uint64(8) | byte.astype(np.uint64)
    return mix(mix(at + np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03))


class WordHasher:
    """64-bit hashes of words, lower-cased in A-Z, for whole batches; a long text is worked off in pieces.

    A word's hash is the sum of the values of its bytes at their places. Two words that differ at some place differ by
    values that have nothing to do with each other, so no family of words collides, as with powers of one base.
    """

    def __init__(self) -> None:
        byte = np.arange(256, dtype=np.int64)
        self.table = _value(np.repeat(np.arange(NEAR), 256), LOWER[np.tile(byte, NEAR)])

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE)))
            a, b = int(starts[i]), int(ends[j - 1])
            s, e = starts[i:j] - a, ends[i:j] - a
            place = np.zeros(b - a, np.int64)
            place[s] = s
            place = np.arange(b - a) - np.maximum.accumulate(place)
            far = np.flatnonzero(place >= NEAR)
            value = self.table[np.minimum(place, NEAR - 1) << 8 | data[a:b]]
            if len(far):
                value[far] = _value(place[far], LOWER[data[a:b][far]])
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(value, out=sums[1:])
            out[i:j] = mix(sums[e] - sums[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            i = j
        return out


def groups_of(sizes: np.ndarray, most: int):
    """Runs [i, j) of neighbouring items whose sizes sum to about `most`; a larger item stands alone."""
    i, n = 0, len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
