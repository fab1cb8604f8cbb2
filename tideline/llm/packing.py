"""Best-fit packing of token sequences, bulk-synchronous.

Documents are cut into pieces of at most LENGTH tokens. Pieces are ranked within their length and open sequences within
the size of their gap, over all data. A round takes the pieces that are longer than PART of the longest that waits, sorts the runs
of equal pieces and of equal gaps by size and sweeps from large to small: each run of pieces goes to its successor gap, the smallest that is left and holds them. Where pieces compete for a gap, those of
lower rank get it, as many as it holds, and the others go to the next larger one; what finds none waits. Every open sequence then
finds by its rank what it takes, and its gap shrinks. At the end of a round the longest pieces that took part and found nothing open new sequences, SHARE as
many as all of those would fill, and the next round begins; when nothing waits, each piece fetches its place by
length and rank. Only the runs, at most two for each size whatever the input, meet in one place: the driver sweeps them.
"""

from __future__ import annotations

import math
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import free_name, stored, tidy, work_dir
from .tokens import default_path, encoder

LENGTH = 2048
END_ID = 0
#: Pieces take part in a round from this share of the longest on, and open so many sequences of those that they would fill: more of the
#: first and less of the second make more rounds and fuller sequences.
PART, SHARE = 0.7, 0.9
#: Ranks are counted in so many buckets of rows at least; so many sequences are opened by one row.
BUCKETS, STRIDE = 64, 1 << 16
ROWS = 2048


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids: packed little-endian 32-bit integers]) of every whole text.

    A document is its ids and end_id; only one longer than `length` is cut. A null text counts as empty
    and gives the end id alone. Rows that repeat give their pieces again. Columns besides doc_id and text are ignored.
    """
    path = path or default_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches):
        encode, end = encoder(path).encode, int(end_id).to_bytes(4, "little")
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1))):
                    ids = ids.tobytes() + end
                    for p, a in enumerate(range(0, len(ids), 4 * length)):
                        cut = ids[a : a + 4 * length]
                        rows.append((doc, p, a // 4, len(cut) // 4, zlib.crc32(cut), *([cut] if with_ids else [])))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = [StructField(n, t) for n, t in zip(names, [LongType(), IntegerType(), LongType(), LongType(), LongType(), BinaryType()])]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), StructType(schema))


def sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int]], opened: int = 0, length: int = LENGTH, part: float = PART, share: float = SHARE) -> list[tuple]:
    """One round over runs: pieces (length, first rank, how many) and gaps (size, how many, ranked from 0).

    Rows (kind, length, rank, gap, at, many, each): `match`: the pieces from that rank on go to `many` gaps of that size, ranked from `at`, so many
    pieces to each; `open`: to new sequences numbered from `at`; `wait`: so many pieces (each) wait for the next round.
    """
    least = part * max((size for size, _, _ in pieces), default=0)
    by = {size: (first, n) for size, first, n in pieces if size > least}
    held, out, wait = dict(gaps), [], []
    stack: list[list[int]] = []  # gaps passed so far: size, first rank that is free, how many are
    for size in sorted({*by, *held}, reverse=True):
        if held.get(size):
            stack.append([size, 0, held[size]])
        rank, left = by.get(size, (0, 0))
        while left and stack:
            gap, at, n = stack[-1]
            most = gap // size
            full = min(n, left // most)
            if full:
                out.append(("match", size, rank, gap, at, full, most))
            else:  # fewer than one gap takes
                full, most = 1, left
                out.append(("match", size, rank, gap, at, 1, left))
            rank, left = rank + full * most, left - full * most
            stack[-1] = [gap, at + full, n - full]
            if full == n:
                stack.pop()
        if left:
            wait.append((size, rank, left))
    total = sum(size * n for size, _, n in wait)
    # Longer ones than half a sequence share none, so all of them may open theirs.
    room = max(math.ceil(share * total / length), sum(n for size, _, n in wait if 2 * size > length))
    for size, rank, left in wait:
        while left and room:
            most = length // size
            n, each = (min(room, left // most), most) if left >= most else (1, left)
            out.append(("open", size, rank, length, opened, n, each))
            opened, room, rank, left = opened + n, room - n, rank + n * each, left - n * each
        if left:
            out.append(("wait", size, rank, 0, 0, 0, left))
    return out + [("wait", size, rank, 0, 0, 0, n) for size, rank, n in pieces if size <= least]


ROUND = "length int, rank long, gap int, at long, many long, each long"


def _ranked(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df with `name`, the rank from 0 among rows of one key. A key may hold a third of all rows: ranks are counted within buckets, and
    buckets within keys."""
    n = max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket, base, count = (free_name(x, df) for x in ("bucket_", "base_", "count_"))
    salted = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = salted.groupBy(key, bucket).agg(F.count("*").alias(count))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, bucket, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    nth = F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order))
    out = salted.withColumn(name, nth).join(counts, [key, bucket])
    return out.select(*df.columns, (F.col(name) - 1 + F.col(base)).cast("long").alias(name))


def _many(rows: DataFrame, most: int, name: str) -> DataFrame:
    """rows as often as their `many` says, at most `most`, numbered by `name` from 0; in two steps where a row would become more than STRIDE at once."""
    zero, n = F.lit(0).cast("long"), F.col("many")
    if most <= STRIDE:
        return rows.withColumn(name, F.explode(F.sequence(zero, n - 1)))
    step = rows.withColumn("step_", F.explode(F.sequence(zero, F.floor((n - 1) / STRIDE)))).repartition("at", "step_")
    return step.withColumn(name, F.explode(F.sequence(F.col("step_") * STRIDE, F.least(n, (F.col("step_") + 1) * STRIDE) - 1))).drop("step_")


def _rounds(counts: DataFrame, length: int) -> DataFrame | None:
    """(length, rank, each, sequence_id, offset): `each` pieces from that rank on lie in a sequence from an offset on. None where there are no pieces.

    Each round writes what its sequences took to a folder of its own; the sweep's rows, a few for each size, are known to the driver.
    """
    spark = counts.sparkSession
    path = f"{work_dir(spark)}/sequences-{uuid.uuid4().hex}"
    schema = "sequence_id long, gap int, length int, rank long, each long"
    waiting = [(r["length"], 0, r["n"]) for r in counts.collect()]  # one row for each length
    opened = k = 0
    while waiting:
        open_ = None
        if k:
            open_ = spark.read.schema(schema).parquet(f"{path}/round={k - 1}")
            open_ = open_.select("sequence_id", (F.col("gap") - F.coalesce(F.col("length") * F.col("each"), F.lit(0))).cast("int").alias("gap")).where("gap > 0")
        gaps = [(r["gap"], r["n"]) for r in open_.groupBy("gap").agg(F.count("*").alias("n")).collect()] if k else []  # one row for each size
        now = sweep(waiting, gaps, opened, length)
        of = lambda kind: [r[1:] for r in now if r[0] == kind]
        new = spark.createDataFrame(of("open"), ROUND)
        after = _many(new, max((r[4] for r in of("open")), default=0), "nth")
        after = after.select((F.col("at") + F.col("nth")).alias("sequence_id"), F.lit(length).alias("gap"), "length", (F.col("rank") + F.col("nth") * F.col("each")).alias("rank"), "each")
        if gaps and of("match"):
            # Sequences find what they take by the rank of their gap.
            match = F.broadcast(spark.createDataFrame(of("match"), ROUND).withColumnRenamed("gap", "gap_"))
            ranked = _ranked(open_, "gap", ["sequence_id"], "nth")
            taken = ranked.join(match, (F.col("gap") == F.col("gap_")) & (F.col("nth") >= F.col("at")) & (F.col("nth") < F.col("at") + F.col("many")), "left")
            after = after.unionByName(taken.select("sequence_id", "gap", "length", (F.col("rank") + (F.col("nth") - F.col("at")) * F.col("each")).alias("rank"), "each"))
        elif gaps:
            nothing = [F.lit(None).cast(t).alias(c) for c, t in (("length", "int"), ("rank", "long"), ("each", "long"))]
            after = after.unionByName(open_.select("sequence_id", "gap", *nothing))
        after.write.parquet(f"{path}/round={k}")
        opened += sum(r[4] for r in of("open"))
        waiting = [(size, rank, each) for size, rank, *_, each in of("wait")]
        k += 1
    if not k:
        return None
    placed = spark.read.schema(f"{schema}, round int").parquet(path).where("each is not null")
    return placed.select("length", "rank", "each", "sequence_id", (F.lit(length) - F.col("gap")).cast("long").alias("offset"))


def best_fit(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """parts (with doc_id, piece, length from 1 to `length`) plus sequence_id and offset, both long.

    Sequences are filled without gaps from offset 0. Equal pieces are ranked by document, piece and then in
    any order, so ties and repeated rows get places of their own, whatever the partitions. An empty
    table gives an empty one; other columns are carried along, whatever their names, but those of the new names replaced.
    `parts` is read twice; store it first if it is dear.
    """
    parts = parts.drop("sequence_id", "offset")
    counts = stored(parts.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    places = _rounds(counts, length)
    if places is None:
        return parts.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rank = free_name("rank_", parts)
    places = places.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("each") - 1))).select(
        F.col("length").alias("length_"), (F.col("rank") + F.col("nth")).alias("at_"), "sequence_id", (F.col("offset") + F.col("nth") * F.col("length")).alias("offset")
    )
    ranked = _ranked(parts, "length", ["doc_id", "piece"], rank).alias("p")
    both = ranked.join(places.alias("q"), (F.col("p.length") == F.col("q.length_")) & (F.col(f"p.{rank}") == F.col("q.at_")))
    return both.select(*[F.col(f"p.`{c}`") for c in parts.columns], "q.sequence_id", "q.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): each sequence's packed ids in the order of offsets; needs `ids`."""
    row = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(row.alias("r")).select(
        "sequence_id",
        F.aggregate("r.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
        F.col("r.doc_id").alias("doc_ids"),
    )


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Cut, encode and pack all documents: pieces() and their places."""
    return best_fit(stored(pieces(docs, path, with_ids=with_ids), "pieces"))
