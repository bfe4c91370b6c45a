"""Session helpers: shared checkpoints, fixed-size merged tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Cells of a merged table that travel in one row; parts in which the driver fetches a table of more bytes than the last number.
SLICE, FETCHES, SMALL = 1 << 16, 6, 1 << 22


def shared(spark: SparkSession) -> None:
    """Have a checkpoint folder: the cluster's, or one of this machine where all of Spark runs on it, as in tests."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestream-"))


def saved(df: DataFrame) -> DataFrame:
    """The rows, kept in the shared folder; lost executors cost nothing, and old ones go with their references."""
    shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As saved, but compressed and by column: for texts, and for small rows in loops, as nothing of the plan stays.

    (A checkpoint keeps what the optimiser inferred of its plan, and that multiplies from round to round.)
    These tables stay until ``tidy`` or until the folder goes, or until the end of ``passing``.
    """
    spark = df.sparkSession
    shared(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rounds/{_OWNER.get()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_OWNER: ContextVar[str] = ContextVar("owner", default="shared")


def deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is ``written`` meanwhile goes at the end; results must be elsewhere by then."""
    shared(spark)
    name = uuid.uuid4().hex
    before = _OWNER.set(name)
    try:
        yield
    finally:
        _OWNER.reset(before)
        deleted(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rounds/{name}")


def tidy(spark: SparkSession) -> None:
    """Delete the tables of ``written`` once no result that reads them is needed any more."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        deleted(spark, f"{folder.get()}/rounds")


#: Cells of the table that tells which rows may be among some others.
MAYBE_CELLS = 1 << 22


def bitmap(rows: DataFrame, cell: Column, cells: int) -> np.ndarray:
    """One bit for each of so many cells, set where a row has it; partial bitmaps of 4 KB are merged, and its size is fixed."""
    at = cell + 1
    found = rows.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(max(cells // 8, 4096), np.uint8)
    for r in found.coalesce(FETCHES).toLocalIterator():
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def has_bit(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def maybe_among(keys: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test of 64-bit keys: true for all keys of the one column of ``keys``, false for most others; its size is fixed."""
    shared = keys.sparkSession.sparkContext.broadcast(bitmap(keys, F.col(keys.columns[0]).bitwiseAND(F.lit(MAYBE_CELLS - 1)), MAYBE_CELLS))

    def test(keys: np.ndarray) -> np.ndarray:
        return has_bit(shared.value, keys & (MAYBE_CELLS - 1))

    return test


def parted(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose 64-bit column may be among the keys, and the others, told apart before any shuffle."""
    among, at, schema = maybe_among(keys), df.columns.index(column), df.schema

    def pick(wanted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(among(np.asarray(batch.column(at))) == wanted))

        return picked

    return df.mapInArrow(pick(True), schema), df.mapInArrow(pick(False), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows no model may learn from; a missing doc_id is in neither part."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def row_key(doc_id: Column, text: Column) -> Column:
    """The same for repeated rows; used together with doc_id, for nothing else."""
    return F.xxhash64(doc_id, text)


class Tally:
    """Counts in a fixed number of cells, for one task."""

    def __init__(self, cells: int, kind: type = np.uint8):
        self.counts, self.most = np.zeros(cells, kind), np.iinfo(kind).max

    def add(self, cells: np.ndarray) -> None:
        at, n = np.unique(cells, return_counts=True)
        self.counts[at] = np.minimum(self.counts[at].astype(np.int64) + n, self.most)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.counts), SLICE):
            at = np.flatnonzero(self.counts[k : k + SLICE])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([self.counts[k + at].tobytes()], pa.binary())], names=["slice", "cells", "counts"])


SLICES = "slice int, cells binary, counts binary"


def merged(partial: DataFrame, cells: int, kind: type = np.uint8) -> np.ndarray:
    """The sum of all tasks' tallies; its size doesn't depend on the input's."""
    most = np.iinfo(kind).max

    def row(k: int, total: np.ndarray) -> pa.RecordBatch:
        tally = Tally(SLICE, kind)
        tally.counts[:] = np.minimum(total, most)
        one = next(tally.rows())
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), one.column(1), one.column(2)], names=one.schema.names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(SLICE, np.int64)  # slices come in order: one is held at a time
        for batch in batches:
            for k, at, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != now:
                    if now is not None:
                        yield row(now, total)
                    now, total = k, np.zeros(SLICE, np.int64)
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, kind)
        if now is not None:
            yield row(now, total)

    out = np.zeros(cells, kind)
    rows = partial.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, SLICES)
    # a small table comes at once, a large one in few parts, as each costs the driver a job
    for r in rows.collect() if out.nbytes <= SMALL else rows.coalesce(FETCHES).toLocalIterator():
        part = out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE]
        part[np.frombuffer(r["cells"], np.uint16)] = np.frombuffer(r["counts"], kind)
    return out


def tallied(df: DataFrame, cells_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], cells: int, kind: type = np.uint8) -> np.ndarray:
    """Counts of what cells_of gives for the rows, from all partitions."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(cells, kind)
        for found in cells_of(batches):
            tally.add(found)
        yield from tally.rows()

    return merged(df.mapInArrow(partial, SLICES), cells, kind)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v), u <> v; nodes of one component share a root.

    Each round moves every node to its least neighbour (if that is less), then twice to where that has moved,
    and drops edges that became loops.  Rounds in turn take the least number, which ends stars around
    their least node at once, and the least hash, which halves the nodes in expectation whatever the
    shape of the graph.  No node's neighbours are ever gathered.
    """
    edges, left = counted(edges)
    moves, turn = [], 0
    while left:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if turn % 2 == 0:
            step = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("to"))
        else:
            rank = lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: E731, B023
            step = both.groupBy("u").agg(F.min_by("v", rank("v")).alias("m")).select("u", F.when(rank("m") < rank("u"), F.col("m")).otherwise(F.col("u")).alias("to"))
        jump = lambda a: a.select("u", F.col("to").alias("via")).join(a.select(F.col("u").alias("via"), "to"), "via").select("u", "to")
        move = written(jump(written(jump(step))))
        moves.append(move)
        edges, left = counted(edges.join(move.select("u", F.col("to").alias("a")), "u").join(move.select(F.col("u").alias("v"), F.col("to").alias("b")), "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct())
        turn += 1
    if not moves:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return written(followed(moves))


def counted(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows, written, and their number."""
    seen = Observation()
    out = written(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def followed(moves: list[DataFrame]) -> DataFrame:
    """(node, root) of moves (u, to) one after another; a node that doesn't move any more is its root."""
    out = moves[-1].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        out = move.join(out.withColumnRenamed("node", "to"), "to", "left").select(F.col("u").alias("node"), F.coalesce("root", "to").alias("root"))
    return out
