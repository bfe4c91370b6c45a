"""Mixing sources to target weights: cube-method balanced sampling.

Each source's target over its size is the number of times its documents are
taken on average: whole copies are certain, the fraction is an inclusion
probability.  The flight phase moves these probabilities through the null space
of the constraints (documents and words of the source stay as they are in
expectation), a few units at a time, until at most two of a block are undecided.
What blocks leave undecided forms the next level's blocks, with a bounded number of
decided units beside it; when one block of a source is left, whatever the other
sources' sizes, the landing rounds its last two units with the least error in
words and turns others over as long as that brings the words nearer.  Blocks are hashed parts of a source of bounded expected size, so a source of any
size is shared out, and all chance comes from hashes: reruns agree.

Defined results: null texts and blank ones have size 0; null is a source of its own,
the last; repeated rows are units of their own; a source of size 0 has target 0;
the rows keep all their columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _spark, _text

#: Weights by source order, repeated; share of all words in the mix; most times a source is taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Units of a block, and about the decided units that all blocks of a source hand on to its landing.
BLOCK = 2048


def sized(docs: DataFrame) -> DataFrame:
    """All columns, ``_size`` (words) and ``_h`` (a hash of the row's doc_id and text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            data, offsets = _text.raw(piece.column(piece.schema.get_field_index("text")))
            n = np.bincount(_text.words(data, offsets)[2], minlength=piece.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(n)], schema=piece.schema.append(pa.field("_size", pa.int64())))

    keyed = docs.withColumn("_h", F.xxhash64("doc_id", "text"))
    return keyed.mapInArrow(count, T.StructType([*keyed.schema.fields, T.StructField("_size", T.LongType())]))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target by source: shares by weight, what exceeds a source's bound reshared by weight.

    The level of water is found in one sweep over the sources in the order of
    their bounds over weights; no source's rows meet, only the sources' sums.
    """
    sums = rows.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("source_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    bound = sums.withColumn("w", weight).withColumn("bound", F.col("source_size") * F.lit(most))
    by_bound = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    swept = bound.select("*", F.coalesce(F.sum("bound").over(before), F.lit(0.0)).alias("full"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("passed"), F.sum("w").over(every).alias("all_w"), (F.sum("source_size").over(every) * F.lit(share)).alias("asked"))
    # the level if all before this one are full; the first source below its bound fixes it
    level = (F.col("asked") - F.col("full")) / (F.col("all_w") - F.col("passed"))
    swept = swept.withColumn("level", level).withColumn("open", F.col("bound") >= F.col("level") * F.col("w"))
    fixed = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_bound.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return swept.withColumn("fixed", fixed).select("source", "source_size", "source_rows", F.least("bound", F.coalesce(F.col("fixed") * F.col("w"), F.col("bound"))).alias("target"))


def fly(p: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The flight phase for two constraints, sum of p and sum of p * size; at most two entries stay fractional."""
    p, draw, eps = p.astype(float).copy(), np.random.default_rng(seed), 1e-9
    chance, drawn = draw.random(len(p) + 1), 0
    held: list[int] = []
    for k in np.flatnonzero((p > eps) & (p < 1 - eps)):
        held.append(int(k))
        while len(held) == 3:
            a, b, c = held
            u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(held, u, strict=True) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(held, u, strict=True) if x)
            step = up if chance[drawn] * (up + down) < down else -down
            drawn += 1
            for k, x in zip(held, u, strict=True):
                p[k] = min(1.0, max(0.0, p[k] + step * x))
            held = [k for k in held if eps < p[k] < 1 - eps]
    p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
    return p


def land(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The last undecided units, rounded with the least error in words, then in documents; then units of the block turned over, each at most once, as long as that brings the words nearer."""
    p, goal, left = p.copy(), float((p * sizes).sum()), np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        ways = [np.array([way >> k & 1 for k in range(len(left))]) for way in range(1 << len(left))]
        p[left] = min(ways, key=lambda x: (round(abs(float(((x - p[left]) * sizes[left]).sum())), 6), abs(float((x - p[left]).sum()))))
    fresh = np.ones(len(p), bool)
    while fresh.any():
        off = float((p * sizes).sum()) - goal
        after = np.where(fresh, np.abs(off + np.where(p > 0.5, -sizes, sizes)), np.inf)
        k = int(after.argmin())
        if after[k] > abs(off) - 0.5:
            break
        p[k], fresh[k] = 1 - p[k], False
    return p


def _level(rows: DataFrame, level: int) -> DataFrame:
    """Each block's flight, and the landing of a source that is one block; _on: goes on to the next level."""

    def block(table: pa.Table) -> pa.Table:
        sizes, h = table["_size"].to_numpy().astype(float), table["_h"].to_numpy()
        order = np.lexsort((h, -sizes))  # one order for every run; units much longer than the others stay undecided to the last, the landing makes up for them
        source, n = table["source"][0].as_py(), table["_n"][0].as_py()
        given = table["_p"].to_numpy()[order]
        p = fly(given, sizes[order].tolist(), crc32(f"{source}/{level}/{table['_block'][0].as_py()}".encode()))
        on = np.zeros(len(p), bool)
        if n > BLOCK:
            on = (p > 0) & (p < 1)
            if on.any():
                spare = np.flatnonzero(~on)
                on[spare[np.argsort(h[order][spare], kind="stable")[: max(2, -(-BLOCK * BLOCK // n))]]] = True
        elif ((given > 0) & (given < 1)).any():
            p = land(p, sizes[order])
        out, goes = np.empty(len(p)), np.empty(len(p), bool)
        out[order], goes[order] = p, on
        table = table.set_column(table.schema.get_field_index("_p"), "_p", pa.array(out))
        return table.set_column(table.schema.get_field_index("_on"), "_on", pa.array(goes)).drop_columns(["_block"])

    blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(BLOCK)))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(level), "_h"), blocks).cast("long"))
    return dealt.groupBy("source", "_block").applyInArrow(block, rows.schema)


def _mix(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    aims = _spark.saved(targets(rows.select("source", "_size"), weights, share, most))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    right = aims.select(F.col("source").alias("_s"), "source_size", "target", F.floor(times).alias("_whole"), (times - F.floor(times)).alias("_p"), F.lit(True).alias("_on"), F.col("source_rows").alias("_n"))
    now, level, done = rows.join(right, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), 0, None
    biggest = aims.agg(F.max("source_rows")).first()[0] or 0
    while True:
        flown = _spark.saved(_level(now, level))
        decided = flown.where("not _on")
        done = decided if done is None else done.union(decided)
        if biggest <= BLOCK:
            break
        left = flown.where("_on").drop("_n")
        counts = left.where("_p not in (0.0, 1.0)").groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("_n"))
        biggest = counts.agg(F.max("_n")).first()[0] or 0
        now, level = left.join(counts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").select(*rows.columns, "source_size", "target", "_whole", "_p", "_on", "_n"), level + 1
    return done.withColumn("_copies", (F.col("_whole") + F.col("_p")).cast("int"))


def mixture(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them; all columns."""
    names = docs.columns
    own = [c if c in ("doc_id", "text", "source") else f"_c{k}" for k, c in enumerate(names)]  # no name of ours meets one of theirs
    out = _mix(sized(docs.toDF(*own)), WEIGHTS, SHARE, MOST)
    return out.where("_copies > 0").withColumn("_turn", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*own).toDF(*names)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) for every row."""
    rows = sized(docs.select("doc_id", "text", "source")).drop("text")
    return _mix(rows, WEIGHTS, SHARE, MOST).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).cast("long").alias("taken"))
