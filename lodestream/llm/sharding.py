"""Sharding: minimax contiguous partition of equal-text groups.  DataFrame functions only.

Groups of equal texts, in the order of their MD5, are atomic.  The smallest
capacity with which a greedy left-to-right filling needs no more than the asked
number of shards is found by binary search, and the order is cut where that
filling cuts.  The search runs over sums by hash prefix: only prefixes in which a
cut can still fall are split further, until those are single groups, so the
answer is exact while the driver sees a bounded number of sums.

Law ``bytes``: near-equal sizes.  Size: UTF-8 bytes plus 1; null texts have
size 1, CRC 0 and are one group of their own.  Repeated rows each get a slot; a
null doc_id sorts first.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _spark

SHARDS = 8
#: Hex digits of the first sums and of each further split.
FIRST, FURTHER = 3, 2
#: Rows of a hash prefix (two digits) are numbered in so many parts at least, so that one text's copies are shared out; rows to a further part.
PARTS, SHARED = 64, 1 << 24
#: The key of null texts: no MD5, and after all of them.
NULL = "g" * 32


def _ends(sizes: list[int]) -> list[int]:
    out = [0]
    for x in sizes:
        out.append(out[-1] + x)
    return out


def _fill(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy cuts (numbers of cells) for this capacity; None if it doesn't do."""
    cuts, at = [], 0
    for _ in range(shards):
        at = bisect_right(ends, ends[at] + capacity) - 1
        cuts.append(at)
        if at == len(ends) - 1:
            return cuts
        if len(cuts) > 1 and cuts[-2] == at or not at:
            return None
    return None


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The least capacity and its greedy cuts."""
    ends = _ends(sizes)
    low, high = max([0, -(-ends[-1] // shards), *sizes]), ends[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _fill(ends, mid, shards) else (mid + 1, high)
    return low, _fill(ends, low, shards) or [0]


def _cells(groups: DataFrame, open_prefixes: list[str] | None, digits: int) -> list[tuple[str, int, bool]]:
    """(prefix, bytes, whether it is one group) by hash prefix."""
    if open_prefixes is not None:
        groups = groups.where(F.substring("md5", 1, len(open_prefixes[0])).isin(open_prefixes))
    rows = groups.groupBy(F.substring("md5", 1, digits).alias("p")).agg(F.sum("size").alias("b"), F.min("md5").alias("a"), F.max("md5").alias("z")).collect()
    return [(r["p"] if r["a"] != r["z"] else r["a"], r["b"], r["a"] == r["z"]) for r in rows]


def cut_points(groups: DataFrame, shards: int) -> list[str]:
    """The MD5 at which each shard but the first begins."""
    cells, digits = sorted(_cells(groups, None, FIRST)), FIRST
    while True:
        ends = _ends([b for _, b, _ in cells])
        most = minimax([b for _, b, _ in cells], shards)[0]  # whole prefixes as groups: never less than the true capacity
        least = max([-(-ends[-1] // shards), *(b for _, b, one in cells if one)])
        low = high = 0
        can: set[int] = set()
        for _ in range(shards - 1):  # the k-th cut lies between these
            low = ends[max(0, bisect_right(ends, low + least) - 1)]
            high = min(ends[-1], high + most)
            can.update(range(max(0, bisect_right(ends, low) - 1), min(len(cells), bisect_right(ends, high))))
        wide = [k for k in can if not cells[k][2]]
        if not wide:
            break
        digits += FURTHER
        found = _cells(groups, [cells[k][0] for k in wide], digits)
        cells = sorted([c for k, c in enumerate(cells) if k not in set(wide)] + found)
    cuts = minimax([b for _, b, _ in cells], shards)[1]
    return [cells[k][0] for k in cuts[:-1]]


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.col("text").cast("binary")
    rows = _spark.saved(docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.md5(text), F.lit(NULL)).alias("md5")))
    cuts, parts = cut_points(rows, shards), max(PARTS, rows.count() // SHARED)
    shard = sum(((F.col("md5") >= c).cast("int") for c in cuts), F.lit(0))
    placed = rows.select("*", shard.cast("int").alias("shard"), F.substring("md5", 1, 2).alias("bin"), F.pmod(F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part"))
    units = placed.groupBy("shard", "bin", "part").agg(F.count("*").alias("n"))  # at most (257 + shards) * parts rows
    before = Window.partitionBy("shard").orderBy("bin", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = units.select("shard", "bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "bin", "part").orderBy("md5", F.col("doc_id").asc_nulls_first())
    numbered = placed.withColumn("own", F.row_number().over(own) - 1).join(firsts, ["shard", "bin", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
