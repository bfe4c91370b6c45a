"""N-gram Jaccard join: grouped prefix join on word shingles.

Documents with equal shingle sets fall into one class; classes with equal
prefix and size into one group.  Groups that share a prefix token are paired
under the size and position filters, pairs of groups are expanded to their
members, and members are verified on their whole sets.

Tokens are ordered by an estimate of their document frequency (the smaller of
two hashed counts in fixed-size tables that cover every document), then by hash:
any total order gives the same links, this one keeps frequent passages out of
the prefixes.  Since only components are asked for, a first round pairs each
token's groups with one hub; later pairs are made between groups that are not yet
in one component, so a family of near copies costs its size and not its square,
and no link between different components is lost.

Defined results: null or blank texts have the empty set and link with nothing;
a text with fewer words than a shingle is one shingle; rows without a doc_id link
with nothing and have no component; repeated rows each return a row; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text
from ._text import U

#: Words of a shingle; least similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Cells of each of the two frequency tables (2 bytes each).
FREQUENCY_CELLS = 1 << 19


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document, its distinct shingle hashes in ascending order) for documents that have words."""
    starts, ends, doc = _text.words(data, offsets)
    h = _text.word_hashes(data, starts, ends, lower=True)
    at = _text.word_offsets(doc, len(offsets) - 1)
    prefix = _text.Prefix(h)
    every = _text.mix(prefix.windows(size), 2)
    for d in np.flatnonzero(at[1:] > at[:-1]):
        a, b = at[d], at[d + 1]
        own = every[a : b - size + 1] if b - a >= size else _text.mix(prefix.hash(np.array([a]), np.array([b])), 3 + int(b - a))
        own = np.sort(own)
        yield int(d), own[np.concatenate(([True], own[1:] != own[:-1]))]


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & U(FREQUENCY_CELLS - 1)).astype(np.int64), ((h >> U(32)) & U(FREQUENCY_CELLS - 1)).astype(np.int64) + FREQUENCY_CELLS


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for piece in _text.pieces(batches):
            sets = [s for _, s in shingles(*_text.raw(piece.column(0)), size)]
            if sets:
                yield np.concatenate(_cells(np.concatenate(sets)))

    return _spark.tallied(docs.select("text"), cells, 2 * FREQUENCY_CELLS, np.uint16)


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, two hashes of the set, two of the prefix, and the prefix's tokens that other documents may have, with their places in token order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies(docs, size))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for piece in _text.pieces(batches):
            n = np.zeros(piece.num_rows, np.int64)
            keys = np.zeros((4, piece.num_rows), np.int64)
            prefixes, places, at = [], [], np.zeros(piece.num_rows + 1, np.int64)
            for d, s in shingles(*_text.raw(piece.column(1)), size):
                a, b = _cells(s)
                often = np.minimum(counts[a], counts[b]).astype(U)
                order = np.argsort((np.minimum(often, U(0xFFFF)) << U(48)) | (s >> U(16)), kind="stable")
                prefix = s[order[: len(s) - (percent * len(s) + 99) // 100 + 1]]
                alone = np.minimum(often, U(0xFFFF))[order[: len(prefix)]] < 2  # no other document has these
                n[d], at[d + 1] = len(s), len(prefix) - int(alone.sum())
                keys[:, d] = _text.signed(np.array([_text.mix(x, k).sum() for x in (s, prefix) for k in (5, 6)], U))
                prefixes.append(prefix[~alone])
                places.append(np.flatnonzero(~alone).astype(np.int32))
            ends = np.cumsum(at)
            flat, place = np.concatenate([np.empty(0, U), *prefixes]), np.concatenate([np.empty(0, np.int32), *places])
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n), *map(pa.array, keys), _text.lists(_text.signed(flat), ends), _text.lists(place, ends)], names=["doc_id", "n", "s1", "s2", "p1", "p2", "prefix", "places"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, n long, s1 long, s2 long, p1 long, p2 long, prefix array<long>, places array<int>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, members) of the wanted documents' sets; a fixed-size table drops most others before the shuffle."""

    among = _spark.maybe_among(wanted.select(F.xxhash64("id")))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(among(np.asarray(batch.column(1)))))
            for piece in _text.pieces([kept]):
                found = list(shingles(*_text.raw(piece.column(2)), size))
                if found:
                    at = np.cumsum([0, *(len(s) for _, s in found)])
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array([d for d, _ in found])), _text.lists(_text.signed(np.concatenate([s for _, s in found])), at)], names=["id", "members"])

    some = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"), "text").where("id is not null")
    return some.mapInArrow(expand, "id long, members array<long>").join(wanted, "id", "left_semi")


def components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links, itself included."""
    signed = _spark.saved(signatures(docs, size, percent))
    usable = signed.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("n", "s1", "s2", "p1", "p2").agg(F.min("doc_id").alias("id"))
    classes = _spark.saved(classes)
    groups = classes.groupBy("n", "p1", "p2").agg(F.min("id").alias("g"), F.count("*").alias("members"))
    member = _spark.saved(classes.join(groups, ["n", "p1", "p2"]).select("g", "id", "n", "members"))

    # the inverted index over the groups' prefixes, without tokens of one group only; each token has its first group as hub
    some = usable.where(F.size("prefix") > 0).select(F.col("doc_id").alias("g"), "n", "prefix", "places")
    prefix = some.join(member.where("id = g").select("g", "n").distinct(), ["g", "n"])
    # n and the token's place in one number: these rows are the most that is shuffled
    tokens = prefix.select("g", "n", F.explode(F.arrays_zip("prefix", "places")).alias("p")).select(F.col("p.prefix").alias("token"), "g", (F.shiftleft("n", 32) + F.col("p.places")).alias("pos"))
    hubs = tokens.groupBy("token").agg(F.min("g").alias("hub"), F.max("g").alias("last"), F.min_by("pos", "g").alias("hub_pos")).where("hub < last").drop("last")
    index = _spark.saved(tokens.join(hubs, "token"))

    most = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    fits = (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & ((100 + percent) * most >= percent * (F.col("a.n") + F.col("b.n")))
    wide = member.where("members > 1")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) of documents whose whole sets are similar enough; sets are made for documents in pairs only."""
        pairs = _spark.saved(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        sets = _sets(docs, _spark.saved(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()), size)
        u, v = (sets.select(F.col("id").alias(x), F.col("members").alias(f"{x}_set")) for x in "uv")
        both = pairs.join(u, "u").join(v, "v")
        same = F.size(F.array_intersect("u_set", "v_set"))
        return both.where(100 * same >= percent * (F.size("u_set") + F.size("v_set") - same)).select("u", "v")

    # each token's groups with its hub, each group's members with its first
    at = lambda g, pos: F.struct(F.col(g).alias("g"), F.shiftright(pos, 32).alias("n"), F.col(pos).bitwiseAND(F.lit(2**32 - 1)).alias("at"))
    star = index.where("g <> hub").select(at("g", "pos").alias("a"), at("hub", "hub_pos").alias("b")).where(fits).select(F.col("a.g").alias("u"), F.col("b.g").alias("v"))
    links = verified(star.union(wide.select(F.col("g").alias("u"), F.col("id").alias("v"))))

    # what is left: groups that share a token, members of one group, in different components so far
    root = _spark.components(links)
    rooted = _spark.saved(member.join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    rest = index.select("token", "g", F.shiftright("pos", 32).alias("n"), F.col("pos").bitwiseAND(F.lit(2**32 - 1)).alias("at")).join(rooted.select("g", "id", "root"), "g")
    open_tokens = rest.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token")
    rest = _spark.saved(rest.join(open_tokens, "token"))
    inner = rooted.where("members > 1")
    apart = F.col("a.root") < F.col("b.root")
    pairs = rest.alias("a").join(rest.alias("b"), "token").where(apart & fits).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    within = inner.alias("a").join(inner.alias("b"), "g").where(apart).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    # the new links join whole components: only these are gone through again
    more = verified(pairs.union(within))
    of = lambda c: rooted.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    joined = _spark.components(more.join(of("u"), "u").join(of("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v")))
    after = joined.select(F.col("node").alias("root"), F.col("root").alias("last"))
    root = _spark.written(rooted.select(F.col("id").alias("node"), "root").distinct().join(after, "root", "left").select("node", F.coalesce("last", "root").alias("root")))
    least = root.groupBy("root").agg(F.min("node").alias("component_id"))
    named = root.join(least, "root").select(F.col("node").alias("id"), "component_id")
    by_class = classes.join(named, "id", "left").select("n", "s1", "s2", F.coalesce("component_id", "id").alias("component_id"))
    lone = F.when((F.col("n") == 0) | F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return signed.select("doc_id", "n", "s1", "s2").join(by_class, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), lone).alias("component_id"))


def deduplicated(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows without those that have a partner of smaller doc_id; all columns.

    Rows without a doc_id and blank ones stay, and so do repeated rows of a doc_id that stays.
    """
    found = components(docs, size, percent)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    return kept
