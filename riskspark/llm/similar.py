"""Near copies by exact similarity of word shingles; SimHash tables and banded minima find the candidates.

Two texts link if the Jaccard similarity of their sets of five-word shingles is at least 0.8 (ASCII lower
case, words between ASCII white space; a shorter text is one shingle). Texts with equal sets are one node.
Nodes are candidates if they meet in a bucket of one of these tables:

- the 15 covering masks of ``simhash`` over 64-bit fingerprints of the shingles: every pair within three
  bits meets, whatever its shingles;
- 16 bands of five minima each: a pair of similarity 0.8 meets with probability 0.998, a closer one sooner.

Candidates are decided by their whole shingle sets. A bucket of two is a pair; buckets of the same members
count once. A larger bucket gives the edges of a spanning forest, not its pairs: it is cut into blocks of
about ``block`` shingles, and every two blocks meet in a task. A bucket of more than ``peel`` shingles is
first measured against its smallest member in one linear pass. With u the least distance above the limit,
a linked member nearer than u - limit leaves the bucket: by the triangle inequality all its links lie among
the linked ones. So a huge group of copies shrinks at once, and no link is lost.

Null and empty texts are one node without links to others. Of rows that share an id and a shingle set one
stays. Rows without id are kept only where no row of their group has one. An empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskspark import session
from riskspark.llm import common, simhash

BANDS, ROWS = 16, 5
CHUNK = 4096
_draw = np.random.default_rng(8)
FACTORS = _draw.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _draw.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64)
MIX = _draw.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
POINT = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("fp", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
GRAMS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("grams", T.ArrayType(T.LongType()))])
EDGES = T.ArrayType(T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())]))


def bands(grams: np.ndarray) -> np.ndarray:
    """One hash per band over its minima; none for an empty set."""
    if not len(grams):
        return np.zeros(0, np.int64)
    grams, least = grams.view(np.uint64), np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(grams), CHUNK):
        least = np.minimum(least, (grams[None, k:k + CHUNK] * FACTORS + TERMS).min(axis=1))
    least ^= least >> np.uint64(31)
    return (least.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sets(texts: list[bytes], shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Shingle hashes, distinct ascending ones as signed numbers, and the key of the set, for every text."""
    for text in texts:
        hashes = simhash.shingle_hashes(text, shingle)
        grams = np.unique(hashes.astype(np.uint64).view(np.int64))
        yield hashes, grams, xxhash.xxh3_128_digest(grams.tobytes())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)))


def _points(shingle: int):
    def run(texts: list[bytes]) -> pa.Array:
        keys, prints, sizes, rows = [], [], [], []
        for hashes, grams, key in _sets(texts, shingle):
            keys.append(key)
            prints.append(simhash.signed(simhash.majority(hashes)))
            sizes.append(len(grams))
            rows.append(bands(grams))
        return common.struct_array(key=pa.array(keys, pa.binary()), fp=pa.array(prints, pa.int64()),
                                   size=pa.array(sizes, pa.int64()), bands=_lists(rows))

    return common.text_udf(run, POINT)


def _grams(shingle: int):
    def run(texts: list[bytes]) -> pa.Array:
        found = [(key, grams) for _, grams, key in _sets(texts, shingle)]
        return common.struct_array(key=pa.array([k for k, _ in found], pa.binary()), grams=_lists([g for _, g in found]))

    return common.text_udf(run, GRAMS)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def forest_of(keys: list[bytes], grams: list[np.ndarray], least: float) -> list[tuple[bytes, bytes]]:
    """Edges (member, first member of its component) of one block of ascending sets; a found member leaves the search."""
    order = np.array(sorted(range(len(keys)), key=lambda i: keys[i]), np.int64)
    sizes = np.array([len(g) for g in grams], np.int64)
    every = np.concatenate([grams[i] for i in order]) if len(order) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(order)), sizes[order])
    sizes = sizes[order]
    start = np.concatenate([[0], np.cumsum(sizes)])
    free = np.ones(len(order), bool)
    edges = []
    for root in range(len(order)):
        if not free[root]:
            continue
        free[root] = False
        queue = deque([root])
        while queue and free.any():
            now = queue.popleft()
            own = every[start[now]:start[now + 1]]
            fits = free & (np.minimum(sizes, len(own)) >= least * np.maximum(sizes, len(own)))
            if not fits.any():
                continue
            held = fits[owner]
            rest, who = every[held], owner[held]
            at = np.minimum(np.searchsorted(own, rest), len(own) - 1)
            both = np.bincount(who[own[at] == rest], minlength=len(order))
            near = np.flatnonzero(fits & (both >= least * (sizes + len(own) - both) - 1e-9))
            free[near] = False
            queue.extend(near.tolist())
            edges += [(keys[order[i]], keys[order[root]]) for i in near]
    return edges


def _forest(least: float):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            offsets, found = [0], []
            for bucket in column:
                rows = bucket.values
                keys = rows.field("key").to_pylist()
                found += forest_of(keys, [np.array(g.values, np.int64) for g in rows.field("grams")], least)
                offsets.append(len(found))
            pairs = common.struct_array(a=pa.array([a for a, _ in found], pa.binary()), b=pa.array([b for _, b in found], pa.binary()))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, EDGES).asNondeterministic()


def _peeled(members: DataFrame, sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Edges to each bucket's smallest member, and the members that may have further links."""
    first = members.groupBy("t", "k").agg(F.min("key").alias("first"))
    rows = members.join(first, ["t", "k"]).where("key <> first")
    pairs = rows.select("key", "first").distinct()
    near = (pairs.join(sets, "key").join(sets.select(F.col("key").alias("first"), F.col("grams").alias("other")), "first")
            .select("key", "first", (1 - similarity(F.col("grams"), F.col("other"))).alias("d")))
    rows = session.cut_lineage(rows.join(near, ["key", "first"]))
    limit = 1 - least + 1e-9
    beyond = rows.where(F.col("d") > limit).groupBy("t", "k").agg(F.min("d").alias("u"))
    left = rows.join(beyond, ["t", "k"]).where((F.col("d") > limit) | (F.col("d") >= F.col("u") - limit))
    return rows.where(F.col("d") <= limit).select(F.col("key").alias("a"), F.col("first").alias("b")), left.select("t", "k", "key", "size")


def links(points: DataFrame, texts: DataFrame, least: float, shingle: int, block: int, peel: int) -> DataFrame:
    """Edges (a, b) whose components are those of all candidate pairs with enough similarity.

    ``points``: one row (key, fp, size, bands, id) per distinct set; ``texts``: (id, text).
    """
    masks = [F.col("fp").bitwiseAND(F.lit(simhash.signed(m))) for m in simhash.masks(3)]
    tables = points.where("size > 0").select("key", "size", F.posexplode(F.concat(F.array(*masks), F.col("bands"))).alias("t", "k"))
    census = session.cut_lineage(tables.groupBy("t", "k").agg(
        F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"), F.sum("size").alias("w"),
        F.expr("bit_xor(xxhash64(key))").alias("x")).where("n > 1"))
    two = census.where("n = 2").select("a", "b").distinct()
    more = census.where("n > 2").groupBy("n", "x", "a", "b").agg(F.min(F.struct("t", "k")).alias("tk")).select("tk.*")
    members = session.cut_lineage(tables.join(more, ["t", "k"]))
    wanted = members.select("key").union(two.select("a")).union(two.select("b")).distinct()
    wanted = session.cut_lineage(wanted.join(points.select("key", "id"), "key"))
    named = texts.join(wanted.select("id").distinct(), "id", "left_semi")
    if not wanted.where("id IS NULL").isEmpty():
        named = named.unionByName(texts.where("id IS NULL"))
    sets = named.select(_grams(shingle)("text").alias("g")).select("g.*")
    sets = session.cut_lineage(sets.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]))

    pairs = two.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a")
    pairs = pairs.join(sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")
    edges = pairs.where(similarity(F.col("ga"), F.col("gb")) >= least - 1e-9).select("a", "b")
    for _ in range(3):
        weight = members.groupBy("t", "k").agg(F.sum("size").alias("w"))
        heavy = weight.where(F.col("w") > peel)
        if heavy.isEmpty():
            break
        linked, left = _peeled(members.join(heavy.select("t", "k"), ["t", "k"]), sets, least)
        edges = edges.unionByName(linked)
        members = session.cut_lineage(members.join(heavy.select("t", "k"), ["t", "k"], "left_anti").unionByName(left))
    weight = members.groupBy("t", "k").agg(F.sum("size").alias("w"), F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("w") / block).cast("int")
    rows = members.join(weight, ["t", "k"]).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.select("t", "k", "key", "own", other.alias("other"))
    rows = rows.select("t", "k", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    grouped = rows.join(sets, "key").groupBy("t", "k", "p", "q").agg(F.collect_list(F.struct("key", "grams")).alias("rows"))
    found = grouped.select(F.explode(_forest(least)("rows")).alias("e")).select("e.a", "e.b")
    return edges.unionByName(found).distinct()


def classes(docs: DataFrame, least: float = 0.8, shingle: int = 5, block: int = 500_000, peel: int = 2_000_000,
            id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, key) of every row, and (key, root, id) of every distinct set with its smallest id."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    points = session.cut_lineage(texts.select("id", _points(shingle)("text").alias("p")).select("id", "p.*"))
    own = session.cut_lineage(points.groupBy("key").agg(
        F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    roots = simhash.components(links(own, texts, least, shingle, block, peel)).withColumnRenamed("node", "key")
    return points.select("id", "key"), own.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "id")


def keep_one(docs: DataFrame, least: float = 0.8, shingle: int = 5, block: int = 500_000, peel: int = 2_000_000,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of every group of near copies, with its columns."""
    points, named = classes(docs, least, shingle, block, peel, id_col, text_col)
    best = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("lacks"), "id", "key")).alias("m"))
    best = session.cut_lineage(best.select("m.id", "m.key"))
    again = points.groupBy("id").count().where("count > 1 OR id IS NULL").select("id").intersect(best.select("id"))
    again = session.cut_lineage(again)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row_id = F.col("row")[id_col]
    kept = row.join(best.select("id").distinct().hint("shuffle_hash"), row_id == F.col("id"), "left_semi")
    if not again.isEmpty():
        same = row_id.eqNullSafe(F.col("id"))
        keyed = row.join(again, same, "left_semi").select("row", _grams(shingle)(F.col("row")[text_col])["key"].alias("own"))
        chosen = keyed.join(best, same & (F.col("own") == F.col("key")), "left_semi")
        chosen = chosen.withColumn("again", row_id).dropDuplicates(["again", "own"]).select("row")
        kept = kept.join(again, row_id == F.col("id"), "left_anti").unionByName(chosen)
    return kept.select("row.*")
