"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the XXH64 hashes of a text's three-word shingles.
Bit position ``i`` carries a non-zero code ``m(i)`` of ``radius + 1`` bits; table ``v`` (again a
non-zero code) keeps the positions with an odd product ``<m(i), v>`` and masks the others. The
positions in which two fingerprints differ are at most ``radius`` codes, which never span the whole
code space, so some ``v`` is orthogonal to all of them: in that table the pair agrees on every kept bit.
With radius 3 there are 15 tables of 32 to 36 kept bits, and no pair within the radius is missed.

Only distinct fingerprints are compared. A bucket gives the edges of a spanning forest, not its pairs.
A bucket of more than ``most`` fingerprints is covered once more, with the codes dealt anew (a pair
agrees in some table of every level, hence on both masks); after the last level so few bits are free
that every bucket is small.

Null and empty texts have fingerprint zero and link like any other. Repeated rows get equal results; a
row without doc_id is labelled but never names a component unless all its rows lack one.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from riskspark import session
from riskspark.llm import common

BITS = 64
LEVELS = 5  # after the last, eight bits at most are free at radius 3, so a bucket has at most 256 fingerprints
EDGES = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def codes(radius: int) -> list[int]:
    return list(range(1, 2 ** (radius + 1)))


def masks(radius: int, level: int = 0) -> list[int]:
    """One mask per table, as unsigned integers; every level deals the codes to the bits anew."""
    names = codes(radius)
    dealt = [names[i % len(names)] for i in range(BITS)]
    random.Random(level).shuffle(dealt)
    return [sum(1 << bit for bit in range(BITS) if (dealt[bit] & v).bit_count() % 2) for v in names]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of ASCII lower-cased words, repeats included; a shorter text is one shingle."""
    words = text.lower().split()
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    else:
        parts = zip(*(words[k:] for k in range(shingle)), strict=False)
        hashes = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return np.array(hashes, ">u8")


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero if there are none."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65_536):
        ones += np.unpackbits(h[k:k + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """64-bit fingerprints: ASCII lower case, words between ASCII white space, repeats count."""
    return np.array([majority(shingle_hashes(text, shingle)) for text in texts], np.uint64)


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""
    udf = common.text_udf(lambda t: pa.array(fingerprints(t).view(np.int64)), T.LongType())
    return docs.withColumn(name, udf(F.col(text_col)))


def forest_of(values: np.ndarray, radius: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smallest value of its component) among distinct fingerprints of one bucket."""
    values = np.sort(values)
    bits = values.view(np.uint64)
    label = np.arange(len(values))
    while True:
        new = label.copy()
        for k in range(0, len(bits), block):
            near = np.bitwise_count(bits[k:k + block, None] ^ bits[None, :]) <= radius
            new[k:k + block] = np.where(near, label[None, :], len(bits)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(values)))
    return values[other], values[label[other]]


def _forest_udf(radius: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            offsets, left, right = [0], [], []
            for bucket in column:
                a, b = forest_of(np.array(bucket.values, np.int64), radius)
                left.append(a)
                right.append(b)
                offsets.append(offsets[-1] + len(a))
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), common.struct_array(a=join(left), b=join(right)))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, EDGES).asNondeterministic()


def _spread(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """Each row once per table of the level: (fp, mask, k), k being the kept bits."""
    mask = F.explode(F.array(*[F.lit(signed(m)) for m in masks(radius, level)]))
    rows = rows.select("fp", mask.alias("m"), "mask").select("fp", F.col("mask").bitwiseOR(F.col("m")).alias("mask"))
    return rows.withColumn("k", F.col("fp").bitwiseAND(F.col("mask")))


def links(points: DataFrame, radius: int = 3, most: int = 16_384) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``fp`` within ``radius`` bits."""
    keyed, edges = _spread(points.select("fp", F.lit(0).cast("long").alias("mask")), 0, radius), None
    for level in range(LEVELS):
        size = keyed.groupBy("mask", "k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        size = session.cut_lineage(size.where("n > 1"))
        close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
        two = size.where((F.col("n") == 2) & close).select("a", "b")
        rows = keyed.join(size.where("n > 2").select("mask", "k", "n"), ["mask", "k"])
        last = level == LEVELS - 1
        small = (rows.where(F.lit(last) | (F.col("n") <= most)).groupBy("mask", "k").agg(F.collect_list("fp").alias("fps"))
                 .select(F.explode(_forest_udf(radius)("fps")).alias("e")).select("e.a", "e.b"))
        edges = two.unionByName(small) if edges is None else edges.unionByName(two).unionByName(small)
        if last or size.where(F.col("n") > most).isEmpty():
            break
        keyed = _spread(rows.where(F.col("n") > most), level + 1, radius).distinct()
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``: root is its component's smallest node.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the smallest
    node it knows. Minima are pre-aggregated before the shuffle; a checkpoint ends each round.
    """
    now = session.cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = (small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = session.cut_lineage(now)
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen


def classes(points: DataFrame, radius: int = 3, most: int = 16_384, id_col: str = "doc_id") -> DataFrame:
    """(fp, component_id, rows) of every distinct fingerprint of ``points`` (``id_col``, fp)."""
    own = session.cut_lineage(points.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("rows")))
    roots = components(links(own, radius, most)).withColumnRenamed("node", "fp")
    named = own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id", "rows")


def near_duplicates(docs: DataFrame, radius: int = 3, most: int = 16_384, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, fingerprint (hex), component_id (smallest id reachable)."""
    points = session.cut_lineage(with_fingerprint(docs.select(id_col, F.col(text_col).alias("text"))).select(id_col, "fp"))
    found = points.join(classes(points, radius, most, id_col), "fp", "left")
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3, most: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of every component, once, with its columns.

    Repeated rows of one id count as one document. Rows without id are kept only where their whole
    component lacks ids, one for each such component's equal fingerprint.
    """
    columns = docs.columns
    points = session.cut_lineage(with_fingerprint(docs.select(id_col, F.col(text_col).alias("text"))).select(id_col, "fp"))
    found = classes(points, radius, most, id_col)
    keep = found.where(F.col("component_id").isNotNull()).select(F.col("component_id").alias(id_col)).distinct()
    kept = docs.join(keep.hint("shuffle_hash"), id_col, "left_semi").select(columns)
    if not points.groupBy(id_col).count().where(F.col("count") > 1).where(F.col(id_col).isNotNull()).isEmpty():
        kept = kept.dropDuplicates([id_col])
    nameless = found.where(F.col("component_id").isNull())
    if nameless.isEmpty():
        return kept
    lone = with_fingerprint(docs.where(F.col(id_col).isNull()), text_col, "_fp").join(
        nameless.select(F.col("fp").alias("_fp")), "_fp", "left_semi").dropDuplicates(["_fp"]).select(columns)
    return kept.unionByName(lone)
