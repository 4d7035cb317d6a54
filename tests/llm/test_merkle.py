import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskspark.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, digest string, kept int"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text=None):
    out = ""
    for v in (*row[:4], text if text is not None else row[4]):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def tree(level, arity=3):
    """(root, the path of every leaf: (siblings to the left, to the right) per level)."""
    paths, owner = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        up, held = [], []
        for k in range(0, len(level), arity):
            run = level[k:k + arity]
            for i in range(len(run)):
                for x in owner[k + i]:
                    paths[x].append((run[:i], run[i + 1:]))
            up.append(sha("".join(run)))
            held.append(sum(owner[k:k + arity], []))
        level, owner = up, held
    return level[0], paths


def brute(rows):
    """One sorted list of tuples, recomputed in plain Python."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = {}, []
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroot, paths = tree([leaf(r) for r in groups[s]])
        found[s] = paths
        subroots.append(subroot)
    root, above = tree(subroots)
    out = []
    for n, s in enumerate(order):
        for r, path in zip(groups[s], found[s], strict=True):
            path = path + above[n]
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            h = leaf(r) if odd or r[4] is None else leaf(r, r[4].replace("\n", ""))
            for left, right in path:
                h = sha("".join(left) + h + "".join(right))
            proof = sha("".join("".join(left + right) for left, right in path))
            out.append((str(r[0]), leaf(r), subroots[n], root, proof, h, h == root))
    return sorted(out)


def checked(df, **options):
    found = merkle.audit(df, {"text": F.translate("text", "\n", "")}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, **options)
    return sorted((str(r[0]), *r[1:]) for r in found.collect())


@pytest.mark.parametrize("small_bytes", [0, merkle.SMALL_BYTES])
def test_hot_source_nulls_and_repeats_against_plain_python(spark, small_bytes):
    rnd = random.Random(0)
    rows = []
    for i in range(400):
        source = rnd.choice(["a"] * 5 + ["b", "", None, "ä", "zz", "z", *[f"s{k}" for k in range(20)]])
        text = rnd.choice([None, "", "x\ny", "é\n\n", "no line", "\n"])
        rows.append((rnd.choice([i, i, i, None]), source, rnd.choice(["en", None]), rnd.choice([None, 3]), text, 1, "d", 2))
    rows += rows[:30] + [(5000, "lone", None, None, "t\n" * 50_000, 1, None, None)]
    assert checked(spark.createDataFrame(rows, SCHEMA).repartition(7), small_bytes=small_bytes) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_small_trees(spark, n):
    rows = [(i, "s", "en", 1, f"text\n{i}", 0, "", 0) for i in range(n)]
    assert checked(spark.createDataFrame(rows, SCHEMA)) == (brute(rows) if rows else [])


def test_every_source_alone(spark):
    rows = [(i, f"s{i:02}", None, None, "a\n", 0, "", 0) for i in range(13)]
    assert checked(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_proofs_are_files_of_their_own(spark):
    """A proof read back folds to the root with plain code."""
    rows = [(i, "s", "en", 1, f"text {i}", 0, "", 0) for i in range(20)]
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        h = bytes(r.leaf).hex()
        for level in map(bytes, r.siblings):
            left, rest = int(level[:1]), level[1:].hex()
            h = sha(rest[:64 * left] + h + rest[64 * left:])
        assert h == bytes(r.root).hex()


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = queries.QUERIES["op12_merkle_manifest"](spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute(rows)
