import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from riskspark.llm import byte_bpe, queries

SCHEMA = "doc_id long, text string, IDS string, n_tokens int"
PARTS = [" ", "  ", "a", "é", "𝛼", "\n", "\t", "\0", "hello", "日本", " x", "​", "　", "'s", "'ll", "\r", "12", "Ⅷ", "!!", "<|endoftext|>", "\x85", "\x1c"]


@pytest.fixture(scope="module")
def library():
    with open(byte_bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(0)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(14))) for _ in range(2000)]
    letters = "".join(rnd.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(6000))
    return made + [None, "", "x " * 40_000, "y" * 20_000, letters, "日本語" * 700, "0123456789abcdef" * 2000, "_" * 1001 + "ab" * 900]


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_ids_and_bytes_equal_the_library(spark, library):
    data = [(i, t, "x", 0) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in byte_bpe.digest(spark.createDataFrame(data, SCHEMA)).collect()}
    for i, t, *_ in data:
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), sha(" ".join(map(str, ids)).encode()), sha(library.decode_bytes(ids))), (t or "")[:50]


def test_encode_then_decode(spark, library):
    data = [(i, t, "x", 0) for i, t in enumerate(texts())]
    df = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame(data, SCHEMA)))
    assert df.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]  # the clashing input column is replaced
    for r in df.collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_decode_of_any_ids(spark, library):
    rnd = random.Random(1)
    rows = [(i, [rnd.randrange(50256) for _ in range(rnd.randrange(30))]) for i in range(300)] + [(300, None), (301, [None, 7])]
    df = byte_bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"))
    for r in df.collect():
        assert bytes(r.decoded) == library.decode_bytes([i for i in r.ids or [] if i is not None])
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [60000])], "k int, ids array<int>")).collect()


def test_pattern_over_every_character(library):
    model = byte_bpe.load(byte_bpe.vocabulary_path(), byte_bpe.word_pattern())
    import regex

    plain = regex.compile(public_tokenizers.PATTERN)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c} {c}1{c} \n{c}  " for c in every)
    assert model.find(text) == plain.findall(text)


def test_both_recursions_agree_on_a_small_vocabulary(tmp_path, spark):
    """Merges learned from nothing: random tokens, so that a later merge may rank lower (tokens contracted alone)."""
    rnd = random.Random(3)
    for trial in range(6):
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 256 + 60:
            new = b"".join(rnd.choice([b"a", b"b", b"c", *tokens[256:]]) for _ in range(2))
            if new not in tokens and len(new) < 9:
                tokens.append(new)
        order = tokens[256:]
        rnd.shuffle(order)
        path = tmp_path / f"v{trial}"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens[:256] + order)))
        model = byte_bpe.Vocabulary(str(path), public_tokenizers.PATTERN)
        ranks = model.ranks
        for _ in range(40):
            word = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(2, 40)))
            parts = [word[i:i + 1] for i in range(len(word))]
            while True:
                found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
                if not found:
                    break
                i = found[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            want = [ranks[p] for p in parts]
            for sql in (byte_bpe.CONTRACT, byte_bpe.CONTRACT_LONG):
                assert model._contract([word], sql) == [want]


def test_empty_table_and_query(spark, sf, library):
    assert byte_bpe.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op11_duckdb_bpe"](spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == len(docs)
    for r in got.collect():
        ids = library.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((docs[r.doc_id] or "").encode()))
