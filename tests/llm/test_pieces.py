import hashlib
import random

import pytest
import sentencepiece

from riskspark.llm import pieces, queries

SCHEMA = "doc_id long, text string, IDS string, n_tokens int"
PARTS = [" ", "  ", "a", "▁", "é", "𝛼", "\n", "\t", "\0", "hello", "日本", " x", "​", "　", "<s>", "</s>", "ﬁ", "\r", "<0x0A>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def texts():
    rnd = random.Random(0)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(14))) for _ in range(3000)] + [None, "", "x " * 60_000, "y" * 20_000]


def test_ids_and_decoding_equal_the_library(spark, library):
    data = [(i, t, "x", 0) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in pieces.digest(spark.createDataFrame(data, SCHEMA)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t, *_ in data:
        ids = library.encode(t or "", add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_spans_tile_the_text_and_round_trip(spark, library):
    data = [(i, t, "x", 0) for i, t in enumerate(texts())]
    df = pieces.decode(pieces.encode(spark.createDataFrame(data, SCHEMA)))
    assert df.columns == ["doc_id", "text", "n_tokens", "ids", "starts", "ends", "decoded"]
    for r in df.collect():
        raw = (r.text or "").encode()
        assert r.ids == library.encode(r.text or "", add_eos=True) and r.decoded == library.decode(r.ids)
        assert r.starts[-1] == r.ends[-1] == len(raw)
        assert r.starts[1:] == r.ends[:-1] and (not raw or r.starts[0] == 0)
        for k, (i, a, b) in enumerate(zip(r.ids[:-1], r.starts, r.ends, strict=False)):
            piece = library.id_to_piece(i).replace("▁", " ").encode()
            if not library.is_byte(i):
                assert raw[a:b].replace("▁".encode(), b" ") == (piece[1:] if k == 0 else piece)


def test_compiled_map_against_the_library():
    """The library's own compiled map: same text, and a span for every normalised byte."""
    model = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model.serialized_model_proto())
    charmap = spec.normalizer_spec.precompiled_charsmap
    assert len(charmap) > 1000
    mine = pieces.Normalizer(charmap, spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces)
    rnd = random.Random(1)
    parts = ["ＡＢＣ", "ﬁ", "①", "é", "é", "　", " ", "x", "\t", "㌔", "ｶﾞ", "日", "​", "Å", "½"]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(10)))
        out, origin = mine(text.encode())
        assert out.decode().replace(" ", "▁") == model.normalize(text), text
        assert len(origin) == len(out) + 1 and (origin[1:] >= origin[:-1]).all() and origin[-1] == len(text.encode())


def test_empty_table_and_query(spark, sf, library):
    assert pieces.encode(spark.createDataFrame([], SCHEMA)).count() == 0
    got = queries.QUERIES["op3_sentencepiece_spans"](spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in got.collect():
        assert r.n_tokens == len(library.encode(docs[r.doc_id], add_eos=True))


def test_digests_encode_with_spans(spark, monkeypatch):
    data = [(i, t, "x", 0) for i, t in enumerate(texts()[-200:])]
    model = pieces.load(pieces.model_path())
    for r in pieces.digest(spark.createDataFrame(data, SCHEMA)).collect():
        _, starts, ends = model.encode(r.text or "")
        assert r.spans_sha256 == hashlib.sha256(b"".join(x.astype("<i4").tobytes() for x in (starts, ends))).hexdigest()
    seen = []
    plain = model.normalize
    monkeypatch.setattr(model, "normalize", lambda data: seen.append(data) or plain(data))
    assert len(list(model.digests(["a b", "", "▁x"]))) == 3 and seen == [b"a b", b"", "▁x".encode()]
    monkeypatch.setattr(model, "normalize", lambda data: (plain(data)[0], plain(data)[1] + 1))
    with pytest.raises(ValueError, match="tile"):
        list(model.digests(["a b"]))
