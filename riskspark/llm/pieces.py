"""SentencePiece encoding and decoding with byte spans of the original text.

Normalisation walks the model's compiled character map (a double-array trie and its replacements):
at every position the longest prefix that the map holds is replaced, everything else is copied, and
each normalised byte notes the original byte it came from. White space becomes the piece mark, one
unit here. A model without a map (identity) copies everything, so only marks need attention.

No piece has a mark after another character (checked when the model is loaded), so merges never
cross such a place: a text is the concatenation of its segments, each a run of marks and the rest up
to the next. A segment's ids come from the library once and are kept in a bounded cache (models
with another normalisation are encoded as whole texts). Spans follow
from the piece lengths, the running sum of which points into the alignment.

Null text counts as empty: its only id is the end id. Empty tables give no rows. Result columns replace
input columns of the same name.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskspark.llm import common

CACHED = 150_000
SPACE = "▁"
DIGEST = T.StructType([T.StructField("n_tokens", T.LongType())] + [
    T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256", "spans_sha256")])  # spans: starts, then ends, as four bytes each
PIECES = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType()))])


class CharacterMap:
    """A compiled map: byte count of the trie, its units, then replacements ended by zero bytes."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.replacements = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """(bytes read, replacement) of the longest prefix at ``at`` that the map holds; (0, b"") if none."""
        best = (0, b"")
        if not self.units:
            return best
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                best = (i - at + 1, self.replacements[value:self.replacements.index(b"\0", value)])
        return best


class Normalizer:
    """Normalised text and, for each of its bytes, the original byte; blanks stand for piece marks."""

    def __init__(self, charmap: bytes, dummy: bool, squeeze: bool):
        self.map, self.dummy, self.squeeze = CharacterMap(charmap), dummy, squeeze

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not self.map.units:
            out, origin = data, None
            if SPACE.encode() in data:
                out, origin = self._walk(data)
        else:
            out, origin = self._walk(data)
        if origin is None:
            origin = np.arange(len(out) + 1)
        if self.squeeze:
            keep = np.ones(len(out), bool)
            blank = np.frombuffer(out, np.uint8) == 32
            if len(blank):
                keep = ~(blank & np.concatenate([[True], blank[:-1]]))
                if not keep.all() or blank[-1]:
                    tail = len(out.rstrip(b" "))
                    keep[tail:] = False
            out, origin = bytes(np.frombuffer(out, np.uint8)[keep]), np.append(origin[:-1][keep], len(data))
        if self.dummy and out:
            out, origin = b" " + out, np.append(origin[:1], origin)
        return out, origin

    def _walk(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, origin, at = bytearray(), [], 0
        while at < len(data):
            read, new = self.map.longest(data, at)
            if not read:
                first = data[at]
                read = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = data[at:at + read]
                if new == SPACE.encode():
                    new = b" "
                origin += range(at, at + len(new)) if len(new) == read else [at] * len(new)
            else:
                new = new.replace(SPACE.encode(), b" ")
                origin += [at] * len(new)
            out += new
            at += read
        return bytes(out), np.array([*origin, len(data)])


class Model:
    """A loaded model, its normaliser, and the lengths of its pieces."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normal = spec.normalizer_spec
        pieces = [p.piece for p in spec.pieces]
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("pieces of this model cross word starts")
        self.normalize = Normalizer(normal.precompiled_charsmap, normal.add_dummy_prefix, normal.remove_extra_whitespaces)
        self.dummy = normal.add_dummy_prefix
        self.lengths = np.array([1 if p.type == 6 else len(p.piece.replace(SPACE, " ").encode()) for p in spec.pieces])
        self.unknown, self.end, self.mark = self.library.unk_id(), self.library.eos_id(), self.library.piece_to_id(SPACE)
        self.identity = not normal.precompiled_charsmap and not normal.remove_extra_whitespaces
        self.cache: dict[str, list[int]] = {}
        self.names = [str(i) for i in range(len(pieces))]
        self.split = re.compile(" +[^ ]*|[^ ]+")

    def cut(self, text: str) -> list[str]:
        return self.split.findall(" " + text.replace(SPACE, " ")) if text else []

    def segments(self, texts: list[str]) -> list[list[list[int]]]:
        """Ids of the segments of every text; new segments are encoded in one call."""
        cuts = [self.cut(t) for t in texts]
        new = {s for c in cuts for s in c if s not in self.cache}
        if len(self.cache) + len(new) > CACHED:
            self.cache = {}
            new = {s for c in cuts for s in c}
        fresh = [s for s in new if s != " "]
        for s, ids in zip(fresh, self.library.encode([s[1:] for s in fresh], num_threads=1) if fresh else [], strict=True):
            self.cache[s] = ids
        self.cache[" "] = [self.mark]
        return [[self.cache[s] for s in c] for c in cuts]

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(ids with the end id, starts, ends): original byte spans; those of the bytes of one
        character that has no piece are its own bytes; the end id has an empty span at the end."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """``encode`` of every text."""
        own = self.identity and self.dummy
        for text, parts in zip(texts, self.segments(texts) if own else texts, strict=True):
            data = text.encode()
            normal, origin = self.normalize(data)
            ids = [i for p in parts for i in p] if own else self.library.encode(text, num_threads=1)
            lengths = self.lengths[np.array(ids, np.int64)]
            edge = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            if edge[-1] != len(normal):
                raise ValueError("an unknown piece hides its length; the model needs byte fallback")
            yield [*ids, self.end], np.append(origin[edge[:-1]], len(data)), np.append(origin[edge[1:]], len(data))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str, str]]:
        """``DIGEST`` of every text; spans of an unmapped text that do not tile its bytes are an error."""
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for text, (ids, starts, ends) in zip(texts, self.encode_all(texts), strict=True):
            if self.identity and (starts[0] or (starts[1:] != ends[:-1]).any() or ends[-1] != len(text.encode())):
                raise ValueError("spans do not tile the text")
            spelled = " ".join([self.names[i] for i in ids])
            spans = np.stack([starts, ends]).astype("<i4").tobytes()
            yield len(ids), sha(spelled.encode()), sha(self.library.decode(ids, num_threads=1).encode()), sha(spans)


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _texts(column: pa.Array) -> Iterator[list[str]]:
    for part in common.text_slices(column):
        yield [t.decode() for t in part]


def _udf(fn, schema, path: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in batches:
                for texts in _texts(column):  # ids and spans are larger than the texts: a slice's go out before the next
                    yield fn(texts)
        finally:  # workers are used again for other stages; they keep the model, not the segments
            load(path).cache = {}

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema).asNondeterministic()


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (the end id last) and the original byte spans ``starts`` and ``ends``."""
    path = path or model_path()

    def run(texts: list[str]) -> pa.Array:
        rows = [load(path).encode(t) for t in texts]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32))
        flat = [np.concatenate([np.asarray(r[k], np.int32) for r in rows]) if rows else np.zeros(0, np.int32) for k in range(3)]
        return common.struct_array(**{n: pa.ListArray.from_arrays(offsets, pa.array(f)) for n, f in zip(PIECES.names, flat, strict=True)})

    return common.add_fields(docs, _udf(run, PIECES, path)(F.col(text_col)), PIECES.names)


def decode(docs: DataFrame, path: str | None = None, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids_col``; null ids give an empty text."""
    path = path or model_path()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            ids = [x or [] for x in column.to_pylist()]
            yield pa.array(load(path).library.decode(ids, num_threads=1) if ids else [], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    text = F.arrow_udf(run, T.StringType()).asNondeterministic()(F.col(ids_col))
    return common.add_fields(docs, F.struct(text.alias(name)), [name])


def digest(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``DIGEST``: the count and the digests of encoding with spans, and of decoding, each text."""
    path = path or model_path()

    def run(texts: list[str]) -> pa.Array:
        cols = zip(*load(path).digests(texts), strict=True) if texts else [()] * len(DIGEST)
        return common.struct_array(**{f.name: pa.array(list(c), pa.int64() if k == 0 else pa.string()) for k, (f, c) in enumerate(zip(DIGEST, cols, strict=True))})

    return common.add_fields(docs, _udf(run, DIGEST, path)(F.col(text_col)), DIGEST.names)
