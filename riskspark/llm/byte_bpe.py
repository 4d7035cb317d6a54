"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside Spark's partitions.

A text is cut by the vocabulary's pattern into words. A word that is a token is that token. Every other
word becomes token-position rows, one per byte, in a DuckDB table of its own partition; a recursive
query joins neighbouring tokens with the merge table and contracts each word's leftmost pair of minimum
rank, until no pair of any word is in the table. Decoding unnests ids with their positions, joins them
with the vocabulary and aggregates the bytes in order. Words repeat, so a bounded cache holds the ids of
those seen last; new words go through the query in chunks of bounded size.

Long words (a run of letters may be a whole text) are first cut where no token holds the two bytes
beside the cut, which no merge can cross. What is left long takes a recursion with one row per word
that is replaced in every step (``using key``), so that its memory stays that of the word, and that
contracts all disjoint pairs of the minimum rank at once; for the tokens after which a lower rank may
appear (found when the vocabulary is read) it contracts the leftmost one only. Ids are the same.

Null and empty texts have no ids and decode to nothing; null ids or nulls among them count as absent,
ids outside the vocabulary are an error; repeated rows get equal results; empty tables give no rows.
Result columns replace input columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskspark.llm import common

CACHED = 250_000  # words whose ids a Python worker keeps, and as many older ones
CHUNK_WORDS, CHUNK_BYTES = 40_000, 600_000  # of one recursive query
LONG = 512  # bytes of a word from which one step contracts all its pairs of the minimum rank
DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                       T.StructField("decoded_sha256", T.StringType())])

# ``place`` orders all rows: 1,024 to a word. A pair and its place are one number, so that the least is the leftmost
# of minimum rank; words without a pair leave the recursion.
CONTRACT = """
with recursive t(live, word, place, token) as (
  select true, word, word * 1024::bigint + pos, token from start
  union all
  (with beside as (select word, place, token, lead(token) over w as after, lead(word) over w as next_word, lag(place) over w as before
                   from t where live window w as (order by place)),
        paired as (select b.*, m.made from beside b left join merges m on m.pair = b.token * 65536::bigint + b.after and b.word = b.next_word),
        best as (select word, coalesce(min(made * 34359738368 + place), -1) as code from paired group by word)
   select code >= 0, word, place, case when place = code % 34359738368 then (code // 34359738368)::int else token end
   from paired join best using (word) where code < 0 or before is null or before <> code % 34359738368))
select word, list(token order by place) as ids from t where not live group by word"""
SPELL = CONTRACT[:CONTRACT.rindex("select word, list")] + """
select string_agg(token::varchar, ' ' order by place) as ids, string_agg(piece, '' order by place) as decoded
from t join vocabulary on id = token where not live group by word order by word"""
CONTRACT_LONG = """
with recursive t(word, ids) using key (word) as (
  select word, list(token order by pos) from start group by word
  union
  (with rows as (select word, unnest(ids) as token, generate_subscripts(ids, 1) as pos from t),
        beside as (select *, lead(token) over (partition by word order by pos) as after from rows),
        paired as (select b.*, m.made, m.alone from beside b left join merges m on m.pair = b.token * 65536::bigint + b.after),
        best as (select word, min(made) as made, min_by(pos, made * 4294967296::bigint + pos) as first,
                        min_by(alone, made) as alone from paired where made is not null group by word),
        fits as (select p.word, p.pos, p.token, b.made,
                        coalesce(p.made = b.made, false) and (not b.alone or p.pos = b.first) as fit
                 from paired p join best b using (word)),
        runs as (select *, max(case when fit then 0 else pos end) over (partition by word order by pos) as gap from fits),
        taken as (select *, fit and (pos - gap) % 2 = 1 as take from runs),
        kept as (select *, lag(take, 1, false) over (partition by word order by pos) as gone from taken)
   select word, list(case when take then made else token end order by pos) from kept where not gone group by word))
select word, ids from t"""
# Bytes as characters of the same number, so that they aggregate as text.
DECODE = """
select text, string_agg(piece, '' order by pos) as piece
from (select text, unnest(ids) as id, generate_subscripts(ids, 1) as pos from given) join vocabulary using (id) group by text"""


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def spelled_out(pattern: str, limit: int) -> re.Pattern:
    """The pattern for ``re``, for texts of characters below ``limit``: its classes of letters, numbers and
    white space are spelled out, which is what makes ``re`` the faster one."""
    import regex

    every = "".join(chr(c) for c in range(limit) if not 0xD800 <= c < 0xE000)
    names = {r"\p{L}": "", r"\p{N}": "", r"\s": ""}
    for name in names:
        codes = np.array([ord(c) for c in regex.findall(name, every)])
        edges = np.flatnonzero(np.diff(codes) > 1)
        ranges = zip(codes[np.append(0, edges + 1)], codes[np.append(edges, len(codes) - 1)], strict=True)
        names[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((n for n in names if pattern.startswith(n, at)), None)
        if pattern.startswith(r"\S", at) and not inside:
            out.append("[^" + names[r"\s"] + "]")
            at += 2
        elif name:
            out.append(names[name] if inside else f"[{names[name]}]")
            at += len(name)
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
            at += 1
    return re.compile("".join(out))


class Cutter:
    """Words of a text by the vocabulary's pattern."""

    def __init__(self, pattern: str):
        import regex

        self.plain, self.usual, self.every = spelled_out(pattern, 0x80), spelled_out(pattern, 0x10000), regex.compile(pattern)
        self.rare = re.compile("[\U00010000-\U0010ffff]")

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain.findall(text)
        return (self.every if self.rare.search(text) else self.usual).findall(text)


class Vocabulary:
    """Ranks, the merge table, and a DuckDB connection that holds both."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = Cutter(pattern)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.cache: dict[str, str] = {}  # ids of words, joined by spaces
        self.older: dict[str, str] = {}
        self.other: dict[str, bytes] = {}  # words whose ids do not decode to their own bytes
        self.beside = np.zeros((256, 256), bool)
        made: list[tuple[int, int, int]] = []
        alone: set[int] = set()
        none = 1 << 40
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                u, v = token[:i], token[i:]
                self.beside[u[-1], v[0]] = True
                if u not in self.ranks or v not in self.ranks:
                    continue
                a, b = self.ranks[u], self.ranks[v]
                made.append((a, b, rank))
                # A pair that made v may stand beside u: if then u + v ranks lower than v did, order matters.
                if b > rank and any(self.ranks.get(u + x, none) >= b for x, _ in self._splits(v)):
                    alone.add(b)
                if a > rank and any(self.ranks.get(y + v, none) >= a for _, y in self._splits(u)):
                    alone.add(a)
        merges = np.array(made, np.int32).reshape(-1, 3)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self._table("merges", pair=merges[:, 0].astype(np.int64) << 16 | merges[:, 1], made=merges[:, 2], alone=np.isin(merges[:, 2], list(alone)))
        ids = sorted(self.ranks.items(), key=lambda x: x[1])
        self._table("vocabulary", id=np.array([r for _, r in ids], np.int32), piece=[t.decode("latin-1") for t, _ in ids])
        self.known = np.zeros(max(self.ranks.values()) + 1, bool)
        self.known[list(self.ranks.values())] = True

    def _splits(self, token: bytes) -> Iterator[tuple[bytes, bytes]]:
        for i in range(1, len(token)):
            if token[:i] in self.ranks and token[i:] in self.ranks:
                yield token[:i], token[i:]

    def _table(self, name: str, **columns) -> None:
        self.db.register("_given", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from _given")
        self.db.unregister("_given")

    def _rows(self, parts: list[bytes]) -> pa.Table:
        """Token-position rows of byte strings, one per byte."""
        lengths = np.array([len(p) for p in parts])
        word = np.repeat(np.arange(len(parts), dtype=np.int32), lengths)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return pa.table({"word": word, "pos": pos.astype(np.int32), "token": self.byte[np.frombuffer(b"".join(parts), np.uint8)]})

    def _query(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.db.register(name, table)
        found = self.db.sql(sql).to_arrow_table()
        for name in tables:
            self.db.unregister(name)
        return found

    def _contract(self, parts: list[bytes], sql: str) -> list[list[int]]:
        """Ids of byte strings: token-position rows, contracted until no pair is left."""
        done = self._query(sql, start=self._rows(parts))
        ids = dict(zip(done.column("word").to_pylist(), done.column("ids").to_pylist(), strict=True))
        return [ids[k] for k in range(len(parts))]

    def _pieces(self, word: bytes) -> list[bytes]:
        """The word, cut between bytes that no token holds side by side."""
        raw = np.frombuffer(word, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.beside[raw[:-1], raw[1:]]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _long(self, word: bytes) -> list[int]:
        """Ids of one long word from those of its pieces."""
        pieces = self._pieces(word)
        done: dict[bytes, list[int]] = {p: self._contract([p], CONTRACT_LONG)[0] for p in set(pieces) if len(p) > LONG}
        rest = [p for p in set(pieces) if len(p) <= LONG]
        for part in self._chunks(rest):
            done.update(zip(part, self._contract(part, CONTRACT), strict=True))
        return [i for p in pieces for i in done[p]]

    def _chunks(self, words: list[bytes]) -> Iterator[list[bytes]]:
        start = size = 0
        for i, word in enumerate(words):
            if i > start and (i - start == CHUNK_WORDS or size + len(word) > CHUNK_BYTES):
                yield words[start:i]
                start, size = i, 0
            size += len(word)
        if start < len(words):
            yield words[start:]

    def words(self, texts: list[str]) -> list[list[str]]:
        """The words of every text; the cache then holds the ids of all of them.

        The words of the last texts are kept, and of those before them the ones that came again.
        """
        cuts = [self.find(t) for t in texts]
        new = set().union(*cuts) - self.cache.keys()
        if len(self.cache) + len(new) > CACHED:
            self.older, self.cache = self.cache, {}
            new = set().union(*cuts)
        again = new & self.older.keys()
        self.cache.update((w, self.older[w]) for w in again)
        left, raws = [], []
        for word in new - again:
            raw = word.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.cache[word] = str(rank)
            elif len(raw) > LONG:
                ids = self._long(raw)
                self._keep([word], [" ".join(map(str, ids))], self.decode([ids]))
            else:
                left.append(word)
                raws.append(raw)
        at = 0
        for part in self._chunks(raws):
            found = self._query(SPELL, start=self._rows(part))
            decoded = [d.encode("latin-1") for d in found.column("decoded").to_pylist()]
            self._keep(left[at:at + len(part)], found.column("ids").to_pylist(), decoded)
            at += len(part)
        return cuts

    def _keep(self, words: list[str], ids: list[str], decoded: list[bytes]) -> None:
        self.cache.update(zip(words, ids, strict=True))
        self.other.update((w, d) for w, d in zip(words, decoded, strict=True) if d != w.encode())

    def decode(self, rows: list[list[int]]) -> list[bytes]:
        """The bytes of every list of ids."""
        out = [b""] * len(rows)
        flat = np.array([i for ids in rows for i in ids], np.int64)
        if len(flat) == 0:
            return out
        if flat.min() < 0 or flat.max() >= len(self.known) or not self.known[flat].all():
            raise ValueError("ids outside the vocabulary")
        edge = np.cumsum([0, *map(len, rows)])
        lists = pa.LargeListArray.from_arrays(pa.array(edge), pa.array(flat.astype(np.int32)))
        found = self._query(DECODE, given=pa.table({"text": np.arange(len(rows), dtype=np.int64), "ids": lists}))
        for k, piece in zip(found.column("text").to_pylist(), found.column("piece").to_pylist(), strict=True):
            out[k] = piece.encode("latin-1")
        return out

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """``DIGEST`` of every text. Ids and bytes of a text are those of its words in their order, so each
        distinct word was encoded, and its ids decoded, once (a token stands for its own bytes)."""
        for cut in self.words(texts):
            spelled = " ".join([self.cache[w] for w in cut])
            if self.other:
                decoded = b"".join([self.other.get(w) or w.encode() for w in cut])
            else:
                decoded = "".join(cut).encode()
            yield (spelled.count(" ") + 1 if cut else 0, hashlib.sha256(spelled.encode()).hexdigest(),
                   hashlib.sha256(decoded).hexdigest())


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _run(fn, schema: T.DataType, place: tuple[str, str]):
    """An Arrow UDF over slices of texts; a worker keeps the vocabulary and a bounded number of words."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [fn([t.decode() for t in part]) for part in common.slices(common.byte_texts(column), 2_000_000)]
            yield pa.concat_arrays(parts) if parts else fn([])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema).asNondeterministic()


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the tokens of ``text_col``."""
    place = (path or vocabulary_path(), pattern or word_pattern())

    def run(texts: list[str]) -> pa.Array:
        model = load(*place)
        rows = [[int(i) for i in " ".join([model.cache[w] for w in cut]).split()] for cut in model.words(texts)]
        return common.struct_array(ids=pa.array(rows, pa.list_(pa.int32())))

    schema = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return common.add_fields(docs, _run(run, schema, place)(F.col(text_col)), ["ids"])


def decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with ``name``, the bytes (a binary column; any ids, so not always UTF-8) of ``ids_col``."""
    place = (path or vocabulary_path(), pattern or word_pattern())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            rows = [[i for i in x or [] if i is not None] for x in column.to_pylist()]
            yield pa.array(load(*place).decode(rows), pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    raw = F.arrow_udf(run, T.BinaryType()).asNondeterministic()(F.col(ids_col))
    return common.add_fields(docs, F.struct(raw.alias(name)), [name])


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``DIGEST``: the number of tokens, and digests of the ids and of what they decode to."""
    place = (path or vocabulary_path(), pattern or word_pattern())

    def run(texts: list[str]) -> pa.Array:
        rows = list(zip(*load(*place).digests(texts), strict=True)) if texts else [()] * 3
        return common.struct_array(n_tokens=pa.array(rows[0], pa.int64()), ids_sha256=pa.array(rows[1], pa.string()),
                                   decoded_sha256=pa.array(rows[2], pa.string()))

    return common.add_fields(docs, _run(run, DIGEST, place)(F.col(text_col)), DIGEST.names)
