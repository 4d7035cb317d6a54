"""Language-model scores by online logistic context mixing, and unigram base scores.

Texts are lower-cased (A-Z) and end with an end symbol. A symbol is spelled by a Huffman code; every bit
of it is predicted from the contexts of the last 0 to 3 bytes. A context and a node of the code tree hash
to a slot that holds how often each bit followed in the training texts. The predictors' logits are mixed
by weights that a gate chooses: how well the two longest contexts are known. The gated weights come from
rounds of gradient and curvature sums over all training texts; each document then refines them with its own additive part, which
takes a gradient step after every chunk (chunks grow from 256 to 8,192 symbols), so a text is coded with
what was known before it. The sum of the bits' log-probabilities is the score: total bits over bytes
is the rate.

Gathered from all training texts, whole, in one pass: the counts of words and of symbols with their three
bytes of context, both summed in the task before the shuffle. Texts go through in slices of SLICE
bytes; words are cut, counted and sent as Arrow arrays, without a Python object for each. Code lengths, slots'
counts and the rounds of the weights are sums over the counted symbols. Slots are bounded (SLOTS) and so is
what the driver gets; it reads the slots' counts as packed arrays, one of PARTS at a time.

Base scores need each word's count. Words above one HOT-th of all tokens (at most HOT of them) are looked
up in a broadcast; the others are joined by word, so no key of the join has more than that share.

Null texts count as empty (the end symbol alone). Repeated rows get equal results, rows without doc_id
are in fold 0 and train; an empty table gives no rows; with no training text all counts are zero.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskspark import session
from riskspark.llm import common

END = 256
ORDERS = 4
SLOTS = (1 << 10, 1 << 16, 1 << 19, 1 << 20)
FIRST = (0, *np.cumsum(SLOTS).tolist())
GATES = 8 * 4
HOT = 400_000
ROUNDS, RIDGE = 6, 64.0
HELD_KEYS = 1_000_000
CHUNKS = [256, 256, 512, 1024, 2048, 4096]  # then 8,192
HELD_WORDS = 1_000_000
SLICE = 500_000
PARTS = 16


@dataclass(frozen=True)
class Code:
    """Huffman code: per symbol the start and length of its path; along paths the nodes and bits."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def build_code(counts: np.ndarray) -> Code:
    heap = [(int(c) + 1, s, None) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    fresh = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], fresh, (a, b)))
        fresh += 1
    paths, stack = {}, [(heap[0], [])]
    while stack:
        (_, name, inner), path = stack.pop()
        if inner is None:
            paths[name] = path
        else:
            stack += [(child, [*path, (name - len(counts), bit)]) for bit, child in enumerate(inner)]
    length = np.array([len(paths[s]) for s in range(len(counts))])
    flat = [x for s in range(len(counts)) for x in paths[s]]
    return Code(np.cumsum(length) - length, length, np.array([n for n, _ in flat]), np.array([b for _, b in flat]))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol its three bytes of context and itself (24 + 9 bits), and the symbols per text."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b"\0\0\0" + b"\0".join([*texts, b""]), np.uint8)
    start = np.cumsum(lengths) - lengths
    key = data[:-3].astype(np.int64)
    for k, bits in ((1, 8), (2, 8), (3, 9)):
        key <<= bits
        key |= data[k:len(data) - 3 + k]
    for k in range(3):  # nothing of the text before
        key[start[lengths > k] + k] &= (1 << 8 * k + 9) - 1
    key[start + lengths - 1] |= END
    return key, lengths


def split_words(texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts in order, and the text of each."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    inside = (data != 32) & (data - np.uint8(9) > 4)
    change = np.flatnonzero(inside[1:] != inside[:-1])
    edge = np.concatenate([[0], np.cumsum(change[1::2] - change[::2])]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge), pa.py_buffer(data[inside]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.searchsorted(ends, change[::2], "right")


def expand(code: Code, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots [order, bit], bits, and the number of bits, of each key."""
    symbol, context = keys & 511, keys >> 9
    bits = code.length[symbol]
    owner = np.repeat(np.arange(len(keys)), bits)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(bits) - bits, bits) + code.start[symbol][owner]
    node = code.node[at].astype(np.uint64)
    slots = np.empty((ORDERS, len(owner)), np.int64)
    slots[0] = node
    for m in range(1, ORDERS):
        seen = (context & ((1 << 8 * m) - 1)).astype(np.uint64)[owner]
        mixed = (seen * np.uint64(0x9E3779B97F4A7C15) + node * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(m)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        slots[m] = (mixed >> np.uint64(64 - SLOTS[m].bit_length() + 1)).astype(np.int64)
    slots += np.array(FIRST[:ORDERS])[:, None]
    return slots, code.bit[at], bits


@dataclass(frozen=True)
class Mixer:
    """Code, logit of every slot, log2 class of its count, and gated weights [gate, order]."""

    code: Code
    logit: np.ndarray
    known: np.ndarray
    weights: np.ndarray
    counts: np.ndarray | None = None  # only while the weights are learned

    def inputs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per bit the logits signed for the bit that comes [bit, order] and the gate; bits per key."""
        slots, bit, bits = expand(self.code, keys)
        sign = (2 * bit - 1).astype(np.float32)
        gate = self.known[slots[3]].astype(np.int64) * 4 + self.known[slots[2]] // 2
        return (self.logit[slots] * sign).T.copy(), gate, bits

    def inputs_without_own(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``inputs`` as they are for a symbol that was not counted itself: an unseen one."""
        slots, bit, bits = expand(self.code, keys)
        same, other = np.maximum(self.counts[slots, bit] - 1, 0), self.counts[slots, 1 - bit]
        known = np.minimum(np.log2(same[2:] + other[2:] + 1) / 1.5, 7).astype(np.int64)
        return np.log((same + 0.3) / (other + 0.3)).T.copy(), known[1] * 4 + known[0] // 2, bits


def make_mixer(code: Code, counts: np.ndarray) -> Mixer:
    """``counts`` [slot, 2] of zero and one bits; equal starting weights."""
    logit, known = np.empty(len(counts), np.float32), np.empty(len(counts), np.uint8)
    for k in range(0, len(counts), 65_536):
        part = counts[k:k + 65_536]
        total = part.sum(axis=1)
        p = (part[:, 1] + 0.3) / (total + 0.6)
        logit[k:k + 65_536] = np.log(p / (1 - p))
        known[k:k + 65_536] = np.minimum(np.log2(total + 1) / 1.5, 7)
    return Mixer(code, logit, known, np.full((GATES, ORDERS), 1 / ORDERS, np.float32), counts.astype(np.float32))


def weight_sums(mixer: Mixer, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per gate the gradient and the curvature [gate, order, 1 + order] of the weights over ``n`` times each key.

    Every symbol is predicted from the counts without itself, else the longest context seems sure.
    """
    out = np.zeros((GATES, ORDERS, 1 + ORDERS))
    for k in range(0, len(keys), 65_536):
        x, gate, bits = mixer.inputs_without_own(keys[k:k + 65_536])
        times = np.repeat(n[k:k + 65_536], bits)
        miss = 1 / (1 + np.exp(np.clip((x * mixer.weights[gate]).sum(axis=1, dtype=np.float64), -30, 30)))
        bend = times * miss * (1 - miss)
        for i in range(ORDERS):
            out[:, i, 0] += np.bincount(gate, times * miss * x[:, i], GATES)
            for j in range(ORDERS):
                out[:, i, 1 + j] += np.bincount(gate, bend * x[:, i] * x[:, j], GATES)
    return out


def step(mixer: Mixer, sums: np.ndarray) -> Mixer:
    """One damped Newton step of every gate's weights, no longer than one."""
    move = np.linalg.solve(sums[:, :, 1:] + RIDGE * np.eye(ORDERS), sums[:, :, :1])[:, :, 0]
    move /= np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 1)
    return replace(mixer, weights=np.round(mixer.weights + move, 5).astype(np.float32))


def learn_weights(mixer: Mixer, texts: list[bytes]) -> Mixer:
    """The rounds over a few texts."""
    keys, n = np.unique(grams(texts)[0], return_counts=True) if texts else (np.zeros(0, np.int64),) * 2
    for _ in range(ROUNDS):
        mixer = step(mixer, weight_sums(mixer, keys, n))
    return mixer


def score_texts(mixer: Mixer, texts: list[bytes], rate: float = 0.05) -> np.ndarray:
    """log10 probability of every (lower-cased) text with its end symbol."""
    keys, lengths = grams(texts)
    encoded = pa.array(keys).dictionary_encode()
    place, distinct = encoded.indices.to_numpy(), encoded.dictionary.to_numpy()
    x, gate, bits = mixer.inputs(distinct)
    plain = np.einsum("ij,ij->i", x, mixer.weights.take(gate, axis=0))
    orders = x.T.copy()
    first = np.cumsum(bits) - bits
    start = np.cumsum(lengths) - lengths
    own = np.zeros((len(texts), ORDERS), np.float32)  # each text's additive part of the weights
    total = np.zeros(len(texts))
    done, step = np.zeros(len(texts), np.int64), 0
    live = np.arange(len(texts))
    while len(live):
        size = np.minimum(CHUNKS[step] if step < len(CHUNKS) else 8192, lengths[live] - done[live])
        symbol = np.repeat(start[live] + done[live] - (np.cumsum(size) - size), size)
        symbol += np.arange(len(symbol))
        gram = place.take(symbol)
        n, begin = bits.take(gram), first.take(gram)
        at = np.ones(n.sum(), np.int64)  # a symbol's bits follow each other
        at[0] = begin[0]
        at[np.cumsum(n[:-1])] += begin[1:] - begin[:-1] - n[:-1]
        np.cumsum(at, out=at)
        seen = [v.take(at) for v in orders]
        z = plain.take(at)
        parts = np.add.reduceat(n, np.cumsum(size) - size)  # bits of each text's chunk
        end = np.cumsum(parts)
        if step:  # no text has a part of its own before
            for i, j, weights in zip((end - parts).tolist(), end.tolist(), own[live], strict=True):
                a, b, c, d = (v[i:j] * w for v, w in zip(seen, weights, strict=True))
                z[i:j] += (a + b) + (c + d)
        np.clip(z, -30, 30, out=z)
        odds = np.exp(np.negative(z, out=z), out=z)
        total[live] -= np.add.reduceat(np.log1p(odds), end - parts, dtype=np.float64)
        odds /= 1 + odds
        grad = np.stack([np.add.reduceat(np.multiply(v, odds, out=v), end - parts) for v in seen], axis=1)
        own[live] += rate * grad / np.sqrt(parts)[:, None] / (1 + 0.25 * step)
        done[live] += size
        live = live[done[live] < lengths[live]]
        step += 1
    return total / math.log(10)


def _summed(counted: list[pa.StructArray]) -> pa.RecordBatch:
    """Counts (values, counts) of several slices as one; a value comes once."""
    held = pa.Table.from_batches([pa.RecordBatch.from_struct_array(c) for c in counted]).group_by("values", use_threads=False)
    return held.aggregate([("counts", "sum")]).rename_columns(["values", "counts"]).combine_chunks().to_batches()[0]


class _Held:
    """Counts of the slices so far; what they come to once they are many."""

    def __init__(self, most: int) -> None:
        self.most, self.counted = most, []

    def add(self, counted: pa.StructArray) -> Iterator[pa.RecordBatch]:
        self.counted.append(counted)
        if sum(map(len, self.counted)) > self.most:
            whole = _summed(self.counted)
            self.counted = [whole.to_struct_array()]
            if 2 * len(whole) > self.most:
                self.counted = []
                yield whole

    def rest(self) -> Iterator[pa.RecordBatch]:
        if sum(map(len, self.counted)):
            yield _summed(self.counted)


def _counts(docs: DataFrame) -> DataFrame:
    """(word, key, n) over all texts: words (no key), and symbols with their context as keys (no word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys = _Held(HELD_WORDS), _Held(HELD_KEYS)
        pack = lambda w, k, n: pa.RecordBatch.from_arrays([w, k, n], names=["word", "key", "n"])
        pack_words = lambda b: pack(b[0], pa.nulls(len(b), pa.int64()), b[1])
        pack_keys = lambda b: pack(pa.nulls(len(b), pa.string()), b[0], b[1])
        for batch in batches:
            for part in common.slices(common.byte_texts(batch.column(0)), SLICE):
                part = [t.lower() for t in part]
                yield from map(pack_words, words.add(split_words(part)[0].value_counts()))
                yield from map(pack_keys, keys.add(pa.array(grams(part)[0]).value_counts()))
        yield from map(pack_words, words.rest())
        yield from map(pack_keys, keys.rest())

    return docs.select("text").mapInArrow(run, "word string, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n"))


def _numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]


def _slot_counts(keys: DataFrame, code: Code) -> np.ndarray:
    """[slot, 2] of zero and one bits over counted keys, summed in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * FIRST[ORDERS])
        for batch in batches:
            numbers = _numbers(batch)
            for k in range(0, len(numbers[0]), 65_536):
                key, n = (x[k:k + 65_536] for x in numbers)
                slots, bit, bits = expand(code, key)
                weight = np.repeat(n, bits)
                for m in range(ORDERS):
                    low, high = 2 * FIRST[m], 2 * FIRST[m + 1]
                    table[low:high] += np.bincount(2 * slots[m] + bit - low, weight, high - low)
        seen = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(table[seen].astype(np.int64))], names=["s", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in _numbers(batch)], names=["s", "n"])

    summed = keys.mapInArrow(run, "s int, n long").groupBy("s").agg(F.sum("n").alias("n")).repartition(PARTS, "s")
    table = np.zeros(2 * FIRST[ORDERS])
    for r in summed.mapInArrow(pack, "s binary, n binary").toLocalIterator():  # a part at a time
        table[np.frombuffer(r.s, np.int32)] = np.frombuffer(r.n, np.int64)
    return table.reshape(-1, 2)


def _learn(keys: DataFrame, mixer: Mixer) -> Mixer:
    """The rounds over counted keys; a task gives one small array."""
    shared = keys.sparkSession.sparkContext.broadcast(replace(mixer, logit=None, known=None))
    for _ in range(ROUNDS):
        def run(batches: Iterator[pa.RecordBatch], weights=mixer.weights) -> Iterator[pa.RecordBatch]:
            now, sums = replace(shared.value, weights=weights), np.zeros((GATES, ORDERS, 1 + ORDERS))
            for batch in batches:
                sums += weight_sums(now, *_numbers(batch))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], names=["i", "v"])

        sums = np.zeros((GATES, ORDERS, 1 + ORDERS))
        for r in keys.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            sums.flat[r.i] = r.v
        mixer = step(mixer, sums)
    shared.destroy()
    return replace(mixer, counts=None)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """One row per row of ``docs``: held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    spark = docs.sparkSession
    docs = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = docs.where(common.fold(F.col(id_col), folds) != held)

    counts = session.cut_lineage(_counts(training))
    keys = counts.where(F.col("key").isNotNull()).select("key", "n")
    seen = np.zeros(END + 1, np.int64)
    for r in keys.groupBy(F.col("key").bitwiseAND(F.lit(511)).alias("s")).agg(F.sum("n").alias("n")).collect():  # at most END + 1 rows
        seen[r.s] = r.n
    code, ends = build_code(seen), int(seen[END])
    mixer = _learn(keys, make_mixer(code, _slot_counts(keys, code)))

    words = counts.where(F.col("key").isNull()).select("word", "n")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = facts.n + ends, facts.v + (ends > 0)
    floor = math.log10(tokens + kinds + 1)
    found = words.where(F.col("n") * HOT > tokens).select(F.col("word").cast("binary"), "n").toArrow()  # at most HOT words
    hot = dict(zip(*(c.to_pylist() for c in found.columns), strict=True))
    shared = spark.sparkContext.broadcast((mixer, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, hot = shared.value
        logs = {w: math.log10(n + 1) - floor for w, n in hot.items()}
        last = math.log10(ends + 1) - floor
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for part in common.slices(common.byte_texts(batch.column(1)), SLICE):
                part = [t.lower() for t in part]
                rid = np.array(ids[at:at + len(part)], np.int64)
                at += len(part)
                words, owner = split_words(part)
                words = words.dictionary_encode()
                kinds = words.dictionary
                value = np.array([logs.get(w, math.nan) for w in kinds.cast(pa.binary()).to_pylist()])
                pairs = pa.array(owner * max(len(kinds), 1) + words.indices.to_numpy()).value_counts()
                times = pairs.field("counts").to_numpy()
                owner, word = np.divmod(pairs.field("values").to_numpy(), max(len(kinds), 1))
                value = value[word]
                cold = np.isnan(value)
                total = lambda v: np.bincount(owner, v, len(part))
                cols = {
                    "base": last + total(np.where(cold, 0, times * value)),
                    "known": int(ends > 0) + total(np.where(cold, 0, times)).astype(np.int64),
                    "n_tokens": 1 + total(times).astype(np.int64),
                    "score": score_texts(mixer, part),
                    "n_bytes": np.array([len(t) for t in part], np.int64)}
                joined = {
                    "rid": pa.array(np.concatenate([rid, rid[owner[cold]]])),
                    "word": pa.concat_arrays([pa.array([f" {r}" for r in rid.tolist()], pa.string()), kinds.take(pa.array(word[cold]))]),
                    "times": pa.array(np.concatenate([np.zeros(len(part), np.int64), times[cold]]))}
                empty = lambda v: pa.nulls(int(cold.sum()), v.type)
                cols = joined | {k: pa.concat_arrays([v, empty(v)]) for k, v in ((k, pa.array(v)) for k, v in cols.items())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    keyed = docs.withColumn("rid", F.monotonically_increasing_id())
    spread = keyed.select("rid", "text").mapInArrow(run, "rid long, word string, times long, base double, known long, n_tokens long, score double, n_bytes long")
    joined = spread.join(words, "word", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    sums = joined.groupBy("rid").agg(
        (F.sum(F.col("times") * (F.log10(n + 1) - floor)) + F.max("base")).alias("base_score"),
        (F.sum(F.when(n > 0, F.col("times")).otherwise(0)) + F.max("known")).alias("n_known"),
        F.max("n_tokens").alias("n_tokens"), F.max("score").alias("score"), F.max("n_bytes").alias("n_bytes"))
    named = keyed.select("rid", id_col)
    return named.join(sums, "rid").select(
        id_col, (common.fold(F.col(id_col), folds) == held).alias("held_out"), "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")
