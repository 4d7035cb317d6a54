"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``WINDOW`` bytes; all of them are read, in both directions, all windows of
a slice at once. Every position gets a probability for each language; their mean over the whole text is
the document's. The network is trained in numpy by backpropagation through time (Adam, position-wise
cross-entropy) on the driver, from a bounded sample: at most ``max_rows`` training documents, chosen by
a hash of doc_id, and ``PER_DOC`` windows of each at hashed offsets, cut before they are collected.
Languages are weighted equally.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing was
learned. Repeated rows get equal results; empty tables give no rows; result columns replace columns of
the same name.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskspark.llm import common

WINDOW, HIDDEN, PER_DOC = 96, 12, 2
SLICE = 1_500_000
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Network:
    """Per direction: input table [3H, 256], recurrent matrix [3H, H]; output [L, 2H] and bias [L].

    Rows of the gates in order: update, reset, candidate.
    """

    langs: list[str]
    tables: tuple[np.ndarray, np.ndarray]
    recurrent: tuple[np.ndarray, np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def start_network(langs: list[str], seed: int = 11) -> Network:
    rnd = np.random.default_rng(seed)
    draw = lambda *shape: (rnd.normal(size=shape) / np.sqrt(HIDDEN)).astype(np.float32)
    two = lambda n: (draw(3 * HIDDEN, n), draw(3 * HIDDEN, n))
    return Network(langs, two(256), two(HIDDEN), draw(len(langs), 2 * HIDDEN), np.zeros(len(langs), np.float32))


def run_direction(table: np.ndarray, recurrent: np.ndarray, ids: np.ndarray, keep: bool = False):
    """Yields the hidden state [H, N] after each row of ``ids`` [T, N]; with ``keep`` also what backpropagation needs."""
    h = np.zeros((HIDDEN, ids.shape[1]), np.float32)
    for row in ids:
        x = np.take(table, row, axis=1)
        a = recurrent @ h
        gates = x[:2 * HIDDEN]
        gates += a[:2 * HIDDEN]
        gates = sigmoid(gates)
        update, reset = gates[:HIDDEN], gates[HIDDEN:]
        new = x[2 * HIDDEN:]
        new += reset * a[2 * HIDDEN:]
        new = np.tanh(new, out=new)
        before, h = h, h - new
        h *= update
        h += new
        yield (h, before, update, reset, new, a[2 * HIDDEN:]) if keep else h


def backward(table, recurrent, ids, steps, from_above):
    """Gradients of table and recurrent matrix, given those of the hidden states [T, H, N]."""
    d_table, d_recurrent = np.zeros_like(table), np.zeros_like(recurrent)
    dh = np.zeros_like(steps[0][0])
    for t in range(len(ids) - 1, -1, -1):
        _, before, update, reset, new, inner = steps[t]
        dh = dh + from_above[t]
        d_new = dh * (1 - update) * (1 - new * new)
        d_update = dh * (before - new) * update * (1 - update)
        d_reset = d_new * inner * reset * (1 - reset)
        direct = np.concatenate([d_update, d_reset, d_new])
        through = np.concatenate([d_update, d_reset, d_new * reset])
        d_recurrent += through @ before.T
        for k in range(len(direct)):
            d_table[k] += np.bincount(ids[t], direct[k], 256)
        dh = dh * update + recurrent.T @ through
    return d_table, d_recurrent


def train_network(windows: list[bytes], labels: list[str], epochs: int = 5, batch: int = 256, rate: float = 0.02, seed: int = 5) -> Network:
    """Fit on byte windows (zero-padded to WINDOW) with the label of their document at every position."""
    langs = sorted(set(labels))
    net = start_network(langs)
    if len(langs) < 2:
        return net
    target = np.array([langs.index(x) for x in labels])
    weight = (len(target) / len(langs) / np.bincount(target))[target].astype(np.float32)
    ids = np.zeros((len(windows), WINDOW), np.int64)
    for i, w in enumerate(windows):
        ids[i, :len(w)] = np.frombuffer(w, np.uint8)
    length = np.array([len(w) for w in windows])
    params = [*net.tables, *net.recurrent, net.out, net.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    rnd = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rnd.permutation(len(windows))
        for k in range(0, len(order), batch):
            pick = order[k:k + batch]
            x = np.ascontiguousarray(ids[pick].T)
            mask = (np.arange(WINDOW)[:, None] < length[pick]) * weight[pick] / max(1, length[pick].sum())
            ahead = list(run_direction(params[0], params[2], x, keep=True))
            back = list(run_direction(params[1], params[3], x[::-1], keep=True))
            both = np.stack([np.concatenate([f[0], b[0]]) for f, b in zip(ahead, back[::-1], strict=True)])
            logits = params[4] @ both + params[5][:, None]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[:, target[pick], np.arange(len(pick))] -= 1
            d = (p * mask[:, None, :]).astype(np.float32)
            above = params[4].T @ d
            t0, r0 = backward(params[0], params[2], x, ahead, above[:, :HIDDEN])
            t1, r1 = backward(params[1], params[3], x[::-1], back, above[::-1, HIDDEN:])
            grads = [t0, t1, r0, r1, np.einsum("tln,thn->lh", d, both), d.sum(axis=(0, 2))]
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                pace = rate * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                q -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return Network(langs, (params[0], params[1]), (params[2], params[3]), params[4], params[5])


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids [WINDOW, N], used positions of each window, text of each window)."""
    data, lengths = common.concat_bytes(texts)
    count = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(lengths) - lengths)[owner] + nth * WINDOW
    used = np.minimum(WINDOW, lengths[owner] - nth * WINDOW)
    padded = np.append(data, np.zeros(WINDOW, np.uint8))
    place = np.arange(WINDOW)[:, None]
    return np.where(place < used, padded[start + place], 0).astype(np.int64), used, owner


def position_probabilities(net: Network, ids: np.ndarray) -> np.ndarray:
    """[T, L, N]: the probability of each language at every position."""
    logits = np.empty((len(ids), len(net.langs), ids.shape[1]), np.float32)
    for t, h in enumerate(run_direction(net.tables[0], net.recurrent[0], ids)):
        np.matmul(net.out[:, :HIDDEN], h, out=logits[t])
    for t, h in enumerate(run_direction(net.tables[1], net.recurrent[1], ids[::-1])):
        own = logits[len(ids) - 1 - t]
        own += net.out[:, HIDDEN:] @ h
        own += net.bias[:, None]
        np.exp(own, out=own)
        own /= own.sum(axis=0)
    return logits


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """[text, L]: mean of the position probabilities; zeros for an empty text."""
    ids, used, owner = windows_of(texts)
    total = np.zeros((len(texts), len(net.langs)))
    if ids.shape[1]:
        p = position_probabilities(net, ids)
        p *= (np.arange(WINDOW)[:, None] < used)[:, None, :]
        mean = p.sum(axis=0, dtype=np.float64)
        for k in range(len(net.langs)):
            total[:, k] = np.bincount(owner, mean[k], len(texts))
    return total / np.maximum(np.bincount(owner, used, len(texts)), 1)[:, None]


def has_letter(text: bytes) -> bool:
    if len(text.translate(None, LETTERS)) < len(text):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def train(docs: DataFrame, max_rows: int = 4_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Network:
    """Learn from at most ``max_rows`` documents with text and lang outside fold 1 of 3."""

    def cut(texts: list[bytes]) -> pa.Array:
        out = []
        for t in texts:
            seed = zlib.crc32(t)
            offsets = [(seed * k) % max(1, len(t) - WINDOW + 1) for k in range(1, PER_DOC + 1)]
            out.append([t[o:o + WINDOW] for o in dict.fromkeys(offsets)])
        return pa.array(out, pa.list_(pa.binary()))

    usable = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (common.fold(F.col(id_col), 3) != 1))
    share, rank = common.hashed_share(usable, id_col, max_rows, "language")
    rows = (share.select(F.col(lang_col).alias("lang"), rank.alias("rank"), common.text_udf(cut, T.ArrayType(T.BinaryType()))(F.col(text_col)).alias("w"))
            .orderBy("rank", "lang", "w").limit(max_rows).collect())
    pairs = [(bytes(w), r.lang) for r in rows for w in r.w if has_letter(bytes(w))]
    return train_network([w for w, _ in pairs], [x for _, x in pairs], **options)


def identify(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the predicted language's mean probability)."""

    def run(texts: list[bytes]) -> pa.Array:
        langs, score = [], []
        for part in common.slices(texts, SLICE):
            p = pooled(net, part) if net.langs else np.zeros((len(part), 1))
            best = p.argmax(axis=1)
            for t, k, row in zip(part, best, p, strict=True):
                known = bool(net.langs) and has_letter(t)
                langs.append(net.langs[k] if known else "und")
                score.append(min(1.0, float(row[k])) if known else 0.0)
        return common.struct_array(lang_pred=pa.array(langs, pa.string()), score=pa.array(score, pa.float64()))

    return common.add_fields(docs, common.text_udf(run, RESULT)(F.col(text_col)), ["lang_pred", "score"])
