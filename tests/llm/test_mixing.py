import math
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from riskspark.llm import mixing as mx

SCHEMA = "doc_id long, text string, SCORE string, rid int"


def make(texts):
    seen = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=257)
    code = mx.build_code(seen)
    table = np.zeros(2 * mx.FIRST[mx.ORDERS])
    for key in mx.grams(texts)[0].tolist():
        slots, bit, _ = mx.expand(code, np.array([key]))
        for m in range(mx.ORDERS):
            np.add.at(table, 2 * slots[m] + bit, 1)
    return mx.learn_weights(mx.make_mixer(code, table.reshape(-1, 2)), texts)


def prose(n, seed):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(["the", "of", "tion", "and", "zebra", "ingly"]) for _ in range(rnd.randrange(1, 90))).encode() for _ in range(n)]


def test_next_symbol_probabilities_sum_to_one():
    mixer = make(prose(40, 0))
    for context in (b"\0\0\0", b"the", b"\xff\x00z"):
        keys = np.array([int.from_bytes(context, "big") << 9 | s for s in range(257)])
        x, gate, bits = mixer.inputs(keys)
        p = 1 / (1 + np.exp(-(x * mixer.weights[gate]).sum(axis=1)))
        product = np.multiply.reduceat(p, np.cumsum(bits) - bits)
        assert abs(product.sum() - 1) < 1e-5


def test_score_against_a_loop_over_bits():
    texts = prose(40, 1)
    mixer = make(texts)
    probe = [b"", b"the of", b"qqq \xc3\xa9 zzz", b" ".join(texts)[:9000]]
    got = mx.score_texts(mixer, probe)
    for text, s in zip(probe, got, strict=True):
        keys, own, total, at, step = mx.grams([text])[0], np.zeros(mx.ORDERS), 0.0, 0, 0
        while at < len(keys):
            size = mx.CHUNKS[step] if step < len(mx.CHUNKS) else 8192
            grad, n = np.zeros(mx.ORDERS), 0
            for key in keys[at:at + size]:
                x, gate, _ = mixer.inputs(np.array([key]))
                for v, g in zip(x, gate, strict=True):
                    p = 1 / (1 + math.exp(-float(v @ (mixer.weights[g] + own))))
                    total += math.log10(p)
                    grad += (1 - p) * v
                    n += 1
            own += 0.05 * grad / math.sqrt(n) / (1 + 0.25 * step)
            at, step = at + size, step + 1
        assert abs(total - s) < 1e-3 * max(1, abs(s))


def test_mixing_beats_its_parts_on_unseen_text(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(70).collect()
    texts = [r.text[:2000].lower().encode() for r in rows]
    mixer, unseen = make(texts[:50]), texts[50:]
    mixed = mx.score_texts(mixer, unseen).sum()
    for m in range(mx.ORDERS):
        alone = mx.Mixer(mixer.code, mixer.logit, mixer.known, np.eye(mx.ORDERS, dtype=np.float32)[[m] * mx.GATES])
        assert mixed > mx.score_texts(alone, unseen, rate=0).sum()


def test_base_scores_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    parts = ["the", "The", "of", "É", "é", "x\x0by", "\n", "rare%d", " ", "𝛼"]
    texts = [" ".join(rnd.choice(parts).replace("%d", str(rnd.randrange(500))) for _ in range(rnd.randrange(60))) for _ in range(300)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(900, None, "x", 1), (901, "", "x", 1), (None, "the of", "x", 1), (5, texts[5], "x", 1), (902, "unseenword " * 50_000, "x", 1)]
    words = lambda t: (t or "").encode().lower().split()
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 7
    train = [words(t) for i, t, *_ in rows if fold(i) != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = []
    for i, t, *_ in rows:
        counts = [c[w] for w in words(t)] + [len(train)]
        want.append((str(i), fold(i) == 2, len(counts), sum(k > 0 for k in counts), n, round(sum(math.log10((k + 1) / (n + v + 1)) for k in counts), 6)))
    for hot in (400_000, 5):
        monkeypatch.setattr(mx, "HOT", hot)
        got = mx.score(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert mx.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_tell_prose_from_noise(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(100)
    rnd = random.Random(1)
    noise = spark.createDataFrame([(10_000 + i, "".join(chr(rnd.randrange(33, 127)) for _ in range(400))) for i in range(20)], "doc_id long, text string")
    got = mx.score(docs.unionByName(noise)).toPandas()
    rate = -got.score / np.log10(2) / got.n_bytes
    held = got.held_out
    assert rate[held & (got.doc_id < 10_000)].mean() < 4 < rate[held & (got.doc_id >= 10_000)].mean()
    assert (got.score < 0).all()


def test_model_learns_from_every_byte_of_every_training_text(spark, monkeypatch):
    """Code and weights equal those of all texts at once; the tail of a long text counts."""
    made = []
    learn = mx._learn
    monkeypatch.setattr(mx, "_learn", lambda keys, mixer: made.append(learn(keys, mixer)) or made[-1])
    texts = prose(700, 5) + [b"the of " * 4000 + b"q" * 9000]
    rows = [(i, t.decode(), "x", 1) for i, t in enumerate(texts)]
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert texts[-1] in train
    mx.score(spark.createDataFrame(rows, SCHEMA))
    seen = np.bincount(np.frombuffer(b"".join(train), np.uint8), minlength=257)
    seen[mx.END] = len(train)
    code = mx.build_code(seen)
    assert made[0].code.length.tolist() == code.length.tolist()
    keys, n = np.unique(mx.grams(train)[0], return_counts=True)
    slots, bit, bits = mx.expand(code, keys)
    table = sum(np.bincount(2 * s + bit, np.repeat(n, bits), 2 * mx.FIRST[mx.ORDERS]) for s in slots)
    want = mx.learn_weights(mx.make_mixer(code, table.reshape(-1, 2)), train)
    assert np.array_equal(made[0].logit, want.logit) and np.abs(made[0].weights - want.weights).max() < 1e-3


def test_slot_counts_reach_the_driver_in_parts(spark):
    """Beside the table itself the driver holds one part of the counts, not all of them."""
    keys = np.arange(257 * 12_000, dtype=np.int64) // 257 * 0x9E3779B1 % (1 << 24) << 9 | np.arange(257 * 12_000) % 257
    rows = spark.range(257 * 12_000).selectExpr(
        "shiftleft((id div 257) * 2654435761 % 16777216, 9) + id % 257 key", "id % 3 + 5000000000 n")
    code = mx.build_code(np.zeros(257, np.int64))
    tracemalloc.start()
    got = mx._slot_counts(rows, code)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros(2 * mx.FIRST[mx.ORDERS])
    for k in range(0, len(keys), 65_536):
        slots, bit, bits = mx.expand(code, keys[k:k + 65_536])
        n = np.repeat((np.arange(k, min(k + 65_536, len(keys))) % 3 + 5_000_000_000), bits)
        for m in range(mx.ORDERS):
            low, high = 2 * mx.FIRST[m], 2 * mx.FIRST[m + 1]
            want[low:high] += np.bincount(2 * slots[m] + bit - low, n, high - low)
    assert (want > 0).mean() > 0.6
    assert np.array_equal(got.ravel(), want)
    assert most < 1.6 * got.nbytes


def by_rows(mixer, texts, rate=0.05):
    """``score_texts`` with the four logits of a bit side by side."""
    keys, lengths = mx.grams(texts)
    encoded = pa.array(keys).dictionary_encode()
    place = encoded.indices.to_numpy()
    x, gate, bits = mixer.inputs(encoded.dictionary.to_numpy())
    plain = np.einsum("ij,ij->i", x, mixer.weights[gate])
    first, start = np.cumsum(bits) - bits, np.cumsum(lengths) - lengths
    own, total = np.zeros((len(texts), mx.ORDERS), np.float32), np.zeros(len(texts))
    done, step, live = np.zeros(len(texts), np.int64), 0, np.arange(len(texts))
    while len(live):
        size = np.minimum(mx.CHUNKS[step] if step < len(mx.CHUNKS) else 8192, lengths[live] - done[live])
        owner = np.repeat(np.arange(len(live)), size)
        gram = place[(start[live] + done[live])[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)]
        n = bits[gram]
        edge = np.cumsum(n) - n
        at = np.arange(edge[-1] + n[-1]) + np.repeat(first[gram] - edge, n)
        parts = np.add.reduceat(n, np.cumsum(size) - size)
        begin, seen = np.cumsum(parts) - parts, x[at]
        z = plain[at] + np.einsum("ij,ij->i", seen, np.repeat(own[live], parts, axis=0))
        odds = np.exp(-np.clip(z, -30, 30))
        total[live] -= np.add.reduceat(np.log1p(odds), begin, dtype=np.float64)
        seen *= (odds / (1 + odds))[:, None]
        own[live] += rate * np.add.reduceat(seen, begin, axis=0) / np.sqrt(parts)[:, None] / (1 + 0.25 * step)
        done[live] += size
        live = live[done[live] < lengths[live]]
        step += 1
    return total / math.log(10)


def test_scores_equal_those_of_rows_in_less_time():
    rnd = random.Random(4)
    kinds = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 11))) for _ in range(2000)]
    texts = [" ".join(rnd.choices(kinds, k=rnd.randrange(1200))).encode() for _ in range(250)] + [b"", b"a", b"ab " * 9000]
    mixer, took = make(prose(40, 6)), {by_rows: [], mx.score_texts: []}
    for _ in range(3):
        found = []
        for f, seconds in took.items():
            before = time.process_time()
            found.append(f(mixer, texts))
            seconds.append(time.process_time() - before)
        assert np.abs(found[0] - found[1]).max() < 1e-9 * np.abs(found[0]).max()
    assert min(took[mx.score_texts]) < 0.85 * min(took[by_rows])


def test_words_and_contexts_against_plain_python():
    rnd = random.Random(7)
    texts = [b"", b" ", b"a", b"\x0b\x0c", b"a\tb\r\nc ", b"\x1c\x85 \0\0", "é\u3000𝛼 é".encode(), b""]
    texts += [bytes(rnd.choice(b"ab\0 \n\x1f\xff") for _ in range(rnd.randrange(40))) for _ in range(200)]
    words, owner = mx.split_words(texts)
    assert list(zip(owner.tolist(), words.view(pa.binary()).to_pylist(), strict=True)) == [(i, w) for i, t in enumerate(texts) for w in t.split()]
    want = [int.from_bytes((b"\0\0\0" + t)[i:i + 3], "big") << 9 | s for t in texts for i, s in enumerate([*t, mx.END])]
    keys, lengths = mx.grams(texts)
    assert keys.tolist() == want and lengths.tolist() == [len(t) + 1 for t in texts]
    assert len(mx.split_words([b""])[0]) == 0


def test_held_counts_lose_nothing_and_stay_few():
    rnd, held, got, want = random.Random(8), mx._Held(100), Counter(), Counter()
    out = []
    for kinds in (20, 1000):
        for _ in range(60):
            values = [str(rnd.randrange(kinds)) for _ in range(30)]
            want.update(values)
            out += held.add(pa.array(values).value_counts())
            assert sum(map(len, held.counted)) <= 100
    for batch in [*out, *held.rest()]:
        got.update(dict(zip(batch["values"].to_pylist(), batch["counts"].to_pylist(), strict=True)))
    assert got == want and len(out) > 10
    assert list(mx._Held(5).rest()) == []
