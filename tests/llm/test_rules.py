import random
from collections import Counter

import numpy as np

from riskspark.llm import queries, rules

SCHEMA = "doc_id long, text string, lang string, KEPT string, n_words int"
BLANK = " \t\n\r\x0b\x0c"


def brute(text):
    words, line, word = [], [], ""
    for c in (text or "") + " ":
        if c in BLANK:
            words += [word] if word else []
            word = ""
        else:
            word += c
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(BLANK):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            marked |= set(range(i, i + 5))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked))


def texts():
    rnd = random.Random(3)
    parts = ["a", "b", "é", "𝛼", "|", "# ", " ", "\n", "\n\n", "\t", "\x0b", " ", "word ", "x y z u v ", "of the "]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(500)] + [
        None, "", " \n", "one two three four five " * 4000, " ".join(f"w{i % 5000}" for i in range(20_000))]


def test_base_against_brute_force(spark):
    data = [(i, t, "en", "x", 0) for i, t in enumerate(texts())]
    df = spark.createDataFrame(data, SCHEMA)
    for r in rules.judge(df, rules.references(df)).collect():
        want = brute(r.text)
        assert tuple(r[n] for n in rules.BASE) == want, r.text
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)


def test_repeated_words_of_large_vocabularies():
    rnd = np.random.default_rng(0)
    for size in (3, 50, 6000):
        words = [b"%d" % i for i in rnd.integers(0, size, 9000)] + [b"%d" % i for i in range(7)] * 2
        assert rules.repeated_words(words) == brute(b" ".join(words).decode())[4]


def test_distance_is_jensen_shannon():
    p, q = np.array([[1, 0, 3], [0, 0, 0], [2, 2, 0]]), np.array([0, 5, 5])
    got = rules.distance(p, q)
    a, b = np.array([.25, 0, .75]), np.array([0, .5, .5])
    m = (a + b) / 2
    kl = lambda x: sum(u * np.log2(u / v) for u, v in zip(x, m, strict=True) if u)
    assert abs(got[0] - np.sqrt((kl(a) + kl(b)) / 2)) < 1e-12 and got[2] < 1


def test_references_and_verdicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    refs = rules.references(docs)
    assert sorted(refs) == ["de", "en", "es", "fr"]
    text = docs.where("lang = 'fr'").select("text").collect()
    want = np.bincount(rules.BYTE_CLASS[np.frombuffer("".join(r.text for r in text).encode(), np.uint8)], minlength=rules.CLASSES)
    assert refs["fr"][0].tolist() == want.tolist()
    got = queries.QUERIES["op10_divergence_rules"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    long = got[(got.n_words >= rules.LEAST) & ~got.base_failed]
    assert long[long.quality == 1].kept.mean() > 0.98 and long[long.quality == 0].kept.mean() < 0.2


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "a b " * 40, None, "x", 1), (1, None, "en", "x", 1), (1, None, "en", "x", 1)], SCHEMA)
    got = rules.judge(df, rules.references(df.limit(0)))
    assert got.columns == ["doc_id", "text", "lang", *rules.BASE, "class_distance", "word_distance", "base_failed", "kept"]
    assert [r.kept for r in got.collect()] == [False] * 3
    assert rules.judge(df.limit(0), {}).count() == 0
