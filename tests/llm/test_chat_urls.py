import hashlib
import random

import ahocorasick
import pytest

from riskspark.llm import chat, urls


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_conversations_round_trip(spark):
    rnd = random.Random(2)
    parts = ["<|start|>", "<|text|>", "<|also|>", "<|end|>\n", "<\\|", "<\\\\|", "<", "|", "\\", ">", "a", "\n", "é", "𝛼", "</s>[INST] ok [/INST]", "$1"]
    rows = []
    for c in range(150):
        for t in range(rnd.randrange(1, 9)):
            text = None if rnd.random() < 0.1 else "".join(rnd.choice(parts) for _ in range(rnd.randrange(8)))
            role = rnd.choice(["user", "assistant", "assistant", "system", None, "<|end|>\n"])
            rows.append((c, t if rnd.random() < 0.9 else 0, role, text, "x"))
    rows += [(None, None, None, None, "x"), (None, 1, "assistant", "z" * 50_000, "x"), (None, 1, "assistant", "z" * 50_000, "x")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((t if t is not None else -1, r or "", x or "") for cc, t, r, x, _ in rows if cc == c)
        learned = "".join(x for _, r, x in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for _, a, b in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_neighbours_of_one_role_share_a_block(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df).first()
    assert row.formatted == "<|start|>user<|text|>a<|also|>b<|end|>\n<|start|>assistant<|text|>c<|end|>\n"
    assert [row.formatted[m.start:m.end] for m in row.mask] == ["c"]


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    (None, "", "", None, "allow"), ("no host", "", "", None, "allow"), ("http://A.NET/x", "a.net", "/x", "net/", "block"),
    ("http://a.net", "a.net", "", None, "allow"), ("x://example.net/en/1?q", "example.net", "/en/1", "example.net/en/", "allow"),
    ("x://a.example.net/de/1", "a.example.net", "/de/1", "net/", "block"), ("x://myexample.com/de/", "myexample.com", "/de/", None, "allow"),
    ("x://w.example.com/de/?a", "w.example.com", "/de/", "example.com/de/", "block"), ("x://q.org/fr/casino", "q.org", "/fr/casino", "org/fr/", "allow"),
    ("x://q.org/fr", "q.org", "/fr", None, "allow"), ("x://q.org/CASINO", "q.org", "/CASINO", None, "block"),
    ("x://q.org/casinos", "q.org", "/casinos", None, "allow"), ("x://free-bets.q.org#x", "free-bets.q.org", "", None, "block"),
    ("x://free-free.q.org", "free-free.q.org", "", None, "allow"), ("x://q.org?a=poker&b=win", "q.org", "", None, "block"),
    ("x://" + "a/" * 40_000, "a", "/" + "a/" * 39_999, None, "allow")])
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "x", 1), (1, url, "x", 1)], "page_id long, url string, Host string, verdict int")
    got = urls.judge(df)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "strict_hits", "soft_terms", "soft_weight"]
    assert {(r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {(host, path, rule, verdict)}
    assert ahocorasick and urls.judge(df.limit(0)).count() == 0
