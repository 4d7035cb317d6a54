import re

import sentencepiece

import corpus_pipeline
from riskspark.llm import decontaminate, pieces


def test_pipeline_against_plain_python(spark, sf):
    """Every stage's decisions, recomputed one document at a time from the stage's own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, held = docs.columns, {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        held[k] = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(held[k])
        assert k == 4 or docs.columns == columns
    all_docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    good, bad = labels.index[labels == 1], labels.index[labels == 0]
    assert sum(i in held[0] for i in good) + sum(i not in held[0] for i in bad) >= 0.95 * len(labels)

    order = sorted(held[0])
    words = {i: held[0][i].text.encode().lower().split() for i in order}
    sets = {i: {b" ".join(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} for i, w in words.items()}
    root = {i: i for i in order}
    for a in order:
        for b in order:
            if b < a and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert set(held[1]) == set(root.values())

    words = lambda t: b" " + b" ".join(decontaminate.plain(t.encode()).split()) + b" "
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(held[2]) == {i for i, r in held[1].items() if not any(x in words(r.text) for x in items)}

    secret = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}")
    assert set(held[3]) == set(held[2])
    for i, r in held[3].items():
        assert r.text == secret.sub("[SECRET]", all_docs.text[i]) and r.n_chars == len(r.text)

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert {i: r.ids for i, r in held[4].items()} == {i: library.encode(r.text, add_eos=True) for i, r in held[3].items()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(held[4])
