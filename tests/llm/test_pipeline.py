import hashlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import reference
from trajscreen.llm import mixing


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = np.random.default_rng(0)
    words = "the sun rose over hills and rivers while birds sang of morning light near old stone walls".split()
    items = [(k, " ".join(r.choice(words, 30))) for k in range(3)]
    texts = []
    for i in range(240):
        t = list(r.choice(words, r.integers(30, 120)))
        if i % 6 == 1:
            t = [w + "$$$" for w in t]
        if i % 6 == 2 and i > 6:
            t = texts[i - 6][1].split()[:-1] + ["end"]
        if i % 24 == 3:
            t[10:10] = items[i % 3][1].split()
        texts.append((i, " ".join(t), ("en", "de", None)[i % 3], f"s{i % 2}", 1))
    texts += [(240, None, None, None, 1), (241, "", "en", "s0", 1), (0, texts[0][1], "en", "s0", 1)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 1), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages_and_run(spark, corpus):
    path, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()}
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        assert set(rows) <= before
        kept[name] = (before, rows)
    good = [r for r in kept["quality"][1] if r[0] < 240]
    assert all(r[0] % 6 != 1 for r in good) and len({r[0] for r in good}) >= 198
    before, rows = kept["ngram_jaccard"]
    want = {i for i, (_, c) in reference.components([(i, t) for i, t, *_ in before], 5, 80).items() if i == c}
    assert sorted(r[0] for r in rows) == sorted(want)
    before, rows = kept["decontamination"]
    assert {r[0] for r in rows} == {x[0] for x in reference.contamination([(i, t) for i, t, *_ in before], items) if not x[5]}
    before, rows = kept["mixing"]
    u = lambda i: int(hashlib.md5(f"{i}|mix".encode()).hexdigest()[:13], 16) / 2**52
    p = {r.doc_id: r.probability for r in mixing.mixture(spark.read.parquet(f"{path}/decontamination")).collect()}
    assert {r[0] for r in rows} == {i for i, *_ in before if u(i) < p[i]}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert sorted(r.doc_id for r in last) == sorted(r[0] for r in rows)
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, last))
