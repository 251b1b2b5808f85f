import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import reference
from trajscreen.llm import common, decontaminate, ngram_join, suffix_dedup
from trajscreen.llm.suffix_dedup import deep_shallow


def sentence(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi".split()) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out, bases = [], [sentence(r, n) for n in (3, 12, 40, 90, 400, 1500)]
    for i in range(150):
        w = r.choice(bases).split()
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            w[r.randrange(len(w))] = "w%d" % r.randrange(50)
        out.append((i, " ".join(w)))
    return out + [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "É é " * 5000), (906, "É é " * 5000)]


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_join_equals_all_pairs(spark, rows, words, percent):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sid string, prefix int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(df.repartition(5), words=words, percent=percent).collect()}
    assert got == reference.components(rows, words, percent)


def test_join_repeats_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None)], schema)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.similar(df).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 0, 2), ("None", 1, 1)]
    assert ngram_join.similar(df.where("doc_id = 5")).count() == 0
    assert sorted(r.doc_id for r in ngram_join.deduplicated(df).collect()) == [1, 2]


def test_survivors_of_repeated_and_null_keys(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    near = a.replace("a29", "z")
    rows = [(None, a), (None, b), (None, b), (None, near), (None, c), (4, c), (5, d), (5, "one two"), (5, c), (5, d), (7, None), (7, ""), (None, None), (None, " ")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    got = ngram_join.deduplicated(df.repartition(3)).select("doc_id", "text").collect()
    left = sorted(map(repr, (tuple(r) for r in got if r.text not in (a, near))))
    assert left == sorted(map(repr, [(None, b), (4, c), (5, d), (5, "one two"), (7, None), (7, ""), (None, None), (None, " ")]))
    assert sum(r.text in (a, near) for r in got) == 1
    assert sorted(ngram_join.deduplicated(df.where("doc_id is null")).columns) == ["doc_id", "n", "text"]


def test_frequency_table_counts_every_document(spark, rows):
    texts = spark.createDataFrame([(t,) for _, t in rows], "text string").select(F.col("text").cast("binary").alias("text"))
    classes = ngram_join.Classes(*ngram_join.frequency_classes(texts, 5))
    tokens = [s for t in rows for s in ngram_join.token_sets(pa.array([t[1]]), 5)]
    count = Counter(x for s in tokens for x in s.tolist())
    often, once = max(count, key=count.get), min(count, key=count.get)
    assert classes.of(np.array([often], np.uint64))[0] > classes.of(np.array([once], np.uint64))[0]


def test_tables_are_summed_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(common, "FAN_IN", 3)
    part = lambda k: zlib.compress(np.arange(k, k + 4, dtype=np.uint8).tobytes())
    rows = spark.createDataFrame([(i, part(k + i)) for k in range(20) for i in range(2)], "slice int, part binary").repartition(20)
    got = {r["slice"]: np.frombuffer(zlib.decompress(r["part"]), np.uint64).tolist() for r in common.summed_table(rows, 2, np.uint8).collect()}
    assert got == {i: [sum(k + i + j for k in range(20)) for j in range(4)] for i in range(2)}


def test_prefixes_meet_under_every_order():
    """Sets at the bound share a prefix token under each order, and their signatures meet."""
    r = np.random.default_rng(3)
    for n in (1, 7, 40, 300):
        same = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = len(same) // 20
        a, b = np.delete(same, r.choice(len(same), drop, False)), np.delete(same, r.choice(len(same), drop, False))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            for k in range(ngram_join.ORDERS):
                p, q = (ngram_join.prefix(x, np.zeros(len(x), np.uint8), k, 90) for x in (a, b))
                assert len(np.intersect1d(p, q)) and len(np.intersect1d(p.astype(np.uint16), q.astype(np.uint16)))


def test_join_restores_the_session_and_leaves_little(spark, rows):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, home = spark.conf.get(name), common.shared_dir(spark)
    kept = set(os.listdir(home)) if os.path.isdir(home) else set()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ngram_join.similar(df).count()
    suffix_dedup.removals(df).count()
    assert spark.conf.get(name) == before and not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(home)) - kept} <= {"slim", "set-ids", "texts", "cut", "copies"}


def test_survivors_with_any_column_names(spark):
    df = spark.createDataFrame([(1, "a b c d e", 5, 6, 7), (2, "a b c d e", 5, 6, 7), (2, "x y", 5, 6, 7)], "doc_id long, text string, __key int, __again int, class int")
    got = ngram_join.deduplicated(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a b c d e"), (2, "x y")]


@pytest.mark.parametrize("crowds", [suffix_dedup.CROWDS, ((0, 161), (2, 21), (9, 1))])
@pytest.mark.parametrize("batch", [2000, 7])
def test_removals_equal_brute_force(spark, crowds, batch, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 50)
    monkeypatch.setattr(suffix_dedup, "small_batches", lambda s: common.small_batches(s, batch))
    r = random.Random(batch)
    base = ["".join(r.choice("ab c") for _ in range(r.randrange(900))) for _ in range(8)]
    texts = []
    for i in range(120):
        a, b = r.choice(base), r.choice(base)
        x, y = r.randrange(len(a) + 1), r.randrange(len(b) + 1)
        texts.append((i, a[x : x + r.randrange(450)] + r.choice(["", "é", "zz"]) + b[y : y + r.randrange(450)]))
    texts += [(1000, None), (1001, ""), (1002, "x" * 1000), (1003, "ab" * 400), (1004, "q" * 199), (1005, base[0]), (1005, base[0]), (None, "\u0000" * 300 + "end")]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, gram int").repartition(3)
    got = sorted(map(repr, (tuple(x) for x in suffix_dedup.removals(df, crowds=crowds).collect())))
    assert got == sorted(map(repr, reference.removals(texts)))


def test_removals_of_no_rows(spark):
    assert suffix_dedup.removals(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sorted_anchors_across_batches():
    r = random.Random(1)
    rows = sorted((r.randrange(6), r.randrange(4), i) for i in range(60))
    t = [pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows]), pa.array([x[2] for x in rows]), *(pa.array([0] * 60) for _ in range(3)), pa.array([0] * 60)]
    table = pa.RecordBatch.from_arrays(t, [*suffix_dedup.COLUMNS, "spread"])
    expected = set()
    for g in range(6):
        kinds = {a for x, a, _ in rows if x == g}
        for a in kinds:
            own = [i for x, b, i in rows if (x, b) == (g, a)]
            expected |= {(i, "covered") for i in own if len(own) > 1} | ({(own[0], "asked")} if len(kinds) > 1 else set())
    for size in (1, 2, 3, 7, 60):
        got = set()
        for out in suffix_dedup._sorted_out(iter([table.slice(i, size) for i in range(0, 60, size)])):
            for i, c, a in zip(out.column(2).to_pylist(), out.column("covered").to_pylist(), out.column("asked").to_pylist(), strict=True):
                got |= ({(i, "covered")} if c else set()) | ({(i, "asked")} if a else set())
        assert got == expected, size


def test_deep_shallow_order():
    r = np.random.default_rng(2)
    common = r.integers(97, 99, 60)
    strings = np.stack([np.r_[common[: r.integers(0, 60)], r.integers(97, 99, 100)][:90].astype(np.uint8) for _ in range(300)])
    strings[10], strings[200] = strings[20], strings[20]
    group = r.integers(0, 5, 300)
    order = deep_shallow(np.ascontiguousarray(strings), group)
    keys = [(group[i], strings[i].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(300))


def test_contamination_equals_brute_force(spark):
    r = random.Random(9)
    items = [(k, sentence(r, n)) for k, n in enumerate((1, 2, 5, 12, 13, 14, 30, 60))] + [(50, None), (51, "..."), (52, "É-é 42")]
    docs = [(i, sentence(r, r.randrange(80))) for i in range(60)]
    for i in range(60, 120):
        w = sentence(r, 40).split()
        piece = r.choice(items)[1] or ""
        p = piece.split()[r.randrange(4) :]
        docs.append((i, " ".join(w[:20] + p + w[20:]).replace(" ", r.choice([" ", ", ", "\n"])).title()))
    docs += [(500, None), (501, ""), (502, "!!!"), (503, items[-5][1]), (504, "é É 42")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fp string").repartition(3)
    got = sorted(map(repr, (tuple(x) for x in decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")).drop("text_hash").collect())))
    assert got == sorted(map(repr, reference.contamination(docs, items)))


def test_contamination_without_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (None, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.contamination(docs, items).collect()] == [False, False]
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    same = spark.createDataFrame([(7, "A b!"), (7, "a b")], "item_id long, text string")
    assert {(r.n_hit, r.n_items) for r in decontaminate.contamination(docs, same).collect()} == {(2, 1)}
    assert decontaminate.decontaminate(docs, same).count() == 0
    clash = docs.selectExpr("doc_id as fp", "text as gram", "1 as __hash", "2 as bad_key", "3 as text_hash")
    assert [r.n_hit for r in decontaminate.contamination(clash, same, "fp", "gram").collect()] == [2, 2]
    left = decontaminate.decontaminate(clash.unionByName(spark.createDataFrame([(9, "c", 1, 2, 3)], clash.schema)), same, "fp", "gram")
    assert left.columns == clash.columns and [tuple(r) for r in left.collect()] == [(9, "c", 1, 2, 3)]
