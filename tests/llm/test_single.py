import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trajscreen.llm import mixing, pii, quality, sharding, sketch, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, draw string, label string"


# --- sharding


def test_sharding_law_and_slots(spark):
    rows = [(i, "t" * (i % 7), None, None, "", "") for i in range(500)] + [(3, "same", None, None, "", "")] * 2 + [(None, None, None, None, "", "")]
    got = sharding.assign_shards(spark.createDataFrame(rows, DOCS), [1.0] * 5).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.grown_shard in (r.shard, 5)
    moved = sum(r.grown_shard == 5 for r in got)
    assert 40 < moved < 140
    for shard in range(5):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    odd = next(r for r in got if r.doc_id is None)
    assert (odd.size, odd.text_crc32) == (8, 0)
    assert {r.text_crc32 for r in got if r.doc_id == 6} == {zlib.crc32(b"tttttt")}
    assert sharding.assign_shards(spark.createDataFrame([], DOCS), [1.0]).count() == 0


@pytest.mark.parametrize("before,after,changed", [([1.0, 1.0, 1.0], [1.0, 1.0, 1.0, 2.0], 3), ([1.0, 1.0, 1.0], [1.0, 1.0, 1.5], 2), ([0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.10000000000000002], 3)])
def test_only_the_changed_shard_takes_records(spark, before, after, changed):
    df = spark.range(3000).select(sharding.shard_of(F.col("id"), before).alias("a"), sharding.shard_of(F.col("id"), after).alias("b"))
    moved = df.where("a <> b").groupBy("b").count().collect()
    assert [r.b for r in moved] == [changed] and 0 < moved[0]["count"] < 1500


def test_growth_by_float_weights(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.assign_shards(rows, [0.1, 0.1, 0.1]).where("grown_shard <> shard").select("grown_shard").distinct().collect()
    assert [r.grown_shard for r in got] == [3]


def test_weighted_shards(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    counts = Counter(r[0] for r in df.select(sharding.shard_of(F.col("doc_id"), [1.0, 3.0, 0.0])).collect())
    assert set(counts) == {0, 1} and 2.5 < counts[1] / counts[0] < 3.6
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), [])


# --- mixing


def test_raking_hits_targets(spark):
    cells = spark.createDataFrame([("a", "en", "note", 900.0), ("a", "de", "long", 100.0), ("b", "en", "long", 50.0), ("b", "de", "note", 150.0), ("c", "en", "note", 0.0)], "source string, lang string, topic string, tokens double")
    out, residual = mixing.raked(cells, {"source": {"a": 1, "b": 1}, "lang": {"en": 0.7, "de": 0.3}, "topic": {"note": 0.5, "long": 0.5}})
    assert residual <= mixing.CLOSE
    out = out.collect()
    total = sum(r.tokens * r.weight for r in out)
    share = lambda f: sum(r.tokens * r.weight for r in out if f(r)) / total
    assert abs(share(lambda r: r.source == "a") - 0.5) < 1e-3 and abs(share(lambda r: r.lang == "en") - 0.7) < 1e-3 and abs(share(lambda r: r.topic == "note") - 0.5) < 1e-3
    assert next(r for r in out if r.source == "c").weight == 0


def test_mixture_budget_and_odd_rows(spark):
    rows = [(i, "w " * (20 + i % 300), "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 4}", "", "") for i in range(1500)] + [(None, None, None, None, "", ""), (5, "", None, None, "", ""), (5, "", None, None, "", "")]
    got = mixing.mixture(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    kept, every = sum(r.n_tokens for r in got if r.kept), sum(r.n_tokens for r in got)
    assert abs(kept / every - mixing.BUDGET) < 0.06
    assert all(0 <= r.probability <= 1 for r in got)
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mixture(empty).count() == 0 and mixing.sample_mixture(empty).columns == empty.columns
    blank = spark.createDataFrame([(1, "", "en", "s", "", "")], DOCS)
    assert not mixing.mixture(blank).first().kept


# --- sketch


def test_sketch_next_edited_and_equal(spark):
    texts = ["one two three four five six seven eight " * 30, "", None, "Short É", "short É", "x", "a b c d e f g"]
    rows = [(i * 700, t, None, None, "", "") for i, t in enumerate(texts * 3)] + [(None, "last one", None, None, "", "")]
    got = {r.doc_id: r for r in sketch.fingerprints(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    order = sorted([r for r in rows if r[0] is not None], key=lambda r: -r[0]) + [rows[-1]]
    for k, r in enumerate(order):
        a, b = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        x = got[r[0]]
        assert x.n_chars == len(a) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        if edited == a:
            assert x.near_edited == 1 and x.fingerprint == x.edited_fingerprint
    assert len({got[i * 700].fingerprint for i in (0, 7, 14)}) == 1
    assert sketch.fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    alone = sketch.fingerprints(spark.createDataFrame([(1, "a b c", None, None, "", "")], DOCS)).first()
    assert alone.near_next == 1


def test_sketch_estimates(spark):
    words = [f"w{i}" for i in range(4000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[2000:]), " ".join(words[3000:] + [f"v{i}" for i in range(3000)]))], "a string, b string, c string")
    s = df.select(*[sketch.sketch(F.col(c)).alias(c) for c in "abc"])
    r = s.select(sketch.containment(F.col("b"), F.col("a")).alias("whole"), sketch.containment(F.col("a"), F.col("b")).alias("half"), sketch.likeness(F.col("a"), F.col("c")).alias("some"), F.size(sketch.merged(F.col("a"), F.col("b"))).alias("m"), F.size("a").alias("n")).first()
    assert r.whole > 0.99 and abs(r.half - 0.5) < 0.06 and abs(r.some - 1000 / 7000) < 0.05 and abs(r.m - r.n) <= 1


# --- personal data


def test_surrogates(spark):
    text = "Mail jo.Anne_5@mail4.example.com, +1 (017) 555-7713; Mr. John Smith met Mrs Smith, г-жа Иванова. 4111 1111 1111 1111 10.2.3.4."
    rows = [(1, text), (2, "jo.Anne_5@mail4.example.com again"), (3, None), (4, ""), (4, ""), (None, "nothing here"), (6, "word " * 30000 + "9.9.9.9")]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    out = got[1].surrogate_text
    assert got[1].n_entities == 7 and got[1].kinds == "address,card,email,name,phone"
    for secret in ("jo.Anne", "555-7713", "Smith", "Иванова", "4111", "10.2.3.4"):
        assert secret not in out
    assert out.startswith("Mail ") and "Mr. " in out and " met Mrs " in out and "г-жа " in out
    email = out.split()[1].rstrip(",")
    assert got[2].surrogate_text == f"{email} again"
    digits = [int(c) for c in re.search(r"\d{4} \d{4} \d{4} \d{4}", out)[0].replace(" ", "")]
    assert sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    assert got[3].surrogate_text is None and got[4].surrogate_text == "" and got[None].surrogate_text == "nothing here"
    assert got[6].n_entities == 1 and "9.9.9.9" not in got[6].surrogate_text
    assert pii.pseudonymised(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_colliding_surrogates_are_drawn_again(spark):
    entities = spark.createDataFrame([(f"({i:03d}) 555-0{j:03d}",) for i in range(40) for j in range(40)] + [("1.1.1.1",)], "entity string")
    taken = entities.select(pii.surrogate(F.col("entity"), "k").alias("s")).limit(3).collect()
    both = entities.union(spark.createDataFrame([(r.s,) for r in taken], "entity string")).distinct()
    odd = {r.entity: r.surrogate for r in pii.exceptions(both, "k").collect()}
    first = {r.entity: r.s for r in both.select("entity", pii.surrogate(F.col("entity"), "k").alias("s")).collect()}
    final = {**first, **odd}
    assert odd and len(set(final.values())) == len(final) and not set(final.values()) & set(final)


# --- URLs


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=lambda x: len(x[0])) if fit else None


def test_rules_and_trees(spark):
    urls = [None, "", "no url", "http://", "HTTP://EXAMPLE.org/es/1?x=/#", "https://a.b.example.org/en/12", "https://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/1", "http://xcom/de/1", "http://a.net/de/9", "http://org", "http://q.org?x", "http://é.net/ö#"]
    urls += [f"https://{'de' if i % 3 else 'w'}{i}.example.com/{'de' if i % 2 else 'fr'}/{i}" for i in range(200)] + [f"http://s{i}.net/{'de' if i % 2 else 'fr'}/{i}" for i in range(60)] + ["http://a.net/" + "x" * 50000]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, None, "x")], "page_id long, url string, label string")
    got = url_filter.judged(df).collect()
    assert len(got) == len(urls) + 1
    right = 0
    for r in got:
        host, path, rule = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule[0] if rule else None)
        assert r.verdict in ("allow", "block") and (not rule or r.verdict == rule[1])
        right += host.endswith(".net") and host.startswith("s") and (r.verdict == "block") == path.startswith("/de/")
    assert right >= 54  # 60 unseen hosts
    assert url_filter.judged(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judged(df.where("url like '%.net%'")).collect()} == {"allow"}


# --- classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(0)
    good = [" ".join(r.choice("the sun rose over hills and rivers while birds sang of morning light".split(), r.integers(20, 200))) for _ in range(250)]
    bad = [" ".join(w + "$$$" for w in r.choice("the sun rose over hills buy now cheap".split(), r.integers(20, 200))) for _ in range(120)]
    docs = [(i, t, None, None, "", "") for i, t in enumerate(good + bad)] + [(9000, None, None, None, "", ""), (9001, "", None, None, "", ""), (9001, "", None, None, "", ""), (None, "the sun", None, None, "", ""), (9002, "over hills " * 40000, None, None, "", "")]
    labels = [(i, int(i < 250), int(i % 5 == 0)) for i in range(370)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_quality_on_held_out_rows(spark, labelled):
    docs, labels, rows = labelled
    held = lambda k: quality.crc_remainder(k, 5) == 0
    got = quality.scored(docs, labels, held).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    out = [(r.doc_id < 250) == bool(r.predicted) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 370]
    assert len(out) > 40 and np.mean(out) > 0.95
    kept = quality.accepted(docs, labels, held)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.scored(docs.limit(0), labels, held).count() == 0
    assert {r.score for r in quality.scored(docs.limit(5), labels.limit(0), held).collect()} == {0.5}


def test_toxicity_and_identity_terms(spark):
    r = np.random.default_rng(1)
    plain = "people walked along streets beside old houses and talked about weather".split()
    rows, labels = [], []
    for i in range(600):
        w = list(r.choice(plain, 30))
        toxic = i % 4 == 0
        if toxic:
            w += [str(r.choice(["idiot", "scum"])), "muslims" if i % 8 == 0 else "women"]
        elif i % 40 == 1:
            w += ["christians"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    odd = [(2000, "people walked beside muslims and women"), (2001, "such SCUM!"), (2002, None), (2003, ""), (None, "weather"), (2004, "houses " * 50000)]
    docs, known = spark.createDataFrame(rows + odd, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = lambda k: quality.crc_remainder(k, 4) == 2
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    free = {x.doc_id: x for x in toxicity.scored(docs, known, held, penalty=0.0).collect()}
    got = {x.doc_id: x for x in toxicity.scored(docs, known, held).collect()}
    assert len(got) == len(rows) + len(odd)
    assert np.mean([got[i].predicted == y for i, y in labels if got[i].held_out]) > 0.97
    assert got[2000].score < free[2000].score and got[2000].predicted == 0
    assert got[2001].predicted == 1 and got[2002].predicted == got[2003].predicted == got[2004].predicted == 0
    assert toxicity.scored(docs.limit(0), known, held).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_swaps_stay_in_their_group():
    x = np.zeros((2, 6), bool)
    x[0, [0, 1, 4]] = True
    own, other = toxicity.swapped(x, [np.array([1, 2, 3])], np.random.default_rng(0))
    assert own.shape == (2, 6) and other[0, 0] and other[0, 4] and not other[0, 1] and other[0, [2, 3]].sum() == 1
    assert other[1, [0, 4]].all() and not other[1, [1, 2, 3]].any()


def test_fit_pulls_swapped_terms_together():
    """Column 0 marks the class, 1 comes with it by chance, 2 is the other term of 1's group, 3 is noise."""
    r = np.random.default_rng(2)
    y = (np.arange(400) % 4 == 0).astype(float)
    x = np.stack([y > 0, (y > 0) & (r.random(400) < 0.5), (y == 0) & (r.random(400) < 0.1), r.random(400) < 0.3], 1)
    row, at = np.nonzero(x)
    gaps = {}
    for penalty in (0.0, 10.0):
        w, bias = toxicity.fit(at, row, 4, y, [np.array([1, 2])], penalty)
        assert ((x @ w + bias > 0) == (y > 0)).all()
        gaps[penalty] = abs(w[1] - w[2])
    assert gaps[10.0] < 0.2 * gaps[0.0]


def test_pooling_of_nulls():
    context = np.ones((1 << quality.TABLE_BITS, quality.DIMENSIONS), np.float32)
    v = quality.pooled(pa.array([None, "", "a b", " "]), context)
    assert v.shape == (4, quality.WIDTH) and list(v[:, -1]) == [1, 1, 0, 1]
