"""Fill-in-middle: the bounds as a set, the cuts against plain Python, and the exact way back."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajscreen.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(key, text, unit="token", rate=50, spm=80):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 300_000), min_size=1, max_size=300), st.integers(0, 200_000), st.integers(0, 70_000))
def test_select_is_the_kth_smallest(scattered, start, run):
    values = np.array(sorted(scattered | set(range(start, start + run, 1))), np.int64)
    held = fill_middle.Bounds(values)
    assert len(held) == len(values)
    for k in {0, len(values) - 1, len(values) // 2, len(values) // 3, min(4096, len(values) - 1)}:
        assert held.select(k) == values[k]


def test_all_kinds_of_container_are_used():
    values = np.concatenate([np.arange(0, 60_000), 65_536 + np.arange(0, 60_000, 2), 131_072 + np.arange(0, 60_000, 50)])
    held = fill_middle.Bounds(values)
    assert held.kinds == ["run", "bitmap", "array"]
    assert all(held.select(k) == values[k] for k in range(0, len(values), 7))
    with pytest.raises(IndexError):
        held.select(len(values))


ROWS = [(1, "one two  three\tfour five"), (2, ""), (3, None), (4, " \n\t"), (5, "trailing words here \n"), (6, "has <P> in it, many words of it"), (7, "é ü ßß 日本語   x" * 5), (8, "w"), (None, "a text without a key but with words"), (9, "<<S <P" * 9 + " <M"), (9, "<<S <P" * 9 + " <M"), (10, "x" * 70_000 + " y z"), (11, "long words " * 40_000)]
ROWS += [(100 + i, "some words that are to be cut in two places " * (i % 5)) for i in range(60)]


@pytest.mark.parametrize("unit", ["token", "character"])
def test_equals_plain_python(spark, unit):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in ROWS], "doc_id long, text string, form string, n int")
    cut = fill_middle.transformed(docs, unit=unit, rate=90)
    got = cut.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((k,) + plainly(k, t, unit, 90) for k, t in ROWS), key=repr)
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == want
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in ROWS)
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}


def test_empty_tables_odd_names_and_wrong_parameters(spark):
    docs = spark.createDataFrame([], "`a.key` string, `the text` string")
    assert fill_middle.transformed(docs, "a.key", "the text").collect() == []
    with pytest.raises(ValueError):
        fill_middle.transformed(docs, "a.key", "the text", unit="line")
    with pytest.raises(ValueError):
        fill_middle.transformed(docs, "a.key", "the text", sentinels=("<P>", "P><", "<M>"))
