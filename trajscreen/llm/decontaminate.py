"""Benchmark decontamination by winnowing (DataFrame functions only).

Texts are lower-cased (A-Z) word lists. The smallest k-gram hash of each run of w k-grams is a fingerprint; with
k + w - 1 = 13 every shared run of 13 words shares one. A bit table of the benchmark's fingerprints, sized by their number, drops
nearly all fingerprints of the documents before the shuffle; the rest are joined, and each hit is extended word by word
on both sides. Benchmark texts of fewer than 13 words are one window of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, let, null_safe, saved

SPAN = 13  # words of a window
GRAM = 7  # words of a k-gram
WINDOW = SPAN - GRAM + 1  # k-grams of which the smallest is kept
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bounds of the binary logarithm of the bit table's 64-bit cells, about one a fingerprint (8 KB to 8 MB). A benchmark of more
#: than a million fingerprints fills it more, and more rows reach the exact join.
CELL_BITS = (10, 20)

HIT = "array<struct<fp:bigint,pos:int,gram:array<string>,before:array<string>,after:array<string>>>"


def words_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), NOT_WORD), "")


def _entry(words: Column, fp: Column, pos: Column, length: int, reach: int) -> Column:
    """A k-gram at pos (from 1) with up to reach words before it (nearest first) and after it."""
    left = F.least(pos - 1, F.lit(reach))
    return F.struct(
        fp.cast("bigint").alias("fp"), pos.cast("int").alias("pos"), F.slice(words, pos, length).alias("gram"),
        F.reverse(F.slice(words, pos - left, left)).alias("before"), F.slice(words, pos + length, F.lit(reach)).alias("after"),
    )


def _held(bits: Column, h: Column) -> Column:
    cell = F.element_at(bits, (F.shiftrightunsigned(h, 6).bitwiseAND((F.size(bits) - 1).cast("bigint")) + 1).cast("int"))
    return F.getbit(cell, h.bitwiseAND(F.lit(63)).cast("int")) == 1


def _gram(words: Column, i: Column) -> Column:
    """Hash of the k-gram at i (from 1)."""
    return F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(GRAM)])


def _smallest(words: Column, i: Column) -> Column:
    """Whether the k-gram at i is the smallest of some run of WINDOW k-grams; ties count."""
    last = F.size(words) - (GRAM - 1)
    higher = lambda at: F.transform(at, lambda j: _gram(words, j) >= _gram(words, i))
    length = lambda flags: F.array_position(F.concat(flags, F.array(F.lit(False))), False) - 1
    offsets = F.array(*[F.lit(j) for j in range(1, WINDOW)])
    left = higher(F.filter(F.transform(offsets, lambda j: i - j), lambda j: j >= 1))
    right = higher(F.filter(F.transform(offsets, lambda j: i + j), lambda j: j <= last))
    return length(left) + length(right) + 1 >= WINDOW


def _winnowed(words: Column, bits: Column | None) -> Column:
    """Entries of the fingerprints of a word list of SPAN words or more, those that bits holds (looked up first: cheaper)."""
    at = F.sequence(F.lit(1), F.size(words) - (GRAM - 1))
    at = at if bits is None else F.filter(at, lambda i: _held(bits, _gram(words, i)))
    found = F.transform(F.filter(at, lambda i: _smallest(words, i)), lambda p: _entry(words, _gram(words, p), p, GRAM, SPAN - GRAM))
    return F.when(F.size(words) >= SPAN, found).otherwise(F.array().cast(HIT))


def _whole(words: Column, length: int) -> Column:
    return F.xxhash64(F.lit(-length), F.slice(words, 1, length))


def _short(words: Column, length: int, bits: Column) -> Column:
    """Entries of the runs of length words whose hash bits holds."""
    h = lambda i: F.xxhash64(F.lit(-length), F.slice(words, i, length))
    at = F.filter(F.sequence(F.lit(1), F.size(words) - (length - 1)), lambda i: _held(bits, h(i)))
    return F.when(F.size(words) >= length, F.transform(at, lambda i: _entry(words, h(i), i, length, 0))).otherwise(F.array().cast(HIT))


def benchmark_index(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """item_id, need (words a hit must span) and one row per fingerprint: fp, gram, before, after."""
    items = benchmark.select(F.col(item).cast("string").alias("item_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    long = items.where(F.size("w") >= SPAN).select("item_id", F.lit(SPAN).alias("need"), F.inline(_winnowed(F.col("w"), None)))
    short = items.where(F.size("w") < SPAN)
    for length in range(1, SPAN):
        long = long.unionByName(short.where(F.size("w") == length).select("item_id", F.lit(length).alias("need"), F.inline(F.array(_entry(F.col("w"), _whole(F.col("w"), length), F.lit(1), length, 0)).cast(HIT))))
    return long.drop("pos").distinct()


def bit_table(index: DataFrame) -> DataFrame:
    """One row, one column: a power of two of longs in which the bit of each fingerprint is set."""
    spark = index.sparkSession
    n = 1 << min(max((index.count() - 1).bit_length(), CELL_BITS[0]), CELL_BITS[1])
    cells = index.select(F.shiftrightunsigned("fp", 6).bitwiseAND(F.lit(n - 1)).alias("id"), F.expr("shiftleft(1L, cast(fp & 63 as int))").alias("b")).groupBy("id").agg(F.bit_or("b").alias("b"))
    dense = spark.range(0, n, 1, 1).join(cells, "id", "left").select("id", F.coalesce("b", F.lit(0)).alias("b"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("bits"))


def _agreeing(a: Column, b: Column) -> Column:
    """How many leading elements are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.array_position(F.concat(same, F.array(F.lit(False))), False).cast("int") - 1


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: int = 20) -> DataFrame:
    """One row per row of docs: key, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a benchmark window; a row is contaminated if it has a hit and
    share * n_hit >= n_words. Null texts and texts without words have no words and aren't contaminated. Null keys are
    keys. Very long texts are judged whole. Repeated rows get equal results each; rows that share a key but not the text are judged apart. Repeated items
    count once per item id. Empty tables, either one, are fine. Only the named columns are read.
    """
    index = saved(benchmark_index(benchmark, item, item_text), "windows")
    lengths = [r[0] for r in index.where(F.col("need") < SPAN).select("need").distinct().collect()]  # at most 12
    bits = saved(bit_table(index), "bits")

    def found(w: Column) -> Column:
        return let(F.col("__bits"), lambda b: F.concat(_winnowed(w, b), *[_short(w, n, b) for n in sorted(lengths)]))

    own = ["doc", "text_hash"]
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text")).withColumn("__bits", bits.scalar())
    rows = rows.select(*own, let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), found(w).alias("hits"))).alias("j")).select(*own, "j.n_words", "j.hits")
    rows = saved(rows, "doc-fingerprints")

    hits = rows.select(*own, F.inline("hits")).distinct().alias("d")
    on = (F.col("d.fp") == F.col("i.fp")) & (F.col("d.gram") == F.col("i.gram"))
    left, right = _agreeing(F.col("d.before"), F.col("i.before")), _agreeing(F.col("d.after"), F.col("i.after"))
    spans = hits.join(index.alias("i"), on).select(*own, "item_id", "need", "pos", F.size("d.gram").alias("n"), left.alias("l"), right.alias("r"))
    spans = saved(spans.where(F.col("l") + F.col("r") + F.col("n") >= F.col("need")).select(*own, "item_id", (F.col("pos") - F.col("l")).alias("first"), (F.col("pos") + F.col("n") - 1 + F.col("r")).alias("last")), "spans")
    hit = spans.select(*own, "first", "last").distinct().select(*own, F.explode(F.sequence("first", "last")).alias("p")).distinct().groupBy(*own).agg(F.count(F.lit(1)).alias("n_hit"))
    items = spans.select(*own, "item_id").distinct().groupBy(*own).agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    both = null_safe(null_safe(rows.drop("hits"), hit, own, "left"), items, own, "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return both.select(
        F.col("doc").alias(key), "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, all columns, whatever their names."""
    own, hashed = free_name(docs, "bad_key"), free_name(docs, "bad_hash")
    bad = saved(contamination(docs, benchmark, key, text).where("contaminated").select(F.col(key).alias(own), F.col("text_hash").alias(hashed)).distinct(), "contaminated")
    return docs.join(bad, F.col(key).eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text)) == F.col(hashed)), "left_anti")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS g FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
