"""Document fingerprints by a threshold-scaled sketch (DataFrame functions only).

A document's shingles are its runs of five words; every shingle hash below a fixed fraction of the hash range is kept; a
document without any such keeps its smallest. Sketches merge to the sketch of all their shingles together, and containment
and Jaccard similarity of documents of very unequal length follow from the kept hashes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, let, saved

WORDS = 5
SCALE = 4  # one hash in SCALE is kept
BITS = 48  # bits of a hash
SPACE = r"[\x20\x09-\x0D]+"
#: Neighbouring keys are brought together in blocks of this many key values.
BLOCK = 512


def sketch(text: Column, scale: int = SCALE) -> Column:
    """Sorted array of the kept hashes of a text; empty for null and for texts without words. Fewer than WORDS words are
    one shingle."""
    limit = F.lit((1 << BITS) // scale)
    words = F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SPACE), "")
    value = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 64 - BITS)
    every = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: value(*[F.get(w, i + j) for j in range(WORDS)]))
    several = lambda w: F.array_sort(F.array_distinct(let(every(w), lambda h: _below(h, limit))))
    return let(words, lambda w: F.when(F.size(w) >= WORDS, several(w)).when(F.size(w) > 0, F.array(value(w))).otherwise(F.array().cast("array<bigint>")))


def _below(hashes: Column, limit: Column) -> Column:
    """The hashes below limit, or the smallest if none is."""
    return F.when(F.array_min(hashes) < limit, F.filter(hashes, lambda x: x < limit)).otherwise(F.array(F.array_min(hashes)))


def as_text(kept: Column) -> Column:
    """The kept hashes as lower-case hexadecimal numbers of 12 digits, one after another."""
    return F.array_join(F.transform(kept, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty. Null, for no estimate, if none of a's hashes lies below the
    fraction: the one it keeps in their stead tells nothing, as a longer b wouldn't have kept it."""
    told = F.array_min(a) < F.lit((1 << BITS) // scale)
    return F.when(F.size(a) == 0, 1.0).when(told, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of both documents' shingles together, from their sketches."""
    return let(F.array_sort(F.array_union(a, b)), lambda both: F.when(F.size(both) == 0, both).otherwise(_below(both, F.lit((1 << BITS) // scale))))


def _next_lower(keys: DataFrame, depth: int) -> DataFrame:
    """keys: distinct longs k. Adds the next lower one, found within blocks and between the blocks' largest keys, so that
    only the topmost level (1 / 4096**depth of the key range) is ordered as a whole."""
    if not depth:
        return keys.select("k", F.lead("k").over(Window.orderBy(F.desc("k"))).alias("lower"))
    blocks = keys.withColumn("g", F.floor(F.col("k") / 4096))
    tops = blocks.groupBy("g").agg(F.max("k").alias("top"))
    after = _next_lower(tops.select(F.col("g").alias("k")), depth - 1).join(tops.select(F.col("g").alias("lower"), F.col("top").alias("next_top")), "lower").select(F.col("k").alias("g"), "next_top")
    inside = blocks.withColumn("lower", F.lead("k").over(Window.partitionBy("g").orderBy(F.desc("k"))))
    return inside.join(after, "g", "left").select("k", F.coalesce("lower", "next_top").alias("lower"))


def _places(docs: DataFrame, key: str) -> DataFrame:
    """(key, place) of the distinct keys that aren't null: 0, 1, .. in ascending order, counted range by range."""
    ranged = saved(docs.select(F.col(key).alias("key")).where("key is not null").distinct().repartitionByRange("key").select("key", F.spark_partition_id().alias("range")), "key-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return saved(ranged.withColumn("n", F.row_number().over(Window.partitionBy("range").orderBy("key"))).join(starts, "range").select("key", (F.col("start") + F.col("n") - 1).alias("place")), "key-places")


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with next_<column> of the row that follows in descending key order; the first follows the last. Null keys
    come last; rows of equal key follow in order of `columns`' hash. One shuffle of the rows, by block of keys; each
    block's first row is also sent to the block before it. Keys that aren't whole numbers are first numbered in order,
    which costs another shuffle."""
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        places = _places(docs, key)
        numbered = docs.join(places, F.col(key) == F.col("key"), "left") if key != "key" else docs.join(places, "key", "left")
        found = with_next(numbered.select(F.struct(F.col(key)).alias("__own"), "place", *columns), "place", ["__own", *columns])
        return found.select(F.col(f"__own.{key}").alias(key), *columns, *[f"next_{c}" for c in columns])
    number = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    block = F.floor(number / BLOCK).cast("long")
    tops = saved(docs.select(number.alias("n"), block.alias("k")).groupBy("k").agg(F.max("n").alias("top")), "blocks")
    order = saved(_next_lower(tops.select("k"), 2), "block-order")
    first = tops.agg(F.max("k").alias("k"))
    wrapped = order.withColumn("lower", F.coalesce("lower", first.scalar()))
    copies = saved(wrapped.join(tops.select(F.col("k").alias("lower"), "top"), "lower").select(F.col("k").alias("__to"), F.col("top").alias("__top")), "block-heads")
    rows = docs.select(key, *columns, number.alias("__n"), block.alias("__block"))
    sent = rows.join(copies, rows["__n"] == copies["__top"]).select(key, *columns, "__n", F.col("__to").alias("__block"), F.lit(True).alias("__copy"))
    # a copy sorts after its new block's own rows even if it comes from a higher block (the first row after the last)
    order_by = Window.partitionBy("__block").orderBy("__copy", F.desc("__n"), F.col(key).isNull(), F.xxhash64(*columns))
    both = rows.withColumn("__copy", F.lit(False)).unionByName(sent)
    return both.select(key, *columns, "__copy", *[F.lead(c).over(order_by).alias(f"next_{c}") for c in columns]).where(~F.col("__copy")).drop("__copy")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty; texts without words have an empty fingerprint, and two of those are alike (1). A single
    row is followed by itself. Rows of equal key follow one another. Keys may be of any type that has an order. Very long
    texts are sketched whole. An empty table gives no rows. Other columns aren't read.
    """
    body = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    pairs = with_next(body.withColumn("s", sketch(F.col("text"))), key, ["text", "s"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = pairs.select(key, F.length("text").cast("long").alias("n_chars"), "s", "next_s", edited.alias("edited"))
    out = out.select(key, "n_chars", "s", "next_s", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), let(sketch(F.col("edited")), lambda e: F.struct(as_text(e).alias("fp"), likeness(F.col("s"), e).alias("near"))).alias("e"))
    return out.select(key, "n_chars", "edited_sha256", as_text(F.col("s")).alias("fingerprint"), F.col("e.fp").alias("edited_fingerprint"), F.col("e.near").alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"))
