"""Sharding by weighted rendezvous hashing of stable record keys (DataFrame functions only).

Each shard draws an exponential of rate `weight` from a hash of (key, shard); the smallest draw takes the record. The
draw of a shard doesn't depend on the other shards, so one more shard takes records only into itself. Draws grow with the
hash; equal weights need the hash alone, which orders the shards alike.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Records of a shard are numbered within this many hash ranges, so that no task holds a whole shard.
RANGES = 4096
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def hashed_52(*parts: Column) -> Column:
    """52 bits of the md5 of the parts joined by '|', as a long. A null part counts as 'null'."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 .. len(weights) - 1) of a key. A shard of weight 0 gets nothing; equal draws go to the lower one."""
    if not weights or min(weights) < 0 or not any(weights):
        raise ValueError("weights must be at least 0 and one of them more")
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = hashed_52(key, F.lit(shard))
            even = len({w for w in weights if w > 0}) == 1
            draw = bits if even else -F.log1p(-bits / F.lit(math.ldexp(1, 52))) / F.lit(float(weight))
            draws.append(F.struct(draw.alias("draw"), F.lit(shard).alias("shard")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: key, keep columns (after an underscore where a result column has the name), size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 8; a null text has none, and counts as empty for text_crc32. slot: 0, 1, .. within
    a shard, by hash range, key, checksum and size, so repeated rows get slots of their own. grown_shard: the shard
    after one more of mean weight. A null key is a key like others. Very long texts count whole. An empty table gives no rows. Other columns of docs,
    whatever their names, are not read.
    """
    grown = [*weights, sum(weights) / len(weights)]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    names = {c: f"_{c}" if c in RESULT else c for c in keep if c != key}
    rows = docs.select(
        F.col(key), *[F.col(c).alias(n) for c, n in names.items()],
        (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(F.col(key), weights).alias("shard"), shard_of(F.col(key), grown).alias("grown_shard"),
        F.pmod(hashed_52(F.col(key), F.lit("slot")), F.lit(RANGES)).cast("int").alias("__range"),
    )
    counts = docs.select(shard_of(F.col(key), weights).alias("shard"), F.pmod(hashed_52(F.col(key), F.lit("slot")), F.lit(RANGES)).cast("int").alias("__range"))
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy("shard", "__range").count().select("shard", "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy("shard", "__range").orderBy(F.col(key), "text_crc32", "size")
    placed = rows.withColumn("__n", F.row_number().over(own)).join(starts, ["shard", "__range"])
    return placed.select(key, *names.values(), "size", "text_crc32", "law", F.col("shard").cast("int"), (F.col("__start") + F.col("__n") - 1).alias("slot"), F.col("grown_shard").cast("int"))


def oracle_sql(shards: int) -> str:
    """The query's rows in DuckDB's SQL for `shards` equal weights. DuckDB has no crc32: a table of 256 remainders is built by
    the rule and the text's bytes are folded over it."""
    drawn = lambda label: f"('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || {label}), 1, 13))::BIGINT"
    least = lambda n: f"list_position(draws, list_min(draws[1:{n}])) - 1"
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    table = "SELECT i AS c0, i FROM (SELECT unnest(range(256)) AS i) r"
    for _ in range(8):
        table = f"SELECT {step.format('c0')} AS c0, i FROM ({table}) q"
    return f"""
WITH t AS MATERIALIZED (SELECT list(c0 ORDER BY i) AS crc FROM ({table}) q),
d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS h, list_transform(range({shards + 1}), lambda s: {drawn('CAST(s AS VARCHAR)')}) AS draws FROM documents),
c AS (SELECT doc_id, CAST(octet_length(raw) + 8 AS BIGINT) AS size,
  CAST(xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(raw)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, crc[CAST(xor(a, b) & 255 AS INT) + 1])), 4294967295) AS BIGINT) AS text_crc32,
  CAST({least(shards)} AS INT) AS shard, CAST({least(shards + 1)} AS INT) AS grown_shard, {drawn("'slot'")} % {RANGES} AS place FROM d, t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard FROM c"""
