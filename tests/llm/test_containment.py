"""Containment of short texts in long ones, by sketches and by whole sets."""

import random

from pyspark.sql import functions as F

from trajscreen.llm import sketch


def test_short_texts_in_a_long_one(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(words[i : i + n]) for n in (6, 12, 30) for i in range(0, 400 - n, 3)]
    foreign = [" ".join(f"v{r.randrange(10**6)}" for _ in range(12)) for _ in range(60)]
    half = [" ".join(words[i : i + 24] + [f"v{r.randrange(10**6)}" for _ in range(20)]) for i in range(0, 370, 3)]
    rows = [(t, 1.0) for t in texts] + [(t, 0.0) for t in foreign] + [(t, 0.5) for t in half]
    df = spark.createDataFrame(rows, "text string, truth double").withColumn("s", sketch.sketch(F.col("text"))).withColumn("long", sketch.sketch(F.lit(" ".join(words))))
    got = df.select("truth", sketch.containment(F.col("s"), F.col("long")).alias("c")).toPandas()
    told = got.dropna()
    assert len(told) > 0.6 * len(got)
    assert (told[told.truth == 1].c == 1).all() and (told[told.truth == 0].c == 0).all()
    assert abs(told[told.truth == 0.5].c.mean() - 0.5) < 0.08
    assert got.c.isna().any()  # six words have two shingles; where neither is kept there is no estimate


def test_empty_and_merged(spark):
    a, b = "a b c d e f g h i j k l m n", "x y z a b c d e f g h"
    one = spark.range(1).select(sketch.sketch(F.lit("")).alias("e"), sketch.sketch(F.lit(a)).alias("a"), sketch.sketch(F.lit(b)).alias("b"))
    row = one.select(sketch.containment(F.col("e"), F.col("a")).alias("x"), sketch.containment(F.col("a"), sketch.merged(F.col("a"), F.col("b"))).alias("y"), sketch.containment(F.col("a"), F.col("a")).alias("z")).first()
    assert row["x"] == 1.0 and row["y"] == 1.0 and row["z"] == 1.0
