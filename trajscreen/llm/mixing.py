"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Token counts are summed over (source, language, topic) cells; the cells' weights are raked in turn to the source, language
and topic targets until every marginal is met; a common factor, with probabilities capped at 1, calibrates the expected
tokens to the budget; each document is kept if a hash of its key is below its cell's probability. Only the cell table is shuffled: it has a row for
each cell that occurs, however many documents that has, and joins back by broadcast only while Spark sees it is small.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, free_name, saved
from .sharding import hashed_52

DIMENSIONS = ("source", "lang", "topic")
#: Targets: each value's share of the tokens to this power, rescaled; below 1 large values shrink.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 8  # raking rounds between two looks at the residual
MOST = 25  # looks at most
CLOSE = 1e-9  # raking ends when no marginal misses its target by more than this share of all tokens
STEPS = 40  # calibration steps at most
BUDGET = 0.7  # share of all tokens to keep


def n_tokens(text: Column) -> Column:
    """Words between ASCII spaces; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """licence, table, note (under 50 words), article (under 400) or long; null texts are notes."""
    holds = lambda s: F.coalesce(F.contains(text, F.lit(s)), F.lit(False))
    return F.when(holds("licensed under"), "licence").when(holds(" | "), "table").when(tokens < 50, "note").when(tokens < 400, "article").otherwise("long")


Topic = Callable[[Column, Column], Column]


def _rows(docs: DataFrame, key: str, text: str, source: str, lang: str, topic: Topic) -> DataFrame:
    """(key, source, lang, topic, n_tokens) of each row, whatever docs calls its columns."""
    named = docs.select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), n_tokens(F.col(text)).alias("n_tokens"), F.col(text).alias("text"))
    return named.select("key", "source", "lang", topic(F.col("text"), F.col("n_tokens")).alias("topic"), "n_tokens")


def raked(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, powers: Mapping[str, float] = POWERS, close: float = CLOSE) -> tuple[DataFrame, float]:
    """Cells (source, lang, topic, tokens) with their weight, and the residual: the largest miss of a marginal, as a share
    of all tokens. Rounds go on until it is `close` or less, or MOST * ROUNDS are done (targets that contradict each other,
    or that ask for tokens of values without any, can't be met: the residual says by how much). targets: shares by dimension and value; a value not named keeps nothing.
    Dimensions without targets take powers. Cells without tokens weigh 0."""
    out = cells
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("t"))
    out = out.withColumn("__total", total.scalar())
    for d in DIMENSIONS:
        if targets and d in targets:
            goal = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in targets[d].items() for x in kv]), F.col(d)), F.lit(0.0)) / sum(targets[d].values())
        else:
            sums = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("s"))
            norm = sums.agg(F.sum(F.pow("s", F.lit(powers[d]))).alias("n"))
            out = out.withColumn(f"__n_{d}", norm.scalar()).withColumn(f"__s_{d}", F.sum("tokens").over(Window.partitionBy(d)).cast("double"))
            goal = F.coalesce(F.try_divide(F.pow(F.col(f"__s_{d}"), F.lit(powers[d])), F.col(f"__n_{d}")), F.lit(0.0))
        out = out.withColumn(f"__goal_{d}", goal * F.col("__total"))
    out = saved(out.withColumn("weight", F.when(F.col("tokens") > 0, F.lit(1.0)).otherwise(0.0)), "cells")
    sums = lambda d: F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(d))
    residual = 0.0
    for _ in range(MOST):
        before = out
        for _ in range(ROUNDS):
            for d in DIMENSIONS:
                out = out.withColumn("weight", F.when(sums(d) > 0, F.col("weight") * F.col(f"__goal_{d}") / sums(d)).otherwise(0.0))
        out = saved(out, "raking")
        discard(before)
        misses = [F.abs(sums(d) - F.col(f"__goal_{d}")) for d in DIMENSIONS]
        residual = out.select(F.try_divide(F.greatest(*misses), F.col("__total")).alias("r")).agg(F.coalesce(F.max("r"), F.lit(0.0))).first()[0]
        if residual <= close:
            break
    return out.select(*DIMENSIONS, "tokens", "weight"), residual


def probabilities(cells: DataFrame, budget: float = BUDGET, steps: int = STEPS) -> DataFrame:
    """Raked cells with probability = min(1, factor * weight), so that the expected tokens are budget times all tokens.
    Each step reads two sums; one is enough while no probability is capped."""
    factor = 1.0
    for _ in range(steps):
        got, all_of = cells.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(factor) * F.col("weight"))), F.sum("tokens")).first()
        if not got or abs(got - budget * all_of) <= 1e-12 * all_of:
            break
        factor *= budget * all_of / got
    return saved(cells.withColumn("probability", F.least(F.lit(1.0), F.lit(factor) * F.col("weight"))), "probabilities")


def _chances(rows: DataFrame, targets, powers, budget: float) -> DataFrame:
    """Weight and probability of each cell of rows."""
    cells = saved(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    return probabilities(raked(cells, targets, powers)[0], budget)


def _draw(key: Column) -> Column:
    return hashed_52(key, F.lit("mix")) / F.lit(float(1 << 52))


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", targets: Mapping | None = None, powers: Mapping[str, float] = POWERS, budget: float = BUDGET, topic: Topic = topic_of) -> DataFrame:
    """One row per row of docs: key, source, lang, topic, n_tokens, weight, probability, draw, kept.

    topic: (text, number of tokens) -> topic column; the default is a plain rule. Null sources and languages count as the
    value ''. Null texts have no tokens and weight the same as their cell. Rows that share a key share the draw, so they are
    kept or dropped together within a cell; a null key has a draw like others. If all texts are empty every weight is 0 and
    nothing is kept. Very long texts count whole. An empty table gives no rows. Other columns aren't read.
    """
    rows = _rows(docs, key, text, source, lang, topic)
    cells = _chances(rows, targets, powers, budget)
    joined = rows.join(cells.drop("tokens"), list(DIMENSIONS)).withColumn("draw", _draw(F.col("key")))
    return joined.select(F.col("key").alias(key), *DIMENSIONS, "n_tokens", "weight", "probability", "draw", (F.col("draw") < F.col("probability")).alias("kept"))


def sample_mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", targets: Mapping | None = None, powers: Mapping[str, float] = POWERS, budget: float = BUDGET, topic: Topic = topic_of) -> DataFrame:
    """The rows of docs that mixture() keeps, all columns, whatever their names."""
    cells = _chances(_rows(docs, key, text, source, lang, topic), targets, powers, budget)
    names = {d: free_name(docs, f"mix_{d}") for d in (*DIMENSIONS, "probability")}
    value = {"source": F.coalesce(F.col(source).cast("string"), F.lit("")), "lang": F.coalesce(F.col(lang).cast("string"), F.lit("")), "topic": topic(F.col(text), n_tokens(F.col(text)))}
    marked = docs.select("*", *[value[d].alias(names[d]) for d in DIMENSIONS])
    joined = marked.join(cells.select(*[F.col(d).alias(n) for d, n in names.items()]), [names[d] for d in DIMENSIONS])
    return joined.where(_draw(F.col(key)) < F.col(names["probability"])).select(*[joined[c] for c in docs.columns])


def _oracle() -> str:
    parts = [
        r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, text, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents)""",
        """r AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN contains(text, 'licensed under') THEN 'licence' WHEN contains(text, ' | ') THEN 'table' WHEN n_tokens < 50 THEN 'note' WHEN n_tokens < 400 THEN 'article' ELSE 'long' END AS topic FROM w)""",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM r GROUP BY ALL)",
        *[f"g_{d} AS (SELECT {d}, pow(s, {POWERS[d]}e0) / sum(pow(s, {POWERS[d]}e0)) OVER () * sum(s) OVER () AS goal_{d} FROM (SELECT {d}, sum(tokens) AS s FROM c GROUP BY {d}))" for d in DIMENSIONS],
        "k0 AS (SELECT *, CASE WHEN tokens > 0 THEN 1e0 ELSE 0e0 END AS weight FROM c " + " ".join(f"JOIN g_{d} USING ({d})" for d in DIMENSIONS) + ")",
    ]
    n = 0
    for _ in range(4 * ROUNDS):
        for d in DIMENSIONS:
            parts.append(f"k{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (weight), CASE WHEN sum(tokens * weight) OVER (PARTITION BY {d}) > 0 THEN weight * goal_{d} / sum(tokens * weight) OVER (PARTITION BY {d}) ELSE 0e0 END AS weight FROM k{n})")
            n += 1
    parts.append("f0 AS (SELECT 1e0 AS f)")
    for i in range(STEPS):
        parts.append(f"f{i + 1} AS MATERIALIZED (SELECT f * {BUDGET}e0 * (SELECT sum(tokens) FROM k{n}) / (SELECT sum(tokens * least(1e0, f * weight)) FROM k{n}) AS f FROM f{i})")
    return ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(least(1e0, f * weight), 6) AS probability,
  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|mix'), 1, 13))::BIGINT / 4503599627370496e0 < least(1e0, f * weight) AS kept
FROM r JOIN k{n} USING (source, lang, topic), f{STEPS}"""


ORACLE_SQL = _oracle()
