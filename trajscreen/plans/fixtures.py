"""Views that the registered queries read, derived from the tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "rest": """SELECT CAST(n AS INT) AS node, CAST(t AS INT) AS node_type, CAST(a AS DOUBLE) AS rx, CAST(b AS DOUBLE) AS ry, CAST(c AS DOUBLE) AS rz
FROM (VALUES (0,0,0e0,0e0,0e0),(1,0,20e0,0e0,0e0),(2,0,0e0,20e0,0e0),(3,0,0e0,0e0,20e0),(4,0,20e0,20e0,20e0),(5,1,0e0,0e0,-4e-1),(6,1,20e0,0e0,-20e0),(7,1,0e0,20e0,-20e0),(8,1,6e0,6e0,-40e0)) AS r(n,t,a,b,c)""",
    "cells": "SELECT CAST(c AS INT) AS cell, CAST(a AS INT) AS v0, CAST(b AS INT) AS v1, CAST(d AS INT) AS v2, CAST(e AS INT) AS v3 FROM (VALUES (0,0,1,2,3),(1,1,2,3,4),(2,6,5,7,8)) AS q(c,a,b,d,e)",
    "positions": """SELECT q.sim, q.frame, q.node,
  rx + q.frame*5e-2*(q.node%3-1) + (CAST(q.l_quantity AS DOUBLE)-255e-1)*4e-4 AS x, ry + q.frame*3e-2*(q.node%2) + (CAST(q.l_discount AS DOUBLE)-5e-2)*2e-1 AS y, rz + q.frame*2e-2 + (CAST(q.l_tax AS DOUBLE)-4e-2)*25e-2 AS z
FROM (SELECT sim, CAST(FLOOR(r/9e0) AS INT) AS frame, CAST(r%9 AS INT) AS node, l_quantity, l_discount, l_tax
  FROM (SELECT l_suppkey AS sim, l_quantity, l_discount, l_tax, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) w
  WHERE r < n - n % 9) q JOIN rest ON rest.node = q.node""",
    "records": """SELECT sim, frame, type, sev, k, k >= 50 AS label, CASE WHEN k >= 75 THEN 'onset' WHEN k >= 50 THEN 'sustained' ELSE 'clean' END AS phase, value + k*5e-1 AS score_a, value AS score_b
FROM (SELECT user_id AS sim, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame, CAST(1 + event_id % 3 AS INT) AS sev, CAST(value AS DOUBLE) AS value,
  CASE event_type WHEN 'signup' THEN 'hourglass' WHEN 'error' THEN 'penetration' WHEN 'click' THEN 'inversion' WHEN 'view' THEN 'instability' ELSE 'frozen' END AS type,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e""",
    "tall": "SELECT sim, frame, type, sev, label, phase, 'a' AS detector, score_a AS score FROM records UNION ALL SELECT sim, frame, type, sev, label, phase, 'b' AS detector, score_b AS score FROM records",
    "edges": """SELECT a AS src, b AS dst FROM und UNION ALL SELECT b AS src, a AS dst FROM und""",
    "und": """SELECT DISTINCT CASE WHEN p < q THEN p ELSE q END AS a, CASE WHEN p < q THEN q ELSE p END AS b FROM (SELECT v0 AS p, v1 AS q FROM cells UNION ALL SELECT v0, v2 FROM cells UNION ALL SELECT v0, v3 FROM cells UNION ALL SELECT v1, v2 FROM cells UNION ALL SELECT v1, v3 FROM cells UNION ALL SELECT v2, v3 FROM cells) e""",
    "confidence": "SELECT d.doc_id AS item, (d.n_chars % 1000)/1e3 AS conf, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS correct FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "answers": """SELECT conv_id, turn, role AS arm, CAST(conv_id % 6 AS INT) AS truth_id, CAST((conv_id*7+turn) % 6 AS INT) AS type_id, CAST((conv_id*7+turn) % 9 AS INT) AS cell_id, CAST((conv_id + turn) % 9 AS INT) AS truth_cell,
  concat(coalesce(text, ''), ' {"anomaly_type": "', CASE WHEN (conv_id*5+turn) % 13 = 0 THEN 'unknown' ELSE concat('type', CAST((conv_id*7+turn) % 6 AS STRING)) END, '", "location": "c', CAST((conv_id*7+turn) % 9 AS STRING), '", "confidence": ', CAST((conv_id % 10) AS STRING), CASE WHEN (conv_id*3+turn) % 11 = 0 THEN '' ELSE '}' END) AS raw FROM conversations""",
    "unit": "SELECT vec_id, label, CAST(FLOOR(vec_id/4e0) AS BIGINT) AS item, embedding FROM embeddings",
}
NEEDS = {"positions": ("rest", "lineitem"), "records": ("events",), "tall": ("records",), "und": ("cells",), "edges": ("und",), "confidence": ("documents", "labels"), "answers": ("conversations",), "unit": ("embeddings",)}
TABLES = ("lineitem", "events", "documents", "labels", "conversations", "embeddings")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of sf_dir."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = {n: view(spark, sf_dir, n) for n in NEEDS.get(name, ())}
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for n in needs:
        text = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    text = text.replace("rest.node", "r9.node").replace("JOIN {rest} ON", "JOIN {rest} r9 ON") if name == "positions" else text
    return spark.sql(text, **needs) if needs else spark.sql(VIEWS[name])


def oracle(select: str, *names: str) -> str:
    """SQL for DuckDB: the named views and those they need as common table expressions before a select (or more
    expressions, beginning with a comma)."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, ()):
            if m in VIEWS:
                add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    head = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order)
    return head + (select if select.lstrip().startswith(",") else "\n" + select)
