"""Operators run where only the driver has the package."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).config("spark.local.dir", sys.argv[2]).config("spark.sql.warehouse.dir", sys.argv[2]).getOrCreate()
def missing(_):
    try:
        import trajscreen
    except ImportError:
        return [1]
    return [0]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(missing).collect() == [1], "workers have the package"
sys.path.insert(0, sys.argv[1])
from trajscreen.llm import fill_middle, hard_negatives, lm_score, ngram_join
texts = ["one two three four five six seven", "one two three four five six seven", "quite another text of some more words", None, ""]
docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
assert sorted((r[0], r[2]) for r in ngram_join.similar(docs).collect()) == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 4)]
assert ngram_join.deduplicated(docs).count() == 4
assert fill_middle.transformed(docs, rate=100).count() == 5
assert lm_score.scored(docs, lambda k: k == "1", steps=2).count() == 5
rows = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.8, 0.0])], "vec_id long, label int, embedding array<double>")
assert hard_negatives.mined(rows, F.col("vec_id") == 0).count() == 1
print("all ran")
"""


def test_operators_without_the_package_on_workers(tmp_path):
    (tmp_path / "shared").mkdir()
    (tmp_path / "run.py").write_text(SCRIPT)
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "run.py", root, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "all ran" in done.stdout, done.stderr[-3000:]
