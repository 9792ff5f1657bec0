"""What tasks leave in the executors' Python workers, and that decontamination starts none."""

import re
import subprocess
import sys

from pyspark import SparkContext

from scorelake.llm.decontaminate import contaminated, decontaminate

#: Memory of a process of its own before and after a task's function has run over 12 MB of texts.
TASK = """
import random, re
import pyarrow as pa
from scorelake.llm import ngram_join

def held():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon:\\s+(\\d+)", f.read())[1]) / 1024

rng = random.Random(3)
words = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
def batches(n):
    for _ in range(n):
        yield pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([" ".join(rng.choices(words, k=1500)) for _ in range(400)])], ["id", "text"])

list(ngram_join.profile(1 << 16)(batches(0)))
before, rows = held(), 0
for out in ngram_join.profile(1 << 16)(batches(3)):
    rows += out.num_rows
del out
print("LEFT", held() - before, rows)
"""


def test_a_task_leaves_little_in_its_worker():
    said = subprocess.run([sys.executable, "-c", TASK], capture_output=True, text=True, timeout=120, check=True).stdout
    left, rows = re.search(r"LEFT (\S+) (\d+)", said).groups()
    assert int(rows) == 3 * 400 + 64
    assert float(left) < 30  # the powers that all texts share are 16 of them


def test_decontamination_starts_no_python_worker(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "nothing of that is in here at all")], "doc_id long, text string").localCheckpoint()
    bench = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").localCheckpoint()

    def converted(*_, **__):
        raise AssertionError("rows of a list are converted by workers")

    monkeypatch.setattr(SparkContext, "parallelize", converted)
    assert [tuple(r) for r in contaminated(docs, bench).select("doc_id", "item_id").collect()] == [(1, 7)]
    assert [r["doc_id"] for r in decontaminate(docs, bench).collect()] == [2]
