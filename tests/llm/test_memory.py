"""Workers that serve every stage of the pipeline must not keep what one of them needed at its peak."""

import subprocess
import sys

import numpy as np
import pyarrow as pa

from corpuslens.llm import toxicity
from corpuslens.llm.common import map_arrow

LEARN = """
import random
from corpuslens.llm import toxicity

def megabytes(key):
    return next(int(x.split()[1]) / 1024 for x in open("/proc/self/status") if x.startswith(key))

rng = random.Random(5)
texts = [" ".join(f"w{rng.randrange(150_000)}abc" for _ in range(250)) for _ in range(2000)]
toxicity.train(texts[:20], [0, 1] * 10, 4)
open("/proc/self/clear_refs", "w").write("5")
before = megabytes("VmRSS")
toxicity.train(texts, [0, 1] * 1000, 4)
print(megabytes("VmHWM") - before)
"""


def test_memory_of_learning():
    """A sample of 150,000 different words: with all their grams and inputs made at once it took 306 MB."""
    done = subprocess.run([sys.executable, "-c", LEARN], capture_output=True, text=True, env={"PYTHONPATH": ".", "OMP_NUM_THREADS": "1"}, check=True)
    assert float(done.stdout.split()[-1]) < 220


def test_codes_by_part(monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 7)
    words = [f"{'x' * (k % 9)}{k}".encode() for k in range(50)]
    hashes, edges, own = toxicity.gram_codes(words)
    by_part = toxicity.gram_codes_by_part(words)
    assert (by_part[0] == hashes % np.uint64(toxicity.BUCKETS)).all() and (by_part[1] == edges).all() and (by_part[2] == own).all()
    assert [len(x) for x in toxicity.gram_codes_by_part([])] == [0, 1, 0]
    net, table = toxicity.Network(), np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)
    parts = net.word_inputs(by_part, (table, table))
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 1000)
    assert (net.word_inputs((hashes, edges, own), (table, table)) == parts).all()


def test_freed_memory_goes_back(spark):
    """A worker's memory after a task that filled 300 MB with small arrays and kept only the last."""

    def run(batches):
        import os
        import sys

        for _ in batches:
            held = [np.ones(5000) for _ in range(8000)]
            sys.modules["os"].held_for_a_test = held[-1]  # the top of the heap stays in use
            del held
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()])], ["pid"])

    pid = map_arrow(spark.range(1).repartition(1), run, "pid long", release=True).collect()[0].pid
    with open(f"/proc/{pid}/status") as file:
        kept = next(int(x.split()[1]) / 1024 for x in file if x.startswith("RssAnon"))
    assert kept < 200
