"""What operators leave behind in Python workers, which outlive their tasks."""

import re
import subprocess
import sys
from pathlib import Path

from stratakv.llm import bpe, minhash, quality
from stratakv.llm.queries import vocabulary


def test_operators_drop_what_others_keep(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    texts, found = minhash.row_texts(docs), []
    whole = type(docs).mapInArrow

    def seen(self, func, *rest, **more):
        found.append(func)
        return whole(self, func, *rest, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", seen)
    model = quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    quality.keep_good(docs, model), quality.score(docs, model), minhash.sketches(texts), minhash._with_sets(docs.withColumnRenamed("doc_id", "id"))
    monkeypatch.undo()
    assert len(found) == 6
    path = vocabulary("word_bpe_49k.json")
    for func in found:
        bpe.codec(path)
        list(func(iter([])))
        assert bpe.codec.cache_info().currsize == 0
    monkeypatch.setattr(type(docs), "mapInArrow", seen)
    bpe.bpe_encode(docs, path)
    bpe.codec(path)
    list(found[-1](iter([])))
    assert bpe.codec.cache_info().currsize == 1  # its own tables stay from task to task


PROBE = """
import re, sys
from pathlib import Path
import numpy as np
from stratakv.llm.common import lean

def mb():
    return int(re.search(r"VmRSS:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024

def work(batches):
    for _ in batches:
        held = [np.ones(8_000) for _ in range(3_000)]
        pins.append(bytes(200_000 // 2))  # above them, so the heap's end can't sink
        del held
        yield 0

pins, before = [], mb()
list((lean(work) if sys.argv[1] == "lean" else work)(iter([0])))
print(mb() - before)
"""


def test_free_memory_goes_back():
    def left(how: str) -> float:
        root = str(Path(bpe.__file__).resolve().parents[2])
        env = {"PYTHONPATH": root, "OMP_NUM_THREADS": "1", "PATH": "/usr/bin:/bin"}
        return float(subprocess.run([sys.executable, "-c", PROBE, how], env=env, cwd=root, capture_output=True, text=True, check=True, timeout=120).stdout)

    if not re.search("glibc|GNU", subprocess.run(["ldd", "--version"], capture_output=True, text=True).stdout):
        return
    assert left("plain") > 100 and left("lean") < 30
