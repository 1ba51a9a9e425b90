"""Arrow workers hold little memory between tasks."""

import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontam, jaccard_join, packing, textvec
from tidemark.llm.queries import tokenizer_path


def longest_tables(spark):
    """The longest table of powers in each worker that Spark kept."""

    def told(batches):
        for _ in batches:
            time.sleep(0.5)  # long enough that every kept worker gets a task
            yield pa.RecordBatch.from_arrays([pa.array([max(map(len, textvec._powers.values()), default=0)])], names=["n"])

    return [r.n for r in spark.range(0, 8, 1, 8).mapInArrow(told, "n long").collect()]


@pytest.mark.parametrize("which", ["near_duplicates", "contamination", "pieces"])
def test_a_long_text_leaves_no_table_behind(spark, which):
    docs = spark.createDataFrame([(1, "some words " * 200_000), (2, "other words")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "some words that are in no text at all")], "item_id string, text string")
    found = {
        "near_duplicates": lambda: jaccard_join.keep_one(docs),
        "contamination": lambda: decontam.contamination(docs, items),
        "pieces": lambda: packing.token_pieces(docs, tokenizer_path()),
    }[which]()
    assert {r.doc_id for r in found.collect()} == {1, 2}
    assert max(longest_tables(spark)) <= 1 << 20


def test_freed_memory_goes_back_when_a_task_ends():
    from tidemark.llm import workers

    def held():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    kept = []

    def work(batches):
        yield from batches
        parts = [np.ones(4_000) for _ in range(8_000)]  # 256 MB in pieces too small to be mapped apart
        kept.append(np.ones(1_000))  # lies behind them, so that they stay inside the heap

    before = held()
    assert len(list(workers.tidy(work)(iter([pa.RecordBatch.from_pydict({"n": [1]})])))) == 1
    assert held() - before < 64
