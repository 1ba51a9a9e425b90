"""The pipeline's stages, each against brute force on what it was given."""

import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
import pyarrow.parquet as pq
from test_operators import ALNUM, FOLD, SF, SPACED, components

from tidemark.llm import quality
from tidemark.llm.shared import table, written


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    given = {}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = [(r.doc_id, r.text) for r in docs.collect()]
        docs = written(stage(spark, docs, SF), name)
        out[name] = docs.collect()
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns

    ids = lambda name: sorted(r.doc_id for r in out[name])
    judged = quality.judge(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert ids("quality_rules") == sorted(r.doc_id for r in judged.filter("kept").collect())
    assert ids("near_duplicates") == sorted(d for d, _, c in components(given["near_duplicates"], 5, 80, 100) if d == c)

    windows = defaultdict(set)
    for text in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist():
        w = ALNUM.findall((text or "").translate(FOLD))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[len(w[k : k + 10])].add(tuple(w[k : k + 10]))
    clean = []
    for d, text in given["decontamination"]:
        w = ALNUM.findall((text or "").translate(FOLD))
        if not any(tuple(w[i : i + n]) in found for n, found in windows.items() for i in range(len(w) - n + 1)):
            clean.append(d)
    assert ids("decontamination") == sorted(clean)
    assert sorted({r.doc_id for r in out["best_fit_packing"]}) == sorted(clean)
    assert all(SPACED.findall(t) for _, t in given["best_fit_packing"])


def test_repeated_rows_stay_once(spark):
    docs = table(spark, SF, "documents").limit(5)
    twice = docs.union(docs).union(docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars").limit(1))
    kept = corpus_pipeline.near_duplicates(spark, twice, SF).collect()
    named = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(named) == len(set(named)) and all(r.doc_id is not None for r in kept)


def test_run_is_the_last_stage(spark):
    found = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(found.columns)
    assert found.count() > 0
