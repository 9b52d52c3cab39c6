"""The pipeline against its stages' rules, and the registered queries."""

import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from trackmill.llm import decontaminate, near_dups, tokens, toxicity
from trackmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    a = stages[0](spark, docs, SF).cache()
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    assert a.columns == docs.columns and sorted(ids(a)) == sorted(set(ids(docs)) - toxic)
    b = stages[1](spark, a, SF).cache()
    first = {r["class_id"] for r in near_dups.near_dups(a).collect()}
    assert b.columns == docs.columns and set(ids(b)) == first
    c = stages[2](spark, b, SF).cache()
    leaked = {r["doc_id"] for r in decontaminate.contamination(b, bench).filter("contaminated = 1").collect()}
    assert c.columns == docs.columns and set(ids(c)) == set(ids(b)) - leaked
    d = stages[3](spark, c, SF).cache()
    assert d.columns == docs.columns and set(ids(d)) <= set(ids(c)) and len(ids(d)) == len(set(ids(d)))
    good = {r["doc_id"] for r in labels.filter("quality = 1 and toxic = 0").collect()} & set(ids(c))
    assert len(good - set(ids(d))) <= 0.1 * len(good)
    e = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in stages[4](spark, d, SF).collect()}
    encoder, start = tokens.Encoder(tokens.tokenizer_path(), 4), 0
    for r in d.orderBy("doc_id").collect():
        data = encoder.encode(r["text"] or "") + np.array([2], "<u4").tobytes()
        assert e[r["doc_id"]] == (start, len(data) // 4, zlib.crc32(data))
        start += len(data) // 4


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)


@pytest.mark.parametrize("table", ["documents"])
def test_entry_without_llm(table):
    """The other queries import while the removable parts are missing."""
    import subprocess
    import sys

    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('trackmill.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 100 and 'pipeline' not in e.queries() and not any(n.startswith('op1_') for n in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
