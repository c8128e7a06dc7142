"""What a task holds, and what it leaves to the next one."""

from __future__ import annotations

import re
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from obsmill.llm import packing, secret_scan
from obsmill.llm.common import tidy


def task(monkeypatch, df, make):
    """The function that an operator gives to mapInArrow, to be called here."""
    found = []
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, f, schema: found.append(f) or self)
        make(df)
    return found[0]


def held(run, batch) -> tuple[int, int]:
    """Peak bytes of Python and NumPy, and rows out."""
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak, rows


@pytest.fixture(scope="module")
def batch():
    some = np.random.default_rng(1)
    words = np.array([f"w{x}" for x in some.integers(0, 10**6, 2000)])
    return pa.record_batch([pa.array(range(4000), pa.int64()), pa.array([" ".join(words[some.integers(0, 2000, 900)]) for _ in range(4000)])], ["id", "text"])


def test_packing_holds_some_texts_and_a_window(spark, monkeypatch, batch):
    file = public_tokenizers.path("byte_bpe_50k.json")
    run = task(monkeypatch, spark.createDataFrame([], "doc_id long, text string"), lambda df: packing.pack_documents(df, file))
    packing.tokenizer(file)
    monkeypatch.setattr(packing, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})())}))
    size = batch.column(1).nbytes
    peak, rows = held(run, batch)
    assert size > 20_000_000 and rows >= 4000
    assert peak < 2.5 * size


def test_redaction_holds_some_texts(spark, monkeypatch, batch):
    run = task(monkeypatch, spark.createDataFrame([], "doc_id long, text string"), lambda df: secret_scan.redact_documents(df))
    peak, rows = held(run, batch)
    assert rows == 4000
    assert peak < batch.column(1).nbytes


def test_redaction_in_parts_is_the_whole_batch(spark, monkeypatch):
    texts = [None, "", "x" * 5_000_000, "password=hunter22 end", "y" * 5_000_000, "é token: abcdef12", None]
    run = task(monkeypatch, spark.createDataFrame([], "doc_id long, text string, n_chars long"), lambda df: secret_scan.redact_documents(df))
    b = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([None if t is None else len(t) for t in texts], pa.int64())], ["doc_id", "text", "n_chars"])
    out = [r for part in run(iter([b])) for r in part.to_pylist()]
    assert [r["doc_id"] for r in out] == list(range(len(texts)))
    assert [r["text"] for r in out] == [None, "", texts[2], "[SECRET] end", texts[4], "é [SECRET]", None]
    assert [r["n_chars"] for r in out] == [None if r["text"] is None else len(r["text"]) for r in out]


def test_a_task_gives_back_its_memory():
    def anon() -> int:
        return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1])

    pinned = []

    def run(batches):
        some = [bytes(1000 + k % 7) for k in range(200_000)]
        pinned.append(bytes(2000))  # at the heap's end: what is below can't go by itself
        yield anon()
        del some

    [at_peak] = tidy(run)(iter([]))
    assert at_peak - anon() > 150_000
