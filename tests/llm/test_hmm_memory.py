"""What op3's steps hold at once in a Python worker: two of them share an executor's memory with a JVM that may use all its heap."""

import pickle
import tracemalloc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pytest

from texmill.llm import hmm

MB = 1 << 20


@contextmanager
def held():
    """Most MB held at once since the start, by Python with numpy and by Arrow."""
    was, most = pa.default_memory_pool(), {}
    pool = pa.proxy_memory_pool(was)
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        yield most
        most |= {"python": tracemalloc.get_traced_memory()[1] / MB, "arrow": pool.max_memory() / MB}
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(was)


def batches(n, size=4 * MB, distinct=400_000):
    """Record batches like Spark's, of texts of some 300 words, most of them rare."""
    rng = np.random.default_rng(3)
    for k in range(n):
        texts = [" ".join(f"w{x:x}" for x in (distinct * rng.random(300) ** 2).astype(int)) for _ in range(size // 2000)]
        ids = pa.array(range(k * len(texts), (k + 1) * len(texts)), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array([False] * len(texts)), pa.array(texts)], names=["doc_id", "held_out", "text"])


def test_counting_holds_little():
    given = [b.select(["text"]) for b in batches(5)]
    with held() as most:
        n = sum(sum(b.column("n").to_pylist()) for b in hmm._counts(iter(given)))
    assert n == sum(b.num_rows for b in given) * 301
    assert most["arrow"] < 45, most


def test_coding_holds_little(spark):
    how = hmm.Setup()
    words = spark.range(150_000).selectExpr("concat('w', lower(hex(id))) AS word", "150000 - id AS c")
    sent = pickle.dumps(hmm.vocabulary(words, how))
    given = list(batches(2))
    with held() as most:
        vocab = pickle.loads(sent)
        tokens = sum(sum(b.column("n_tokens").to_pylist()) for b in hmm._encoded(iter(given), vocab, how))
    assert tokens == sum(b.num_rows for b in given) * 301
    assert most["python"] < 30, most
    assert most["arrow"] < 30, most


@pytest.mark.parametrize("long", [100, 2000])
def test_a_pass_holds_little(long):
    how, rng = hmm.Setup(), np.random.default_rng(4)
    emit = rng.random((how.kinds, how.states))
    model = hmm.Model(np.full(how.states, 1 / how.states), np.full((how.states,) * 2, 1 / how.states), emit / emit.sum(axis=0))
    texts = [rng.integers(0, how.kinds, int(rng.integers(1, 2 * long))) for _ in range(600_000 // long)]
    with held() as most:
        total = sum(hmm.expected(model, [texts[k] for k in some], how.kinds)[2].sum() for some in hmm.parts(texts))
    assert total == pytest.approx(sum(len(t) for t in texts))
    assert most["python"] < 60, most


def test_slices_hold_every_row():
    sizes = [0, 5, 3, 40, 0, 9, 10, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(["é" * (n // 2) + "x" * (n % 2) for n in sizes])], names=["text"])
    for most in (1, 8, 10, 1000):
        for given in (batch, batch.slice(1, 6), batch.slice(0, 0)):
            got = list(hmm.slices(given, most))
            assert [x for b in got for x in b.column("text").to_pylist()] == given.column("text").to_pylist()
            assert all(b.num_rows == 1 or sum(len(x.encode()) for x in b.column("text").to_pylist()) <= most for b in got)


def test_classes_of_arrays():
    how = hmm.Setup()
    words = pa.array(["", "a", "abc.", "É'", "...", "x)!", "日本語四", "🙂🙂🙂🙂;", "don't", "\x00\x1f", "é̂̃.", "abc."])
    assert hmm.klasses(words, how).tolist() == [hmm.klass(w, how) for w in words.to_pylist()]
    assert hmm.klasses(words[2:5], how).tolist() == [hmm.klass(w, how) for w in words[2:5].to_pylist()]
    assert len(hmm.klasses(words[:0], how)) == 0
