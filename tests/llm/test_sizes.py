"""Plans and memory that must not depend on the size of the table."""

import inspect
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from frameloom.llm import lines, lm


def sent(k, chunks, size, seed=5):
    """What chunks send to shard 3: n-grams of few contexts, sorted at order 2."""
    r, rows = np.random.default_rng(seed), [{"shard": 3, "chunk": "x", "kept": b"kept", "alone": b"", "own": b""}]
    for c in range(chunks):
        pair = np.unique(r.integers(1, 1 + size // 8, size) * (1 << 20) + r.integers(1, 1 << 12, size))
        context, word = pair >> 20, pair & ((1 << 20) - 1)
        new = np.append(True, context[1:] != context[:-1])
        heads = context[new]
        train = r.integers(0, 3, len(pair)).astype(np.uint32)
        rows.append({
            "shard": 3, "chunk": str(c), "new": lm._pack(np.packbits(new)), "context": lm._pack(np.diff(heads, prepend=0) if k == 2 else heads), "context_n": lm._pack(heads * 50), "word": lm._pack(word), "train": lm._pack(train),
            "other": lm._pack(1 - np.minimum(train, 1)), "lower": lm._pack((word % 9000).astype(np.uint16)),
        })
    return pa.Table.from_pylist(rows, schema=lm._arrow(lm.SENT))


@pytest.mark.parametrize("k", [2, 3])
def test_answers_by_ranges_of_contexts(k):
    """The same answers, numbers included, however a shard's level is cut."""
    t = sent(k, 5, 3000)
    whole = lm._answer(k, False, 7, 1 << 40)(t)
    assert all(lm._answer(k, False, 7, part)(t).equals(whole) for part in (64, 500, 4000))
    assert lm._answer(k, True, 7, 500)(t).column("code").equals(whole.column("code"))
    one = pa.concat_tables([t.slice(0, 1), t.slice(1, 1)])
    assert lm._answer(k, True, 7, 64)(one).column("code")[1] is not None


def test_memory_of_a_shard():
    """Bytes for each n-gram that a shard gets: its columns and a part of the level, not several copies."""
    t = sent(3, 6, 200_000)
    n = sum(len(lm._unpack(b, np.int64)) for b in t.column("word").to_pylist()[1:])
    small = {"part": 1 << 16} if "part" in inspect.signature(lm._answer).parameters else {}
    run = lm._answer(3, False, 7, **small)
    tracemalloc.start()
    run(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / n < 70


def test_line_dedup_has_one_plan_for_all_sizes(spark):
    docs = spark.createDataFrame([(k, "a b\nc d\ne f\nown %d" % k) for k in range(5)] + [(9, None)], "doc_id long, text string")
    got = lines.dedup_lines(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {r.doc_id: r.n_removed for r in got.collect()} == {0: 0, 1: 3, 2: 3, 3: 3, 4: 3, 9: 0}
