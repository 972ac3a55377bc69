"""What a Python worker holds while it compares a large group, and from one operator to the next."""

import tracemalloc

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa

from tarnbase.llm import neardup, packing


class Group:
    """Stands for the rows: gives back the function that a worker runs on a group."""

    def groupBy(self, *_):
        return self

    def applyInPandas(self, run, _):
        return run

    mapInArrow = applyInPandas


def peak(run):
    tracemalloc.start()
    try:
        got = run()
        return got, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def alike(n):
    """Sketches and bands of n copies that share one band, the last."""
    bands = np.arange(32 * n, dtype=np.int64).reshape(n, 32)
    bands[:, -1] = -7
    return [np.zeros(8, np.int64)] * n, list(bands)


def test_memory_of_promising_rows_of_a_group():
    n = 4 * neardup.MOST
    sketch, bands = alike(n)
    rows = {"key": -7, "wi": 0, "wj": 1, "blk": np.arange(n) % 4, "per": 2, "doc": np.arange(n), "comp": np.arange(n), "sketch": sketch, "bands": bands}
    got, mb = peak(lambda: neardup._promising(Group(), 100)(pd.DataFrame(rows)))
    assert sorted(zip(got["doc"], got["bi"], got["bj"], strict=True)) == sorted((d, min(d % 4, b), max(d % 4, b)) for d in range(n) for b in range(4) if b // 2 != d % 4 // 2)
    assert mb < 60, mb


def test_memory_of_whole_sets_of_a_group():
    n = 2 * neardup.MOST
    sets = [np.r_[np.arange(60), 100 + i].astype(np.uint64).tobytes() for i in range(n)]
    cols = [np.zeros(n, np.int64), np.zeros(n, np.int32), np.ones(n, np.int32), (np.arange(n) % 2).astype(np.int32), np.arange(n), np.arange(n) // 2 * 2, pa.array([[0] * 8] * n, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
    batch = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=[*"abcdefgh"])
    got, mb = peak(lambda: list(neardup._compare_blocks(Group(), 100, 75, whole=True)(iter([batch]))))
    # every pair of components meets once
    assert sum(b.num_rows for b in got) == (n // 2) * (n // 2 - 1) // 2
    assert mb < 90, mb


def test_one_operator_at_a_time_is_remembered():
    path = public_tokenizers.path("word_bpe_49k.json")
    first = packing._codec(path, 1)
    assert packing._codec(path, 1) is first and len(first.encode("some words")) > 4
    neardup.shingle_hashes("other words of another stage")
    assert packing._codec(path, 1) is not first
