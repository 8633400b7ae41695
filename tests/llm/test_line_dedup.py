"""Memory of the signatures of operator 4."""

import tracemalloc

import numpy as np

from emporio.llm import line_dedup as L


def test_signatures_of_a_stretch_need_little_memory():
    """Every array of a stretch is alive at once, in each task of an executor."""
    letters = np.random.default_rng(1).integers(97, 123, (80_000, 80), dtype=np.uint8)
    lines = [bytes(x).decode() for x in letters]
    start, end = next(L.chunks(lines))
    tracemalloc.start()
    L.signatures(lines[start:end], L.Options())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
