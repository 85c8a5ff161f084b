"""The run-length index against a plain sort and a plain search."""

import random

import numpy as np
import pytest

from loomtrace.llm import repeat_index


def _covered(segments, docs, length):
    first = {}
    for s, d in zip(segments, docs, strict=True):
        for k in range(len(s) - length + 1):
            first.setdefault(s[k : k + length], d)
    out = []
    for s, d in zip(segments, docs, strict=True):
        gone = bytearray(len(s))
        for k in range(len(s) - length + 1):
            if first[s[k : k + length]] < d:
                gone[k : k + length] = b"\1" * length
        out.append(bytes(gone))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_statistics_and_marks(seed):
    rng = random.Random(seed)
    length, base = rng.choice([10, 17, 50]), bytes(rng.choice(b"ab") for _ in range(400))
    segments, docs = [], []
    for _ in range(rng.randrange(1, 12)):
        a = rng.randrange(350)
        segments.append(base[a : a + rng.randrange(1, 150)] + bytes(rng.choice(b"abc") for _ in range(rng.randrange(30))))
        docs.append(docs[-1] + rng.randrange(2) if docs else 0)
    marks = [bytearray(len(s)) for s in segments]
    for i, a, b in repeat_index.repeats(segments, np.array(docs), length):
        marks[i][a:b] = b"\1" * (b - a)
    assert [bytes(m) for m in marks] == _covered(segments, docs, length)
    index = repeat_index.RunLengthIndex(segments, length)
    matched, source = index.statistics()
    windows = [bytes(index.data[p : p + length]) for p in index.places]
    order = sorted(range(len(windows)), key=lambda i: (windows[i], i))
    for x, y in zip(order, order[1:], strict=False):
        common = next((k for k in range(length) if windows[x][k] != windows[y][k]), length)
        assert (matched[y], source[y]) == (common, x)
    assert len(index.run_starts) == len(index.run_heads) <= len(windows)


def test_repetitive_text_is_compressed():
    rng = random.Random(7)
    text = b" ".join(b"w%d" % rng.randrange(500) for _ in range(4000))
    segments = [text[a : a + 1500] for a in (rng.randrange(len(text) - 1500) for _ in range(200))]
    index = repeat_index.RunLengthIndex(segments)
    assert 10 * len(index.samples) < len(index.places) and 10 * len(index.run_starts) < len(index.places)
