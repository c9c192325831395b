"""Phrases leave a chunk in slices, so that a task never holds all their strings."""

import numpy as np
import pyarrow as pa

from oreflow.llm import collocations as c


def given(texts, size, monkeypatch, width):
    monkeypatch.setattr(c, "SLICE", width)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})
    every = np.full(1 << 12, 255, np.uint8)
    found = list(c._given_out(iter([batch]), size, None if size == 1 else every))
    counts = {}
    for d in found:
        for phrase, n in zip(d["phrase"].to_pylist(), pa.array(d["n"]).to_pylist(), strict=True):
            counts[phrase] = counts.get(phrase, 0) + n
    return counts, max(len(d["phrase"]) for d in found)


def test_slices_hold_all_phrases(monkeypatch):
    texts = [" ".join(f"W{(i * j) % 97}" + (".\n" if j % 11 == 3 else "") for j in range(120)) for i in range(1, 40)]
    for size in (1, 2, 3, 5):
        whole, _ = given(texts, size, monkeypatch, 1 << 17)
        cut, most = given(texts, size, monkeypatch, 16)
        assert cut == whole and most <= 16
    plain = {}
    for t in texts:
        for piece in t.lower().replace("\n", ".").split("."):
            w = piece.split()
            for p in zip(w, w[1:]):
                plain[" ".join(p)] = plain.get(" ".join(p), 0) + 1
    assert given(texts, 2, monkeypatch, 16)[0] == plain
