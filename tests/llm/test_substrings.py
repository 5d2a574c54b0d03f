import random

import numpy as np
import pytest

from kinetable.llm import substrings as S


def split(text):
    return [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]


def brute(rows, width):
    first = {}
    for d, t in rows:
        w = split(t)
        for a in range(len(w) - width + 1):
            key, n = tuple(w[a : a + width]), d if d is not None else float("inf")
            first[key] = min(first.get(key, n), n)
    out = []
    for d, t in rows:
        w, gone = split(t), set()
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] < (d if d is not None else float("inf")):
                gone.update(range(a, a + width))
        out.append((str(d), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("width,depth,chunk,cells,slice_bits", [(13, 1, 8 << 20, 32, 23), (13, 2, 3000, 2, 10), (5, 1, 5000, 1, 8)])
def test_matches_brute_force(docs, texts, monkeypatch, width, depth, chunk, cells, slice_bits):
    for name, value in (("CHUNK", chunk), ("CELLS", cells), ("SLICE_BITS", slice_bits), ("BUCKET", 1 << 6 if chunk < 1 << 20 else 1 << 20)):
        monkeypatch.setattr(S, name, value)
    if chunk < 1 << 20:
        docs = docs.where("length(text) < 10000 OR text IS NULL")
        texts = [(i, t) for i, t in texts if t is None or len(t) < 10_000]
    got = S.keep_first_windows(docs, width, depth)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in got.collect()) == brute(texts, width)


def test_empty(empty):
    assert S.keep_first_windows(empty).count() == 0


def test_packing():
    rng = random.Random(1)
    for n in (0, 1, 5, 1000):
        values = np.array(sorted(rng.sample(range(1 << 22), n)), np.int64)
        assert (S.unpack(S.pack(values)) == values).all()


def test_groups_of_colliding_hashes():
    h, e = np.array([5, 3, 5, 5, 3], np.uint64), np.array([1, 0, 2, 1, 0], np.uint32)
    order, first = S.grouped(h, e)
    assert [(int(h[order[k]]), int(e[order[k]])) for k in first] == [(3, 0), (5, 1), (5, 2)]
