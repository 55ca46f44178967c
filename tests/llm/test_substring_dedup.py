"""Removal of repeated bytes against a count of every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from swathkit.llm import substring_dedup as X
from tests.llm.conftest import TEXTS, rows_of

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(docs, size=200):
    raw = [(d, (t or "").encode()) for d, t in docs]
    counts = Counter(hashlib.blake2b(b[k : k + size], digest_size=16).digest() for _, b in raw for k in range(len(b) - size + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 1, np.int32)
        for k in range(len(b) - size + 1):
            if counts[hashlib.blake2b(b[k : k + size], digest_size=16).digest()] > 1:
                gone[k] += 1
                gone[k + size] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], mask.astype(np.int8)])) == 1).sum())
        out.append((d, len(b), int(mask.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest()))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, sf_dir, documents):
    got = rows_of(X.op5_substrings(spark, sf_dir), *COLUMNS)
    assert got == brute(documents) and any(r[2] for r in got)


def test_odd_documents(odd_docs, no_docs):
    assert rows_of(X.remove_repeats(odd_docs), *COLUMNS) == brute([(d, t) for d, t, _ in TEXTS])
    assert X.remove_repeats(no_docs).count() == 0


def planted(seed):
    """Random texts that share passages of all lengths, at all offsets, with few distinct letters."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 9)))
    passages = ["".join(word() for _ in range(r.randint(20, 120))) for _ in range(8)]
    docs = []
    for k in range(40):
        parts = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : a + r.randint(50, len(p))], "".join(word() for _ in range(r.randint(0, 40)))]
        docs.append((k, "".join(parts)))
    return [*docs, (100, "z" * 900), (101, "z" * 199), (102, "ab" * 300), (103, "z" * 200)]


@pytest.mark.parametrize("most", [X.MAX_GROUP, 3])
def test_planted_passages(spark, most):
    docs = planted(most)
    assert rows_of(X.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), max_group=most), *COLUMNS) == brute(docs)


@pytest.mark.parametrize("bits", [0, 3])
def test_colliding_stretches_are_told_apart(spark, documents, bits):
    """With digests of stretches that often collide, their bytes decide."""
    for docs in (planted(7), documents[:60]):
        assert rows_of(X.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), span_bits=bits), *COLUMNS) == brute(docs)


def test_suffix_sort_and_collisions(monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (300, 24)).astype(np.uint8)
    rows[::7] = rows[0]
    starts, sizes = np.array([0, 1, 120]), np.array([1, 119, 180])

    def check():
        order, common = X.suffix_sort(rows, starts, sizes)
        for s, z in zip(starts.tolist(), sizes.tolist(), strict=True):
            own = order[s : s + z]
            texts = [rows[k].tobytes() for k in own]
            assert texts == sorted(rows[k].tobytes() for k in range(s, s + z)) and sorted(own.tolist()) == list(range(s, s + z))
            assert common[s] == -1
            for k in range(1, z):
                a, b = texts[k - 1], texts[k]
                assert common[s + k] == next((i for i in range(24) if a[i] != b[i]), 24)

    check()
    honest = X.prefix_hashes
    monkeypatch.setattr(X, "prefix_hashes", lambda r: honest(r) % np.uint64(5))  # hashes that often collide
    check()


def test_anchors_depend_on_the_window_alone():
    r = random.Random(9)
    shared = bytes(r.randrange(256) for _ in range(700))
    a, b = bytes(r.randrange(256) for _ in range(333)) + shared, shared + bytes(r.randrange(256) for _ in range(95))
    place = {}
    for raw, shift in ((a, 333), (b, 0)):
        pos, lo, hi, _ = X.anchors(raw)
        assert lo[0] == 0 and hi[-1] == len(raw) - X.SIZE and (lo[1:] == hi[:-1] + 1).all()
        for p, x, y in zip(pos.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for w in range(x, y + 1):
                assert 0 <= p - w <= X.LEFT
                if 0 <= w - shift <= 500:
                    place.setdefault(w - shift, set()).add(p - shift)
    assert len(place) == 501 and all(len(x) == 1 for x in place.values())
