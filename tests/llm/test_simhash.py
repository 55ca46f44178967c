"""SimHash and Golay keys against all pairs."""

from itertools import combinations

import numpy as np
import xxhash

from swathkit.llm import simhash as S
from tests.llm.conftest import TEXTS, rows_of


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate(dict.fromkeys([32, 9, 10, 11, 12, 13], " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """Smallest of the linked, by all pairs and repeated merging."""
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= 2:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {f: top(f) for f in distinct}


def brute(docs, fps):
    root = classes(fps)
    first = {}
    for (d, _), f in zip(docs, fps, strict=True):
        if d is not None:
            first[root[f]] = min(d, first.get(root[f], d))
    return sorted(((d, f"{f:016x}", first.get(root[f])) for (d, _), f in zip(docs, fps, strict=True)), key=repr)


def test_query_equals_brute_force(spark, sf_dir, documents):
    assert rows_of(S.op9_simhash(spark, sf_dir), "doc_id", "fingerprint", "component_id") == brute(documents, [slow_fingerprint(t) for _, t in documents])


def test_odd_documents(odd_docs, no_docs):
    docs = [(d, t) for d, t, _ in TEXTS]
    assert rows_of(S.near_duplicates(odd_docs), "doc_id", "fingerprint", "component_id") == brute(docs, [slow_fingerprint(t) for _, t in docs])
    assert S.near_duplicates(no_docs).count() == 0


def test_golay_code():
    words = np.arange(1 << 12, dtype=np.int64) * 2048
    codes = words ^ S.syndrome(words)
    assert min(int(x).bit_count() for x in codes[1:].tolist()) == 7 and not S.syndrome(codes).any()
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 23, 20_000)
    flips = [0, *(1 << x for x in range(23)), *(1 << x | 1 << y for x, y in combinations(range(23), 2))]
    b = a ^ rng.choice(flips, len(a))
    x, y = S.codewords(a), S.codewords(b)
    assert ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_close_fingerprints_share_a_key():
    rng = np.random.default_rng(6)
    a = rng.integers(-(1 << 63), 1 << 63, 3000)
    one, two = (np.left_shift(np.uint64(1), rng.integers(0, 64, len(a)).astype(np.uint64)).view(np.int64) for _ in range(2))
    b = a ^ one ^ np.where(rng.random(len(a)) < 0.3, 0, two)
    keys = [dict() for _ in a]
    for side, fp in ((0, a), (1, b)):
        key, row = S.golay_keys(fp)
        assert np.bincount(row).max() <= 18
        for k, r in zip(key.tolist(), row.tolist(), strict=True):
            keys[r].setdefault(side, set()).add(k)
    assert all(k[0] & k[1] for k in keys)


def test_large_buckets_lose_no_link(spark):
    rng = np.random.default_rng(7)
    seeds = rng.integers(-(1 << 62), 1 << 62, 12)
    fps = []
    for s in seeds.tolist():
        for _ in range(25):
            s ^= 1 << int(rng.integers(0, 62))
            if rng.random() < 0.6:
                s ^= 1 << int(rng.integers(0, 62))
            if rng.random() < 0.2:
                s ^= 1 << int(rng.integers(0, 62))
            fps.append(s)
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    wanted = classes([f & (1 << 64) - 1 for f in fps])
    groups = {}
    for f in set(fps):
        groups.setdefault(wanted[f & (1 << 64) - 1], set()).add(f)
    from swathkit.llm.graph import components

    for most in (1, 64):
        roots = {r.node: r.root for r in components(S.links(df, most)).collect()}
        got = {}
        for f in set(fps):
            got.setdefault(roots.get(f, f), set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
