"""Decontamination against a search for every window."""

import hashlib
import re

from swathkit.llm import decontaminate as D
from tests.llm.conftest import TEXTS, rows_of

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, size=10):
    wins = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(item)
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if ids := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, sf_dir, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = rows_of(D.op3_decontaminate(spark, sf_dir), *COLUMNS)
    assert got == brute(documents, items) and any(r[5] for r in got) and not all(r[5] for r in got)


ITEMS = [("b", "Quick brown fox jumps over the lazy dog and runs far away"), ("a", "one"), ("c", None), ("d", " .,! "), (None, "words and"), ("a", "the lazy dog"), ("e", "你好 😀")]


def test_odd_documents(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id string, text string").selectExpr("*", "'x' as doc_id", "'y' as size")
    docs = [(d, t) for d, t, _ in TEXTS]
    wanted = brute(docs, [x for x in ITEMS if None not in x])
    assert rows_of(D.decontaminate(odd_docs, items), *COLUMNS) == wanted
    assert D.decontaminate(no_docs, items).count() == 0
    assert not any(r[5] for r in rows_of(D.decontaminate(odd_docs, items.filter("false")), *COLUMNS))


def test_several_shares(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(D, "MAX_WINDOW_BYTES", 20)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert len(D.shares(items, "item_id", "text")) > 1
    assert rows_of(D.decontaminate(odd_docs, items), *COLUMNS) == brute([(d, t) for d, t, _ in TEXTS], [x for x in ITEMS if None not in x])


def test_spans_in_the_original():
    text = "Ünder é: The LAZY--dog? and more, the\tlazy dog"
    scan = D.Scanner([("a", b"the lazy dog")])
    n, runs, ids = scan.scan(text.encode())
    assert (n, ids) == (len(words(text)), {"a"})
    assert [text[a:b] for a, b in D.spans(text, runs)] == ["The LAZY--dog", "the\tlazy dog"]


def test_hits_carry_offsets_in_the_original(spark, sf_dir, documents):
    """The text between a hit's offsets is, as words, the run of words that is hit."""
    text = dict(documents)
    rows = D.find_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("size(starts) > 0").collect()
    assert rows
    for r in rows:
        w = words(text[r.doc_id])
        for a, b, x, y in zip(r.starts, r.ends, r.char_starts, r.char_ends, strict=True):
            assert words(text[r.doc_id][x:y]) == w[a:b]
