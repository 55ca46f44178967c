"""Token ids, the token store, packing and token counts."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from swathkit.llm import packing as P
from swathkit.llm import token_counts as C
from swathkit.llm import token_store as S
from swathkit.llm.common import scratch
from swathkit.llm.tokens import encoder, vocabulary
from tests.llm.conftest import TEXTS, rows_of

NASTY = [
    "", " ", "  ", "\n", "a\nb", "a\n\nb", "a \n b", " a", "a ", "a  b", "\ta", "a b", "don't DON'T 'tis we'll 've", "x.y,z!", "...", "!?", "12 345 6.7", "é É ẞ ß İ ı ſ ŉ", "你好 世界", "😀👍🏽 a", "a​b", "é é",
    "<|endoftext|>", "<|startoftext|> x", "a<|endoftext|>b", "ǅ ɐ ʼn", "\r\n\r\n", "tab\tsep", "A-B_c/d", "　wide", "end.", "end. ", ".. .", "word sep", "\x00\x01", "Σίσυφος ΣΑΣ", "ﬁ ﬀ", "x" * 3000,
]


def texts_for_ids(documents):
    r = random.Random(1)
    mixed = [" ".join(r.choice([*NASTY, "word", "Other", "there's"]) for _ in range(r.randint(1, 12))) for _ in range(400)]
    glued = ["".join(chr(r.choice([32, 32, 10, 9, 39, 46, 65, 97, 98, 49, 233, 304, 0x301, 0x4F60, 0x1F600])) for _ in range(r.randint(1, 30))) for _ in range(600)]
    return [*NASTY, *mixed, *glued, *[t or "" for _, t in documents]]


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_ids_equal_the_library(documents, name, kind):
    path = vocabulary(name)
    own, library = encoder(path, kind, "<u4"), Tokenizer.from_file(path)
    for text in texts_for_ids(documents):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:200])


def stored(docs, name="word_bpe_49k.json", end=2):
    library, out, at = Tokenizer.from_file(vocabulary(name)), [], 0
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_store_query_equals_brute_force(spark, sf_dir, documents):
    assert rows_of(S.op6_token_store(spark, sf_dir), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(stored(documents), key=repr)


def test_store_of_odd_documents(spark, odd_docs, no_docs):
    path = scratch(spark, "odd-store")
    got = rows_of(S.read_store(path, S.write_store(odd_docs, path, vocabulary("word_bpe_49k.json"))), "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted((r[0], *r[2:]) for r in got if r[0] is not None) == sorted((r[0], *r[2:]) for r in stored([(d, t) for d, t, _ in TEXTS]) if r[0] is not None)
    spans = sorted((r[1], r[1] + r[2]) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # gapless
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0)) and len(order) == len(TEXTS)
    empty = scratch(spark, "no-store")
    assert S.read_store(empty, S.write_store(no_docs, empty, vocabulary("word_bpe_49k.json"))).count() == 0


def one_file(docs, frame_bytes=64):
    sink = io.BytesIO()
    w = S.Writer(sink, "<u2", frame_bytes)
    for d, ids in docs:
        w.add(d, np.array(ids, "<u2").tobytes())
    w.close()
    return sink.getvalue()


def test_reader_decompresses_only_what_it_needs():
    docs = [(k, list(range(k, k + 7 + k % 50))) for k in range(200)]
    data = one_file(docs)
    r = S.Reader(pa.BufferReader(data))
    assert r.ids(150).tolist() == docs[150][1] and r.frames_read <= 3 < len(r.frames)
    assert [r.ids(k).tolist() for k in range(200)] == [x for _, x in docs]
    long = S.Reader(pa.BufferReader(one_file([(1, [5] * 1000), (2, [])])))
    assert long.ids(0).tolist() == [5] * 1000 and long.ids(1).tolist() == [] and len(long.frames) > 20
    import zstandard

    whole = b"".join(iter(lambda it=zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True): it.read(1 << 16), b""))
    assert whole.startswith(np.array([x for _, ids in docs for x in ids], "<u2").tobytes())  # an ordinary decoder reads the frames


def test_damage_is_noticed():
    data = bytearray(one_file([(k, [k] * 40) for k in range(60)]))
    data[30] ^= 1
    r = S.Reader(pa.BufferReader(bytes(data)))
    with pytest.raises(Exception, match="damaged|zstd|decompress"):
        for k in range(60):
            r.ids(k)
    with pytest.raises(ValueError, match="seek table"):
        S.Reader(pa.BufferReader(bytes(data[:-3])))


def check_packing(rows, docs, size=2048):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}
    by_doc, by_seq = {}, {}
    for d, start, length, crc, n, seq, offset in rows:
        assert n == len(ids[d]) and length > 0
        assert crc == zlib.crc32(np.array(ids[d][start : start + length], "<u4").tobytes())
        by_doc.setdefault(d, []).append((start, length))
        by_seq.setdefault(seq, []).append((offset, length))
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == len(ids[d])
    padding = 0
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & at - 1 == 0 else size - at
    assert padding == 0 and sorted(by_seq) == list(range(len(by_seq)))


PACKED = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_packing_covers_each_id_once(spark, sf_dir, documents):
    check_packing(rows_of(P.op10_pack(spark, sf_dir), *PACKED), documents)


def test_packing_of_odd_documents(spark, odd_docs, no_docs):
    vocab = vocabulary("byte_bpe_50k.json")
    rows = rows_of(P.pack(odd_docs, vocab), *PACKED)
    n = len(Tokenizer.from_file(vocab).encode(TEXTS[0][1], add_special_tokens=False).ids) + 1
    assert sum(r[2] for r in rows if r[0] == 2) == 2 * n  # a repeated row is packed twice
    assert sum(r[2] for r in rows if r[0] in (3, 4)) == 2
    once = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(rows_of(P.pack(once, vocab, size=64), *PACKED), [(d, t) for d, t in {d: t for d, t, _ in TEXTS if d is not None}.items()], 64)
    assert P.pack(no_docs, vocab).count() == 0


def test_sequences_hold_the_ids(spark, documents):
    vocab, library = vocabulary("byte_bpe_50k.json"), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    docs = spark.createDataFrame(documents[:30], "doc_id long, text string")
    got = P.sequences(P.pack(docs, vocab, with_ids=True)).collect()
    assert sorted(x for r in got for x in r.ids) == sorted(x for _, t in documents[:30] for x in [*library.encode(t or "", add_special_tokens=False).ids, 1])


def test_hilbert_keys_are_a_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = P.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_on_the_curve_are_alike():
    """Texts of one vocabulary lie closer along the curve than texts of different ones."""
    rng, table = np.random.default_rng(2), P.directions(1000)
    topic = np.repeat(np.arange(4), 50)
    sums = np.array([P.direction(rng.integers(250 * t, 250 * t + 40, 300), table) for t in topic])
    order = topic[np.argsort(P.curve_keys(sums), kind="stable")]
    assert (order[1:] == order[:-1]).mean() > 0.9
    assert P.curve_keys(np.zeros((2, P.DIMS))).tolist()[0] == P.curve_keys(np.zeros((1, P.DIMS))).tolist()[0]


def best(word, uni):
    """Score and least tokens over all segmentations, without a trie."""
    table = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(max(0, end - uni.longest), end):
            piece, (s, n) = word[start:end], table[start]
            if piece in uni.pieces:
                options.append((s + uni.pieces[piece], -(n + 1)))
            elif end - start == 1:
                width = len(piece.encode())
                options.append((s + width * uni.floor, -(n + width)))
        s, n = max(options)
        table.append((s, -n))
    return table[-1]


def test_shared_prefixes_equal_each_word_alone(documents):
    uni = C.model(vocabulary("piece_bpe_32k.model"))
    words = {C.MARK + w for _, t in documents[:40] for w in (t or "").split()} | {C.MARK + w for w in ("😀", "日本語", "naïve", "a" * 400, "")}
    got = C.shared_prefix_counts(words, uni)
    assert got == {w: best(w, uni)[1] for w in words}


def test_each_prefix_is_scored_once():
    class Watched(dict):
        asked = 0

        def get(self, key, default=None):
            Watched.asked += 1
            return super().get(key, default)

    uni = C.Unigram(Watched({x: -1.0 for x in ("a", "b", "ab", "ba")}), 2, -20.0)
    C.shared_prefix_counts(["abababab", "ababab", "abababba"], uni)
    alone = Watched.asked
    Watched.asked = 0
    for w in ("abababab", "ababab", "abababba"):
        C.shared_prefix_counts([w], uni)
    assert alone == 2 * 10 - 1 < Watched.asked  # ten nodes of the trie


def test_counts_query(spark, sf_dir, documents, odd_docs, no_docs):
    path = vocabulary("piece_bpe_32k.model")
    uni, cache = C.model(path), {}

    def slow(text):
        words = (text or "").encode().split()
        return len(words), sum(cache.setdefault(w, None) or cache.update({w: best(C.MARK + w.decode(), uni)[1]}) or cache[w] for w in words)

    assert rows_of(C.op7_token_counts(spark, sf_dir), "doc_id", "n_words", "n_tokens") == sorted(((d, *slow(t)) for d, t in documents), key=repr)
    got = rows_of(C.count_tokens(odd_docs, path), "doc_id", "n_words", "n_tokens")  # with a pre-token of 70,000 characters
    assert got == sorted(((d, *slow(t)) for d, t, _ in TEXTS), key=repr)
    assert C.count_tokens(no_docs, path).count() == 0
    assert sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size() >= len(uni.pieces)
