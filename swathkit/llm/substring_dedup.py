"""Removal of repeated substrings of SIZE bytes, by a sparse suffix sort with hash comparisons.

Anchors: in every window of SIZE bytes the smallest-hashed gram of GRAM bytes (leftmost of equals) is its anchor, a choice
that depends on the window's bytes alone. Equal windows thus have equal anchors at equal offsets, and comparing what
surrounds anchors with equal grams finds every repeat. The windows of one anchor are a range of starts; the bytes they
cover are the anchor's stretch.

1. Scan: one row an anchor (about one in GAP/2 bytes) with the hash of its gram and a BLAKE2 hash of its stretch.
2. Grams that occur once are done. If a stretch occurs twice, all its windows repeat. A second scan groups the stretches that
   count as equal by their bytes, each once a task; if they differ, all stretches of that gram go to 3.
3. Grams with several different stretches are contested: of each stretch one copy is compared with the others. A third scan
   fetches the bytes around just these anchors (found by a bitmap of bounded size). Within a gram's group the right
   contexts, and the reversed left ones, are suffix-sorted: prefix polynomial hashes and binary search give the longest
   common extension of two, so a mergesort needs a logarithmic number of steps a comparison; neighbours' extensions are
   verified by their bytes, and a collision sends the group to a sort of the bytes themselves. A window that starts o
   bytes before its anchor repeats if another member shares o bytes to the left and SIZE - o to the right: if both are in
   one run of either sorted order at these depths.
4. Groups over MAX_GROUP are not gathered in a task: their windows, as bytes, are counted by the executors' aggregation, so a
   hot anchor's work is spread over all tasks.
5. The repeated ranges of a document are joined to it and cut out.

Defined results: texts are UTF-8 bytes; null and empty texts have no bytes and nothing is removed; texts below SIZE bytes
stay whole. Repeated rows (same doc_id and text) repeat each other and get equal results. A null doc_id is like any id.
An empty table gives an empty result. Extra columns are ignored. Very long texts are scanned whole, in one pass each.

No removal rests on a hash alone: equal stretches, extensions and windows are compared by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.llm.common import Scope, batches_of, bitmap, documents, drop, in_bitmap, partitions, prepare, presence_filter, skew_join, table, written

SIZE, GRAM, MAX_GROUP = 200, 48, 4_000
GAP = SIZE - GRAM + 1  # grams in a window
LEFT = SIZE - GRAM  # the most bytes of a window before its anchor
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
CHUNK = 6_000  # contested rows compared at once, whole groups
ROW = "doc_id long, th long, pos long, lo long, hi long, khash long"

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), BASE, np.uint64)]))
    return _powers[:n]


def prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """For each row of bytes the polynomial hashes of its prefixes of 0, 1, ... bytes."""
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * powers(rows.shape[1])[None, :], axis=1, out=out[:, 1:])
    return out


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of anchors, first and last start of their windows, hashes of their grams (signed)."""
    n = len(text)
    if n < SIZE:
        return (np.zeros(0, np.int64),) * 4
    x = gram_hashes(np.frombuffer(text, np.uint8))
    keyed = (x >> np.uint64(32) << np.uint64(32)) | np.arange(len(x), dtype=np.uint64)
    windows = n - SIZE + 1
    blocks = -(-len(keyed) // GAP)
    grid = np.full(blocks * GAP, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(keyed)] = keyed
    grid = grid.reshape(blocks, GAP)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    pos = (np.minimum(ahead[:windows], behind[GAP - 1 : GAP - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
    hi = np.concatenate([lo[1:], [windows]]) - 1
    return pos[lo], lo, hi, x[pos[lo]].view(np.int64)


#: The inverse of BASE modulo 2^64, and its powers, bring a gram's hash to position 0.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_inverses = np.ones(1, np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Mixed hashes of all grams of a text; equal grams have equal hashes in all texts."""
    global _inverses
    n = len(data)
    if len(_inverses) < n + 1:
        _inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), INVERSE, np.uint64)]))
    h = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=h[1:])
    x = (h[gram:] - h[:-gram]) * _inverses[: n - gram + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def row_key(th: np.ndarray | int, pos: np.ndarray) -> np.ndarray:
    return th % (1 << 40) + pos * 1_000_003


def span_hashes(raw: bytes, lo: np.ndarray, hi: np.ndarray, bits: int) -> list[int]:
    """BLAKE2 hashes of stretches, of which so many bits count."""
    digest = lambda x, y: int.from_bytes(hashlib.blake2b(raw[x : y + SIZE], digest_size=8).digest(), "little", signed=True)
    out = [digest(x, y) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
    return out if bits == 64 else [x & ((1 << bits) - 1) for x in out]


def _scan(span_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(7)]
            docs, hashes, spans = [], [], []
            for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = text.as_py()
                found = anchors(raw)
                k = len(found[0])
                if not k:
                    continue
                docs += [doc] * k
                hashes += [th] * k
                for p, x in zip(parts, found, strict=False):
                    p.append(x)
                spans += span_hashes(raw, found[1], found[2], span_bits)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), *(pa.array(np.concatenate(p)) for p in parts[:4]), pa.array(spans, pa.int64())], names=["doc_id", "th", "pos", "lo", "hi", "khash", "span"])

    return run


def _stretches(repeated, span_bits: int):
    """(khash, span, stretch) of anchors whose stretch may be among the repeated ones, each different one once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = repeated.value
        schema = pa.schema([("khash", pa.int64()), ("span", pa.int64()), ("stretch", pa.binary())])
        for b in batches:
            seen: set[tuple[int, int, bytes]] = set()
            for text in b.column(2):
                raw = text.as_py()
                pos, lo, hi, khash = anchors(raw)
                if len(pos):
                    spans = np.array(span_hashes(raw, lo, hi, span_bits), np.int64)
                    for k in np.flatnonzero(in_bitmap(bits, khash ^ spans)).tolist():
                        seen.add((int(khash[k]), int(spans[k]), raw[int(lo[k]) : int(hi[k]) + SIZE]))
            yield from batches_of(schema, iter(seen))

    return run


def _fetch(needed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = needed.value
        schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("khash", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])

        def rows():
            for b in batches:
                for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    raw = text.as_py()
                    pos, lo, hi, khash = anchors(raw)
                    if len(pos):
                        for k in np.flatnonzero(in_bitmap(bits, row_key(th, pos))).tolist():
                            p = int(pos[k])
                            yield doc, th, p, int(lo[k]), int(hi[k]), int(khash[k]), raw[max(0, p - LEFT) : p], raw[p : p + SIZE]

        yield from batches_of(schema, rows(), 2000)

    return run


def extensions(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefix of rows a and b, by binary search on their prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), h.shape[1] - 1, np.int64)
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = h[a, mid] == h[b, mid]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def suffix_sort(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes within groups (groups are contiguous), and each row's common extension with the one before it in that order (-1 at a group's first).

    A stable mergesort from the bottom up, all groups at once: an element's place in a merge is its own plus its rank in the
    other run, found by binary search with hash comparisons.
    """
    n, width = rows.shape
    h = prefix_hashes(rows)
    order = np.arange(n)
    begin = np.repeat(starts, sizes)
    finish = begin + np.repeat(sizes, sizes)

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether row x sorts before row y; equal rows if ties."""
        e = extensions(h, x, y)
        at = np.minimum(e, width - 1)
        return np.where(e == width, ties, rows[x, at] < rows[y, at])

    w = 1
    while w < (sizes.max() if len(sizes) else 0):
        slot = np.flatnonzero(finish - begin > w)
        base = begin[slot] + (slot - begin[slot]) // (2 * w) * (2 * w)
        middle, end = np.minimum(base + w, finish[slot]), np.minimum(base + 2 * w, finish[slot])
        live = middle < end
        slot, base, middle, end = slot[live], base[live], middle[live], end[live]
        first = slot < middle
        lo, hi = np.where(first, middle, base), np.where(first, end, middle)
        other, mine = lo.copy(), order[slot]
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = before(order[mid], mine[open_], ~first[open_])
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        place = np.where(first, slot + lo - other, slot - middle + base + lo - other)
        fresh = order.copy()
        fresh[place] = mine
        order = fresh
        w *= 2
    common = np.full(n, -1, np.int64)
    at = np.flatnonzero(np.arange(n) > begin)
    if len(at):
        a, b = order[at - 1], order[at]
        common[at] = extensions(h, a, b)
        differ = rows[a] != rows[b]
        true = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        nxt = np.minimum(true, width - 1)
        if (true != common[at]).any() or ((true < width) & (rows[a, nxt] > rows[b, nxt])).any():  # a hash collision
            order = np.concatenate([np.array(sorted(range(s, s + z), key=lambda k: rows[k].tobytes()), np.int64) for s, z in zip(starts.tolist(), sizes.tolist(), strict=True)])
            a, b = order[at - 1], order[at]
            differ = rows[a] != rows[b]
            common[at] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, common


def repeated_ranges(khash: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: list[bytes], right: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of ranges of repeated windows; rows are sorted by khash, and groups are whole."""
    n = len(khash)
    starts = np.flatnonzero(np.concatenate([[True], khash[1:] != khash[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    ahead, back = np.zeros((n, SIZE), np.uint8), np.zeros((n, LEFT), np.uint8)
    for k, (x, y) in enumerate(zip(right, left, strict=True)):
        ahead[k, : len(x)] = np.frombuffer(x, np.uint8)
        back[k, : len(y)] = np.frombuffer(y, np.uint8)[::-1]
    order_r, common_r = suffix_sort(ahead, starts, sizes)
    order_l, common_l = suffix_sort(back, starts, sizes)
    repeated = np.zeros((n, LEFT + 3), bool)  # by start - (pos - LEFT), one empty column at each end
    run_r, run_l = np.empty(n, np.int64), np.empty(n, np.int64)
    near, far = pos - hi, pos - lo
    for o in range(LEFT + 1):
        rows = np.flatnonzero((near <= o) & (o <= far))
        if len(rows) < 2:
            continue
        run_r[order_r] = np.cumsum(common_r < SIZE - o)
        run_l[order_l] = np.cumsum(common_l < o)
        key = run_r[rows] * (n + 1) + run_l[rows]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        repeated[rows[count[inverse] > 1], LEFT - o + 1] = True
    step = np.diff(repeated.astype(np.int8), axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    for r, a, b in zip(row.tolist(), first.tolist(), last.tolist(), strict=True):
        at = int(pos[r]) - LEFT
        yield r, at + a, at + b - 1 + SIZE


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by khash; whole groups are compared, about CHUNK rows at once."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def ranges():
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= CHUNK:
                t = pa.Table.from_batches(held)
                keys = t["khash"].to_numpy()
                cut = int(np.searchsorted(keys == keys[-1], True))
                if cut:
                    yield from compared(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    rows -= cut
        if held:
            yield from compared(pa.Table.from_batches(held))

    def compared(t: pa.Table):
        keys = t["khash"].to_numpy()
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        t = t.filter(pa.array(count[inverse] > 1))
        if len(t):
            docs, hashes = t["doc_id"].to_pylist(), t["th"].to_pylist()
            for r, a, b in repeated_ranges(t["khash"].to_numpy(), t["pos"].to_numpy(), t["lo"].to_numpy(), t["hi"].to_numpy(), t["left"].to_pylist(), t["right"].to_pylist()):
                yield docs[r], hashes[r], a, b

    yield from batches_of(schema, ranges())


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("window", pa.binary())])

    def rows():
        for b in batches:
            for r in b.to_pylist():
                both, first = r["left"] + r["right"], r["pos"] - len(r["left"])
                for p in range(r["lo"], r["hi"] + 1):
                    yield r["doc_id"], r["th"], p, both[p - first : p - first + SIZE]

    yield from batches_of(schema, rows())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def rows():
        for b in batches:
            for doc, text, found in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("ranges"), strict=True):
                raw, runs = text.as_py(), merged([(x["start"], x["end"]) for x in found.as_py() or ()])
                h, at = hashlib.sha256(), 0
                for x, y in runs:
                    h.update(raw[at:x])
                    at = y
                h.update(raw[at:])
                yield doc, len(raw), sum(y - x for x, y in runs), len(runs), h.hexdigest()

    yield from batches_of(schema, rows(), 1000)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in any range."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def unequal_grams(base: DataFrame, repeated: DataFrame, span_bits: int) -> DataFrame | None:
    """khash of grams with stretches that count as equal but are not, by their bytes; None for none."""
    n = repeated.count()
    if not n:
        return None
    bits = base.sparkSession.sparkContext.broadcast(bitmap(repeated, F.col("khash").bitwiseXOR(F.col("span")), n))
    different = base.mapInArrow(_stretches(bits, span_bits), "khash long, span long, stretch binary").groupBy("khash", "span", "stretch").agg(F.count("*").alias("n"))
    several = written(different.groupBy("khash", "span").agg(F.count("*").alias("n")).filter("n > 1").join(repeated.select("khash", "span"), ["khash", "span"], "left_semi").select("khash").distinct(), "unequal-grams")
    return None if several.isEmpty() else several


def find_repeats(base: DataFrame, max_group: int = MAX_GROUP, span_bits: int = 64) -> DataFrame:
    """(doc_id, th, start, end): byte ranges made of repeated windows; base has doc_id, th and text as bytes. span_bits: only tests take fewer, to see that unequal stretches are told apart."""
    spark = base.sparkSession
    found = written(base.mapInArrow(_scan(span_bits), ROW + ", span long"), "anchors")
    grams = written(found.groupBy("khash").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-grams")
    n_grams, total = grams.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shared = skew_join(presence_filter(found, F.col("khash"), grams, F.col("khash"), n_grams), grams, "khash", "n", total).drop("n")
    shared = written(shared, "shared-anchors")
    drop(found, grams)
    who = F.struct("doc_id", "th", "pos")
    stretches = written(shared.groupBy("khash", "span").agg(F.count("*").alias("copies"), F.min(who).alias("one")), "stretches")
    unequal = unequal_grams(base, stretches.filter("copies > 1"), span_bits)
    equal = stretches if unequal is None else stretches.join(unequal, "khash", "left_anti")
    several = equal.groupBy("khash").agg(F.count("*").alias("n")).filter("n > 1")
    n_several, rows_several = several.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    need = skew_join(equal, several, "khash", "n", rows_several).select(F.col("one.th").alias("th"), F.col("one.pos").alias("pos"))
    if unequal is not None:
        need = need.unionByName(shared.join(unequal, "khash", "left_semi").select("th", "pos"))
    need = written(need, "contested")
    copied = skew_join(shared, equal.filter("copies > 1").select("khash", "span", "copies"), ["khash", "span"], "copies", total)
    whole = copied.select("doc_id", "th", F.col("lo").alias("start"), (F.col("hi") + SIZE).alias("end"))
    if not n_several and unequal is None:
        return whole
    bits = spark.sparkContext.broadcast(bitmap(need, F.pmod("th", F.lit(1 << 40)) + F.col("pos") * 1_000_003, need.count()))
    around = written(base.mapInArrow(_fetch(bits), ROW + ", left binary, right binary"), "contexts")
    large = around.groupBy("khash").agg(F.count("*").alias("n")).filter(F.col("n") > max_group)
    out = "doc_id long, th long, start long, end long"
    if large.isEmpty():
        small, rest = around, None
    else:
        large = written(large.select("khash"), "large-groups")
        small, rest = around.join(large, "khash", "left_anti"), around.join(large, "khash", "left_semi")
    ranges = small.repartition(partitions(spark), "khash").sortWithinPartitions("khash").mapInArrow(_compare, out)
    if rest is not None:
        single = written(rest.repartition(partitions(spark)).mapInArrow(_windows, "doc_id long, th long, start long, window binary"), "single-windows")
        counts = written(single.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-windows")
        n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        again = skew_join(single, counts, "window", "n", n)
        ranges = ranges.unionByName(again.select("doc_id", "th", "start", (F.col("start") + SIZE).alias("end")))
    return whole.unionByName(ranges)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_group: int = MAX_GROUP, span_bits: int = 64) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = prepare(docs.sparkSession)
    base = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    with Scope(spark, "substrings") as scope:
        found = find_repeats(base, max_group, span_bits)
    ranges = written(found, "ranges")
    scope.delete()
    by_doc = ranges.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    joined = base.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
