"""Exact-passage removal with a sparse, distributed suffix array.

A passage goes if a string of ``length`` tokens that covers it also starts
anywhere else.  Tokens are bytes or words (see Law).  Sorting all suffixes of a
corpus would shuffle it many times over, so only *anchored* suffixes are sorted:

1. Each window of ``length`` tokens names one anchor, its gram of least hash
   (the leftmost).  Equal windows have equal anchors at equal places, so
   windows need comparing only if their anchors are equal.  Consecutive
   windows with the same anchor make a *run*.
2. Grams are counted.  A bit set of fixed size over those that occur again
   keeps most other runs out of all that follows; it never drops one that matters.
3. Runs whose whole content occurs again are repeated in all their windows.
   That takes a count of 128-bit hashes, no texts.
4. For grams with different runs, one run of each content is cut from its text.
   Sampled splitters range-partition the suffixes that start at anchors by
   their leading tokens.  Each bucket sorts them by multikey quicksort, and the
   texts before the anchors (read backwards) as well; tokens that neighbours
   have in common then say, token by token, which windows are equal.
5. Splitters fall between grams, so suffixes on two sides of a boundary share
   less than a gram.  But a gram with too many different runs for a bucket
   would stretch over many: its windows are compared across all of them by a
   count of 128-bit hashes of whole windows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import map_batches, utf8
from quiltgraph.storage import materialize, remove


@dataclass(frozen=True)
class Law:
    """Which passages repeat: ``length`` tokens, each a byte or (``words``) a run of bytes other than ASCII white space; gram: tokens of an anchor."""

    length: int
    gram: int
    words: bool = False


BYTES_400 = Law(400, 64)
WORDS_50 = Law(50, 8, words=True)
#: Different runs of a gram that one bucket compares; see 5 above.
BUCKET_RUNS = 20_000
#: Tokens in one numpy pass; longer texts are passed in overlapping blocks.
BLOCK = 1 << 20
#: Runs that fill a bucket, and the sample from which splitters are taken.
RUNS_PER_BUCKET, SPLITTER_SAMPLE = 20_000, 20_000
#: Bits of the filter of step 2: 4 MB in each task and on the driver, at any size of the input.
FILTER_BITS = 1 << 25
#: Rows, and bytes of text, that a task gathers before it passes them on.
OUT_ROWS, OUT_BYTES = 50_000, 8 << 20

#: Joins broadcast keys with more rows than HOT_ROWS and than a HOT_KEYS-th part of all; see _join_counted.
HOT_ROWS, HOT_KEYS = 500, 10_000

_RNG = np.random.default_rng(0x5EED)
#: Random value of each byte, and an odd base and its inverse, modulo 2**64.
_VALUE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, BLOCK + 1024), _powers(_INVERSE, BLOCK + 1024)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers of the base (no more than a block of them)."""
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * _UP[: len(values)], dtype=np.uint64, out=sums[1:])
    return sums


def _hashed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, a block of text at a time; of a word longer than a block all blocks count."""
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        a = int(starts[first])
        last = int(np.searchsorted(ends, a + BLOCK, "right"))
        if last == first:
            out[first] = sum(int(_sums(_VALUE[data[k : min(k + BLOCK, ends[first])]])[-1]) for k in range(a, int(ends[first]), BLOCK)) % (1 << 64)
            first += 1
            continue
        sums = _sums(_VALUE[data[a : ends[last - 1]]])
        at = starts[first:last] - a
        out[first:last] = (sums[ends[first:last] - a] - sums[at]) * _DOWN[at]
        first = last
    return _mixed(out)


def tokenize(text: bytes, law: Law) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Tokens (bytes, or hashes of words), and for words where each starts and ends."""
    data = np.frombuffer(text, np.uint8)
    if not law.words:
        return data, None, None
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (~_SPACE[data]).view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    return _hashed_words(data, starts, ends), starts, ends


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """A mixed rolling hash of each n tokens (no more than a block of them): it chooses anchors and groups them, but never decides equality."""
    sums = _sums(_VALUE[tokens] if tokens.dtype == np.uint8 else tokens)
    return _mixed((sums[n:] - sums[:-n]) * _DOWN[: len(tokens) - n + 1])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values: of twice as many in each pass, then of two that overlap."""
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :])


def anchor_runs(tokens: np.ndarray, law: Law) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first window, last window, hash of the gram) of the runs, block by block; windows and anchors by their first token."""
    length, w = law.length, law.length - law.gram + 1
    for at in range(0, len(tokens) - length + 1, BLOCK):
        h = gram_hashes(tokens[at : at + BLOCK + length - 1], law.gram)
        ordered = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        anchors = (_sliding_min(ordered, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
        last = np.append(first[1:], len(anchors)) - 1
        yield anchors[first] + at, first + at, last + at, h[anchors[first]] ^ np.uint64(law.length)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of words (unsigned, a row is a string of them).

    Three-way partition about a pivot word; rows equal in it go on with the
    next word.  Small parts are sorted at once.
    """
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        a, b, depth = stack.pop()
        if b - a < 2 or depth == words.shape[1]:
            continue
        part = order[a:b]
        if b - a <= 64:
            order[a:b] = part[np.lexsort(words[part, depth:].T[::-1])]
            continue
        c = words[part, depth]
        pivot = np.sort(c[:: max(1, len(c) // 33)])[len(c[:: max(1, len(c) // 33)]) // 2]
        less, more = c < pivot, c > pivot
        same = ~(less | more)
        order[a:b] = np.concatenate([part[less], part[same], part[more]])
        i, j = a + int(less.sum()), b - int(more.sum())
        stack += [(a, i, depth), (i, j, depth + 1), (j, b, depth)]
    return order


def suffix_array(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings (rows of tokens, bytes in eights), and how many tokens each has in common with the one before it (0 for the first)."""
    words = strings if strings.dtype == np.uint64 else strings.view(">u8").astype(np.uint64)
    order = multikey_quicksort(words)
    common = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 4096):  # bounds the table of differences
        differs = strings[order[a : a + 4096]] != strings[order[a - 1 : a + 4095]][: len(order[a : a + 4096])]
        common[a : a + 4096] = np.where(differs.any(axis=1), differs.argmax(axis=1), strings.shape[1])
    return order, common


def _strings(tokens: np.ndarray, at: np.ndarray, sizes: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of up to ``width`` tokens from each place on, forwards or backwards, filled up with zeros."""
    width = -(-width // 8) * 8 if tokens.dtype == np.uint8 else width
    take = np.arange(width)
    inside = take < np.minimum(sizes, width)[:, None]
    return np.where(inside, tokens[np.where(inside, at[:, None] + step * take, 0)], tokens.dtype.type(0))


def repeated_windows(runs: list[np.ndarray], before: np.ndarray, law: Law) -> list[np.ndarray]:
    """For runs of any grams, which of their windows also start in another of the runs.

    A run is its tokens from the first window's start to the last one's end;
    before: tokens from the first window's start to the anchor.  Windows with
    the anchor at place d are equal if d tokens before it and length - d from
    it on are: each part is decided by the suffix array of that side.
    """
    m, length = len(runs), law.length
    sizes = np.array([len(r) for r in runs], np.int64)
    windows = sizes - length + 1
    starts, ends = np.cumsum(sizes) - sizes, np.cumsum(windows)
    hit = np.zeros(int(windows.sum()), bool)
    if m > 1:
        tokens = np.concatenate(runs)
        after, common_after = suffix_array(_strings(tokens, starts + before, sizes - before, length, 1))
        ahead, common_ahead = suffix_array(_strings(tokens, starts + before - 1, before, length - law.gram, -1))
        same_after, same_ahead = np.empty(m, np.int64), np.empty(m, np.int64)
        for d in range(length - law.gram + 1):
            who = np.flatnonzero((before >= d) & (before - d < windows))
            if len(who) < 2:
                continue
            same_after[after] = np.cumsum(common_after < length - d)
            same_ahead[ahead] = np.cumsum(common_ahead < d)
            key = np.sort((same_after[who] * (m + 1) + same_ahead[who]) * m + who)
            pair, i = key // m, key % m
            same = pair[1:] == pair[:-1]
            i = i[np.append(same, False) | np.append(False, same)]
            hit[ends[i] - windows[i] + before[i] - d] = True
    return np.split(hit, ends[:-1])


def _intervals(flags: np.ndarray, law: Law, start: int, span: bytes) -> list[tuple[int, int]]:
    """Byte ranges covered by the flagged windows of a run whose text starts at ``start``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).reshape(-1, 2).tolist()
    if not law.words:
        return [(start + a, start + b - 1 + law.length) for a, b in edge]
    _, starts, ends = tokenize(span, law)
    return [(start + int(starts[a]), start + int(ends[b - 2 + law.length])) for a, b in edge]


RUN = "k1 bigint, k2 bigint, law int, a bigint, b bigint, before int, lead bigint, gram bigint, span bigint, span2 bigint"
CUT = "k1 bigint, k2 bigint, law int, bucket int, start bigint, before int, span binary"
WINDOW = "k1 bigint, k2 bigint, law int, a bigint, b bigint, gram bigint, h1 bigint, h2 bigint"
RANGE = "k1 bigint, k2 bigint, law int, a bigint, b bigint"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _longs(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _repeated_grams(rows: DataFrame, laws: tuple[Law, ...]) -> np.ndarray:
    """Bit set of the grams (by their hash modulo its size) of more than one run."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in utf8(batch.column(0)):
                for law in laws:
                    for *_, gram in anchor_runs(tokenize(text, law)[0], law):
                        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], names=["gram"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for some in grams(batches):
            held.append(some)
            n += some.num_rows
            if n > OUT_ROWS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    counted = rows.select("text").mapInArrow(joined, "gram bigint").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bit = F.pmod("gram", F.lit(FILTER_BITS))
    words = counted.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _find_runs(rows: DataFrame, laws: tuple[Law, ...], grams: np.ndarray) -> DataFrame:
    """The runs of all texts whose gram may occur again, with hashes of gram and whole content (span, span2).

    In a text with very many runs (a constant text has one for each token)
    those that occur in it a third time and more are put together to ranges
    that are known to repeat: rows with before = -1.
    """
    repeated = rows.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, out = repeated.value, []
        seen: dict[tuple, int] = {}
        again: list[list[int]] = []
        for batch in batches:
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                view = memoryview(text)
                for k, law in enumerate(laws):
                    tokens, starts, ends = tokenize(text, law)
                    for anchor, first, last, gram in anchor_runs(tokens, law):
                        at = (gram & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                        some = np.flatnonzero(bits[at >> 6] >> (at & 63) & 1)
                        anchor, first, last, gram = anchor[some], first[some], last[some] + law.length, gram[some].view(np.int64)
                        before = anchor - first
                        dense = len(anchor) * 8 > len(tokens)
                        if law.words:
                            anchor, first, last = starts[anchor], starts[first], ends[last - 1]
                        seen.clear()
                        for x, f, e, p, g in zip(anchor.tolist(), first.tolist(), last.tolist(), before.tolist(), gram.tolist(), strict=True):
                            content = (g, *_longs(xxhash.xxh3_128_digest(view[f:e], p)))  # which includes where the anchor is
                            if dense:
                                seen[content] = n = seen.get(content, 0) + 1
                                if n > 2:
                                    if again and f <= again[-1][1]:
                                        again[-1][1] = e
                                    else:
                                        again.append([f, e])
                                    continue
                            out.append((k1, k2, k, f, e, p, int.from_bytes(view[x : x + 8].tobytes().ljust(8, b"\0"), "big") - (1 << 63), *content))
                            if len(out) >= OUT_ROWS:
                                yield _batch(out, RUN)
                                out = []
                        out += [(k1, k2, k, f, e, -1, 0, 0, 0, 0) for f, e in again]
                        again.clear()
        if out:
            yield _batch(out, RUN)

    return rows.select("k1", "k2", "text").mapInArrow(run, RUN)


def _splitters(needed: DataFrame, n_needed: int, n: int) -> list[tuple[int, int]]:
    """n - 1 splitters (lead, gram) from a sample of about SPLITTER_SAMPLE suffixes, chosen by hash."""
    one_in = -(-n_needed // SPLITTER_SAMPLE)
    sample = sorted((r["lead"], r["gram"]) for r in needed.where(F.pmod(F.xxhash64("gram", "span"), F.lit(max(1, one_in))) == 0).select("lead", "gram").collect())
    return sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []


def _join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """Inner join with counted (keys, n), n being how many of the n_rows rows have a key.

    Frequent keys, HOT_KEYS at most, are broadcast, so their rows stay in the
    tasks that read them; the rows of all other keys are shuffled, HOT_ROWS or
    a HOT_KEYS-th part of all rows at most for each key.
    """
    most = max(HOT_ROWS, n_rows // HOT_KEYS)
    hot = F.broadcast(counted.where(F.col("n") > most))
    others = rows.join(hot, keys, "left_anti").join(counted.where(F.col("n") <= most), keys)
    return rows.join(hot, keys).unionByName(others)


def _semi_join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """As _join_counted, but only the rows that have a key, without n."""
    most = max(HOT_ROWS, n_rows // HOT_KEYS)
    hot = F.broadcast(counted.where(F.col("n") > most).select(*keys))
    others = rows.join(hot, keys, "left_anti").join(counted.where(F.col("n") <= most).select(*keys), keys, "left_semi")
    return rows.join(hot, keys, "left_semi").unionByName(others)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, k1, k2): two long keys together name id and text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(id_col)).alias("k1"), F.xxhash64(F.col(text_col), F.lit(1)).alias("k2"))


def repeated_ranges(rows: DataFrame, laws: tuple[Law, ...], bucket_runs: int = BUCKET_RUNS) -> tuple[DataFrame, list[DataFrame]]:
    """(k1, k2, law, a, b): byte ranges covered by repeated windows, which may overlap, for rows (doc_id, text, k1, k2); and the tables it is read from."""
    spark = rows.sparkSession
    all_runs = materialize(_find_runs(rows, laws, _repeated_grams(rows, laws)), "runs")
    runs = all_runs.where("before >= 0")
    content = ["gram", "span", "span2"]
    where = ("k1", "k2", "law", "a", "b", "before", "lead")
    one = F.min(F.struct(*where)).alias("one")
    spans = materialize(runs.groupBy(*content).agg(F.count(F.lit(1)).alias("n"), one).select(*content, "n", "one.*"), "spans")
    # 3: the same run elsewhere.
    n_runs = runs.count()
    found = _semi_join_counted(runs, spans.where("n > 1").select(*content, "n"), content, n_runs).unionByName(all_runs.where("before < 0")).select("k1", "k2", "law", "a", "b")

    # 4 and 5: one run of each content, for grams with several contents.
    several = spans.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    needed = materialize(_join_counted(spans.drop("n"), several, ["gram"], n_runs).withColumn("wide", F.col("n") > bucket_runs).drop("n"), "needed")
    n_needed = needed.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_needed // RUNS_PER_BUCKET))
    splitters = spark.sparkContext.broadcast(_splitters(needed.where("not wide"), n_needed, buckets))
    by_text = needed.groupBy("k1", "k2").agg(F.collect_set(F.struct("law", "a", "b", "before", "lead", "gram", "wide")).alias("runs"))
    # doc_id is taken along so that the final join can reuse this exchange of the texts.
    cut = rows.join(by_text, ["k1", "k2"]).select("doc_id", "text", "k1", "k2", "runs")

    def cut_runs(wide: bool) -> DataFrame:
        schema = WINDOW if wide else CUT

        def windows(k1: int, k2: int, r: dict, span: bytes) -> list[tuple]:
            law = laws[r["law"]]
            tokens, starts, ends = tokenize(span, law)
            view, size, n = memoryview(tokens).cast("B"), tokens.itemsize, law.length
            place = lambda w: (int(starts[w]), int(ends[w + n - 1])) if law.words else (w, w + n)
            return [(k1, k2, r["law"], r["a"] + place(w)[0], r["a"] + place(w)[1], r["gram"], *_longs(xxhash.xxh3_128_digest(view[w * size : (w + n) * size], r["before"] - w))) for w in range(len(tokens) - n + 1)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            held = 0
            for batch in batches:
                for text, k1, k2, some in zip(utf8(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    for r in some:
                        if r["wide"] is not wide:
                            continue
                        span = text[r["a"] : r["b"]]
                        if wide:
                            out += windows(k1, k2, r, span)
                        else:
                            out.append((k1, k2, r["law"], bisect.bisect_right(splitters.value, (r["lead"], r["gram"])), r["a"], r["before"], span))
                        held += len(span)
                        if held > OUT_BYTES or len(out) > OUT_ROWS:
                            yield _batch(out, schema)
                            out, held = [], 0
            if out:
                yield _batch(out, schema)

        return cut.mapInArrow(run, schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        table = pa.Table.from_batches(some)
        bucket, kind, start, before = (table[c].to_numpy() for c in ("bucket", "law", "start", "before"))
        order = np.lexsort((kind, bucket))
        edges = np.flatnonzero(np.append(True, (np.diff(bucket[order]) != 0) | (np.diff(kind[order]) != 0)))
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            at = order[a:b]
            law, texts = laws[kind[at[0]]], table["span"].take(pa.array(at)).to_pylist()
            hits = repeated_windows([tokenize(t, law)[0] for t in texts], before[at].astype(np.int64), law)
            out = [(i, *x) for i, h, t in zip(at.tolist(), hits, texts, strict=True) if h.any() for x in _intervals(h, law, int(start[i]), t)]
            if out:
                i, lo, hi = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(table[c].take(pa.array(i)).combine_chunks() for c in ("k1", "k2", "law")), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["k1", "k2", "law", "a", "b"])

    found = found.unionByName(cut_runs(False).repartitionById(buckets, "bucket").mapInArrow(compare, RANGE))
    tables = [all_runs, spans, needed]
    if not needed.where("wide").isEmpty():
        windows = materialize(cut_runs(True), "windows")
        twice = windows.groupBy("gram", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.unionByName(_semi_join_counted(windows, twice, ["gram", "h1", "h2"], windows.count()).select("k1", "k2", "law", "a", "b"))
        tables.append(windows)
    return found, tables


def _by_text(found: DataFrame) -> DataFrame:
    """(k1, k2, found): the distinct ranges of each text."""
    return found.groupBy("k1", "k2").agg(F.collect_set(F.struct("law", "a", "b")).alias("found"))


def _join_spans(pairs: list[dict] | None, law: int = 0) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((p["a"], p["b"]) for p in pairs or () if p["law"] == law):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", law: Law = BYTES_400, report: Law | None = None, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """Remove each byte covered by a passage of the law that also starts anywhere else, in the same text too.

    Returns for each input row: doc_id, n_bytes, spans (removed byte ranges,
    maximal and in order), kept (the bytes that remain), reported (ranges of
    what repeats by the other law, ``report``, which are not removed).
    Passages are judged on the input, so all occurrences go, the first one
    too.  A null text is empty; texts shorter than a passage keep everything;
    repeated rows are each other's repeats.  Matches never cross texts.
    """
    rows = _keyed(docs, id_col, text_col)
    laws = tuple(dict.fromkeys([law, report or law]))
    found, _ = repeated_ranges(rows, laws, bucket_runs)
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, ranges = utf8(batch.column(1)), batch.column(2).to_pylist()
        spans = [_join_spans(x, 0) for x in ranges]
        other = [_join_spans(x, laws.index(report)) if report else [] for x in ranges]
        as_pairs = lambda some: pa.array([[{"start": a, "end": b} for a, b in s] for s in some], pairs)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, texts), pa.int64()), as_pairs(spans), pa.array([_cut_out(t, s) for t, s in zip(texts, spans, strict=True)], pa.binary()), as_pairs(other)],
            names=["doc_id", "n_bytes", "spans", "kept", "reported"],
        )

    joined = rows.join(_by_text(found), ["k1", "k2"], "left")
    ranges = "array<struct<start:bigint,end:bigint>>"
    return map_batches(joined, ["doc_id", "text", "found"], f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, spans {ranges}, kept binary, reported {ranges}", cut)


def strip_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", law: Law = WORDS_50) -> DataFrame:
    """The documents with their repeats cut from the text; other columns, of any names, as they are.

    A character that a cut divides goes with it.  A text of which nothing
    but white space remains goes as a whole; empty and null texts stay as they
    were.
    """
    found, tables = repeated_ranges(_keyed(docs, id_col, text_col), (law,))
    # Columns are known by their places, so that no name can clash.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at, by = docs.columns.index(text_col), docs.columns.index(id_col)
    joined = plain.withColumns({"k1": F.xxhash64(f"c{by}"), "k2": F.xxhash64(F.col(f"c{at}"), F.lit(1))}).join(_by_text(found), ["k1", "k2"], "left").drop("k1", "k2")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_join_spans(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            texts = [t if t is None or not s else _cut_out(t, s).decode(errors="ignore").encode() for t, s in zip(batch.column(at).cast(pa.binary()).to_pylist(), spans, strict=True)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.binary()).cast(columns[at].type)
            keep = pa.array([not s or bool(t.strip()) for t, s in zip(texts, spans, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(keep)

    return joined.mapInArrow(cut, plain.schema).toDF(*docs.columns)


def digest(cut: DataFrame) -> DataFrame:
    """The report columns, and n_passages: passages by the law that was only reported."""
    n_removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.size("reported").cast("bigint").alias("n_passages"))
