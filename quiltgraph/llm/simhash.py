"""SimHash near-duplicates, linked by a binary-trie self-join.

Within buckets a binary trie of fingerprints is joined with itself: node pairs
go down together, add up differing bits and are pruned beyond the budget.

* near_duplicates: fingerprints of 64 bits that differ in two at most.  Such
  agree in two of four 16-bit blocks, so each pair of blocks makes a bucket in
  which all its links are found.
* keep_alike: fingerprints of 256 bits, of distinct five-word shingles, whose
  likeness is 0.8 or more.  The share of differing bits tells the angle between
  two sets and thereby their Jaccard index.  Buckets are keyed by samples of bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import acos, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import LOWER, map_batches, utf8
from quiltgraph.llm.suffixes import Law, gram_hashes, tokenize
from quiltgraph.operators.components import connected_components
from quiltgraph.storage import materialize

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 2
#: A bucket with more fingerprints is divided by two more blocks of eight bits,
#: which leaves at most 2**16 different ones.
BUCKET_ROWS = 2048
#: Fingerprints that a task joins at once, and node pairs that go down together.
TASK_ROWS, FRONTIER = 100_000, 1 << 20
#: Shingles, bits and least likeness of keep_alike; its buckets are keyed by KEYS
#: samples of KEY_BITS bits.  By computation a pair of likeness 0.8 misses all
#: of them with chance 0.18, one of 0.85 with 0.05 and one of 0.9 with 0.002.
ALIKE_WORDS, ALIKE_BITS, LEAST_ALIKE = 5, 256, 0.8
KEYS, KEY_BITS = 64, 22
#: A bucket with more rows is first held against PIVOTS of its rows.
DENSE_ROWS, PIVOTS = 64, 4
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (ALIKE_BITS // 64, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits, from the top, of the blocks.
_WIDE = tuple(0xFFFF << s for s in (48, 32, 16, 0))


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's word shingles, repeats included; 0 for no words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    n = max(1, len(words) - size + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), ">u8", n)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text, as a signed long.  Null is as empty: 0."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter(map(fingerprint, utf8(batch.column(1))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs, [F.col(id_col), F.col(text_col)], f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint", rows)


def _differ(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values[a] ^ values[b]).sum(axis=1, dtype=np.int64)


def trie_links(values: np.ndarray, starts: np.ndarray, budget: int = MOST_BITS, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within the same bucket whose values differ in 1 to ``budget`` bits.

    values: rows of unsigned 64-bit words, sorted and distinct within each
    bucket, which is the range from one of starts to the next.  A trie node is
    a range of values that agree in the bits so far; one with a single value
    is a leaf with all bits left, so a pair of leaves is finished at once.
    Node pairs whose values all have one label are left out.
    """
    values = values.reshape(len(values), -1)
    ends = np.append(starts[1:], len(values))
    zero = np.zeros(len(starts), np.int16)
    stack = [(0, starts, ends, starts, ends, zero)]
    ones_by_bit: dict[int, np.ndarray] = {}  # set bits before each position
    changes = None if label is None else np.append(0, np.cumsum(label[1:] != label[:-1]))
    while stack:
        bit, a0, a1, b0, b1, e = stack.pop()
        while len(a0):
            if len(a0) > FRONTIER:
                half = len(a0) // 2
                stack.append((bit, a0[half:], a1[half:], b0[half:], b1[half:], e[half:]))
                a0, a1, b0, b1, e = a0[:half], a1[:half], b0[:half], b1[:half], e[:half]
            if bit not in ones_by_bit:
                ones_by_bit[bit] = np.append(0, np.cumsum(values[:, bit // 64] >> np.uint64(63 - bit % 64) & np.uint64(1), dtype=np.int64))
            ones = ones_by_bit[bit]
            am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
            same, more = a0 == b0, e < budget
            parts = [
                (a0, am, b0, bm, e, np.ones(len(a0), bool)),
                (am, a1, bm, b1, e, np.ones(len(a0), bool)),
                (a0, am, bm, b1, e + 1, more),
                (am, a1, b0, bm, e + 1, more & ~same),
            ]
            kept = [[x[ok] for x in part[:5]] for *part, want in parts if len(ok := np.flatnonzero(want & (part[1] > part[0]) & (part[3] > part[2]) & ~((part[0] == part[2]) & (part[1] - part[0] < 2))))]
            a0, a1, b0, b1, e = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else [np.empty(0, np.int64)] * 5
            bit += 1
            if changes is not None and len(a0):
                ok = (changes[a0] != changes[a1 - 1]) | (changes[b0] != changes[b1 - 1]) | (label[a0] != label[b0])
                a0, a1, b0, b1, e = (x[ok] for x in (a0, a1, b0, b1, e))
            leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
            if leaves.any():
                a, b = a0[leaves], b0[leaves]
                near = _differ(values, a, b) <= budget
                yield a[near], b[near]
                a0, a1, b0, b1, e = (x[~leaves] for x in (a0, a1, b0, b1, e))


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least position that each of n reaches by links (a, b), and by those that gave root."""
    root = np.arange(n) if root is None else root
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def spanning_links(values: np.ndarray, starts: np.ndarray, budget: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For every value linked in its bucket, it and the least value that it reaches there: as many links as values at most.

    Values of large buckets are first linked to a few of their bucket; the
    trie join then leaves out what is connected, so that a dense group costs
    no work for each of its pairs.
    """
    values = values.reshape(len(values), -1)
    sizes = np.diff(np.append(starts, len(values)))
    root, label = np.arange(len(values)), None
    for a, n in zip(starts[sizes > DENSE_ROWS].tolist(), sizes[sizes > DENSE_ROWS].tolist(), strict=True):
        for pivot in range(a, a + n, max(1, n // PIVOTS)):
            near = a + np.flatnonzero(np.bitwise_count(values[a : a + n] ^ values[pivot]).sum(axis=1, dtype=np.int64) <= budget)
            root[a : a + n] = _roots(n, near - a, np.full(len(near), pivot - a), root[a : a + n] - a) + a
        label = root
    label = None if label is None else label.copy()
    for a, b in trie_links(values, starts, budget, label):
        root = _roots(len(values), a, b, root)
    at = np.flatnonzero(root != np.arange(len(values)))
    return values[at], values[root[at]]


def _bucket_keys(fps: DataFrame) -> DataFrame:
    """Each fingerprint with the key of each pair of blocks: the masked value and which pair."""
    masks = [a | b for a, b in combinations(_WIDE, 2)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.part", "k.key")


def _finer(rows: DataFrame) -> DataFrame:
    """Rows of full buckets, each with the keys of two of the four free bytes as well."""
    masks = []
    for a, b in combinations(_WIDE, 2):
        free = [m for w in _WIDE if w not in (a, b) for m in (w & 0xFF00FF00FF00FF00, w & 0x00FF00FF00FF00FF)]
        masks.append([a | b | x | y for x, y in combinations(free, 2)])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = F.array(*[F.array(*[F.lit(signed(m)) for m in row]) for row in masks])
    keys = F.transform(table[F.col("part")], lambda m, i: F.struct((F.col("part") * 6 + i + 6).alias("part"), F.col("fp").bitwiseAND(m).alias("key")))
    return rows.select("fp", F.explode(keys).alias("k")).select("fp", "k.part", "k.key")


def link_fingerprints(fps: DataFrame, budget: int = MOST_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp) that connect all which are within ``budget`` <= 2 bits.

    Within a bucket a spanning set of links is returned, not all pairs, so
    dense groups give as many rows as they have members in each bucket.
    """
    if not 0 <= budget <= 2:
        raise ValueError("blocks are laid out for up to two differing bits")
    keyed = _bucket_keys(fps)
    full = materialize(keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).select("part", "key"), "full")
    if not full.isEmpty():
        keyed = keyed.join(full, ["part", "key"], "left_anti").unionByName(_finer(keyed.join(full, ["part", "key"], "left_semi").select("fp", "part", "key")))

    return _link_buckets(keyed, ["part", "key"], ["fp"], budget)


def _link_buckets(keyed: DataFrame, keys: list[str], words: list[str], budget: int) -> DataFrame:
    """Spanning links (u, v) of all buckets: the rows that agree in keys.  Values of several words become binary."""
    kind = "bigint" if len(words) == 1 else "binary"

    def column(values: np.ndarray) -> pa.Array:
        return pa.array(values.view(np.int64)[:, 0]) if len(words) == 1 else pa.array([v.tobytes() for v in values.astype(">u8")], pa.binary())

    def join(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        named = [table[k].to_numpy() for k in keys]
        values = np.stack([table[w].to_numpy().view(np.uint64) for w in words], axis=1)
        new = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in named], axis=0)))
        sizes = np.diff(np.append(new, len(values)))
        order = np.flatnonzero(np.repeat(sizes > 1, sizes))  # single ones have no partner
        sizes = sizes[sizes > 1]
        group = np.repeat(np.arange(len(sizes)), sizes)
        order = order[np.lexsort((*values[order].T[::-1], group))]
        u = v = values[:0]
        if len(order):
            u, v = spanning_links(values[order], np.append(0, np.cumsum(sizes)[:-1]).astype(np.int64), budget)
        return pa.RecordBatch.from_arrays([column(u), column(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:  # sorted by bucket: the last may go on in the next batch
            if n + batch.num_rows > TASK_ROWS and held:
                same = np.all([batch.column(i).to_numpy() == held[-1].column(i)[-1].as_py() for i in range(len(keys))], axis=0)
                more = int(np.argmin(same)) if not same.all() else batch.num_rows
                held.append(batch.slice(0, more))
                n += more
                if more < batch.num_rows:
                    yield join(held)
                    held, n = [batch.slice(more)], batch.num_rows - more
            elif batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield join(held)

    return keyed.select(*keys, *words).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", budget: int = MOST_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for each input row.

    Fingerprints within ``budget`` bits are linked, those of texts without
    words (0; null texts too) like any other; component_id is the smallest
    doc_id reachable (null only if the whole component has null ids).  Equal
    fingerprints are one node, so copies cost a row each and never pairs;
    repeated rows each get a row.  An empty table gives an empty result.
    """
    found = materialize(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    component = connected_components(link_fingerprints(nodes.select("fp"), budget, bucket_rows))
    placed = nodes.join(component.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_fp = placed.select("fp", "component").join(least, "component").select("fp", "component_id")
    return found.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def alike_fingerprint(text: bytes, words: int = ALIKE_WORDS) -> bytes:
    """SimHash, of ALIKE_BITS, of a text's distinct shingles of lower-cased words; zeros for no words."""
    tokens = tokenize(text.translate(LOWER), Law(words, words, words=True))[0]
    if not len(tokens):
        return bytes(ALIKE_BITS // 8)
    at_once = 1 << 16
    hashes = np.unique(np.concatenate([gram_hashes(tokens[a : a + at_once + words - 1], min(words, len(tokens))) for a in range(0, max(1, len(tokens) - words + 1), at_once)]))
    bits = np.zeros(ALIKE_BITS, np.int64)
    for a in range(0, len(hashes), 255):  # as many as a byte can count
        some = hashes[a : a + 255] * _MIX
        some ^= some >> np.uint64(32)
        some *= np.uint64(0xBF58476D1CE4E5B9)
        some ^= some >> np.uint64(29)
        bits += np.add.reduce(np.unpackbits(np.ascontiguousarray(some.T).view(np.uint8).reshape(-1, ALIKE_BITS // 8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * bits > len(hashes)).tobytes()


def alike_budget(likeness: float = LEAST_ALIKE) -> int:
    """Bits that two sets of equal size and that Jaccard index are expected to differ in."""
    return int(ALIKE_BITS * acos(2 * likeness / (1 + likeness)) / pi)


def key_masks() -> list[list[int]]:
    """For each key the bits that make it, as signed masks of the fingerprint's words."""
    rng = np.random.default_rng(SEED + 1)
    out = []
    for _ in range(KEYS):
        chosen = np.zeros(ALIKE_BITS, np.uint8)
        chosen[rng.permutation(ALIKE_BITS)[:KEY_BITS]] = 1
        out.append(np.packbits(chosen).view(">i8").tolist())
    return out


def link_alike(nodes: DataFrame, budget: int) -> DataFrame:
    """Links (u, v) between fingerprints (words w0 to w3) within the budget that agree in a key."""
    words = [f"w{i}" for i in range(ALIKE_BITS // 64)]
    keys = [F.xxhash64(F.lit(k), *[F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(words, mask, strict=True) if m]) for k, mask in enumerate(key_masks())]
    return _link_buckets(nodes.select(*words, F.explode(F.array(*keys)).alias("key")), ["key"], words, budget)


def keep_alike(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", likeness: float = LEAST_ALIKE) -> DataFrame:
    """The documents, all columns as they are, of which one stays for each component of texts alike.

    Texts are alike if their fingerprints (see alike_fingerprint) differ in at
    most the bits that ``likeness``, a Jaccard index, gives on average; see
    KEYS for what is missed.  The row with the smallest id stays (null last),
    of equal ids one with the least hash of its text.  Rows that agree in id
    and text count as one.  Texts without words, null ones too, are alike.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.frombuffer(b"".join(map(alike_fingerprint, utf8(batch.column(2)))), ">i8").reshape(batch.num_rows, -1).astype(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, found.T.copy())], names=["id", "print", *words])

    words = [f"w{i}" for i in range(ALIKE_BITS // 64)]
    found = materialize(map_batches(rows, ["id", "print", "text"], f"id {kind}, print bigint, {', '.join(f'{w} bigint' for w in words)}", sketch), "sketches")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("print"))).alias("least")
    nodes = materialize(found.groupBy(*words).agg(least), "nodes")
    component = connected_components(link_alike(nodes, alike_budget(likeness)))
    node = F.unhex(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words])).alias("node")
    placed = nodes.select(node, "least").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = placed.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.id").alias("id"), F.col("least.print").alias("print"))

    # Two long keys name id and text; both join and last sum use them, so texts are shuffled once.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # by place, so that no name can clash
    at = {c: F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col)}
    named = plain.withColumns({"k1": F.xxhash64(at[id_col]), "k2": F.xxhash64(at[text_col])})
    return named.join(kept.select(F.xxhash64("id").alias("k1"), F.col("print").alias("k2")), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).drop("k1", "k2").toDF(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The report columns."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
