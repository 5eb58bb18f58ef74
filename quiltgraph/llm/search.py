"""Ranked lexical search by sort-based accumulation.

Documents are scanned once for the terms of the queries (items).  Each task
then concatenates arrays of (item, document, impact) for the terms that its
documents hold, radix sorts their packed keys and adds up equal keys with
``numpy.add.reduceat``; the best documents of each item are kept by heaps, and
a range partition by item merges the tasks' best."""

from __future__ import annotations

import functools
import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.llm.common import map_batches, open_store, utf8
from quiltgraph.llm.decontaminate import words_of
from quiltgraph.operators.ranking import prefix_sum
from quiltgraph.storage import materialize, remove, remove_path, shared_path

TOP = 10
#: The parts of the length norm that don't and do follow a document's length, in hundredths; the scale of
#: an impact; and by how much the norm counts against a term's occurrences.
NORM, LENGTH_PART, SCALE, PER_TF, PER_NORM = 100, 75, 1_000_000_000, 1000, 8
#: (item, term) pairs of one chunk of the queries, or one longer item: what a task holds of them at a time.  More queries
#: are looked up chunk by chunk; results are the same at any size.
CHUNK_PAIRS = 1 << 20
#: Texts that a task holds while it looks up several chunks.
HELD_BYTES = 64 << 20
#: (item, document, impact) entries that are sorted at a time, or those of one document.
SORTED = 1 << 22


# --- queries -------------------------------------------------------------------------------------------------------


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, times): what each item holds.  Rows that share an id are one item."""
    own = items.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, terms, times = [], [], []
        for k, text in enumerate(utf8(batch.column(1))):
            counted = Counter(words_of(text))
            at += [k] * len(counted)
            terms += counted.keys()
            times += counted.values()
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.binary()), pa.array(times, pa.int64())], names=["item_id", "term", "times"])

    found = map_batches(items, [F.col(id_col).alias("item_id"), F.col(text_col).alias("text")], f"item_id {own}, term binary, times bigint", rows)
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _numbered_items(pairs: DataFrame) -> DataFrame:
    """(item_id, item_no, chunk): items in the order of their hashes; a chunk ends once it has CHUNK_PAIRS pairs."""
    sized = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("c")).withColumn("_h", F.xxhash64("item_id"))
    # Ids that are alike but for their hash's bucket are told apart by rank, as prefix sums want distinct keys.
    rank = F.row_number().over(Window.partitionBy(F.shiftright(F.col("_h"), 44)).orderBy("_h", "item_id")) - 1
    keyed = sized.select("item_id", "c", (F.shiftleft(F.shiftright(F.col("_h"), 44) + (1 << 19), 24) + rank).alias("_k"), F.lit(1).alias("one"))
    numbered = prefix_sum(prefix_sum(keyed, "_k", "c", "_before"), "_k", "one", "item_no")
    return numbered.select("item_id", "item_no", F.expr(f"_before div {CHUNK_PAIRS}").alias("chunk"))


def _write_vocabulary(pairs: DataFrame, folder: str) -> DataFrame:
    """Number each chunk's terms and write them (chunk, term, term_no); returns the table."""
    terms = pairs.select("chunk", "term").distinct()
    place = F.row_number().over(Window.partitionBy("chunk").orderBy("term")) - 1  # CHUNK_PAIRS rows, or those of one item
    terms.withColumn("term_no", place).write.partitionBy("chunk").parquet(folder)
    return terms.sparkSession.read.schema("term binary, term_no int, chunk bigint").parquet(folder)


def _chunks(folder: str) -> list[int]:
    files, path = open_store(folder)
    found = files.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(int(f.base_name.removeprefix("chunk=")) for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith("chunk="))


def _read_chunk(folder: str, chunk: int) -> pa.Table:
    files, path = open_store(f"{folder}/chunk={chunk}")
    return ds.dataset(path, filesystem=files, format="parquet", exclude_invalid_files=True).to_table()


@functools.lru_cache(maxsize=1)
def _vocabulary(folder: str, chunk: int) -> dict[bytes, int]:
    table = _read_chunk(folder, chunk)
    return dict(zip(table.column("term").to_pylist(), table.column("term_no").to_pylist(), strict=True))


@functools.lru_cache(maxsize=1)
def _index(folder: str, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: where each term's entries start (and the last end), the entries' items and gains, and the item numbers."""
    table = _read_chunk(folder, chunk)
    term, item, gain = (table.column(c).to_numpy() for c in ("term_no", "item_no", "gain"))
    order = np.lexsort((item, term))
    term, item, gain = term[order], item[order], gain[order]
    numbers, local = np.unique(item, return_inverse=True)
    return np.searchsorted(term, np.arange(int(term.max()) + 2)), local.astype(np.int64), gain, numbers


# --- documents -----------------------------------------------------------------------------------------------------


def _match(docs: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, chunk, terms, times): for each document and chunk, the chunk's terms that it holds.

    A document has a row for the first chunk even if it holds none of its terms.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("chunk", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])

    def looked_up(held: list[tuple[pa.Array, list[bytes]]], chunks: list[int]) -> Iterator[pa.RecordBatch]:
        for k, chunk in enumerate(chunks):
            get = _vocabulary(folder, chunk).get
            for ids, texts in held:
                counts, terms, times = [], [], []
                for text in texts:
                    words = words_of(text)
                    found = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                    own, many = np.unique(found[found >= 0], return_counts=True)
                    counts.append(len(words))
                    terms.append(own)
                    times.append(many.astype(np.int32))
                out = pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array([chunk] * len(texts), pa.int64()), _lists(terms), _lists(times)], schema=schema)
                yield out if k == 0 else out.filter(pa.array([len(t) > 0 for t in terms], pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, held, size = _chunks(folder), [], 0
        for batch in batches:
            held.append((batch.column(0), utf8(batch.column(1))))
            size += sum(map(len, held[-1][1]))
            if len(chunks) < 2 or size > HELD_BYTES:
                yield from looked_up(held, chunks)
                held, size = [], 0
        yield from looked_up(held, chunks)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, "doc_id bigint, n bigint, chunk bigint, terms array<int>, times array<int>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)]), pa.int32()))


# --- accumulation --------------------------------------------------------------------------------------------------


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative keys, 16 bits at a time from the lowest: numpy sorts such digits by radix."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, int(keys.max()).bit_length() if len(keys) else 0, 16):
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def accumulate(items: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of impacts by (item, document), in that order."""
    bits = max(1, int(docs.max()).bit_length()) if len(docs) else 1
    keys = items << bits | docs
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(impacts[order], first) if len(first) else impacts[:0]
    return keys[first] >> bits, keys[first] & (1 << bits) - 1, sums


class Best:
    """The best ``top`` documents of each item, as heaps of (score, -id): of equal scores the smaller id is better, null ids last."""

    def __init__(self, top: int):
        self.top, self.heaps = top, {}

    def add(self, items: np.ndarray, ids: list, scores: np.ndarray) -> None:
        """items ascending.  Only documents that can be among an item's best reach its heap."""
        starts = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])) if len(items) else []
        for a, b in zip(starts, [*starts[1:], len(items)], strict=True):
            own, heap = scores[a:b], self.heaps.setdefault(int(items[a]), [])
            least = heap[0][0] if len(heap) == self.top else 1
            if b - a > self.top:
                least = max(least, int(np.partition(own, b - a - self.top)[b - a - self.top]))
            for k in np.flatnonzero(own >= least).tolist():
                entry = (int(own[k]), -np.inf if ids[a + k] is None else -ids[a + k])
                if len(heap) < self.top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)

    def rows(self) -> Iterator[tuple[int, int, int | None]]:
        for item, heap in self.heaps.items():
            for score, minus in heap:
                yield item, score, None if minus == -np.inf else -minus


def impacts_of(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """How much a term counts that occurs tf times in a document of n terms, out of ``documents`` with ``words`` in all."""
    m = NORM - LENGTH_PART + LENGTH_PART * n * documents // words
    return SCALE * tf // (PER_TF * tf + PER_NORM * m)


def _score(matched: DataFrame, folder: str, documents: int, words: int, top: int) -> DataFrame:
    """(item_no, score, doc_id): the best of each task's documents for each item."""
    most = SORTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(top)
        for batch in batches:
            n, chunks, ids = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(0).to_pylist()
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            term, tf = lists.flatten().to_numpy().astype(np.int64), batch.column(4).flatten().to_numpy().astype(np.int64)
            impact = impacts_of(tf, n[doc], documents, words)
            for chunk in np.unique(chunks[sizes > 0]).tolist():
                starts, items, gains, numbers = _index(folder, chunk)
                rows = np.flatnonzero(chunks[doc] == chunk)
                length = starts[term[rows] + 1] - starts[term[rows]]
                # Cut between documents, so that at most `most` entries are sorted at a time.
                ends = np.flatnonzero(np.concatenate([doc[rows][1:] != doc[rows][:-1], [True]])) + 1
                upto, a = np.cumsum(length)[ends - 1], 0
                while a < len(ends):
                    done = upto[a - 1] if a else 0
                    b = max(a + 1, int(np.searchsorted(upto, done + most, "right")))
                    own = rows[ends[a - 1] if a else 0 : ends[b - 1]]
                    size = length[ends[a - 1] if a else 0 : ends[b - 1]]
                    at = np.repeat(starts[term[own]] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                    low = int(doc[own[0]])
                    item, local, score = accumulate(items[at], np.repeat(doc[own] - low, size), gains[at] * np.repeat(impact[own], size))
                    good = score > 0
                    best.add(numbers[item[good]], [ids[low + k] for k in local[good].tolist()], score[good])
                    a = b
        found = list(best.rows())
        for i in range(0, len(found), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[i : i + 65536], strict=True)], names=["item_no", "score", "doc_id"])

    return matched.mapInArrow(run, "item_no bigint, score bigint, doc_id bigint")


def rank_documents(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item with a score above 0, over all documents.

    Terms are runs of a-z (after lower-casing A-Z), 0-9 and non-ASCII
    characters of whole texts.  A null or empty text, or one without a term,
    isn't counted as a document and is never found; an item without terms, or
    with none that a document holds, has no rows.  Equal scores are ranked by
    ascending id, a null id last; repeated rows are documents of their own,
    each with a rank.  Items that share an id are one item with the terms of
    all; the null id is an item's id like others.  No documents or no items
    give no rows.

    Each text is read once.  What it holds of the items' terms goes to the
    shared folder; counts over all documents come from there, and then scores.
    The items' terms lie in the shared folder in chunks (CHUNK_PAIRS), so
    nothing is broadcast; what is shuffled is counts, and for each task and
    item ``top`` rows.  Intermediate tables are deleted at the end.
    """
    spark = docs.sparkSession
    pairs = materialize(_item_terms(items, item_col, item_text_col), "search_pairs")
    numbered = materialize(_numbered_items(pairs), "search_items")
    chunked = pairs.join(numbered, pairs["item_id"].eqNullSafe(numbered["item_id"])).select("chunk", "item_no", "term", "times")
    vocabulary_folder, index_folder = shared_path(spark, "search_terms"), shared_path(spark, "search_index")
    vocabulary = _write_vocabulary(chunked, vocabulary_folder)
    matched = materialize(_match(docs, vocabulary_folder, id_col, text_col), "search_matches")
    documents, words = matched.where(F.col("chunk") == 0).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    held = matched.select("chunk", F.explode("terms").alias("term_no")).groupBy("chunk", "term_no").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1)))
    weights = vocabulary.join(held, ["chunk", "term_no"]).select("chunk", "term", "term_no", weight.cast("bigint").alias("w"))
    index = chunked.join(weights, ["chunk", "term"]).select("chunk", "item_no", "term_no", (F.col("times") * F.col("w")).alias("gain"))
    index.repartition("chunk").write.partitionBy("chunk").parquet(index_folder)
    # Written, as a range partition reads what it deals out twice.
    best = materialize(_score(matched, index_folder, documents, words or 1, top), "search_best")
    rank = F.row_number().over(Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    merged = best.repartitionByRange("item_no").withColumn("rank", rank).where(F.col("rank") <= top)
    out = materialize(merged.join(numbered, "item_no").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "search_result")
    remove(pairs, numbered, matched, best)
    for folder in (vocabulary_folder, index_folder):
        remove_path(spark, folder)
    return out


#: The same in DuckDB's SQL, in its integers.
ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
items AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
size AS MATERIALIZED (SELECT count(*) AS documents, sum(len(words))::BIGINT AS words FROM d WHERE len(words) > 0),
tf AS MATERIALIZED (SELECT r, doc_id, len(words) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, words, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term, documents),
impact AS MATERIALIZED (SELECT r, doc_id, term, w * (({SCALE} * tf) // ({PER_TF} * tf + {PER_NORM} * ({NORM - LENGTH_PART} + ({LENGTH_PART} * n * documents) // words))) AS impact FROM tf JOIN w USING (term), size),
scores AS (SELECT item_id, r, doc_id, sum(times * impact)::BIGINT AS score FROM items JOIN impact USING (term) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {TOP}"""
