"""Benchmark decontamination: one Aho-Corasick automaton over normalised test
questions and answers, scanning each text once, with hits mapped back to
offsets in the original bytes."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import WORD_BYTES, open_store, utf8
from quiltgraph.storage import shared_path

#: Words of a window.
WINDOW_WORDS = 10
#: Item texts of one automaton: a node for each digit of ten words at most,
#: about 240 MB.  A larger benchmark is scanned by several automata, one after
#: the other, and their hits are put together: exact at any size.
AUTOMATON_BYTES = 1 << 20
#: Benchmark text that one task divides into chunks, a row at a time.
DIVIDED_BYTES = 64 << 20
#: Windows of an item that go into one automaton; longer items are divided.
ITEM_WINDOWS = 100_000
#: A word's number is written in DIGITS digits of this base, the first from an
#: alphabet of its own so that only whole words match.  The automaton searches
#: a node's letters one by one, so a letter for each word would be slow.
BASE, DIGITS = 127, 3
_UNKNOWN = "\0" * DIGITS
#: Texts that a task holds while several automata are built in turn for them.
HELD_BYTES = 64 << 20

SPANS = "array<struct<start:bigint,end:bigint>>"
SCHEMA = f"doc_id {{id}}, n_words bigint, hits {SPANS}, item_ids array<string>, spans {SPANS}"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of a-z, 0-9 and non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


def windows_of(words: list, size: int) -> list[tuple]:
    """Each run of ``size`` words; all words if there are fewer; nothing if there are none."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def _code(number: int) -> str:
    """A word's number as digits, the highest first."""
    digits = [number // BASE**i % BASE for i in reversed(range(DIGITS))]
    return "".join(chr(1 + d if i == 0 else 1 + BASE + d) for i, d in enumerate(digits))


@functools.lru_cache(maxsize=1)
def _read_automaton(folder: str, chunk: str, size: int) -> tuple[dict[bytes, str], ahocorasick.Automaton | None]:
    """_automaton of a chunk in the shared folder."""
    files, path = open_store(f"{folder}/{chunk}")
    rows = pq.read_table(path, filesystem=files, partitioning=None)
    return _automaton(zip(rows.column("item").to_pylist(), rows.column("piece").to_pylist(), strict=True), size)


def _chunk_names(folder: str) -> list[str]:
    files, path = open_store(folder)
    return sorted(f.base_name for f in files.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.type == pafs.FileType.Directory and f.base_name.startswith("chunk="))


def _automaton(items: Iterable[tuple[str, bytes]], size: int) -> tuple[dict[bytes, str], ahocorasick.Automaton | None]:
    """The code of each word, and an automaton of windows in these codes, to (words, item ids).

    AUTOMATON_BYTES and ITEM_WINDOWS leave at most 2**20 different words.
    """
    codes: dict[bytes, str] = {}
    automaton = ahocorasick.Automaton()
    for item, text in items:
        words = words_of(text)
        for word in words:
            if word not in codes:
                codes[word] = _code(len(codes))
        for window in windows_of([codes[w] for w in words], size):
            key = "".join(window)
            _, ids = automaton.get(key, None) or (0, None)
            if ids is None:
                automaton.add_word(key, (len(window), [item]))
            elif ids[-1] != item:
                ids.append(item)
    if not codes:
        return codes, None
    automaton.make_automaton()
    return codes, automaton


def scan(text: bytes, codes: dict[bytes, str], automaton: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, runs of hit words as [first, last + 1), items with occurring windows."""
    words = words_of(text)
    if not words or automaton is None:
        return len(words), [], set()
    items: set[str] = set()
    found = []
    for end, (n, ids) in automaton.iter("".join(map(codes.get, words, repeat(_UNKNOWN)))):
        last = end // DIGITS
        found.append((last - n + 1, last + 1))
        items.update(ids)
    return len(words), _merged(found), items


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def byte_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as byte ranges of the original text."""
    if not runs:
        return []
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_BYTES))]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def _scan_batches(df: DataFrame, text_at: int, schema, folder: str, window: int, rows: Callable[[pa.RecordBatch, list[bytes], list], pa.RecordBatch]) -> DataFrame:
    """mapInArrow with rows(batch, texts, scans), where scans has scan()'s result for each text and all chunks in folder.

    With several chunks a task holds HELD_BYTES of texts, so that each
    automaton is built once for all of them.
    """

    def scanned(held: list[tuple[pa.RecordBatch, list[bytes]]], chunks: list[str]) -> Iterator[pa.RecordBatch]:
        texts = [t for _, some in held for t in some]
        found: list[tuple[int, list[tuple[int, int]], set[str]]] = []
        for k, chunk in enumerate(chunks):
            codes, automaton = _read_automaton(folder, chunk, window)
            for i, text in enumerate(texts):
                n, runs, items = scan(text, codes, automaton)
                if k == 0:
                    found.append((n, runs, items))
                elif items:
                    found[i] = (n, _merged(found[i][1] + runs), found[i][2] | items)
        found = found or [(len(words_of(t)), [], set()) for t in texts]
        at = 0
        for batch, some in held:
            yield rows(batch, some, found[at : at + len(some)])
            at += len(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunk_names(folder)
        held: list[tuple[pa.RecordBatch, list[bytes]]] = []
        size = 0
        for batch in batches:
            held.append((batch, utf8(batch.column(text_at))))
            size += sum(map(len, held[-1][1]))
            if len(chunks) < 2 or size > HELD_BYTES:
                yield from scanned(held, chunks)
                held, size = [], 0
        if held:
            yield from scanned(held, chunks)

    return df.mapInArrow(run, schema)


def _pieces(text: bytes, size: int, most: int) -> Iterator[bytes]:
    """The text, or if it has many windows, pieces that have them all between them."""
    words = words_of(text)
    if len(words) < most + size:
        yield text
        return
    for i in range(0, len(words) - size + 1, most):
        yield b" ".join(words[i : i + most + size - 1])


def _write_chunks(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> str:
    """Write the benchmark's items to the shared folder, in chunks of at most AUTOMATON_BYTES (or one longer item).

    Returns the folder; a chunk is a folder in it.  Only the benchmark's size
    comes to the driver.
    """
    most, windows = AUTOMATON_BYTES, ITEM_WINDOWS
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, held = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                for piece in _pieces(text, size, windows):
                    if held and held + len(piece) > most:
                        chunk, held = chunk + 1, 0
                    held += len(piece)
                    rows.append({"item": item, "piece": piece, "chunk": f"{part:06d}-{chunk:06d}"})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item", pa.string()), ("piece", pa.binary()), ("chunk", pa.string())]))

    folder = shared_path(benchmark.sparkSession, "benchmark")
    items.coalesce(-(-total // DIVIDED_BYTES) or 1).mapInArrow(divide, "item string, piece binary, chunk string").write.partitionBy("chunk").parquet(folder)
    return folder


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """Scan whole texts for windows of benchmark items.

    Returns a row for each input row: doc_id, n_words, hits (runs of hit words
    as [start, end) word numbers), item_ids (sorted as strings), spans (the
    same runs as byte ranges of the original text).  A null text has no words.
    An empty benchmark, or items that are null or have no words, hit nothing;
    items with equal windows are all reported; repeated documents each get
    their row.  The benchmark lies in the shared folder, and the task that reads
    a document reads its chunks (see AUTOMATON_BYTES) one after the other, so
    nothing is shuffled or broadcast.
    """
    folder = _write_chunks(benchmark, item_col, item_text_col, window)
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def as_pairs(spans: Iterator[list[tuple[int, int]]]) -> pa.Array:
        return pa.array([[{"start": a, "end": b} for a, b in some] for some in spans], pairs)

    def rows(batch: pa.RecordBatch, texts: list[bytes], found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([n for n, _, _ in found], pa.int64()),
                as_pairs(runs for _, runs, _ in found),
                pa.array([sorted(items) for _, _, items in found], pa.list_(pa.string())),
                as_pairs(byte_spans(t, runs) for t, (_, runs, _) in zip(texts, found, strict=True)),
            ],
            names=["doc_id", "n_words", "hits", "item_ids", "spans"],
        )

    return _scan_batches(docs.select(F.col(id_col), F.col(text_col)), 1, SCHEMA.format(id=docs.schema[id_col].dataType.simpleString()), folder, window, rows)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """The documents, all columns as they are, in which no benchmark window occurs.

    Null and empty texts stay, and all documents if the benchmark is empty or
    has no words.  Repeated rows stay or go together; ids are not read.  An
    empty table gives none.
    """
    folder = _write_chunks(benchmark, item_col, item_text_col, window)

    def clean(batch: pa.RecordBatch, texts: list[bytes], found: list) -> pa.RecordBatch:
        return batch.filter(pa.array([not runs for _, runs, _ in found], pa.bool_()))

    return _scan_batches(docs, docs.columns.index(text_col), docs.schema, folder, window, clean)


def digest(found: DataFrame) -> DataFrame:
    """The report columns of find_contamination's rows."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "spans",
    )


def items_digest(ids: list[str]) -> str:
    """As in digest(), for tests."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
