"""Cross-tokenizer alignment by an event sweep.

Every token of two tokenizers A and B is an event at the byte offset where it
ends.  The events of both, in blocks, are brought together by document and
sorted by offset; a state machine then streams through them.  Where both end,
a group of tokens ends; between any two neighbouring events lies one link, as
exactly one token of A and one of B cover these bytes."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import open_store
from quiltgraph.llm.packing import _byte_bpe, _byte_characters
from quiltgraph.storage import materialize, remove, remove_path, shared_path

#: Events of one block: what goes through the sort as one row.
BLOCK = 1 << 14
#: Bytes of events, or of links, that a task puts into one batch.
BATCH_BYTES = 16 << 20
#: Different pairs of ids whose counts a task holds at a time; more are looked up one file after the other.
FILE_PAIRS = 1 << 20
#: Links that a task holds while it looks them up in several files.
HELD_LINKS = 1 << 22
#: Links that are counted or looked up at a time.
PART_LINKS = 1 << 18
#: Links of a document that are put together before equal ones are counted.
OPEN_LINKS = 1 << 20

TOKENS = "doc_id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


# --- tokenizers ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tokens:
    """A tokenizer: text to ids, and the bytes that each id stands for."""

    encode: Callable[[str], list[int]]
    pieces: list[bytes]
    widths: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, encode: Callable[[str], list[int]], pieces: list[bytes]) -> Tokens:
        return cls(encode, pieces, np.array([len(p) for p in pieces], np.int64))

    @property
    def dtype(self) -> str:
        return "<u2" if len(self.pieces) <= 1 << 16 else "<u4"


@functools.lru_cache(maxsize=2)
def byte_level(path: str) -> Tokens:
    """The byte-level BPE of a tokenizers file, on a space and the text; strings of special tokens are plain text."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte, tokenizer = _byte_characters(), Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    vocabulary = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    pieces = [bytes(byte[c] for c in t) if (t := vocabulary.get(i)) is not None and all(c in byte for c in t) else b"" for i in range(max(vocabulary) + 1)]
    fast = _byte_bpe(spec)

    def encode(text: str) -> list[int]:
        if fast is not None:
            try:
                return fast.encode_ordinary(f" {text}")
            except BaseException as e:
                if type(e).__name__ != "PanicException":  # Rust's, which is no Exception
                    raise
        return tokenizer.encode(f" {text}", add_special_tokens=False).ids

    return Tokens.of(encode, pieces)


@functools.lru_cache(maxsize=2)
def by_pieces(path: str) -> Tokens:
    """A sentencepiece model, which puts a space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def piece(i: int) -> bytes:
        if model.is_byte(i):
            return bytes([int(model.id_to_piece(i)[3:-1], 16)])
        return model.id_to_piece(i).replace("▁", " ").encode()

    return Tokens.of(lambda text: model.encode(text), [piece(i) for i in range(model.get_piece_size())])


def tokens_of(text: str | None, a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The ids of A and B; none if the text is null or empty, or if the bytes of A's or B's tokens differ from a space and the text."""
    if text:
        both, want = (a.encode(text), b.encode(text)), f" {text}".encode()
        if all(b"".join(map(t.pieces.__getitem__, ids)) == want for t, ids in zip((a, b), both, strict=True)):
            return np.array(both[0], np.int64), np.array(both[1], np.int64)
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


# --- blocks --------------------------------------------------------------------------------------------------------


def pack_ids(ids: np.ndarray, dtype: str) -> bytes:
    """A block's ids, compressed; bytes of the same weight stand together."""
    return zstandard.compress(ids.astype(dtype).view(np.uint8).reshape(len(ids), -1).T.tobytes(), 1)


def unpack_ids(block: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(block), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel().astype(np.int64)


def pack_links(keys: np.ndarray, times: np.ndarray) -> bytes:
    """A document's different links, as A's id * 2**32 + B's id, and how often each occurs."""
    return pack_ids(np.concatenate([keys >> 32, keys & 0xFFFFFFFF, times]), "<u4") if len(keys) else b""


def unpack_links(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b, times = (unpack_ids(block, "<u4") if block else np.zeros(0, np.int64)).reshape(3, -1)
    return a << 32 | b, times


# --- events --------------------------------------------------------------------------------------------------------


def _events(docs: DataFrame, tokenizers: tuple[str, str], id_col: str, text_col: str) -> DataFrame:
    """(key, row, doc_id, offset, side, ids): blocks of end events, A as side 0, B as 1; offset is where the block's first token starts.

    An event's offset follows from the block's ids, so it isn't stored.  key
    depends on a row's id and text alone, so that a task that runs again deals
    rows out alike; row tells repeated rows apart.  A document without tokens has one empty block.
    """
    own = docs.schema[id_col].dataType.simpleString()
    schema = f"key bigint, row bigint, doc_id {own}, offset bigint, side int, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(tokenizers[0]), by_pieces(tokenizers[1])
        for batch in batches:
            at, offsets, sides, blocks, size = [], [], [], [], 0

            def out(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                rows = batch.take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(offsets, pa.int64()), pa.array(sides, pa.int32()), pa.array(blocks, pa.binary())], names=["key", "row", "doc_id", "offset", "side", "ids"])

            narrow = batch.select([0, 1, 2])
            for k, text in enumerate(batch.column(3)):
                for side, tokens, ids in zip((0, 1), (a, b), tokens_of(text.as_py(), a, b), strict=True):
                    starts = np.concatenate([[0], np.cumsum(tokens.widths[ids])])
                    for i in range(0, max(len(ids), 1 - side), BLOCK):
                        at.append(k)
                        offsets.append(int(starts[i]))
                        sides.append(side)
                        blocks.append(pack_ids(ids[i : i + BLOCK], tokens.dtype) if len(ids) else b"")
                        size += len(blocks[-1])
                if size > BATCH_BYTES:
                    yield out(narrow)
                    at, offsets, sides, blocks, size = [], [], [], [], 0
            if at:
                yield out(narrow)

    keyed = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(run, schema)


# --- the sweep -----------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=4)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id below n in decimal, left in rows of bytes, and its number of digits."""
    width = len(str(max(n - 1, 0))) + 1
    rows = np.zeros((n, width), np.uint8)
    texts = np.arange(n).astype(f"S{width}")
    rows[:] = np.frombuffer(texts.tobytes(), np.uint8).reshape(n, width)
    return rows, np.char.str_len(texts)


@dataclass(frozen=True)
class Stretch:
    """A and B tokens from one offset where both end to a later one: ends from the first, and marks and counts by offset."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    mark_a: np.ndarray
    mark_b: np.ndarray

    def links(self) -> np.ndarray:
        """A's id * 2**32 + B's id for each event: the tokens that cover the bytes before it."""
        events = np.flatnonzero(self.mark_a | self.mark_b)
        at_a, at_b = (np.cumsum(m)[events] - m[events] for m in (self.mark_a, self.mark_b))
        return self.a[at_a] << 32 | self.b[at_b]

    def groups_text(self, sizes: tuple[int, int]) -> tuple[int, bytes]:
        """The number of groups, and ``a1,a2|b1;a3|b2,b3;``: the ids of each, A's and then B's."""
        both = self.mark_a & self.mark_b
        common = np.flatnonzero(both)
        before = np.cumsum(both) - both
        group_a, group_b = before[self.ends_a], before[self.ends_b]
        # How many tokens of a side end in the groups before each group.
        ended_a, ended_b = (np.concatenate([[0], np.cumsum(m)[common]]) for m in (self.mark_a, self.mark_b))
        place_a, place_b = np.arange(len(self.a)) + ended_b[group_a], np.arange(len(self.b)) + ended_a[group_b + 1]
        (rows_a, digits_a), (rows_b, digits_b) = _decimals(sizes[0]), _decimals(sizes[1])
        width = max(rows_a.shape[1], rows_b.shape[1])
        rows, digits = np.zeros((len(self.a) + len(self.b), width), np.uint8), np.zeros(len(self.a) + len(self.b), np.int64)
        rows[place_a, : rows_a.shape[1]], digits[place_a] = rows_a[self.a], digits_a[self.a]
        rows[place_b, : rows_b.shape[1]], digits[place_b] = rows_b[self.b], digits_b[self.b]
        mark = np.empty(len(rows), np.uint8)
        mark[place_a] = np.where(both[self.ends_a], ord("|"), ord(","))
        mark[place_b] = np.where(both[self.ends_b], ord(";"), ord(","))
        rows[np.arange(len(rows)), digits] = mark
        return len(common), rows[np.arange(width) <= digits[:, None]].tobytes()


class Sweep:
    """The state machine for one document: tokens after the last offset where both sides ended, and what has been counted.

    So it holds the group that is open, at most a block more of either side,
    and the different links so far.
    """

    def __init__(self, widths: tuple[np.ndarray, np.ndarray], keep_groups: bool = False):
        self.widths, self.n, self.groups, self.links, self.base = widths, [0, 0], 0, 0, 0
        none = np.zeros(0, np.int64)
        self.ids, self.ends = [none, none], [none, none]
        self.sha, self.kept, self.keep_groups = hashlib.sha256(), [], keep_groups
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.open_links = 0

    def add(self, side: int, offset: int, ids: np.ndarray) -> None:
        """The next block of a side."""
        self.n[side] += len(ids)
        ends = offset + np.cumsum(self.widths[side][ids])
        self.ids[side], self.ends[side] = np.concatenate([self.ids[side], ids]), np.concatenate([self.ends[side], ends])
        if len(self.ends[0]) and len(self.ends[1]):
            # Offsets from the last one where both ended, up to where both are known.
            size = int(min(e[-1] for e in self.ends)) - self.base + 1
            near = [e - self.base for e in self.ends]
            marks = [np.zeros(size, bool), np.zeros(size, bool)]
            for mark, e in zip(marks, near, strict=True):
                mark[e[e < size]] = True
            common = np.flatnonzero(marks[0] & marks[1])
            if len(common):
                self._close(int(common[-1]), near, marks)

    def _close(self, last: int, near: list[np.ndarray], marks: list[np.ndarray]) -> None:
        """Groups and links up to the last offset where both sides end; the rest stays open."""
        marks = [m[: last + 1] for m in marks]
        cut = [int(np.count_nonzero(m)) for m in marks]
        stretch = Stretch(*[i[:c] for i, c in zip(self.ids, cut, strict=True)], *[e[:c] for e, c in zip(near, cut, strict=True)], *marks)
        links = stretch.links()
        self._count(*np.unique(links, return_counts=True))
        groups, text = stretch.groups_text((len(self.widths[0]), len(self.widths[1])))
        # The mark after a group is written before the next one.
        self.sha.update((b";" if self.groups else b"") + text[:-1])
        if self.keep_groups:
            self.kept.append(text[:-1].decode())
        self.groups, self.links = self.groups + groups, self.links + len(links)
        self.ids, self.ends = [x[c:] for x, c in zip(self.ids, cut, strict=True)], [x[c:] for x, c in zip(self.ends, cut, strict=True)]
        self.base += last

    def _count(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.pairs.append((keys, times))
        self.open_links += len(keys)
        if self.open_links > OPEN_LINKS:
            self.pairs = [self.counted()]
            self.open_links = 0

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The different links, as A's id * 2**32 + B's id, ascending, and how often each occurs."""
        if len(self.pairs) < 2:
            return self.pairs[0] if self.pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        keys, times = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(times, first)

    def groups_sha256(self) -> str:
        return self.sha.hexdigest() if self.groups else ""


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int32)))


def align_tokens(docs: DataFrame, tokenizers: tuple[str, str], *, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """How the tokens of two tokenizers, a byte-level BPE (A) and a sentencepiece model (B), lie to each other in each document.

    A row for each input row: doc_id, n_a and n_b (tokens), n_groups (the
    least runs of tokens of both that cover the same bytes), n_links (pairs of
    an A and a B token that share bytes), groups_sha256 (of
    ``a1,a2|b1;a3|b2,b3``, ids in order), the different links as link_a, link_b
    (ids) and times (how often); with groups also that text itself.

    Null and empty texts, and texts that either tokenizer doesn't give back
    byte by byte, have no tokens: zeros, no links and '' as groups_sha256.
    Texts of any length are aligned whole.  Repeated rows each give a row; rows
    of the same id and text go to the same task.  Null ids stay null.  An empty
    table gives no rows.  The files are read by each task at the given paths.
    """
    return _align(docs, tokenizers, id_col, text_col, groups, packed=False)


def _align(docs: DataFrame, tokenizers: tuple[str, str], id_col: str, text_col: str, groups: bool, packed: bool) -> DataFrame:
    """align_tokens; packed: with a document's links as one block of pack_links, links, in place of the three arrays."""
    own = docs.schema[id_col].dataType.simpleString()
    schema = f"{TOKENS.format(id=own)}, {'links binary' if packed else 'link_a array<int>, link_b array<int>, times array<int>'}{', groups string' if groups else ''}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = byte_level(tokenizers[0]), by_pieces(tokenizers[1])
        widths = sides[0].widths, sides[1].widths
        done: list[tuple] = []
        key, ident, state, size = None, None, None, 0

        def close() -> None:
            """The document that has been swept becomes a row; what else it took is let go."""
            nonlocal size
            keys, times = state.counted()
            links = [pack_links(keys, times)] if packed else [keys, times]
            size += (len(links[0]) if packed else 12 * len(keys)) + 100
            done.append((ident.as_py(), *state.n, state.groups, state.links, state.groups_sha256(), ";".join(state.kept), *links))

        def out() -> pa.RecordBatch:
            ids, n_a, n_b, n_groups, n_links, hashes, texts, *links = zip(*done, strict=True)
            columns = [
                pa.array(ids, kind),
                *(pa.array(v, pa.int64()) for v in (n_a, n_b, n_groups, n_links)),
                pa.array(hashes),
                *([pa.array(links[0], pa.binary())] if packed else [_lists([k >> 32 for k in links[0]]), _lists([k & 0xFFFFFFFF for k in links[0]]), _lists(links[1])]),
                *([pa.array(texts)] if groups else []),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            kind = batch.schema.field(2).type
            keys, rows, offsets, which = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, block in enumerate(batch.column(5)):
                if (keys[i], rows[i]) != key:
                    if state is not None:
                        close()
                        if size > BATCH_BYTES:
                            yield out()
                            done, size = [], 0
                    key, ident, state = (keys[i], rows[i]), batch.column(2)[i], Sweep(widths, groups)
                if ids := block.as_py():
                    state.add(which[i], offsets[i], unpack_ids(ids, sides[which[i]].dtype))
        if state is not None:
            close()
            yield out()

    events = _events(docs, tokenizers, id_col, text_col)
    return events.repartition("key").sortWithinPartitions("key", "row", "offset", "side").mapInArrow(run, schema)


# --- counts over all documents ---------------------------------------------------------------------------------------


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, documents): in how many documents each pair of ids is linked, by packed links.  Tasks count parts of them first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, documents = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(documents.astype(np.int64))], names=["a", "b", "documents"])

        for batch in batches:
            for block in batch.column(0):
                held.append(unpack_links(block.as_py())[0])
                size += len(held[-1])
                if size > PART_LINKS:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return aligned.select("links").mapInArrow(run, "a int, b int, documents bigint").groupBy("a", "b").agg(F.sum("documents").alias("documents"))


def _write_counts(counts: DataFrame, folder: str) -> None:
    """(pair, documents, best): the pairs as A's id * 2**32 + B's id, their counts and whether these are their A id's highest.

    The files are ranges of A's ids, FILE_PAIRS pairs on average.
    """
    files = max(1, -(-counts.count() // FILE_PAIRS))
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    pair = F.shiftleft(F.col("a").cast("bigint"), 32) + F.col("b")
    table = counts.join(most, "a").select("a", pair.alias("pair"), "documents", (F.col("documents") == F.col("most")).alias("best"))
    table.repartitionByRange(files, "a").sortWithinPartitions("pair").drop("a").write.parquet(folder)


def _files(folder: str) -> list[str]:
    files, path = open_store(folder)
    return sorted(f.path for f in files.get_file_info(pafs.FileSelector(path)) if f.base_name.startswith("part-"))


@functools.lru_cache(maxsize=1)
def _read_counts(folder: str, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of one file, ascending; their counts; whether these are their A id's highest."""
    table = pq.read_table(path, filesystem=open_store(folder)[0], partitioning=None, use_threads=False)
    return tuple(table.column(c).to_numpy() for c in ("pair", "documents", "best"))


@dataclass(frozen=True)
class Held:
    """Some rows without their links, these links' keys, how often each occurs, where each row's links end, and n_best and count_sum so far."""

    rows: pa.RecordBatch
    keys: np.ndarray
    times: np.ndarray
    ends: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, rows: pa.RecordBatch, links: list[tuple[np.ndarray, np.ndarray]]) -> Held:
        keys, times = (np.concatenate(x) for x in zip(*links, strict=True))
        return cls(rows.select(range(6)), keys, times, np.cumsum([0, *(len(k) for k, _ in links)]), np.zeros((2, len(links)), np.int64))

    def add(self, known: np.ndarray, documents: np.ndarray, best: np.ndarray, part: int) -> None:
        """Add up what the known pairs give, for part links at a time, so that little is held beside the links."""
        for low in range(0, len(self.keys) if len(known) else 0, part):
            keys = self.keys[low : low + part]
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            here = np.where(known[at] == keys, self.times[low : low + part], 0)
            cut = np.clip(self.ends, low, low + len(keys)) - low
            for k, value in enumerate((best[at] * here, documents[at] * here)):
                total = np.concatenate([[0], np.cumsum(value, dtype=np.int64)])
                self.sums[k] += total[cut[1:]] - total[cut[:-1]]


def score_links(aligned: DataFrame, counts_folder: str) -> DataFrame:
    """aligned's rows with n_best (links whose pair's count is the highest of its A id) and count_sum (over links).

    A task unpacks PART_LINKS links at a time, or HELD_LINKS where they are looked up in several files, and a document's more.
    """
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    own = aligned.schema["doc_id"].dataType.simpleString()

    def summed(held: list[Held], files: list[str]) -> Iterator[pa.RecordBatch]:
        for path in files:
            known = _read_counts(counts_folder, path)
            for part in held:
                part.add(*known, PART_LINKS)
        for part in held:
            yield pa.RecordBatch.from_arrays([*part.rows.columns, pa.array(part.sums[0]), pa.array(part.sums[1])], names=[*kept, "n_best", "count_sum"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, size = _files(counts_folder), [], 0
        most = PART_LINKS if len(files) < 2 else HELD_LINKS
        for batch in batches:
            start, links = 0, []
            for i, block in enumerate(batch.column(6)):
                links.append(unpack_links(block.as_py()))
                size += len(links[-1][0]) + 1
                if size > most:
                    yield from summed([*held, Held.of(batch.slice(start, i + 1 - start), links)], files)
                    held, size, start, links = [], 0, i + 1, []
            if links:
                held.append(Held.of(batch.slice(start), links))
        yield from summed(held, files)

    return aligned.select(*kept, "links").mapInArrow(run, f"{TOKENS.format(id=own)}, n_best bigint, count_sum bigint")


def alignment_report(docs: DataFrame, tokenizers: tuple[str, str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: align_tokens' numbers, with n_best and count_sum by counts over all documents.

    Odd rows are as in align_tokens; those without tokens have zeros.  The
    documents' links are written to the shared folder once, their counts
    beside them, in files by ranges of A's ids that tasks read (nothing is
    broadcast); both are deleted when the report, which is written too, is done.
    """
    spark = docs.sparkSession
    aligned = materialize(_align(docs, tokenizers, id_col, text_col, groups=False, packed=True), "aligned")
    counts, folder = materialize(pair_counts(aligned), "pair_counts"), shared_path(spark, "pair_table")
    _write_counts(counts, folder)
    out = materialize(score_links(aligned, folder), "alignment")
    remove(aligned, counts)
    remove_path(spark, folder)
    return out
