"""Sequence packing balanced by cost.

The cost of a piece of n tokens is linear plus quadratic (attention) in n.
Descending documents go to the lowest-cost sequence that has token capacity
left for them; documents are cut only where nothing can hold them whole."""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import utf8

CAPACITY = 2048
#: Cost of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens that are packed together: a task holds no more than these, a batch and a document.
WINDOW_TOKENS = 1 << 20
END_ID = 1
SCHEMA = "doc_id {id}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint, ids binary"


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def load_encoder(path: str) -> Callable[[str], list[int]]:
    """A function from text to ids by the tokenizers file at path.

    A byte-level BPE whose ids follow its merges is run by tiktoken, which
    makes the same ids several times faster; texts that hold a special token's
    string, or that it fails on, and other tokenizers go through tokenizers.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    slow = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    fast = _byte_bpe(spec)
    if fast is None:
        return slow
    special = tuple(t["content"] for t in spec.get("added_tokens", ()))

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return slow(text)
        try:
            return fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # a Rust panic is not an Exception
            return slow(text)

    return encode


def _byte_bpe(spec: dict):
    """A tiktoken encoding for the file's model, or None if it isn't one that tiktoken can run alike."""
    import tiktoken

    model, before = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
        return None
    special = {t["content"] for t in spec.get("added_tokens", ())}
    byte = _byte_characters()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    if made != sorted(set(made)) or (made and made[0] < 256):
        return None
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    #: Fixed value: the pattern of byte-level pre-tokenizers.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class Sequences:
    """Open sequences, by what they can still hold: for each room a heap by cost."""

    def __init__(self, rooms: list[int]):
        self.size = max(rooms, default=0)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size + 1)]
        self.least = np.full(self.size + 1, np.inf)
        self.used = [0] * len(rooms)
        for k, room in enumerate(rooms):
            self._put(room, 0.0, k)

    def _put(self, room: int, so_far: float, k: int) -> None:
        heapq.heappush(self.heaps[room], (so_far, k))
        self.least[room] = self.heaps[room][0][0]

    def place(self, n: int) -> list[tuple[int, int, int]]:
        """(sequence, offset there, tokens) of the pieces of n tokens: one, in the
        lowest-cost sequence with room for it, or else the lowest-cost ones with any room."""
        pieces = []
        while n:
            room = n + int(self.least[n:].argmin()) if n <= self.size else self.size + 1
            if room > self.size or self.least[room] == np.inf:
                room = 1 + int(self.least[1:].argmin()) if self.size else 0
                if not room or self.least[room] == np.inf:
                    break  # all is full; what is left waits for the next window
            so_far, k = heapq.heappop(self.heaps[room])
            self.least[room] = self.heaps[room][0][0] if self.heaps[room] else np.inf
            take = min(n, room)
            pieces.append((k, self.used[k], take))
            self.used[k] += take
            if room > take:
                self._put(room - take, so_far + cost(take), k)
            n -= take
        return pieces


def powers(n: int) -> list[int]:
    """Powers of two, largest first, that make n."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_window(lengths: list[int], capacity: int, last: bool) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[int]]:
    """Pack documents of these lengths.

    Returns pieces (document, start, length, sequence, offset), the sequences'
    tokens, and for each document how many of its tokens are packed.  Every
    sequence is full.  If there is a last window, what doesn't fill a sequence
    makes shorter ones of a power of two each, which need no padding; else it
    is left for the next window.
    """
    total = sum(lengths)
    rooms = [capacity] * (total // capacity) + (powers(total % capacity) if last else [])
    pieces, done = [], [0] * len(lengths)
    open_ = Sequences(rooms)
    for d in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        for k, offset, n in open_.place(lengths[d]):
            pieces.append((d, done[d], n, k, offset))
            done[d] += n
    return pieces, rooms, done


def pack_sequences(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, window_tokens: int = WINDOW_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole texts, end each with ``end_id`` and pack all ids into sequences of ``capacity``.

    Returns a row for each piece: doc_id, start (ids of its document before
    it), length, doc_tokens, sequence_id, offset (in the sequence, gapless
    from 0), sequence_tokens, ids (little-endian unsigned 32-bit).  Each id is
    in one piece.  All sequences hold ``capacity`` ids but for the last few of
    a partition, whose lengths are powers of two.  A null or empty text is the
    end id alone; repeated rows are packed each; row order within equal
    lengths decides ties.

    A task packs its own rows, window by window, so nothing is shuffled and
    memory is bounded by the window and the longest document.  ``tokenizer``
    is the path of a tokenizers JSON file that all executors have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        #: Waiting documents: (id, ids not yet packed, how many before them).
        waiting: list[tuple[object, np.ndarray, int]] = []
        held = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal waiting, held, sequence
            out, cut = [], []
            for doc, ids, before in waiting:  # what fills sequences alone; the rest is packed
                n = before + len(ids)
                for at in range(0, len(ids) - capacity + 1, capacity):
                    out.append((doc, before + at, n, sequence, 0, capacity, ids[at : at + capacity]))
                    sequence += 1
                if left := len(ids) % capacity:
                    cut.append((doc, ids[len(ids) - left :], n - left))
            pieces, rooms, done = pack_window([len(ids) for _, ids, _ in cut], capacity, last)
            for d, start, n, k, offset in pieces:
                doc, ids, before = cut[d]
                out.append((doc, before + start, before + len(ids), sequence + k, offset, rooms[k], ids[start : start + n]))
            sequence += len(rooms)
            waiting = [(doc, ids[k:], before + k) for (doc, ids, before), k in zip(cut, done, strict=True) if k < len(ids)]
            held = sum(len(ids) for _, ids, _ in waiting)
            columns = list(zip(*out, strict=True)) or [()] * 7
            long = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), long(columns[1]), long([len(i) for i in columns[6]]), long(columns[2]), long(columns[3]), long(columns[4]), long(columns[5]), pa.array([i.tobytes() for i in columns[6]], pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids"],
            )

        kind: pa.DataType = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids = np.array([*encode(text.decode()), end_id], dtype="<u4")
                waiting.append((doc, ids, 0))
                held += len(ids)
                if held >= window_tokens:
                    yield flush(False)
        if waiting:
            yield flush(True)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, SCHEMA.format(id=docs.schema[id_col].dataType.simpleString()))


def digest(pieces: DataFrame) -> DataFrame:
    """The report columns."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")
