"""Media columns: signature sniffing.

An Aho-Corasick automaton locates magic bytes; a validator for each format
then confirms structure and lengths.  What is confirmed corrects the declared
type and lets embedded media be carved out."""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import utf8

#: Bytes of a row of samples: 64 pixels of three channels.
ROW = 192
#: Bytes of texts or media that a task handles at once (or one longer value).
SLICE_BYTES = 8 << 20
#: Magic bytes by format.
MAGIC = (
    ("png", b"\x89PNG\r\n\x1a\n"),
    ("jpeg", b"\xff\xd8\xff"),
    ("gif", b"GIF87a"),
    ("gif", b"GIF89a"),
    ("bmp", b"BM"),
    ("riff", b"RIFF"),
    ("au", b".snd"),
    ("pnm", b"P5"),
    ("pnm", b"P6"),
    ("ogg", b"OggS"),
    ("gzip", b"\x1f\x8b\x08"),
)
#: Formats that store_media() writes.
STORED = ("audio/wav", "image/png", "image/bmp", "image/x-portable-pixmap", "audio/basic")


# Writers: payloads are positive multiples of ROW.


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW or (0 if text else ROW))


def _wav(samples: bytes) -> bytes:
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + 8 + len(samples), b"WAVE") + head + struct.pack("<4sI", b"data", len(samples)) + samples


def _png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _png(samples: bytes) -> bytes:
    rows = len(samples) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)  # the first byte of a line: no filter
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(rows, ROW)
    return MAGIC[0][1] + _png_chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, rows, 8, 2, 0, 0, 0)) + _png_chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _png_chunk(b"IEND", b"")


def _bmp(samples: bytes) -> bytes:
    return struct.pack("<2sIHHI", b"BM", 54 + len(samples), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, ROW // 3, -(len(samples) // ROW), 1, 24, 0, len(samples), 2835, 2835, 0, 0) + samples


def _ppm(samples: bytes) -> bytes:
    return b"P6\n%d %d\n255\n" % (ROW // 3, len(samples) // ROW) + samples


def _au(samples: bytes) -> bytes:
    return struct.pack(">4s5I", b".snd", 24, len(samples), 2, 8000, 1) + samples


_WRITERS = dict(zip(STORED, (_wav, _png, _bmp, _ppm, _au), strict=True))


# Validators: (type, length) of the medium that starts at ``at``, or None.


def _check_png(d: bytes, at: int):
    p, first = at + 8, True
    while p + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, p)
        if p + 12 + n > len(d) or (first and (kind != b"IHDR" or n != 13)) or zlib.crc32(memoryview(d)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return "image/png", p - at
    return None


def _check_jpeg(d: bytes, at: int):
    p, frame = at + 2, False
    while p + 4 <= len(d) and d[p] == 0xFF:
        kind, n = d[p + 1], struct.unpack_from(">H", d, p + 2)[0]
        if kind == 0xFF:
            p += 1
            continue
        if kind < 0xC0 or 0xD0 <= kind <= 0xD9 or n < 2:
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:  # coded data, in which FF is followed by 00 or a restart
            m = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S).search(d, p)
            if m is None or not frame:
                return None
            p = m.start()
            if d[p + 1] == 0xD9:
                return "image/jpeg", p + 2 - at
    return None


def _check_gif(d: bytes, at: int):
    if at + 13 > len(d):
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    p, images = at + 13 + table(d[at + 10]), 0
    while p < len(d):
        if d[p] == 0x3B:
            return ("image/gif", p + 1 - at) if images else None
        if d[p] == 0x2C and p + 11 <= len(d):
            p, images = p + 11 + table(d[p + 9]), images + 1
        elif d[p] == 0x21:
            p += 2
        else:
            return None
        while p < len(d) and d[p]:
            p += 1 + d[p]
        p += 1
    return None


def _check_bmp(d: bytes, at: int):
    if at + 54 > len(d):
        return None
    size, r1, r2, start, head, width, height, planes, bits = struct.unpack_from("<IHHIIiiHH", d, at + 2)
    if r1 or r2 or head not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or at + size > len(d) or start < 14 + head:
        return None
    compressed = struct.unpack_from("<I", d, at + 30)[0]
    return ("image/bmp", size) if compressed or start + (width * bits + 31) // 32 * 4 * abs(height) <= size else None


def _check_riff(d: bytes, at: int):
    if at + 12 > len(d):
        return None
    size, form = struct.unpack_from("<I4s", d, at + 4)
    end = at + 8 + size
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(form)
    if kind is None or end > len(d):
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", d, p)
        seen.add(name)
        p += 8 + n + n % 2
    return (kind, 8 + size) if p in (end, end + 1) and (form != b"WAVE" or {b"fmt ", b"data"} <= seen) else None


def _check_au(d: bytes, at: int):
    if at + 24 > len(d):
        return None
    start, n, coding, rate, channels = struct.unpack_from(">5I", d, at + 4)
    return ("audio/basic", start + n) if start >= 24 and 1 <= coding <= 27 and rate and 1 <= channels <= 64 and at + start + n <= len(d) else None


_PNM = re.compile(rb"P([56])\s(?:#[^\n]*\n|\s)*(\d{1,9})\s+(\d{1,9})\s+(\d{1,5})\s")


def _check_pnm(d: bytes, at: int):
    m = _PNM.match(d, at)
    if m is None or not 0 < int(m[4]) < 65536:
        return None
    n = int(m[2]) * int(m[3]) * (3 if m[1] == b"6" else 1) * (1 if int(m[4]) < 256 else 2)
    if not n or m.end() + n > len(d):
        return None
    return "image/x-portable-pixmap" if m[1] == b"6" else "image/x-portable-graymap", m.end() + n - at


def _check_ogg(d: bytes, at: int):
    p = at
    while p + 27 <= len(d) and d[p : p + 5] == b"OggS\x00":
        laces = d[p + 26]
        end = p + 27 + laces + sum(d[p + 27 : p + 27 + laces])
        if end > len(d):
            return None
        p = end
    return ("audio/ogg", p - at) if p > at and d[at + 5] & 2 else None


def _check_gzip(d: bytes, at: int):
    z = zlib.decompressobj(31)
    try:
        piece = d[at:]
        while piece and not z.eof:  # bounded output: only the structure is wanted
            z.decompress(piece, 1 << 20)
            piece = z.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", len(d) - at - len(z.unused_data)) if z.eof else None


_CHECKS = {"png": _check_png, "jpeg": _check_jpeg, "gif": _check_gif, "bmp": _check_bmp, "riff": _check_riff, "au": _check_au, "pnm": _check_pnm, "ogg": _check_ogg, "gzip": _check_gzip}


@functools.cache
def _magic() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, magic in MAGIC:
        automaton.add_word(magic.decode("latin-1"), (kind, len(magic)))
    automaton.make_automaton()
    return automaton


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of all confirmed media, by offset; one that starts at 0 is the value itself."""
    found = []
    for end, (kind, n) in _magic().iter(data.decode("latin-1")):
        at = end + 1 - n
        if ok := _CHECKS[kind](data, at):
            found.append((at, ok[1], ok[0]))
    return sorted(found)


# Readers.


def samples_of(data: bytes, kind: str) -> bytes | None:
    """The 8-bit samples of a medium as store_media() writes them; None for others."""
    if kind == "audio/wav":
        p = 12
        while p + 8 <= len(data):
            name, n = struct.unpack_from("<4sI", data, p)
            if name == b"data":
                return data[p + 8 : p + 8 + n]
            p += 8 + n + n % 2
    elif kind == "image/bmp":
        return data[struct.unpack_from("<I", data, 10)[0] :]
    elif kind == "audio/basic":
        start, n = struct.unpack_from(">2I", data, 4)
        return data[start : start + n]
    elif kind == "image/x-portable-pixmap":
        return data[_PNM.match(data).end() :]
    elif kind == "image/png":
        p, parts, width, rows, coding = 8, [], 0, 0, b""
        while p + 12 <= len(data):
            n, name = struct.unpack_from(">I4s", data, p)
            if name == b"IHDR":
                width, rows, coding = *struct.unpack_from(">II", data, p + 8), data[p + 16 : p + 21]
            elif name == b"IDAT":
                parts.append(data[p + 8 : p + 8 + n])
            p += 12 + n
        if coding == b"\x08\x02\x00\x00\x00":
            lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(rows, 3 * width + 1)
            return None if lines[:, 0].any() else lines[:, 1:].tobytes()
    return None


def feature_of(kind: str, samples: bytes | None) -> str:
    """Type, sample count, mean, deviation and entropy in bits, as text."""
    if not samples:
        return f"type={kind};n=0"
    count = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, value, p = len(samples), np.arange(256), count[count > 0] / len(samples)
    mean = float(count @ value) / n
    return f"type={kind};n={n};mean={mean:.4f};std={(float(count @ (value * value)) / n - mean * mean) ** 0.5:.4f};bits={-float(p @ np.log2(p)):.4f}"


# Operators.


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most SLICE_BYTES in the column, or one row."""
    sizes = [len(x) if x else 0 for x in batch.column(column).cast(pa.binary()).to_pylist()]
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > SLICE_BYTES:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def store_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as media: doc_id, n_bytes, declared_type, media.

    The UTF-8 bytes (null: none), padded with spaces to a positive multiple of
    ROW, become the 8-bit samples of a WAV, PNG, BMP, PPM or AU file.  The
    content alone decides the format, so equal texts give equal media.  As in
    collections at large, the declared type is often wrong: it is right for
    about half of the values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                texts = utf8(batch.column(1))
                marks = [zlib.crc32(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([STORED[(m + m // 7 % 2) % 5] for m in marks], pa.string()), pa.array([_WRITERS[STORED[m % 5]](pad(t)) for m, t in zip(marks, texts, strict=True)], pa.binary())],
                    names=["doc_id", "n_bytes", "declared_type", "media"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, declared_type string, media binary")


def sniff_media(rows: DataFrame, *, media_col: str = "media", declared_col: str = "declared_type") -> DataFrame:
    """Sniff a binary column, correct declared types, read samples and carve.

    Returns all columns of rows that have other names, and detected_type
    (null: nothing confirmed), corrected (the declared type is another),
    carved (offset, length and type of all confirmed media, embedded ones
    too), samples (null if the format isn't one that store_media writes) and
    feature.  A null value has nothing in it.
    """
    new = ["detected_type", "corrected", "carved", "samples", "feature"]
    kept = [c for c in rows.columns if c not in new]
    at, declared = kept.index(media_col), kept.index(declared_col)
    carved = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, at):
                media = [x or b"" for x in batch.column(at).to_pylist()]
                found = [sniff(m) for m in media]
                kinds = [next((k for a, _, k in f if a == 0), None) for f in found]
                samples = [samples_of(m, k) if k else None for m, k in zip(media, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(kinds, pa.string()), pa.array([k is not None and k != d for k, d in zip(kinds, batch.column(declared).to_pylist(), strict=True)], pa.bool_()), pa.array([[{"offset": a, "length": n, "type": k} for a, n, k in f] for f in found], carved), pa.array(samples, pa.binary()), pa.array(map(feature_of, (k or "none" for k in kinds), samples), pa.string())],
                    names=[*kept, *new],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[f"`{c}`" for c in kept]).schema)
    return rows.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{schema}, detected_type string, corrected boolean, carved array<struct<offset:bigint,length:bigint,type:string>>, samples binary, feature string")


def carve(sniffed: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each embedded medium (those that don't start at 0): its id, place (offset, length), type and bytes (media).

    Rows without embedded media, of null or empty media too, give none;
    repeated rows give theirs each; null ids stay; an empty table gives no
    rows.  Other columns are not read, whatever their names.
    """
    part = sniffed.select(F.col(id_col).alias("_id"), F.col(media_col).alias("_m"), F.explode("carved").alias("_c")).where("_c.offset > 0")
    return part.select(F.col("_id").alias(id_col), "_c.offset", "_c.length", "_c.type", F.expr("substring(_m, cast(_c.offset + 1 as int), cast(_c.length as int))").alias("media"))


def digest(sniffed: DataFrame) -> DataFrame:
    """The report columns: all of the payload's come from the samples that were read back."""
    return sniffed.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("bigint").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "detected_type",
        "corrected",
        F.size("carved").alias("n_media"),
    )
