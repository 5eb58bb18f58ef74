"""License scan by conditional compression.

Candidate blocks are the surroundings of cue words.  They are taken as words
alone, so line ends, comment marks and punctuation don't matter, and compressed
with each license template as a zstandard raw dictionary.  Templates are ranked
by how much smaller the block gets than without, and all that save enough are
confirmed by the exact differences in wording."""

from __future__ import annotations

import bisect
import functools
import re
from collections import OrderedDict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import LOWER, utf8

#: License notices as they are published, by SPDX-like name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
)
#: A block is a candidate if one of these stands in it.
CUE = re.compile(rb"licen[cs]e|copyright|copyleft|spdx|all rights reserved|permission|warrant|redistribut|public domain|creative commons|waived", re.I)
#: Templates of up to SHORT bytes are looked for in blocks of their own, so that
#: a long block doesn't hide what they save; a block reaches REACH times its longest template from a cue.
SHORT, REACH = 120, 1.5
#: A longer stretch is divided into candidates of so many reaches, each beginning a reach before the last one's end:
#: a notice lies whole in one of them, and what a template saves isn't lost amid much else.
WINDOW_REACHES = 4
#: A template is tried if it saves this part of what it would save of itself,
#: and confirmed if at most this part of its words is missing or changed.
LEAST_SAVED, MOST_CHANGED = 0.2, 0.15
#: Different blocks whose result a task remembers, as notices repeat.
REMEMBERED = 20_000
_WORD = re.compile(rb"[a-z0-9_\x80-\xff]+(?:\.[a-z0-9_\x80-\xff]+)*")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.translate(LOWER))


def blocks(text: bytes, reach: int) -> list[tuple[int, int]]:
    """[start, end) of the stretches of whole words within ``reach`` bytes of a cue, anywhere in the text."""
    out: list[tuple[int, int]] = []
    for m in CUE.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    space = re.compile(rb"\s")
    whole = []
    for a, b in out:  # to the next white space, unless that is far
        left = max(text.rfind(c, max(0, a - 200), a) for c in (b" ", b"\n", b"\t")) + 1 if a else 0
        right = space.search(text, b, b + 200)
        whole.append((left or a, right.start() if right else b))
    return whole


def candidates(text: bytes, reach: int) -> Iterator[tuple[int, int]]:
    """The blocks, those longer than WINDOW_REACHES reaches in overlapping windows of that size."""
    size = WINDOW_REACHES * reach
    for a, b in blocks(text, reach):
        while b - a > size:
            yield a, a + size
            a += size - reach
        yield a, b


def disjoint(found: list, start: Callable, end: Callable) -> list:
    """Those of found that don't overlap an earlier one that is kept, by place."""
    starts, kept = [], []
    for x in found:
        i = bisect.bisect_right(starts, start(x))
        if (i == 0 or end(kept[i - 1]) <= start(x)) and (i == len(kept) or end(x) <= starts[i]):
            starts.insert(i, start(x))
            kept.insert(i, x)
    return kept


@functools.lru_cache(maxsize=4)
def _prepared(templates: tuple[tuple[str, str], ...]) -> tuple[zstandard.ZstdCompressor, list[tuple[list[bytes], zstandard.ZstdCompressor, int]]]:
    """A compressor without a dictionary; of each template its words, its compressor and what it saves of itself."""
    options = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    plain, out = zstandard.ZstdCompressor(**options), []
    for _, text in templates:
        words = words_of(text.encode())
        own = b" ".join(words)
        given = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options)
        out.append((words, given, len(plain.compress(own)) - len(given.compress(own))))
    return plain, out


def rank(block: bytes, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[float, int]]:
    """(bytes saved, as part of what it saves of itself; template) of all templates, best first; ties by their order."""
    plain, given = _prepared(templates)
    size = len(plain.compress(block))
    return sorted((((size - len(c.compress(block))) / max(1, own), k) for k, (_, c, own) in enumerate(given)), key=lambda x: (-x[0], x[1]))


def wording(words: list[bytes], template: list[bytes]) -> tuple[int, int, int, list[str]]:
    """Where in the words the template's are, as [first, last), how many of them are missing or changed, and the changes.

    Words before the first and after the last that agree are context.
    """
    codes = SequenceMatcher(None, template, words, autojunk=False).get_opcodes()
    equal = [k for k, c in enumerate(codes) if c[0] == "equal"]
    if not equal:
        return 0, 0, len(template), []
    missing, changes = 0, []
    text = lambda some: b" ".join(some).decode(errors="replace")
    for k, (tag, a1, a2, b1, b2) in enumerate(codes):
        inner = equal[0] < k < equal[-1]
        if tag == "equal" or (a1 == a2 and not inner):
            continue
        missing += max(a2 - a1, b2 - b1 if inner else 0)
        changes.append(f"{text(template[a1:a2])}>{text(words[b1:b2]) if inner else ''}")
    return codes[equal[0]][3], codes[equal[-1]][4], missing, changes


def occurrences(words: list[bytes], template: list[bytes]) -> list[tuple[int, int, int, list[str]]]:
    """All disjoint confirmed places of the template, in order: the best first, then what is left of it and right of it."""
    n, found, todo = len(template), [], [(0, len(words))]
    while todo:
        start, stop = todo.pop()
        if stop - start < n * (1 - MOST_CHANGED):
            continue
        m = SequenceMatcher(None, template, words[start:stop], autojunk=False).find_longest_match()
        if not m.size:
            continue
        lo, hi = max(start, start + m.b - m.a - n // 4), min(stop, start + m.b - m.a + n + n // 4 + 1)
        first, last, missing, changes = wording(words[lo:hi], template)
        if missing > MOST_CHANGED * n:
            # The longest match is no notice; the rest may still hold one.
            todo += [(start, start + m.b), (start + m.b + m.size, stop)]
        else:
            found.append((lo + first, lo + last, missing, changes))
            todo += [(start, lo + first), (lo + last, stop)]
    return sorted(found, key=lambda x: x[0])


def judge(block: bytes, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[dict]:
    """The confirmed notices of a block, disjoint and in order.

    Of notices that overlap that with most of its template's words stays,
    then that with the fewest changes, then the earlier template.
    """
    places = list(_WORD.finditer(block.translate(LOWER)))
    words = [m[0] for m in places]
    given, found = _prepared(templates)[1], []
    for saved, k in rank(b" ".join(words), templates):
        if saved < LEAST_SAVED:
            break
        n = len(given[k][0])
        found += [(missing - n, missing, k, first, last, saved, changes) for first, last, missing, changes in occurrences(words, given[k][0])]
    kept = disjoint(sorted(found, key=lambda x: x[:4]), lambda x: x[3], lambda x: x[4])
    return [
        {"start": places[first].start(), "end": places[last - 1].end(), "license": templates[k][0], "template": k, "saved": round(saved, 4), "changed": missing, "changes": changes}
        for _, missing, k, first, last, saved, changes in kept
    ]


class _Memory:
    """judge(), remembering the blocks seen last."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.templates, self.known = templates, OrderedDict()

    def __call__(self, block: bytes) -> list[dict]:
        if block in self.known:
            self.known.move_to_end(block)
            return self.known[block]
        found = self.known[block] = judge(block, self.templates)
        if len(self.known) > REMEMBERED:
            self.known.popitem(last=False)
        return found


NOTICE = "struct<start:bigint,end:bigint,license:string,template:int,saved:double,changed:int,changes:array<string>>"


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Find license notices in whole texts, wrapped, in comments or amid other text.

    Returns for each input row: doc_id, n_blocks (candidates), notices (byte
    range, license, template number, bytes saved as part of what the template
    saves of itself, words changed and the changes; disjoint and in order),
    licenses (distinct names, sorted).  All templates that save enough are
    compared (see judge for ties).  Texts of any length are scanned whole, in
    candidates of bounded size, so time grows with their length.  Null and empty texts have no blocks;
    repeated rows get equal results; extra columns are not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("saved", pa.float64()), ("changed", pa.int32()), ("changes", pa.list_(pa.string()))]))
    order = {t: k for k, t in reversed(list(enumerate(templates)))}
    scales = [s for s in (tuple(t for t in templates if len(t[1].encode()) <= SHORT), tuple(t for t in templates if len(t[1].encode()) > SHORT)) if s]

    def notices(text: bytes, memories: list[_Memory]) -> tuple[int, list[dict]]:
        n, found = 0, []
        for memory in memories:
            reach = int(REACH * max(len(t.encode()) for _, t in memory.templates))
            for a, b in candidates(text, reach):
                n += 1
                found += [x | {"start": x["start"] + a, "end": x["end"] + a, "template": order[memory.templates[x["template"]]]} for x in memory(text[a:b])]
        # Of overlapping ones, of both scales or of windows that overlap, the longer stays.
        longest = sorted(found, key=lambda x: (x["start"] - x["end"], x["changed"], x["start"], x["template"]))
        return n, disjoint(longest, lambda x: x["start"], lambda x: x["end"])

    def run(batches):
        memories = [_Memory(scale) for scale in scales]
        for batch in batches:
            counts, found = zip(*(notices(t, memories) for t in utf8(batch.column(1))), strict=True) if batch.num_rows else ([], [])
            names = [sorted({n["license"] for n in f}) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "n_blocks", "notices", "licenses"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_blocks bigint, notices array<{NOTICE}>, licenses array<string>")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: its licenses, where they are and how exact the wording is."""
    return found.select(
        "doc_id",
        "n_blocks",
        F.size("notices").cast("bigint").alias("n_notices"),
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join(F.transform("notices", lambda n: F.concat(n["license"], F.lit("@"), n["start"], F.lit("-"), n["end"], F.lit("~"), n["changed"])), ";").alias("notices"),
    )
