"""Token alignment against brute force over all token pairs, odd rows, and every way in which its work is cut."""

import bisect
import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quiltgraph.llm import alignment, queries

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    """For a text: the (id, bytes) of each tokenizer by its own library, decoded here."""
    tokenizer, model = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    tokenizer.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

    def of(text):
        a = tokenizer.encode(f" {text}", add_special_tokens=False)
        b = [(i, model.id_to_piece(i)) for i in model.encode(text)]
        return [(i, bytes(byte[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)], [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i, p in b]

    return of


def ranges(tokens):
    at, out = 0, []
    for i, piece in tokens:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def plain(rows, both):
    """rows (id, text) to the report's rows, by comparing every A token with every B token near it."""
    found, count = [], Counter()
    for ident, text in rows:
        a, b = both(text) if text else ([], [])
        want = f" {text}".encode()
        if b"".join(p for _, p in a) != want or b"".join(p for _, p in b) != want:
            found.append((ident, [], [], [], ""))
            continue
        a, b = ranges(a), ranges(b)
        links, j = [], 0
        for i, low, high in a:
            while b[j][2] <= low:
                j += 1
            k = j
            while k < len(b) and b[k][1] < high:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        bins = [([], []) for _ in ends]
        for s, side in enumerate((a, b)):
            for i, _, high in side:
                bins[bisect.bisect_left(ends, high)][s].append(str(i))
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in bins]
        found.append((ident, a, b, links, ";".join(groups)))
        count.update(set(links))
    most: dict = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for ident, a, b, links, groups in found:
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((ident, len(a), len(b), len(groups.split(";")) if groups else 0, len(links), sha, sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links)))
    return sorted(out, key=str)


def report(docs, **options):
    return sorted((tuple(r) for r in alignment.alignment_report(docs, PATHS, **options).collect()), key=str)


def test_small_documents_against_brute_force(spark, tiny, both):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_align(spark, tiny).collect()), key=str)
    assert got == plain(rows, both)
    assert sum(r[4] for r in got) > 100_000


ODD = ["<|endoftext|> <s> </s> <unk> <0x0A>", "▁ sign", "a▁b", "  two  spaces \n\n\t tabs  ", "\x00 nul", "ﬁ é é \U0001f600\U0001f468‍\U0001f469", "=" * 3000, "ab" * 5000, "漢字かな交じり文" * 40, " ", "\n", "x"]


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 3, "OPEN_LINKS": 5}, {"BLOCK": 7, "BATCH_BYTES": 50, "FILE_PAIRS": 500, "HELD_LINKS": 100}])
def test_odd_rows_and_cut_work(spark, odd, odd_rows, both, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    more = [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = odd.select("doc_id", "text", "n", "k1", "start").unionByName(spark.createDataFrame([(*r, "clash", "clash", "clash") for r in more], "doc_id bigint, text string, n string, k1 string, start string"))
    assert report(docs) == plain([(r[0], r[1]) for r in odd_rows] + more, both)


def test_a_long_text_without_spaces_and_one_of_prose(spark, both):
    rows = [(1, "aé漢" * 60_000), (2, " ".join(f"word{i * 7 % 1000}" for i in range(150_000)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert report(docs) == plain(rows, both)


def test_groups_and_links_are_given(spark, both):
    docs = spark.createDataFrame([("x", "Unbelievable tokenization!"), ("y", None)], "name string, body string")
    got = {r["doc_id"]: r for r in alignment.align_tokens(docs, PATHS, id_col="name", text_col="body", groups=True).collect()}
    assert hashlib.sha256(got["x"]["groups"].encode()).hexdigest() == got["x"]["groups_sha256"]
    a, b = both("Unbelievable tokenization!")
    assert [x for g in got["x"]["groups"].split(";") for x in g.split("|")[0].split(",")] == [str(i) for i, _ in a]
    assert [x for g in got["x"]["groups"].split(";") for x in g.split("|")[1].split(",")] == [str(i) for i, _ in b]
    assert sum(got["x"]["times"]) == got["x"]["n_links"] and got["y"]["groups"] == "" and got["y"]["link_a"] == []


def test_empty_table(none):
    assert report(none) == []


def test_blocks_round_trip():
    for dtype, top in (("<u2", 1 << 16), ("<u4", 1 << 32)):
        ids = np.random.default_rng(1).integers(0, top, 1000)
        assert (alignment.unpack_ids(alignment.pack_ids(ids, dtype), dtype) == ids).all()


def test_counting_and_scoring_hold_little_of_a_batch(spark, tmp_path, monkeypatch):
    """4 million links come to a task as one batch; its arrays stay far below their 64 MB."""
    n, rng = 10_000, np.random.default_rng(2)
    pairs = np.arange(50).repeat(40) << 32 | np.tile(np.arange(40), 50)
    links = [(np.sort(rng.choice(pairs, 400, replace=False)), rng.integers(1, 9, 400)) for _ in range(n)]
    keys, times = (np.concatenate(x) for x in zip(*links, strict=True))
    count = np.unique(keys, return_counts=True)[1]
    best = count == count.reshape(50, 40).max(axis=1).repeat(40)
    alignment._write_counts(spark.createDataFrame([(int(k >> 32), int(k & 0xFFFFFFFF), int(c)) for k, c in zip(pairs, count, strict=True)], "a int, b int, documents bigint"), f"file://{tmp_path}/counts")

    tasks = []
    aligned = spark.createDataFrame([], f"{alignment.TOKENS.format(id='bigint')}, links binary")
    monkeypatch.setattr(type(aligned), "mapInArrow", lambda self, run, schema: tasks.append(run) or spark.createDataFrame([], schema))
    alignment.pair_counts(aligned)
    alignment.score_links(aligned, f"file://{tmp_path}/counts")
    blocks = pa.array([alignment.pack_links(*x) for x in links], pa.binary())
    whole = pa.RecordBatch.from_arrays([*[pa.array(np.arange(n))] * 5, pa.array([""] * n), blocks], names=[*aligned.columns])
    found = []
    for task, batch in zip(tasks, (pa.RecordBatch.from_arrays([blocks], names=["links"]), whole), strict=True):
        tracemalloc.start()
        found.append(pa.Table.from_batches(task(iter([batch]))))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40 << 20

    counted = Counter()
    for r in found[0].to_pylist():
        counted[r["a"] << 32 | r["b"]] += r["documents"]
    assert counted == dict(zip(pairs.tolist(), count.tolist(), strict=True))
    at = np.searchsorted(pairs, keys)
    for name, value in (("n_best", best[at] * times), ("count_sum", count[at] * times)):
        assert found[1].column(name).to_pylist() == value.reshape(n, 400).sum(axis=1).tolist()
