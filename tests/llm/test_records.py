"""Packing, sharding and WARC: whole results against plain versions."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quiltgraph.llm import packing, queries, sharding, warc
from quiltgraph.operators import ranking


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def check_pieces(pieces, ids_of, capacity=packing.CAPACITY):
    """Every id in one piece, sequences gapless, full or a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc, own in by_doc.items():
        copies = ids_of[doc]
        n = len(copies[0])
        counts = Counter()
        for p in own:
            assert p["doc_tokens"] == n
            part = np.array(copies[0][p["start"] : p["start"] + p["length"]], "<u4")
            assert len(part) == p["length"] > 0
            assert zlib.crc32(part.tobytes()) == p["ids_crc32"]
            counts.update(range(p["start"], p["start"] + p["length"]))
        assert counts == Counter({i: len(copies) for i in range(n)})
    assert by_doc.keys() == ids_of.keys()
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == own[0]["sequence_tokens"] == capacity or at < capacity and at & (at - 1) == 0


def test_packing_is_whole(spark, small, texts, tokenizer):
    ids = {d: [[*e.ids, 1]] for d, e in zip(texts, tokenizer.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    check_pieces(queries.op2_pack(spark, small).collect(), ids)


def test_packing_of_odd_rows(spark, odd, odd_rows, none, tokenizer):
    path = queries.tokenizer_path()
    ids = {}
    for r in odd_rows:
        if r[0] is not None:
            ids.setdefault(r[0], []).append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])
    check_pieces(packing.digest(packing.pack_sequences(odd.where("doc_id is not null"), path)).collect(), ids)
    check_pieces(packing.digest(packing.pack_sequences(odd.where("doc_id is not null"), path, window_tokens=3000)).collect(), ids)
    check_pieces(packing.digest(packing.pack_sequences(odd.where("doc_id is not null"), path, capacity=64)).collect(), ids, 64)
    assert packing.pack_sequences(odd, path).where("doc_id is null").count() >= 2
    assert packing.pack_sequences(none, path).count() == 0


def test_special_strings_are_as_the_tokenizer_has_them(tokenizer):
    encode = packing.load_encoder(queries.tokenizer_path())
    for text in ("a<|endoftext|>b", " " * 5000 + "x", "it's 12 o'clock\n\n\n  é漢\U0001f600", "x" * 3000, "\u2028\u00a0 \t"):
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1200, 2000).tolist()
    pieces, rooms, done = packing.pack_window(lengths, 2048, True)
    assert done == lengths and sum(rooms) == sum(lengths)
    cost = Counter()
    for _, _, n, k, _ in pieces:
        cost[k] += packing.cost(n)
    full = [cost[k] for k, room in enumerate(rooms) if room == 2048]
    in_order, at = Counter(), 0
    for n in lengths:  # filled one after the other
        while n:
            take = min(n, 2048 - at % 2048)
            in_order[at // 2048] += packing.cost(take)
            at, n = at + take, n - take
    plain = list(in_order.values())[:-1]
    assert np.std(full) < np.std(plain)
    assert len(pieces) - len(lengths) <= len(rooms)


def test_places_follow_the_rule():
    """Lowest cost among sequences that can hold the document, by a plain search."""
    rooms = [50, 50, 40, 16]
    open_, plain = packing.Sequences(rooms), [[r, 0.0] for r in rooms]
    for n in (30, 25, 20, 12, 10, 10, 8, 5, 5, 4, 3):
        fits = [(c, k) for k, (r, c) in enumerate(plain) if r >= n]
        want = min(((c, plain[k][0], k) for c, k in fits), default=None)
        (k, _, take), *rest = open_.place(n)
        if want:
            assert (take, rest) == (n, []) and plain[k][1] == want[0]
        for k, take in [(k, take), *((a, c) for a, _, c in rest)]:
            plain[k][0] -= take
            plain[k][1] += packing.cost(take)
        assert all(r >= 0 for r, _ in plain)


def check_shards(rows, n):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sum(map(len, by.values())) == n
    sizes = [len(by[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_shards(spark, small, texts, odd, odd_rows, none):
    got = queries.op5_shard(spark, small).collect()
    check_shards(got, len(texts))
    for r in got:
        text = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
    whole, by = Counter(r["source"] for r in got), defaultdict(Counter)
    for r in got:
        by[r["shard"]][r["source"]] += 1
    for shard in by.values():  # the mixture, to a row or two
        for source, n in whole.items():
            assert abs(shard[source] - n / 16) <= 2
    rows = sharding.digest(sharding.interleave_shards(odd)).collect()
    check_shards(rows, len(odd_rows))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 1) for r in odd_rows)
    assert sharding.interleave_shards(none).count() == 0


def test_shards_do_not_depend_on_buckets(spark, small, monkeypatch):
    """The order is by rank within the source and fraction, as a plain version has it."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    monkeypatch.setattr(sharding, "LEAST_BUCKET", 10_000)
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleave_shards(docs).collect()}
    hashed = docs.selectExpr("doc_id", "source", f"xxhash64({sharding.SEED}, doc_id) h").collect()
    by = defaultdict(list)
    for r in hashed:
        by[r["source"]].append((r["h"], r["doc_id"]))
    order = sorted(((2 * i + 1) / (2 * len(own)), "=" + s, h, d) for s, own in by.items() for i, (h, d) in enumerate(sorted(own)))
    n = len(order)
    for at, (_, _, _, d) in enumerate(order):
        shard = at * 16 // n
        assert got[d] == (shard, at - (shard * n + 15) // 16)


def test_shards_of_one_row_sources(spark, monkeypatch):
    """All have the same fractional rank; still no task ranks more than a few buckets' rows."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('host', id) as source", "'x' as text")
    seen = []
    monkeypatch.setattr(sharding, "prefix_sum", lambda df, *a: seen.append(df) or ranking.prefix_sum(df, *a))
    check_shards(sharding.digest(sharding.interleave_shards(docs)).collect(), 20_000)
    assert max(r["n"] for r in seen[0].collect()) < 3 * sharding.LEAST_BUCKET


def test_warc_matches_sql(spark, small):
    got = {tuple(r) for r in queries.op10_warc(spark, small).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    assert got == set(con.execute(warc.ORACLE_SQL).fetchall())


def test_warc_of_odd_rows_and_selection(spark, tmp_path):
    long = "<p>é\r\n\r\nWARC/1.1</p>" * 100
    rows = [(1, "http://a/\r\nx", long), (2, None, long), (3, "http://c/", None), (4, "http://d/", ""), (5, "http://e/", "short"), (6, "http://f/", "short"), (7, "http://g/", long), (8, "", "x" * 999), (9, "u", "x" * 1000), (10, "u", "x" * 1000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, record string")
    path = f"file://{tmp_path}/w"
    index = warc.write_warc(pages, path)
    read = {r["page_id"]: r for r in warc.read_warc(index, path).collect()}
    for page, url, html in rows:
        r, data = read[page], (html or "").encode()
        assert (r["digest"], r["n_payload"], r["url"]) == (hashlib.sha1(data).hexdigest(), len(data), (url or "").replace("\r\n", ""))
        assert r["refers_to"] == {1: 7, 2: 7, 9: 10}.get(page)
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == data
    every = [r["page_id"] for part in warc.read_warc(index, path).rdd.glom().collect() for r in part[:1]]
    assert len(every) >= 4  # the archives are read by several tasks
    chosen = warc.read_warc(index.where("page_id in (4, 7)"), path).collect()
    assert sorted(r["page_id"] for r in chosen) == [4, 7]
    assert warc.read_warc(index.where("false"), path).count() == 0
    assert warc.archive_pages(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_ranges_coalesce():
    ranges = [(0, 10), (10, 5), (40, 5), (200, 10), (209, 1)]
    assert list(warc.coalesced(ranges, gap=30, most=100)) == [(0, 45, 0, 3), (200, 10, 3, 5)]
    assert list(warc.coalesced(ranges, gap=0, most=12)) == [(0, 10, 0, 1), (10, 5, 1, 2), (40, 5, 2, 3), (200, 10, 3, 5)]
    assert list(warc.coalesced([])) == []
