"""Decontamination, license scan, URL filter and media: against plain versions."""

import hashlib
import random
import re
import textwrap
import zlib
from difflib import SequenceMatcher

import duckdb
import pytest

from quiltgraph.llm import decontaminate, licenses, media, queries, urls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def windows(text, n=10):
    w = WORD.findall(lower(text))
    return [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def brute_contamination(docs, items):
    by_window = {}
    for item, text in items:
        for w in windows(text):
            by_window.setdefault(w, set()).add(str(item))
    sizes = {len(w) for w in by_window}
    out = []
    for doc, text in docs:
        words = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if ids := by_window.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


REPORT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination_matches_brute_force(spark, small, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows(queries.op1_decontaminate(spark, small), *REPORT)
    assert got == sorted(brute_contamination(texts.items(), items), key=str)
    assert 0 < sum(r[5] for r in got) < len(got)


def test_contamination_of_odd_rows(spark, odd, odd_rows, none, monkeypatch):
    items = [(1, "Two words"), (2, None), (3, "..."), (4, "again and again same TEXT here again and again same text"), (5, "ONE"), (6, "two words"), (7, "é ü 漢字")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(brute_contamination([(r[0], r[1]) for r in odd_rows], items), key=str)
    assert rows(decontaminate.digest(decontaminate.find_contamination(odd, bench)), *REPORT) == want
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 10)  # several automata
    monkeypatch.setattr(decontaminate, "ITEM_WINDOWS", 1)  # and divided items
    assert rows(decontaminate.digest(decontaminate.find_contamination(odd, bench)), *REPORT) == want
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.digest(decontaminate.find_contamination(odd, bench.limit(0))).where("contaminated").count() == 0
    clean = decontaminate.drop_contaminated(odd, bench)
    assert clean.columns == odd.columns
    assert clean.count() == sum(not w[5] for w in want)


def test_a_benchmark_of_several_automata(spark):
    """Four megabytes of items go into chunks of one at most; a document with items of all of them has all of these."""
    bench = spark.range(40_000).selectExpr("id AS item_id", "concat_ws(' ', transform(sequence(1, 14), k -> concat('w', cast(id * 14 + k AS string)))) AS text")
    folder = decontaminate._write_chunks(bench, "item_id", "text", 10)
    sizes = [r["n"] for r in spark.read.parquet(folder).selectExpr("chunk", "octet_length(piece) AS n").groupBy("chunk").agg({"n": "sum"}).toDF("chunk", "n").collect()]
    assert len(sizes) >= 4 and max(sizes) <= decontaminate.AUTOMATON_BYTES
    docs = bench.where("item_id % 8000 = 5").selectExpr("'all' AS doc_id", "text").groupBy("doc_id").agg({"text": "collect_list"}).toDF("doc_id", "t").selectExpr("doc_id", "array_join(t, ' - ') AS text")
    r = decontaminate.digest(decontaminate.find_contamination(docs, bench)).first()
    assert (r["n_words"], r["n_hit"], r["n_items"]) == (70, 70, 5)
    assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, range(5, 40_000, 8000)))).encode()).hexdigest()


def test_spans_are_offsets_in_the_original(spark):
    text = "É Zwei, THE quick--brown fox; ende"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "the QUICK brown")], "item_id bigint, text string")
    r = decontaminate.find_contamination(docs, bench).first()
    assert [text.encode()[s["start"] : s["end"]].decode() for s in r["spans"]] == ["THE quick--brown"]


def plain_words(text):
    return re.findall(r"[a-z0-9_\x80-\U0010ffff]+(?:[.][a-z0-9_\x80-\U0010ffff]+)*", lower(text))


def test_licenses_match_plain_wording(spark, small, texts):
    """Every template whose words stand in a row anywhere is found; what is found has the template's words but for a few."""
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert len(got) == len(texts)
    templates = [(name, plain_words(t)) for name, t in licenses.TEMPLATES]
    n = 0
    for doc, text in texts.items():
        joined = f" {' '.join(plain_words(text))} "
        exact = {name for name, words in templates if f" {' '.join(words)} " in joined}
        n += len(exact)
        assert exact <= set(got[doc]["licenses"]), doc
        for notice in got[doc]["notices"]:
            name, words = templates[notice["template"]]
            own = plain_words(text.encode()[notice["start"] : notice["end"]].decode())
            same = sum(m.size for m in SequenceMatcher(None, words, own, autojunk=False).get_matching_blocks())
            assert name == notice["license"] and same >= len(words) * (1 - licenses.MOST_CHANGED)
            assert (notice["changed"] == 0) == (own == words)
    assert n > 10


FILLER = "Zwei drei words of text, the quick brown fox goes over and under the wall. " * 6


@pytest.mark.parametrize("dress", [
    lambda t: t,
    lambda t: textwrap.fill(t, 40, break_long_words=False),
    lambda t: "/*\n" + textwrap.indent(textwrap.fill(t, 60), " * ") + "\n */",
    lambda t: textwrap.indent(textwrap.fill(t, 72), "# "),
    lambda t: f"{FILLER}Copyright 2019 Jane Doe. {t} {FILLER}",
    lambda t: FILLER * 9 + t.upper() + "\n\n" + FILLER * 9,
])
def test_dressed_notices_are_found(spark, dress):
    rows = [(k, dress(text)) for k, (_, text) in enumerate(licenses.TEMPLATES)]
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        name, text = licenses.TEMPLATES[r["doc_id"]]
        assert name in r["licenses"], name
        one = next(n for n in r["notices"] if n["license"] == name)
        assert one["changed"] == 0
        if one["template"] == r["doc_id"]:
            assert plain_words(rows[r["doc_id"]][1].encode()[one["start"] : one["end"]].decode()) == plain_words(text)


def test_each_template_wins_for_itself_and_survives_small_changes(spark):
    rows = [(0, "my driving license is in my pocket"), (1, "x".join(t for _, t in licenses.TEMPLATES[:0])), (2, licenses.TEMPLATES[0][1] + " " + licenses.TEMPLATES[3][1] + " and " + licenses.TEMPLATES[0][1])]
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        if len(words) > 12:
            words[5] = "changed"
            rows.append((100 + k, " ".join(words)))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[0]["licenses"] == got[1]["licenses"] == []
    assert [n["license"] for n in got[2]["notices"]] == ["Apache-2.0", "MIT", "Apache-2.0"]
    for k, r in got.items():
        if k >= 100:
            assert r["licenses"] == [licenses.TEMPLATES[k - 100][0]] and 1 <= r["notices"][0]["changed"] <= 2


def test_license_scan_of_odd_rows(odd, odd_rows, none):
    found = licenses.scan_licenses(odd).collect()
    assert len(found) == len(odd_rows)
    assert next(r for r in found if r["doc_id"] == 13)["licenses"] == ["Apache-2.0", "CC-BY-NC-4.0"]
    assert licenses.scan_licenses(none).count() == 0


def plain_verdict(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = lower(host)
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    hits = lambda terms: {t for t in terms if re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", lower(url))}
    strict, soft = hits(urls.STRICT_TERMS), hits(urls.SOFT_TERMS)
    return host, path, best and best[1], len(strict), len(soft), best[0] if best else "block" if strict or len(soft) >= urls.SOFT_NEEDED else "allow"


def test_urls_match_plain_version_and_sql(spark, small):
    odd = [None, "", "no scheme casino", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "http://a.b.example.com/en/y", "https://x.net/es/free-bet", "https://free.bet/", "http://freebet.org/", "x://a?b://c/d", "http://com", "http://notcom/", "http://WIN.org/win/win", "://h/p#://q", "http://é.net/fr/é", "http://a.org/porn\n"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(odd + odd)] + [(None, "http://spam.org/", "x")], "page_id bigint, url string, verdict string")
    got = {(r["page_id"], *r[1:]) for r in urls.judge_urls(pages).collect()}
    assert got == {(i, *plain_verdict(u)) for i, u in enumerate(odd + odd)} | {(None, *plain_verdict("http://spam.org/"))}
    real = spark.read.parquet(f"{small}/pages.parquet")
    assert {tuple(r) for r in urls.judge_urls(real).collect()} == {(r["page_id"], *plain_verdict(r["url"])) for r in real.collect()}
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert set(con.execute(urls.oracle_sql()).fetchall()) == got
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_media_round_trip(spark, odd, odd_rows, none, small, texts):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in media.digest(media.sniff_media(media.store_media(odd))).collect()}
    for r in odd_rows:
        payload = (r[1] or "").encode()
        payload += b" " * (-len(payload) % 192 if payload else 192)
        one = got[r[0], hashlib.sha256(payload).hexdigest()]
        assert (one["n_bytes"], one["payload_bytes"], one["tail_crc32"]) == (len((r[1] or "").encode()), len(payload), zlib.crc32(payload[-16:]))
        assert one["detected_type"] in media.STORED
    assert media.sniff_media(media.store_media(none)).count() == 0
    real = queries.op4_sniff_media(spark, small).collect()
    assert {r["doc_id"]: r["payload_sha256"] for r in real} == {d: hashlib.sha256(media.pad(t.encode())).hexdigest() for d, t in texts.items()}
    assert {r["detected_type"] for r in real} == set(media.STORED)
    assert any(r["corrected"] for r in real) and not all(r["corrected"] for r in real)


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00?\x00\x12\xff\x00\xd2\xff\xd9"
GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + b"\0" * 6 + b"!\xf9\x04\0\0\0\0\0" + b",\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"


@pytest.mark.parametrize(("kind", "data"), [*((k, media._WRITERS[k](media.pad(b"BM RIFF P6 " * 30))) for k in media.STORED), ("image/jpeg", JPEG), ("image/gif", GIF), ("application/gzip", __import__("gzip").compress(b"x" * 500, mtime=0))])
def test_sniffing_confirms_carves_and_rejects(kind, data):
    assert (0, len(data), kind) in media.sniff(data)
    assert (7, len(data), kind) in media.sniff(b"BM.snd " + data + b"tail")
    if kind not in ("audio/ogg",):
        assert all(n <= len(data) - 1 for _, n, _ in media.sniff(data[:-1]))


def test_carving_and_nulls(spark):
    png = media._WRITERS["image/png"](media.pad(b"x"))
    rows_ = spark.createDataFrame([(1, bytearray(b"head" + png + b"tail"), "image/gif", "clash"), (2, None, None, "clash")], "doc_id bigint, media binary, declared_type string, feature string")
    found = media.sniff_media(rows_)
    assert [(r["detected_type"], r["corrected"]) for r in found.orderBy("doc_id").collect()] == [(None, False), (None, False)]
    assert [bytes(r["media"]) for r in media.carve(found).collect()] == [png]
    assert media.carve(found.withColumnRenamed("doc_id", "c"), id_col="c").columns[0] == "c"
    assert media.carve(found.limit(0)).count() == 0


def test_many_notices_and_notices_in_long_texts_full_of_cues(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    prose = [" ".join([*(word() for _ in range(14)), "license"]) for _ in range(11_000)]
    texts = dict(licenses.TEMPLATES[::-1])  # the first template of each name
    mit = next(t for name, t in licenses.TEMPLATES if name == "MIT" and len(t) > 300)
    put = [(2_000, mit, "MIT"), (2_001, texts["CC-BY-4.0"], "CC-BY-4.0"), (7_777, texts["GPL-3.0-or-later"], "GPL-3.0-or-later"), (10_999, texts["ISC"], "ISC")]
    for at, text, _ in put:
        prose[at] += " " + text
    rows = [(0, (texts["All-Rights-Reserved"] + " ") * 10_000), (1, f"{texts['MIT']} " * 1_500), (2, " ".join(prose)), (3, f"{mit}\n" * 300)]
    got = {r["doc_id"]: r["notices"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert len(got[0]) == 10_000 and len(got[1]) == 1_500 and len(got[3]) == 300
    data = rows[2][1].encode()
    assert len(data) > 1_000_000
    assert [n["license"] for n in got[2]] == [name for _, _, name in put]
    assert all(texts_match(data[n["start"] : n["end"]].decode(), text) for n, (_, text, _) in zip(got[2], put, strict=True))


def texts_match(found, text):
    return plain_words(found) == plain_words(text)


def test_places_that_overlap():
    found = [(3, 9), (0, 4), (9, 12), (1, 3), (0, 1), (11, 20), (20, 20)]
    assert licenses.disjoint(found, lambda x: x[0], lambda x: x[1]) == [(0, 1), (1, 3), (3, 9), (9, 12), (20, 20)]
