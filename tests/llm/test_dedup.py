"""SimHash, components, suffix removal, quality and the pipeline: against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quiltgraph.llm import decontaminate, quality, queries, simhash, suffixes
from quiltgraph.operators import components


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


def plain_components(ids, fps, bits=2):
    """Smallest id reachable, by comparing all pairs of distinct fingerprints."""
    distinct = np.array(sorted(set(fps)), np.uint64)
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1 :] ^ f) <= bits):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    at = {int(f): find(i) for i, f in enumerate(distinct)}
    least = {}
    for d, f in zip(ids, fps, strict=True):
        if d is not None:
            least[at[f]] = min(d, least.get(at[f], d))
    return [least.get(at[f]) for f in fps]


def test_simhash_matches_brute_force(spark, small, texts):
    ids = list(texts)
    fps = [plain_fingerprint(t) for t in texts.values()]
    want = {d: (f"{f:016x}", c) for d, f, c in zip(ids, fps, plain_components(ids, fps), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash(spark, small).collect()}
    assert got == want


@pytest.mark.parametrize("full", [2048, 4])
def test_simhash_of_odd_rows_and_full_buckets(spark, odd, odd_rows, none, full):
    ids, fps = [r[0] for r in odd_rows], [plain_fingerprint(r[1]) for r in odd_rows]
    want = Counter(zip(ids, [f"{f:016x}" for f in fps], plain_components(ids, fps), strict=True))
    got = simhash.digest(simhash.near_duplicates(odd, bucket_rows=full))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("full", [2048, 8])
def test_links_connect_dense_clusters(spark, full):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(300)}
    for center in list(values)[:4]:
        values |= {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(24)) ^ (1 << rng.randrange(24)) for _ in range(150)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp bigint"), bucket_rows=full)
    label = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    ids = sorted(signed)
    by_plain = plain_components(ids, [v & (1 << 64) - 1 for v in ids])
    groups = lambda of: {frozenset(i for i in ids if of[i] == c) for c in set(of.values())}
    assert groups({i: label.get(i, i) for i in ids}) == groups(dict(zip(ids, by_plain, strict=True)))


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(15)]]))
    pairs = {(min(a, b), max(a, b)) for x, y in simhash.trie_links(values, np.zeros(1, np.int64)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert pairs == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if np.bitwise_count(values[i] ^ values[j]) <= 2}


def test_trie_join_of_long_values_and_labels():
    rng = np.random.default_rng(8)
    values = np.unique(rng.integers(0, 1 << 63, (40, 4), dtype=np.uint64).repeat(5, axis=0) ^ (np.uint64(1) << rng.integers(0, 60, (200, 4), dtype=np.uint64)), axis=0)
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if np.bitwise_count(values[i] ^ values[j]).sum() <= 6}
    pairs = lambda label: {(min(a, b), max(a, b)) for x, y in simhash.trie_links(values, np.zeros(1, np.int64), 6, label) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert pairs(None) == want and len(want) > 20
    label = np.arange(len(values)) % 3
    assert {p for p in want if label[p[0]] != label[p[1]]} <= pairs(label) <= want


def jaccard(a, b):
    sets = []
    for text in (a, b):
        w = lower(text).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def plain_alike(rows):
    """Indices of components by all pairs of fingerprints that are near and agree in a key."""
    budget, masks = simhash.alike_budget(), np.array(simhash.key_masks()).view(np.uint64)
    values = np.array([np.frombuffer(simhash.alike_fingerprint((t or "").encode()), ">u8") for _, t in rows]).astype(np.uint64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            differ = values[i] ^ values[j]
            if np.bitwise_count(differ).sum() <= budget and ((differ & masks) == 0).all(axis=1).any():
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def near_copies():
    """Bases with copies of one to several changed words, chains, exact copies, short and empty texts."""
    rng = random.Random(4)
    out = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        out.append(" ".join(base))
        for _ in range(10):
            copy = list(rng.choice([base, out[-1].split()]))
            for at in rng.sample(range(len(copy)), rng.randint(1, max(1, len(base) // 35))):
                copy[at] = f"x{rng.randrange(5000)}"
            out.append(" ".join(copy))
    return [*out, out[0], out[0].upper(), "one", "One", "two words", "", None, " \n"]


@pytest.mark.parametrize("dense", [64, 2])
def test_alike_texts_match_all_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE_ROWS", dense)
    rows = list(enumerate(near_copies()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = plain_alike(rows)
    assert sorted(r["doc_id"] for r in simhash.keep_alike(docs).collect()) == sorted(map(min, want))
    assert len(want) < 40  # of 12 groups, and texts alone
    for group in want:
        for i in group[1:]:
            assert max(jaccard(rows[i][1] or "", rows[j][1] or "") for j in group if j != i) > 0.6 or not (rows[i][1] or "").split()


def test_alike_texts_of_odd_rows(spark, odd, odd_rows, none):
    rows = [(r[0], r[1]) for r in odd_rows]
    want = [min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for g in plain_alike(rows)]
    for docs in (odd, odd.withColumnsRenamed({"fp": "k2", "n": "c0"})):
        kept = simhash.keep_alike(docs)
        assert kept.columns == docs.columns
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, want))
    assert simhash.keep_alike(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "a b c d e f g")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in simhash.keep_alike(twice).collect()) == [(1, "a b c d e f g"), (1, "h i j k l m n")]


def test_alike_texts_of_real_rows(spark, small, texts):
    """Against exact Jaccard indices of all pairs: what goes has a partner, and most pairs of 0.85 and more are found."""
    got = {r["doc_id"] for r in simhash.keep_alike(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    sets = {}
    for d, t in texts.items():
        w = lower(t).split()
        sets[d] = {hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))} if w else set()
    by = {}
    for d, some in sets.items():
        for x in some:
            by.setdefault(x, []).append(d)
    near = Counter(p for own in by.values() for p in {(a, b) for k, b in enumerate(own) for a in own[:k]})
    alike = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in near.items()}
    gone = [d for d in texts if d not in got]
    assert all(max((j for p, j in alike.items() if d in p), default=0) > 0.6 for d in gone)
    sure = [p for p, j in alike.items() if j >= 0.85]
    assert sum(p[0] in got and p[1] in got for p in sure) <= len(sure) // 20 and len(sure) > 20


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(200, 200), (300, 301), (301, 300), (300, 301)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == dict.fromkeys(range(61), 0) | dict.fromkeys(range(100, 150), 100) | {300: 300, 301: 300}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def plain_ranges(data, law):
    """Maximal byte ranges of each text that repeated windows cover, with all windows of all texts counted."""
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] if law.words else [(i, i + 1) for i in range(len(d))] for d in data]
    # Words with one space between them, so that a window of words is a string too.
    joined = [b" ".join(d[a:b] for a, b in p) if law.words else d for d, p in zip(data, places, strict=True)]
    ends = [list(np.cumsum([b - a + 1 for a, b in p]) - 1) if law.words else list(range(1, len(d) + 1)) for d, p in zip(data, places, strict=True)]
    key = lambda k, i: joined[k][ends[k][i] - (places[k][i][1] - places[k][i][0]) : ends[k][i + law.length - 1]]
    count = Counter(hash(key(k, i)) for k, p in enumerate(places) for i in range(len(p) - law.length + 1))
    out = []
    for k, p in enumerate(places):
        merged = []
        for i in range(len(p) - law.length + 1):
            if count[hash(key(k, i))] > 1:
                a, b = p[i][0], p[i + law.length - 1][1]
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = b
                else:
                    merged.append([a, b])
        out.append(merged)
    return out


def without(d, ranges):
    for a, b in reversed(ranges):
        d = d[:a] + d[b:]
    return d


def plain_removal(texts, law=suffixes.BYTES_400):
    data = [(t or "").encode() for t in texts]
    return [(len(d), sum(b - a for a, b in r), len(r), hashlib.sha256(without(d, r)).hexdigest(), len(w)) for d, r, w in zip(data, plain_ranges(data, law), plain_ranges(data, suffixes.WORDS_50), strict=True)]


def test_suffixes_match_brute_force(spark, small, texts):
    got = {tuple(r) for r in queries.op9_suffix_dedup(spark, small).collect()}
    want = {(d, *w) for d, w in zip(texts, plain_removal(texts.values()), strict=True)}
    assert got == want
    assert any(w[2] for w in want) and any(w[5] for w in want)


def planted():
    """Texts with shared passages at all places and distances, periodic ones and near copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (60, 90, 150, 400)]
    out = []
    for i in range(60):
        parts = [prose(rng.randint(0, 200))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            a = rng.randint(0, 40)
            parts += [p[a : len(p) - rng.randint(0, 60)], prose(rng.randint(0, 80))]
        out.append(" ".join(parts))
    base = prose(500)
    out += [base[:k] + word() + base[k + 5 :] for k in range(0, len(base), 60)]
    return [*out, "ab" * 700, "ab" * 500, "x" * 399, "x" * 400, "x" * 401, (prose(30) + "\n") * 8, "a b " * 60, " ".join(passages[0].split()[:50]).replace(" ", " \t"), "\0" * 500, "a\0" * 300]


@pytest.mark.parametrize("law", [suffixes.BYTES_400, suffixes.Law(200, 32), suffixes.WORDS_50])
@pytest.mark.parametrize("bucket_runs", [suffixes.BUCKET_RUNS, 3])
def test_suffixes_of_planted_texts(spark, odd_rows, bucket_runs, law):
    texts = planted() + [r[1] for r in odd_rows]
    docs = spark.createDataFrame([(i if i % 9 else None, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, k1 string").repartition(5)
    got = Counter(tuple(r) for r in suffixes.digest(suffixes.remove_repeats(docs, law=law, report=suffixes.WORDS_50, bucket_runs=bucket_runs)).collect())
    want = Counter((i if i % 9 else None, *w) for i, w in enumerate(plain_removal(texts, law)))
    assert got == want


def test_suffixes_with_small_blocks(spark, monkeypatch):
    text = planted()[5] + planted()[7]
    for law in (suffixes.BYTES_400, suffixes.WORDS_50):
        windows = lambda: {(a, w) for some in suffixes.anchor_runs(suffixes.tokenize(text.encode(), law)[0], law) for a, f, e, _ in zip(*some, strict=True) for w in range(f, e + 1)}  # noqa: E731, B023
        monkeypatch.undo()
        whole = windows()
        monkeypatch.setattr(suffixes, "BLOCK", 300)
        assert windows() == whole and whole


def test_suffixes_tell_structured_texts_apart(spark):
    """Two words whose polynomial hashes agree: what is equal is decided by the bytes."""
    a = b = "a"
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    texts = [f"one {a} two", f"three {b} four", f"five {a} six"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    law = suffixes.Law(1500, 64)
    got = {tuple(r)[:5] for r in suffixes.digest(suffixes.remove_repeats(docs, law=law)).collect()}
    assert got == {(i, *w[:4]) for i, w in enumerate(plain_removal(texts, law))}


def test_suffixes_of_long_and_repeated_rows(spark):
    """A constant text of 5 MB, and 10,000 equal rows, of equal ids too."""
    rng = random.Random(3)
    common = " ".join(f"w{rng.randrange(999)}" for _ in range(120))
    docs = spark.createDataFrame([(1, "x" * 5_000_000), (2, "yy " * 300_000)], "doc_id bigint, text string").union(spark.range(10_000).selectExpr("if(id < 5000, 3, id) as doc_id", f"'{common}' as text"))
    got = Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["n_passages"]) for r in suffixes.digest(suffixes.remove_repeats(docs, report=suffixes.WORDS_50)).collect())
    assert got == {(5_000_000, 5_000_000, 1, 0): 1, (900_000, 900_000, 1, 1): 1, (len(common), len(common), 1, 1): 10_000}


@pytest.mark.parametrize("law", [suffixes.BYTES_400, suffixes.WORDS_50])
def test_suffixes_of_nothing(spark, none, odd, odd_rows, law):
    assert suffixes.remove_repeats(none).count() == 0
    for docs in (odd, odd.withColumnsRenamed({"fp": "_key1", "score": "_found", "n": "k2", "h": "c0"})):
        kept = suffixes.strip_repeats(docs, law=law)
        assert kept.columns == docs.columns
        data = [(r[1] or "").encode() for r in odd_rows]
        left = [without(d, r).decode(errors="ignore") if r else t[1] for d, r, t in zip(data, plain_ranges(data, law), odd_rows, strict=True)]
        assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((o[0], t) for o, t, d in zip(odd_rows, left, data, strict=True) if t == o[1] or t.strip())
    assert suffixes.strip_repeats(none, law=law).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(4)
    strings = rng.integers(0, 2, (3000, 16)).astype(np.uint8)
    strings[:900] = strings[0]
    order, common = suffixes.suffix_array(strings)
    rows = strings[order].tolist()
    assert rows == sorted(strings.tolist())
    assert common.tolist() == [0, *(next((k for k in range(16) if a[k] != b[k]), 16) for a, b in zip(rows, rows[1:], strict=False))]


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, (5000, 6)).astype(np.uint64)
    words[:1500] = words[0]
    assert (words[suffixes.multikey_quicksort(words)] == np.array(sorted(map(tuple, words.tolist())), np.uint64)).all()


def test_quality_on_held_out_rows(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in queries.op7_quality(spark, small).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    known = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    good = [p for p, q in known if q]
    bad = [p for p, q in known if not q]
    assert np.mean(good) >= 0.97 and 1 - np.mean(bad) >= 0.9


def test_quality_of_odd_rows(spark, odd, odd_rows, none, small):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 1), (5, 1), (4, 0), (6, 1), (8, 1), (11, 0), (11, 1)], "doc_id bigint, quality int")
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == len(odd_rows) and len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    clash = odd.withColumnsRenamed({"fp": "label", "n": "_id", "k1": "id", "h": "quality"})
    assert len(quality.score_quality(clash, labels).collect()) == len(odd_rows)
    assert quality.drop_low_quality(clash, labels).columns == clash.columns
    assert quality.score_quality(none, labels).count() == 0
    assert {r["score"] for r in quality.score_quality(odd, labels.limit(0)).collect()} == {1.0}


def plain_score(w, z):
    """Gated attention over the passages z of one document, passage by passage."""
    h = [np.tanh(p @ w["encode"] + w["encode_b"]) for p in z]
    weigh = [np.exp((np.tanh(x @ w["attend"]) / (1 + np.exp(-(x @ w["gate"])))) @ w["weigh"]) for x in h]
    bag = sum(a / sum(weigh) * x for a, x in zip(weigh, h, strict=True))
    return 1 / (1 + np.exp(-(bag @ w["score"] + w["score_b"])))


def test_attention_and_its_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality.N_FEATURES)) for n in (1, 3, 5, 2, 4, 6)]
    bad = np.array([0, 1, 0, 1, 1, 0])
    for bag, label in zip(bags, bad, strict=True):
        bag[0, 3] += 6 * (1 - label)  # one passage decides
    model = quality.fit(bags, bad)
    x, sizes = np.vstack(bags), np.array([len(b) for b in bags])
    p, c = model.forward(x, sizes)
    assert ((p >= 0.5) == (bad == 1)).all()
    assert np.allclose(np.add.reduceat(c["a"], c["starts"]), 1)
    z = np.split(np.clip((x - model.mean) / model.scale, -8, 8), np.cumsum(sizes)[:-1])
    assert np.allclose(p, [plain_score(model.weights, one) for one in z])
    w = model.weights | {k: rng.normal(0, 0.4, np.shape(v)) for k, v in model.weights.items()}
    model.weights = w
    loss = lambda: -np.mean(np.log(np.where(bad, (q := model.forward(x, sizes)[0]), 1 - q)))
    for name, grad in quality.gradients(model, x, sizes, bad.astype(float)).items():
        for at in [()] if np.ndim(grad) == 0 else [tuple(rng.integers(0, n) for n in np.shape(grad)) for _ in range(4)]:
            value = np.array(w[name], float)
            sides = []
            for step in (1e-5, -1e-5):
                moved = value.copy()
                moved[at] += step
                w[name] = moved
                sides.append(loss())
            w[name] = value
            assert np.isclose((sides[0] - sides[1]) / 2e-5, grad[at] if at else grad, rtol=1e-3, atol=1e-8), name


def test_pipeline_against_brute_force(spark, small, texts):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rejected = {r["doc_id"] for r in queries.op7_quality(spark, small).where("predicted = 0").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in rejected}
    alone = [(d, t) for d, t in rows.items()]
    rows = {min(alone[i][0] for i in g): None for g in plain_alike(alone)}
    rows = {d: texts[d] for d in texts if d in rows}
    data = [t.encode() for t in rows.values()]
    left = {}
    for doc, d, r in zip(rows, data, plain_ranges(data, suffixes.WORDS_50), strict=True):
        text = without(d, r).decode(errors="ignore")
        if not r or text.strip():
            left[doc] = text
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    known = {w for t in items for w in decontaminate.windows_of(decontaminate.words_of(t.encode()), 10)}
    leaks = {d for d, t in left.items() if (w := b" " + b" ".join(decontaminate.words_of(t.encode())) + b" ") and any(b" " + b" ".join(k) + b" " in w for k in known)}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in left.items() if d not in leaks}
    got = Counter()
    for r in pipeline.run(spark, small).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want and leaks and len(left) < len(rows) + 1
