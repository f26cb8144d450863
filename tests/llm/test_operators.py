"""Each operator against brute force on a small table with nulls, empty and long texts, copies and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import bpe, license_scan, minhash, mixing, quality, sharding, substring_dedup, topk, toxicity, warc

SPACE = re.compile(r"[^\x20\x09-\x0d]+")


def words(t):
    return SPACE.findall(t or "")


def corpus():
    rnd = random.Random(4)
    vocab = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nü", "Pa", "qu") for b in ("ra", "st", "ti", "ux", "ve", "é", "")]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base = text(60)
    passage = text(15)
    out = [base, base, base + " " + text(3), None, "", " \n\t ", text(2), text(2), "one", text(5000), passage + " " + text(20), text(7) + "\n" + passage, "x" * 20_000, "a " * 40, "idiot, you! \x0b naïve漢字 😀  tail ", text(30) + "\x00 nul"]
    out += [passage + " " + passage, text(12), text(13)] + [base.replace("ba", "BA")]
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, i, "clash") for i, t in enumerate(out)]
    rows.append(rows[9])  # a repeated row
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    own = "doc_id long, text string, source string, size int, kept string"
    return spark.createDataFrame(corpus(), own).repartition(3)


def empty(docs):
    return docs.where("false")


def test_substring_dedup(docs):
    rows = corpus()
    for window in (3, 13):
        least = {}
        for i, t, *_ in rows:
            w = words(t)
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                least[g] = min(least.get(g, i), i)
        want = set()
        for i, t, *_ in rows:
            w, gone = words(t), set()
            for k in range(len(w) - window + 1):
                if least[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
            want.add((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
        out = substring_dedup.repeated(docs, window=window, batch_bytes=20_000)
        got = out.collect()
        assert len(got) == len(rows) and {(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got} == want
        assert all(sum(s.last - s.first + 1 for s in r.removed) == r.n_removed for r in got)
    assert out.columns[:5] == ["doc_id", "text", "source", "size", "kept"]
    assert substring_dedup.repeated(empty(docs)).count() == 0


def test_substring_dedup_random(spark):
    """Few words make many repeats, runs and periods, which try the symbols' contexts."""
    rnd = random.Random(11)
    rows = []
    for i in range(120):
        t = [rnd.choice("ab" if i % 2 else "abcd") for _ in range(rnd.randint(0, 60))]
        if i % 5 == 0:
            t = (t[:3] or ["a"]) * 12
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for window in (5, 13):
        least = {}
        for i, t in rows:
            w = t.split()
            for k in range(len(w) - window + 1):
                least.setdefault(tuple(w[k : k + window]), i)
        got = {r.doc_id: r.n_removed for r in substring_dedup.repeated(df, window=window, batch_bytes=600).collect()}
        for i, t in rows:
            w, gone = t.split(), set()
            for k in range(len(w) - window + 1):
                if least[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
            assert got[i] == len(gone)


def thue_morse(n, first="a"):
    """Words whose polynomial hashes modulo 2**64 are equal, whatever the base, from 1,024 letters on."""
    other = {"a": "b", "b": "a"}
    t = first
    while len(t) < n:
        t += "".join(other[c] for c in t)
    return t[:n]


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_feign_equal_hashes(spark, n, monkeypatch):
    a, b = thue_morse(n), thue_morse(n, "b")
    data = np.frombuffer((a + b).encode(), np.uint8)
    from loomspark.llm.common import word_hashes

    x, y = word_hashes(data, np.array([0, n]), np.array([n, 2 * n])).tolist()
    assert x != y
    rows = [(1, " ".join([a] * 3 + [f"w{i}" for i in range(10)])), (2, " ".join([b] * 3 + [f"w{i}" for i in range(10)])), (3, " ".join([a] * 9 + [b] * 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.repeated(df, window=12).collect()}
    assert got == {1: 0, 2: 0, 3: 0}
    assert all(r.component_id == r.doc_id for r in minhash.near_duplicates(df, size=3, percent=85, permutations=40).collect())


def test_equal_hashes_remove_and_link_nothing():
    """What is compared in the end are words: with all hashes equal, only equal windows are told to be so."""
    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a b c d", "e f g  h", "x b c d"]})
    b = substring_dedup.Batch(rows, "doc_id", "text", 3)
    b.words[:] = 7
    w = substring_dedup.Windows(b, b.at, np.zeros(len(b.at), np.uint64), 3)
    assert w.code.tolist() == [0, 1, 2, 3, 4, 1] and w.least.tolist() == [1, 1, 2, 2, 3]
    words, sizes, start = substring_dedup.unpack_windows(w.pack(0, 5))
    assert words.tobytes() == b"a b c d e f g h x b c " and sizes.tolist() == [2] * 11 and start.tolist() == [0, 1, 4, 5, 8]


@pytest.mark.parametrize("hashed", [True, False])
def test_exact_names(hashed, monkeypatch):
    """Windows get equal numbers for equal words only, whether hashes tell them apart or are all alike."""
    if not hashed:
        monkeypatch.setattr(substring_dedup, "mix", lambda h: np.zeros(len(h), np.uint64))
    rnd = random.Random(6)
    for window in (2, 3, 5, 8, 13, 50):
        w = [rnd.choice(["a", "b", "ab", "a" * 9]) if rnd.random() < 0.3 else "c" for _ in range(400)]
        data = np.frombuffer("".join(x + " " for x in w).encode(), np.uint8)
        off = np.cumsum([0] + [len(x) + 1 for x in w])
        at = np.array(sorted(rnd.sample(range(401 - window), 300)))
        names = substring_dedup.exact_names(data, off, window, at).tolist()
        grams = [tuple(w[k : k + window]) for k in at]
        assert len(set(zip(names, grams))) == len(set(names)) == len(set(grams))
    assert len(substring_dedup.exact_names(data[:0], off[:1], 5, at[:0])) == 0


def test_rows_without_ids(spark):
    """Null ids: later than all others and no repeat of each other (substrings), linked with nothing (near-duplicates)."""
    rnd = random.Random(8)
    t = " ".join(f"w{rnd.randint(0, 999)}" for _ in range(40))
    df = spark.createDataFrame([(None, t), (None, t), (5, t), (6, t + " more")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.repeated(df).collect())
    assert got == [("5", 0), ("6", 40), ("None", 40), ("None", 40)]
    alone = substring_dedup.repeated(df.where("doc_id IS NULL")).collect()
    assert [r.n_removed for r in alone] == [0, 0]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [("5", "5", True), ("6", "5", False), ("None", "None", True), ("None", "None", True)]


def test_toxicity_of_long_texts_and_repeated_rows(spark):
    model = toxicity.Model({"idiot": 3.0}, {}, (-3.0, 0.8, 0.8))
    long = "word " * 300_000
    df = spark.createDataFrame([(1, long + "you idiot"), (2, long), (3, "you idiot"), (3, "you idiot"), (None, "you idiot"), (4, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_clauses, r.toxicity) for r in toxicity.scored(df, model).collect())
    assert [x[:2] for x in got] == [("1", 1), ("2", 0), ("3", 1), ("3", 1), ("4", 0), ("None", 1)] and got[2] == got[3] and got[1][2] == got[4][2]


def test_bpe_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "clash", "clash"), (None, None, "clash", "clash")], "doc_id long, text string, ids string, n_tokens string")
    out = bpe.encoded(df)
    assert [(r.doc_id, r.n_tokens) for r in out.orderBy("doc_id").collect()] == [(None, 0), (1, 2)] and dict(out.dtypes)["ids"].startswith("array")


def shingles(t, n):
    w = words("".join(c.lower() if c < "\x7f" else c for c in t or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(texts, n, percent):
    sets = {i: shingles(t, n) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_min_hash(spark, docs):
    rnd = random.Random(2)
    base = [f"w{rnd.randint(0, 500)}" for _ in range(80)]
    rows = [(i, t) for i, t, *_ in corpus()[:-1]]
    for k in range(60):  # a chain of copies, each with one more word changed
        base[k % 80] = f"z{k}"
        rows.append((100 + k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).repartition(4)
    want = brute_components(dict(rows), 3, 85)
    got = minhash.near_duplicates(df, size=3, percent=85, permutations=40).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)
    out = minhash.near_duplicates(docs).collect()
    assert len(out) == len(corpus()) and {r.doc_id: r.component_id for r in out} == {i: c for i, (_, c) in brute_components({i: t for i, t, *_ in corpus()}, 5, 80).items()}
    assert minhash.near_duplicates(empty(docs)).count() == 0


def test_min_hash_of_an_id_with_two_texts(spark):
    rnd = random.Random(5)
    a, b, c = ([f"w{rnd.randint(0, 5000)}" for _ in range(80)] for _ in range(3))
    near = lambda t: " ".join([*t[:-1], "other"])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (9, near(a)), (12, near(b)), (3, " ".join(c)), (20, near(c)), (20, " ".join(c[:40]))]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "doc_id long, text string").coalesce(1)
        got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()}
        assert got == {(7, 7), (9, 7), (12, 7), (3, 3), (20, 3)}


def test_min_and_max_estimate_similarity():
    a, b = np.arange(0, 900, dtype=np.uint64), np.arange(100, 1000, dtype=np.uint64)
    from loomspark.llm.common import mix

    values = minhash.min_max([np.unique(mix(a)), np.unique(mix(b))], 400)
    assert abs((values[0] == values[1]).mean() - 0.8) < 0.06
    x = np.unique(mix(a))
    one = minhash.min_max([x], 1)[0]
    assert one[0] < one[1]


def test_bpe(docs):
    import tiktoken
    from public_tokenizers import PATTERN, path

    with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decoded(bpe.encoded(docs)).collect()
    assert len(out) == len(corpus())
    for r in out:
        t = r.text or ""
        assert r.ids == enc.encode_ordinary(t) and bytes(r.decoded) == t.encode() and r.n_tokens == len(r.ids)
        sizes = [len(enc.decode_single_token_bytes(i)) for i in r.ids]
        assert r.offsets == [sum(sizes[:k]) for k in range(len(sizes))] if len(sizes) < 500 else True
    coder = bpe.codec(path("byte_bpe_50k.tiktoken"))
    rnd = random.Random(3)
    letters = list("'strlvemd  \n\t1aÉ!漢😀\x1c²") + ["\xa0", "　", "́"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    from loomspark.llm.common import utf8_buffer

    ids, upto = coder.encode(*utf8_buffer(pa.array(texts)))
    for k, t in enumerate(texts):
        assert ids[upto[k] : upto[k + 1]].tolist() == enc.encode_ordinary(t)
    assert bpe.encoded(empty(docs)).count() == 0


def test_license_words_and_base(docs, spark):
    rows = [(0, "Released UNDER the MIT-License: under the mit license"), (1, "Apache License, Version 2.0"), (2, "cc-by-nc cc by ncx"), (3, None), (4, ""), (5, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause WITH x-exception"), (6, "spdx-license-identifier: MIT OR OR"), (7, "All rights reserved."), (8, "é" * 50_000 + " cc by nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x7f" else c for c in t or ""))
        places = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert got[i].n_words == len(w)
        assert sorted((m.word, m.label) for m in got[i].matches if m.kind == "base") == sorted(places)
        assert 0 <= got[i].license_score <= 1
    assert [m.label for m in got[5].matches if m.kind == "tag"] == ["apache-2", "bsd-3", "mit"] and got[6].matches == [] and got[7].matches[0].label == "all-rights-reserved"
    assert license_scan.scan(empty(docs)).count() == 0 and license_scan.scan(docs).count() == len(corpus())


def test_license_expressions():
    parse, evaluate = license_scan.parse_expression, license_scan.evaluate
    assert parse("mit or apache-2.0 and bsd-3-clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert evaluate(parse("(gpl-2.0-only with x or mit) and zlib")) == ({"mit", "gpl-2.0-only", "zlib"}, ["mit", "zlib"], True)
    assert evaluate(parse("gpl-3.0-only or gpl-2.0-only and mit"))[1:] == (["gpl-3.0-only"], False)
    assert evaluate(parse("mit and (gpl-3.0-only or isc and zlib)"))[1:] == (["mit", "isc", "zlib"], True)
    assert evaluate(parse("gpl-3.0-only with classpath-exception"), frozenset({"gpl-3.0-only"})) == ({"gpl-3.0-only"}, ["gpl-3.0-only"], True)
    many = evaluate(parse(" and ".join(f"(a{i}-1 or mit)" for i in range(60))))  # 2**60 choices
    assert many[1:] == (["mit"], True) and len(many[0]) == 61
    for bad in ("", "mit or", "(mit", "mit)", "mit mit", "or mit", "mit (gpl)", "()", "mit; gpl"):
        assert parse(bad) is None


def test_license_tags_amid_prose():
    tags = lambda t: [(m[1], m[2]) for m in license_scan.scan_text(t.encode())[1] if m[0] == "tag"]
    assert tags("SPDX-License-Identifier: MIT, see the LICENSE file") == [("mit", 0)]
    assert tags("license expression: Apache-2.0 OR MIT and then prose") == [("apache-2", 0), ("mit", 0)]
    assert tags("/*! SPDX-License-Identifier: MIT */(function() {})") == [("mit", 0)]
    assert tags("(SPDX-License-Identifier: MIT)") == [("mit", 0)]
    assert tags("a SPDX -- License ---- Identifier: ISC\nb License expression: (MIT OR Zlib) AND gpl-2.0 with x-exception is ours") == [("isc", 1), ("gpl-2.0", 6), ("mit", 6), ("zlib", 6)]
    assert tags("é SPDX-License-Identifier: MIT\u00a0\r\nOR gpl-2.0 spdx-license-identifier: own spdx-license-identifier: Unknown") == [("mit", 1), ("unknown", 13)]
    assert tags("spdx license identifier: MIT or (see below") == [("mit", 0)]
    for bad in ("license expression is described below", "spdx-license-identifier: MIT OR", "spdx-license-identifier: (MIT", "spdx-license-identifier:\nMIT", "spdx-license-identifier"):
        assert tags(bad) == []


def brute_top(rows, k, asked=lambda i: i % 50 == 0):
    out = []
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    for n, (i, a) in enumerate(usable):
        if asked(i):
            best = sorted((-sum(x * y for x, y in zip(a, b)), j) for m, (j, b) in enumerate(usable) if m != n and len(b) == len(a))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(24)]) for i in range(230)]
    rows += [(300 + i, list(rows[7][1])) for i in range(8)] + [(50, None), (400, []), (401, [1.0, None]), (402, [float("nan")] * 24), (403, [float("inf")] * 24), (None, [0.1] * 24), (450, [0.5, 0.25])]
    rows = [r for r in rows if r[0] != 50 or r[1] is None]
    rows += [rows[100], rows[100], (100, [rnd.uniform(-1, 1) for _ in range(24)]), rows[3]]  # repeated queries, an id of two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(3)
    for sizes in ({"block_rows": 64, "query_rows": 2}, {}):
        got = sorted(tuple(r) for r in topk.top_k(df, "vec_id % 50 = 0", **sizes).collect())
        assert got == brute_top(rows, 5)
    assert topk.top_k(df.where("false"), "vec_id % 50 = 0").count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few, "vec_id = 0").orderBy("rank").collect()] == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    # Queries of their own meet all rows.
    assert [tuple(r) for r in topk.top_k(few, few.where("vec_id = 1"), k=2).orderBy("rank").collect()] == [(1, 1, 1, 262144), (1, 2, 2, 262144)]


def test_top_k_of_a_query_given_twice(spark):
    df = spark.createDataFrame([(50, [1.0]), (50, [1.0]), (1, [3.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, "vec_id = 50", k=3).collect())
    assert got == sorted(2 * [(50, 1, 1, 3 << 16), (50, 2, 2, 2 << 16), (50, 3, 50, 1 << 16)])


def test_top_k_of_large_components(spark):
    def best(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        return [tuple(r) for r in topk.top_k(df, "vec_id = 0").orderBy("rank").collect()]

    big = 2.0**41
    assert best([(0, [1.0, 0.0]), (1, [big, 1.0]), (2, [-big, 1.0])]) == [(0, 1, 1, 2**57), (0, 2, 2, -(2**57))]
    assert best([(0, [big, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0])]) == [(0, 1, 1, 2**57), (0, 2, 2, 3 * 2**16)]
    # Over 64 bits on the way only: its own row, and terms that cancel.
    assert best([(0, [big, big]), (1, [big, 2.0 - big])]) == [(0, 1, 1, 2**58)]
    for rows in ([(0, [1.0]), (1, [2.0**56])], [(0, [big]), (1, [big])]):
        with pytest.raises(Exception, match="exceeds 64 bits"):
            best(rows)


def test_bounds_prune_and_keep_the_best():
    rng = np.random.default_rng(0)
    unit = lambda x: np.floor(256 * x / np.linalg.norm(x, axis=0)).astype(np.int64)
    centres = rng.normal(size=(64, 40))
    near = lambda n: centres[:, rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(64, n))
    for block, q, most in ((unit(near(8192)), unit(near(256)), (0.9, 0.4)), (unit(rng.normal(size=(64, 8192))), unit(rng.normal(size=(64, 256))), (1.0, 0.9)), (rng.integers(-40, 40, (64, 3000)) * np.where(np.arange(3000) < 9, 12, 1), rng.integers(-40, 40, (64, 9)), (1.0, 0.9))):
        n, m = q.shape[1], block.shape[1]
        full = q.T @ block
        want = [sorted((-s, j) for j, s in enumerate(full[i]))[:5] for i in range(n)]
        floor = np.array([-w[4][0] for w in want], np.float64)  # as a block met before would leave it
        shares = []  # of all products, those that are made: at first, and behind floors
        for known in (None, floor):
            work = topk.Work()
            row, found, score = topk.best_of_block(np.arange(n) - n, q, np.arange(m), np.arange(m), block, 5, known, work=work)
            assert [sorted(zip((-score[row == i]).tolist(), found[row == i].tolist())) for i in range(n)] == want
            shares.append(work.done / work.all)
        assert shares[0] <= most[0] and shares[1] <= most[1], shares


def test_sharding(docs, tmp_path):
    rows = corpus()
    out = sharding.shard(docs, shards=4, bucket_bytes=3000)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    by = {}
    for r in got:
        t = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(t) + 8, zlib.crc32(t), "key") and r.grown_shard in (r.shard, 4)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= {0, 1, 2, 3}
    grown = {r.doc_id: r.shard for r in sharding.shard(docs, shards=5, bucket_bytes=3000).collect()}
    assert grown == {r.doc_id: r.grown_shard for r in got}
    again = sharding.shard(docs.repartition(2), shards=4, bucket_bytes=3000).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in again)
    assert sharding.shard(empty(docs)).count() == 0
    sharding.write_shards(docs, str(tmp_path / "s"), shards=4)
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == len(rows)


def test_sharding_of_rows_without_ids(spark, tmp_path):
    """A third of all rows without an id, a third copies of one row: no task holds more than a few buckets."""
    rows = [(None, f"text {i} " + "x" * 80) for i in range(3000)] + [(7, "same " + "y" * 80)] * 3000 + [(i, "z" * 80) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.shard(df, shards=4, bucket_bytes=20_000).withColumn("part", F.spark_partition_id())
    largest = got.groupBy("part").count().agg(F.max("count")).first()[0]
    out = got.collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(out) == 9000 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in out if r.doc_id is None}) == 1 and len({r.shard for r in out if r.doc_id == 7}) == 1
    assert largest < 3000
    sharding.write_shards(df, str(tmp_path / "s"), shards=4, bucket_bytes=20_000)
    assert len(list((tmp_path / "s").glob("shard=*/*.parquet"))) > 4  # more than one task to a shard


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, full = {}, float(sum(sizes.values())), set(names)
    while full:
        level = left / sum(w[s] for s in full)
        over = [s for s in full if level * w[s] > most * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in full}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            full.discard(s)
    return target


def test_mixing(docs, spark):
    rows = corpus()
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = brute_targets(sizes)
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.copies and r.copies in (int(r.rate), int(r.rate) + 1) and r.copies <= 3
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    for r in mixing.plan(many).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t / r.g - 1) < 0.1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    tiny = spark.createDataFrame([("a", 1), ("b", 1000), ("c", 10), (None, 0)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.source_targets(tiny).collect()}
    assert t == pytest.approx(brute_targets({"a": 1, "b": 1000, "c": 10, None: 0}))
    assert mixing.plan(empty(docs)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(0, "u0", "same"), (1, "u1", "same"), (2, "u2", None), (3, None, ""), (4, "u\r\n4", "é" * 70_000), (5, "u5", "same"), (5, "u5", "same"), (None, "x", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    archives = warc.write_archives(pages, archive_bytes=300)
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert len(got) == 7
    for i, _, h in rows:
        body = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        if r.record_type == "response":
            assert bytes(r.payload) == body and r.refers_to is None
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {0: 5, 1: 5, 2: 3}
    warc.export_files(archives, str(tmp_path / "w"))
    names = list((tmp_path / "w").iterdir())
    assert names and all(list(warc.read_archive(n.read_bytes())) for n in names)
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0
    assert warc.deduplicated(pages, min_bytes=1).where("refers_to is not null").count() == 2


def test_warc_validation():
    good = warc.write_archive([warc.record(1, "u", b"payload" * 50), warc.record(2, "v", b"x")])
    assert [h["x-page-id"] for h, _ in warc.read_archive(good)] == ["1", "2"]
    with pytest.raises(ValueError):
        list(warc.read_archive(good[:-3]))
    raw = warc.record(1, "u", b"payload")
    for bad in (raw[:-1], raw.replace(b"payload", b"payl0ad"), raw.replace(b"WARC/1.1", b"HTTP/1.1"), raw.replace(b"Content-Length: 7", b"Content-Length: x"), raw.replace(b"WARC-Date", b"No-Date"), b"WARC/1.1"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    import struct

    import zstandard

    size = struct.unpack("<I", good[4:8])[0]
    packed = zstandard.compress(good[8 : 8 + size])
    again = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + good[8 + size :]
    assert len(list(warc.read_archive(again))) == 2  # a dictionary may be compressed itself


def test_quality(docs, spark):
    extra = [(50, "the quick fox jumps over a lazy dog " * 6, "s1", 0, ""), (51, "a b c d e f g h\n" * 3 + "x " * 30, "s1", 0, ""), (52, "# | # | # | " * 20, "s2", 0, ""), (53, "l1\nl1 \nl1\n\nl1", None, 0, "")]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    rows = corpus() + extra
    got = quality.assess(df).collect()
    assert len(got) == len(rows)
    by = {i: t for i, t, *_ in rows}
    for r in got:
        t = by[r.doc_id] or ""
        w = words(t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        gone = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)} if len(grams) < 1000 else set()
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        if len(grams) < 1000:
            assert r.n_repeat_words == len(gone)
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w)) and (not r.base_failed or not r.kept)
    assert quality.assess(empty(docs)).count() == 0


def test_host_rates_shrink(spark):
    rules = spark.range(1000).select(F.when(F.col("id") < 500, "good").when(F.col("id") < 998, "bad").otherwise("tiny").alias("source"), (F.col("id") >= 500).alias("base_failed"), F.lit(False).alias("strong_failed"))
    rate = {r.host: r.host_rate for r in quality.host_verdicts(rules).collect()}
    assert rate["good"] < 0.05 and rate["bad"] > 0.95 and rate["good"] < rate["tiny"] < rate["bad"]


def test_suspect_hosts_lose_weakly_failing_documents(spark):
    """The same text, with repeated lines enough for the weak rule only, stays on a good host and goes on a bad one."""
    rnd = random.Random(9)
    line = lambda: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(9))
    clean = lambda: "\n".join(line() for _ in range(6))
    lines = [f"x{i} y{i} z{i}" for i in range(6)]
    weak = "\n".join([clean(), *lines, *lines[::-1]])  # a third of its lines repeat, though in no long run of words
    rows = [(i, clean(), "good") for i in range(300)] + [(1000 + i, clean() if i % 2 else "too short", "bad") for i in range(100)] + [(2000 + i, clean(), f"h{i % 20}") for i in range(1000)]
    rows += [(5001, weak, "good"), (5002, weak, "bad")]  # ids that no other row has
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id IN (5001, 5002, 1001)").collect()}
    assert got[5001].weak_failed and got[5002].weak_failed and not got[5002].base_failed and not got[5002].strong_failed
    assert (got[5001].kept, got[5002].kept, got[1001].kept) == (True, False, True)
    assert (got[5001].host_suspect, got[5002].host_suspect) == (False, True)


def test_toxicity_grammar():
    g = toxicity.Grammar({"idiot": 3.0, "trash": 3.0, "clown": 3.0}, {"lowei": 4.0})
    best = lambda t: max(g.clauses(t), default=0.0)
    # an insult needs an aim: a person on either side, a lead, another insult
    assert best("you are an idiot") == pytest.approx(4.5) and best("what an idiot") == best("hey idiot") == pytest.approx(2.4)
    assert best("that idiot there follows him") == pytest.approx(3 * (0.6 * 0.8 + 0.4 * 1.5)) and best("trash idiot") == pytest.approx(3 * 0.8 * 1.6)
    for harmless in ("take out the trash", "the idiot by dostoevsky", "a clown at the circus", "they stab the meat", "it's trash", "that is trash", "idiot", "fine. Idiot! fine", "kill", "one two three idiot four five six seven you"):
        assert best(harmless) == 0, harmless
    # aimed at nobody, insults count where a text has several
    assert g.clauses("an idiot. an idiot! some trash; fine") == pytest.approx([3 * 0.6 * 0.8] * 3) and g.clauses("an idiot. you there. fine") == []
    assert len(g.clauses("you idiot. more trash here")) == 2
    # negation and report change what a match weighs
    assert best("you never an idiot") == pytest.approx(4.5 * 0.25) and best("mary said you an idiot") == pytest.approx(2.25)
    assert best("you said not idiot") == pytest.approx(3 * 1.5 * 0.25 * 0.5)
    # a threat needs a will and a victim
    assert best("I will kill you. fine") == best("te voy a matar") == best("we are going to one beat all them") == pytest.approx(4.5)
    assert best("you they kill") == best("kill you") == best("I will kill time") == best("I will kill one two you") == best("he will it") == 0
    assert best("i will not kill you") == pytest.approx(4.5 * 0.25)
    # endings of stems
    assert best("nothing here. you idiotic") == 0 and best("du LoweiTum und") == pytest.approx(6.0) and best("you lowei") == 0
    assert g.clauses(None) == [] and g.clauses("") == []


@pytest.mark.parametrize("gone", ["_insult", "_threat", "_target", "_negation", "_report"])
def test_each_transducer_matters(gone, monkeypatch):
    texts = ["you are an idiot", "an idiot. an idiot", "you never an idiot", "he said you an idiot", "I will kill you", "idiot"]
    g = toxicity.Grammar({"idiot": 3.0}, {})
    full = [g.clauses(t) for t in texts]
    monkeypatch.setattr(toxicity, gone, lambda state, kind: (0, 0.0 if gone in ("_insult", "_threat") else 1.0))
    toxicity.machine.cache_clear()
    assert [g.clauses(t) for t in texts] != full
    monkeypatch.undo()
    toxicity.machine.cache_clear()


def test_toxicity_learns(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        t = [rnd.choice(vocab) for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):  # one insult that is aimed at nobody is no match
                t.insert(rnd.randint(0, 30), f"grumb{rnd.choice('abcdefgh')}x" if i % 4 else "moron")
        rows.append((i, " ".join(t) if i != 599 else None, "clash"))
        labels.append((i, int(toxic)))
    labels += [(3, None), (None, 1), (9999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.scored(docs, model).join(labels, "doc_id").where(toxicity.held_out() & F.col("toxic").isNotNull()).collect()
    assert len(out) > 80 and sum((r.toxicity >= 0.5) == bool(r.toxic) for r in out) / len(out) > 0.97
    assert any(s.startswith("grum") for s in model.stems)
    assert {zlib.crc32(str(r.doc_id).encode()) % 5 for r in out} == {0}
    assert abs(toxicity.accepted(docs, model).count() - 500) <= 3
    plain = toxicity.fit(docs, labels.where("false"))
    assert 0 <= plain.score(None)[0] < 0.5 <= plain.score("you idiot moron you are scum")[0]
    assert toxicity.scored(docs.where("false"), model).count() == 0
