"""Suffix-array dedup against a dictionary of all strings; its merge against sorting."""

import hashlib
import random
import time
from collections import Counter
from itertools import groupby

import numpy as np
import pytest

from loomspark.llm import suffix_dedup as sd


def plain_version(texts, length):
    """For each text (n_bytes, n_removed, n_spans, kept)."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(r), sum(gone), sum(k for k, _ in groupby(gone)), bytes(b for b, g in zip(r, gone) if not g)))
    return out


def texts():
    rnd = random.Random(13)
    some = lambda n, letters="abé漢 \n": "".join(rnd.choice(letters) for _ in range(n))
    passage, other = some(40), some(9)
    out = [None, "", "a", "ab" * 60, "a" * 90, "漢" * 30, some(400), passage, passage + some(30), some(30) + passage, some(11) + passage + some(11) + passage[:25], "x" + passage[1:]]
    out += [some(rnd.randint(0, 20)) + other + some(rnd.randint(0, 20)) for _ in range(25)]
    out += [some(12) + passage[rnd.randint(0, 9) : rnd.randint(20, 40)] + some(12) for _ in range(25)]
    return out + [out[8], out[8], out[10]]


@pytest.mark.parametrize("length,spread,batch,room", [(8, 5, 150, 300), (13, 11, 4000, 10**6), (30, 26, 300, 900), (3, 2, 400, 200)])
def test_against_dictionary(spark, length, spread, batch, room):
    some = texts()
    rows = [(i if i % 7 else None, t, 0, "clash") for i, t in enumerate(some)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, kept string").repartition(3)
    got = sd.repeated_strings(df, length, spread, batch_bytes=batch, range_bytes=room)
    want = sorted(zip(some, plain_version(some, length)), key=str)
    rows = got.select("text", "n_bytes", "n_removed", "n_spans", "kept", "removed").collect()
    assert sorted(((r.text, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in rows), key=str) == want
    for r in rows:
        raw = (r.text or "").encode()
        spans = [(s.first, s.last) for s in r.removed]
        assert sum(b - a + 1 for a, b in spans) == r.n_removed and all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert b"".join(raw[a:b] for a, b in zip([0, *(y + 1 for _, y in spans)], [*(x for x, _ in spans), len(raw)])) == bytes(r.kept)


def test_long_texts_and_empty_table(spark, tmp_path):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    some = [long, long[1000:1150], "head " + long[5000:5200] + " tail", long[9000:9300] + "|" + long[20_000:20_199], "é" * 99, "é" * 101]
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in sd.op13_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for i, x in enumerate(plain_version(some, 200))}
    assert sd.repeated_strings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merge_never_compares_known_bytes():
    rnd = random.Random(7)
    pool = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 30))).encode() for _ in range(300)]
    for n in (1, 2, 3, 7):
        runs = [sorted(rnd.choices(pool, k=rnd.randint(0, 60))) for _ in range(n)]
        runs[-1] = []
        if not any(runs):
            continue
        shared = [[0, *map(sd.common, r, r[1:])][: len(r)] for r in runs]
        at, out, known = [0] * n, [], []
        for run, m in sd.LoserTree(runs, shared):
            out.append(runs[run][at[run]])
            known.append(m)
            at[run] += 1
        assert out == sorted(x for r in runs for x in r)
        assert known[1:] == list(map(sd.common, out, out[1:]))
        most, first, last = sd.longest_shared(runs, shared)
        everything = sorted(x for r in runs for x in r)
        for r, m in zip(runs, most):
            for s, k in zip(r, m.tolist()):
                others = everything.copy()
                others.remove(s)
                assert k == max((sd.common(s, o) for o in others), default=0)
        assert runs[first[0]][first[1]] == out[0] and runs[last[0]][last[1]] == out[-1]
    # Strings of one run that share ever more with the last are given without any comparison of bytes.
    tree = sd.LoserTree([[b"a" * i for i in range(1, 50)], [b"z"]], [[0, *range(1, 49)], [0]])
    assert len(list(tree)) == 50 and tree.compared <= 2


def test_runs_and_ranges():
    rnd = random.Random(9)
    strings = sorted({bytes(rnd.choices(b"abc", k=rnd.randint(1, 9))) for _ in range(200)})
    assert sd.decoded(sd.front_coded(strings))[0] == strings and sd.decoded(sd.front_coded([]))[0] == []
    hot = strings[70]
    splitters = sorted([strings[10], b"aab", hot, hot, hot, strings[150]])
    homes = set()
    for turn in range(6):
        pieces = sd.dealt(strings, splitters, turn)
        assert [r for r, *_ in pieces] == sorted({r for r, *_ in pieces})
        assert [s for _, a, b in pieces for s in strings[a:b]] == strings
        homes.add(next(r for r, a, b in pieces if hot in strings[a:b]))
        for r, a, b in pieces:
            for s in strings[a:b]:
                assert (r == 0 or splitters[r - 1] <= s) and (r == len(splitters) or s <= splitters[r])
    assert len(homes) == 3


def test_places_follow_the_text():
    rnd = random.Random(1)
    passage = bytes(rnd.choices(b"abcdefgh ", k=700))
    room = [bytes(rnd.choices(b"abcdefgh ", k=n)) for n in (301, 95, 0)]
    found = []
    for before in room:
        data = np.frombuffer(before + passage, np.uint8)
        b, lo, hi = sd.chosen(data, np.array([0, len(before), len(data)]), 200, 96, 16)
        inside = b[(lo <= hi) & (lo >= len(before))] - len(before)
        found.append(inside.tolist())
        at = {p: x for x, y, z in zip(b, lo, hi) for p in range(y, z + 1)}
        assert set(at) == {*range(max(0, len(before) - 199)), *range(len(before), len(data) - 199)} and all(p <= x < p + 96 for p, x in at.items())
    assert found[0] == found[1] == found[2]


def test_lookups_do_not_go_through_what_is_known():
    """A range has a parcel for each batch: what a parcel costs must not grow with the range's keys."""
    known = np.arange(0, 6_000_000, 3, dtype=np.uint64)
    parcels = [np.arange(k, k + 40, dtype=np.uint64) for k in range(0, 8000, 4)]
    began = time.process_time()
    hits = [sd.among(p, known) for p in parcels]
    assert time.process_time() - began < 2  # np.isin took 0.05 s and more for each of the 2,000
    assert all((h == (p % 3 == 0)).all() for h, p in zip(hits, parcels))
    assert not sd.among(parcels[0], known[:0]).any() and not sd.among(known[-1:] + np.uint64(1), known).any()


@pytest.mark.parametrize("size", [3, 8, 13])
@pytest.mark.parametrize("like", [None, 5, 1])
def test_recurring_against_counts(monkeypatch, size, like):
    """Also where unlike strings have one hash."""
    if like:
        plain = sd.string_hashes
        monkeypatch.setattr(sd, "string_hashes", lambda *a: plain(*a) % np.uint64(like))
    rnd = random.Random(size)
    raw = bytes(rnd.choice(b"ab") for _ in range(300)) * 2 + bytes(rnd.choice(b"abcdef") for _ in range(600))
    at = np.array(sorted(rnd.sample(range(len(raw) - size), 500)))
    known = np.array([rnd.random() < 0.1 for _ in at])
    count = Counter(raw[a : a + size] for a in at)
    told = sd.recurring(np.frombuffer(raw + bytes(8), np.uint8), at, size, known)
    assert told.tolist() == [bool(k) or count[raw[a : a + size]] > 1 for a, k in zip(at, known)]
    none = np.zeros(0, np.int64)
    assert not len(sd.recurring(np.frombuffer(raw, np.uint8), none, size, none.astype(bool)))
