"""Fill-in-the-middle against a plain version over Python strings."""

import hashlib
import random

import pytest

from loomspark.llm import fim

SENTINELS = fim.SENTINELS


def plain_version(i, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, s, m = SENTINELS
    if h4 % 100 < 20:
        return n, "spm", a, b - a, s + t[b:] + p + t[:a] + m + t[a:b]
    return n, "psm", a, b - a, p + t[:a] + s + t[b:] + m + t[a:b]


def texts():
    rnd = random.Random(11)
    letters = ["a", "é", "漢", "😀", "<", "P", "S", "M", ">", "\n", " ", "\x00", "<P", "S>"]
    out = [None, "", "<P>", "<S", "P>", "<M>x", "a<", "<<P>>", "\U0010ffff", "é" * 1500, "😀" * 5000 + "<P", "x" * 300_000]
    return out + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def rows():
    rows = [(i, t, -1, "clash") for i, t in enumerate(texts())]
    return [*rows, (None, "no id", -1, "clash"), rows[20], rows[20]]


def test_cuts_and_round_trip(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, form string").repartition(3)
    got = fim.fill_in_middle(df)
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = sorted(((i, t, *plain_version(i, t)) for i, t, *_ in rows), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    back = fim.restored(got.withColumnRenamed("text", "was"), name="text")
    assert back.where("coalesce(was, '') <> text").count() == 0 and back.count() == len(rows)
    digests = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.fill_in_middle(df.select("doc_id", "text"), digests=True).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert digests == {(i, sha(plain_version(i, t)[-1]), sha(t or "")) for i, t, *_ in rows}
    forms = {r.form for r in got.select("form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(df).count() == 0 and fim.fill_in_middle(df, digests=True).count() == 0
    assert fim.restored(fim.fill_in_middle(df).drop("text")).count() == 0


def test_scan_across_lanes():
    """Sentinels and code points that straddle the lanes' edges, and a text that ends within a sentinel."""
    for shift in range(8):
        t = ("x" * (1020 + shift) + "<P>" + "é漢😀" * 400 + "<M").encode()
        for other in (b"", b">", "é<S>".encode()):
            counted, over, which = fim.scan(t + fim._BETWEEN + other)
            both = t.decode(), other.decode()
            assert counted[-1] == sum(map(len, both)) and counted[len(t) - 1] == len(both[0])
            found = [(1023 + shift, 0)] + ([(len(t) + 1 + other.index(b"<S>") + 3, 1)] if b"<S>" in other else [])
            assert found == list(zip(over.tolist(), which.tolist()))


def test_other_sentinels_and_faults():
    sentinels = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    texts = ["abc<|fim_".encode(), "<|fim_<|fim_prefix|>".encode(), "né".encode()]
    import numpy as np

    n, units, place, holds = fim.cuts(texts, np.array([[2, 5], [1, 1], [1, 2]]), sentinels)
    assert n.tolist() == [9, 20, 2] and holds.tolist() == [False, True, False] and place[2].tolist() == [1, 3]
    out = fim.joined(texts[0], 2, 5, "spm", sentinels)
    assert fim.rebuilt([out, texts[1]], ["spm", "plain"], sentinels) == texts[:2]
    with pytest.raises(ValueError):
        fim.rebuilt([out], ["psm"], sentinels)
    for bad in (("<a>", "<a>", "<b>"), ("<a>", "x<a>y", "<b>"), ("é", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.automaton(bad)
