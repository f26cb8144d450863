"""BPE in rounds: differences against recounting, order against one merge at a time, and against the library."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import merging, tokenizer


def pair_counts(sym, word, n):
    out = Counter()
    for i in range(len(sym) - 1):
        if word[i] == word[i + 1]:
            out[int(sym[i]), int(sym[i + 1])] += int(n[word[i]])
    return out


def one_merge(sym, word, a, b, new):
    out, owner, i = [], [], 0
    while i < len(sym):
        if i + 1 < len(sym) and sym[i] == a and sym[i + 1] == b and word[i] == word[i + 1]:
            out.append(new)
            owner.append(word[i])
            i += 2
        else:
            out.append(sym[i])
            owner.append(word[i])
            i += 1
    return np.array(out, np.int64), np.array(owner, np.int64)


def test_differences_at_every_step():
    rnd = random.Random(2)
    for trial in range(200):
        letters = rnd.randint(2, 6)
        words = [[rnd.randrange(letters) for _ in range(rnd.randint(1, 12))] for _ in range(rnd.randint(1, 8))]
        sym = np.array([s for w in words for s in w], np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        n = np.array([rnd.randint(1, 5) for _ in words])
        top = [(1, rnd.randrange(letters), rnd.randrange(letters)) for _ in range(8)]
        tokens = [bytes([k]) for k in range(letters)]
        some = merging.apart(top, 5, {}, tokens)
        pairs = np.array([(a, b) for _, a, b in some])
        assert all(c != b and d != a for i, (_, a, b) in enumerate(some) for _, c, d in some[i + 1 :])
        at, which = merging.matches(sym, word, pairs)
        step, a, b, d = merging.differences(sym, word, n[word], at, which, letters)
        counts = pair_counts(sym, word, n)
        now, owner = sym, word
        for k, (x, y) in enumerate(pairs.tolist()):
            now, owner = one_merge(now, owner, x, y, letters + k)
            for i in np.flatnonzero(step == k):
                counts[int(a[i]), int(b[i])] += int(d[i])
            assert +counts == pair_counts(now, owner, n), trial
        both = merging.merged(sym, word, at, letters + which)
        assert both[0].tolist() == now.tolist() and both[1].tolist() == owner.tolist()


TEXTS = ["low lower lowest newest widest  newer", "aaaa aaa aaaaaaa banana", "x = f(x)  # 2024 2025", "naïve 漢字漢字", "the then there these theses", "ababab abab cdcd abcdabcd"]


@pytest.mark.parametrize("every", [2, 50])
def test_rounds_give_the_sequence(spark, every):
    rnd = random.Random(every)
    rows = [(" ".join(rnd.choices(" ".join(TEXTS).split(), k=8)),) for _ in range(60)] + [(t,) for t in TEXTS]
    counts = tokenizer.pretoken_counts(spark.createDataFrame(rows, "text string")).cache()
    plain = tokenizer.train([(r.pretoken, r.n) for r in counts.collect()], 310)
    ids, merges = merging.train_in_rounds(counts, tokenizer.ALPHABET, 4, 310, top=12, every=every)
    assert merges == plain.merges and ids == plain.ids and len(merges) > 40


def test_library_and_limits(spark):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

    rows = [(t,) for t in TEXTS * 3]
    lib = Tokenizer(models.BPE())
    lib.pre_tokenizer, lib.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    lib.train_from_iterator([t for t, in rows], trainers.BpeTrainer(vocab_size=295, min_frequency=2, special_tokens=list(tokenizer.SPECIALS), initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    df = spark.createDataFrame(rows, "text string")
    vocab = tokenizer.train_on(df, 295, most_words=0)
    assert all(vocab.encode(t) == lib.encode(t).ids for t in TEXTS) and vocab.size == 295
    none = tokenizer.train_on(df.where("false"), 295, most_words=-1)
    assert none.merges == [] and none.size == 260
    assert tokenizer.train_on(df.select(F.lit("q").alias("text")), 400, most_words=0).merges == []


def test_cache_keeps_what_is_met_again(monkeypatch):
    import pickle

    vocab = tokenizer.train([("abab", 5), (" ab", 3)], 264)
    monkeypatch.setattr(tokenizer, "CACHED", 3)
    text = " ".join(f"ab{chr(97 + i % 26)}" for i in range(200))
    for _ in range(2):
        ids = vocab.encode(text)
        assert vocab.decode(ids) == text and len(vocab._cache) <= 3 and len(vocab._older) <= 3
    assert ids == tokenizer.Vocabulary(vocab.ids, vocab.merges).encode(text) and pickle.loads(pickle.dumps(vocab))._cache == {}


def test_new_pieces_are_merged_at_once():
    """What the cache lacks is merged in arrays, equal to one by one; long ones and repeated letters too."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcé漢 x") for _ in range(rnd.randint(1, 12))) for _ in range(2000)] + ["a" * 301, "ab" * 200]
    vocab = tokenizer.train([(w, rnd.randint(1, 9)) for w in sorted(set(words))], 500)
    alone = []
    vocab._parts, one_by_one = lambda piece: alone.append(piece), vocab._parts
    texts = [" ".join(rnd.choices(words, k=40)) for _ in range(50)] + ["", words[-1]]
    got = vocab.encode_all(texts)
    assert not alone and [len(x) for x in got]
    vocab._parts = one_by_one
    assert [x.tolist() for x in got] == [vocab.encode(t) for t in texts]
    data, ends = vocab.spelled(np.concatenate(got))
    assert data.tobytes() == "".join(texts).encode() and ends[-1] == len(data)
    assert vocab.merge_all([b"", b"a"]) == [b"", np.int32(vocab.ids[b"a"]).tobytes()] and vocab.merge_all([]) == []


def test_tasks_add_before_they_send():
    rnd = np.random.default_rng(5)
    parts = [tuple(rnd.integers(0, k, 900) for k in (3, 40, 40)) + (rnd.integers(-2, 3, 900),) for _ in range(300)]
    want = Counter()
    for part in parts:
        for *key, d in zip(*(x.tolist() for x in part)):
            want[tuple(key)] += d
    sent = list(merging.added_up(iter(parts), 10_000))
    assert len(sent) == 1 and len(sent[0][0]) <= 3 * 40 * 40
    assert {(s, a, b): d for s, a, b, d in zip(*(x.tolist() for x in sent[0]))} == {k: d for k, d in want.items() if d}


class _Lossy(tokenizer.Vocabulary):
    def decode(self, ids):
        return super().decode(ids).replace("b", "")


def test_round_trip_asks_the_tokenizer_itself(spark):
    """What overrides coding isn't passed by."""
    plain = tokenizer.train([("ab", 3), ("a", 1)], 262)
    df = spark.createDataFrame([("ab",), ("a",), (None,)], "text string")
    lossy = _Lossy(plain.ids, plain.merges)
    assert [tokenizer.round_trip(df, v).first()["failed"] for v in (plain, lossy)] == [0, 1]
