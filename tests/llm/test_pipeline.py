"""The pipeline's stages, one by one, against brute force on a small corpus with planted cases."""

import base64
import hashlib
import random

import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import common, toxicity
from tests.llm.test_operators import brute_components, brute_targets, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Clean texts, toxic ones, exact and near copies, shared passages of 60 words, nulls, empty and long texts."""
    rnd = random.Random(21)
    vocab = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nü", "Pa", "qu", "re") for b in ("ra", "st", "ti", "ux", "ve", "é", "", "nn")]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    rows, toxic = [], set()
    passage = text(60)
    for i in range(240):
        t = text(rnd.randint(30, 90))
        if i % 8 == 3:
            at = rnd.randint(1, len(t))
            t[at:at] = ["you", "moron", "scum"]
            toxic.add(i)
        elif i % 16 == 5:
            t = t[:20] + passage + t[20:]
        rows.append((i, " ".join(t)))
    base = text(80)
    for i in range(240, 260):  # near copies, a chain
        base[(i * 7) % 80] = f"z{i}"
        rows.append((i, " ".join(base)))
    rows += [(i, rows[10][1]) for i in range(260, 270)] + [(270, None), (271, ""), (272, " \n"), (273, "one"), (274, " ".join(text(4000))), (275, " ".join(passage)), (None, rows[0][1])]
    return [(i, t, "en", f"s{k % 4}" if k % 9 else None, len(t or "")) for k, (i, t) in enumerate(rows)], toxic


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows, toxic = corpus()
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def as_rows(df):
    return sorted(df.collect(), key=str)


def brute_passages(rows, window):
    """(doc_id, text) of what stays; null ids come last and repeat nothing of each other."""
    late = float("inf")
    least = {}
    for r in rows:
        w = words(r.text)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, late), late if r.doc_id is None else r.doc_id)
    out = []
    for r in rows:
        w, gone = words(r.text), set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (late if r.doc_id is None else r.doc_id):
                gone |= set(range(k, k + window))
        left = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r.text
        if not gone or left:
            out.append((r.doc_id, left, r.lang, r.source, len(left) if gone else r.n_chars))
    return sorted(out, key=str)


def brute_mix(rows):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    target = brute_targets(sizes)
    out = []
    for r in rows:
        rate = min(target[r.source] / sizes[r.source], 3.0) if sizes[r.source] else 1.0
        drawn = hashlib.md5("|".join(["29", "" if r.doc_id is None else str(r.doc_id), r.text or ""]).encode()).hexdigest()
        out += [tuple(r)] * (int(rate) + (int(drawn[:13], 16) / 2**52 < rate - int(rate)))
    return sorted(out, key=str)


def test_stages_against_brute_force(spark, sf_dir):
    _, toxic = corpus()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "substring_dedup", "mixing", "bpe"]
    docs = common.load(spark, sf_dir, "documents")
    rows = as_rows(docs)

    model = toxicity.fit(docs, common.load(spark, sf_dir, "labels"))
    docs = common.materialize(stages["toxicity"](spark, docs, sf_dir))
    kept = as_rows(docs)
    assert kept == [r for r in rows if model.score(r.text)[0] < 0.5] and docs.columns == list(corpus_pipeline.COLUMNS)
    assert {r.doc_id for r in rows} - {r.doc_id for r in kept} == toxic

    docs = common.materialize(stages["near_duplicates"](spark, docs, sf_dir))
    root = brute_components({r.doc_id: r.text for r in kept if r.doc_id is not None}, 5, 80)
    kept = [r for r in kept if r.doc_id is None or root[r.doc_id][1] == r.doc_id]
    assert as_rows(docs) == kept and 0 < len(kept) < len(rows) - len(toxic) - 20

    docs = common.materialize(stages["substring_dedup"](spark, docs, sf_dir))
    want = brute_passages(kept, corpus_pipeline.PASSAGE)
    assert [tuple(r) for r in as_rows(docs)] == want and want != [tuple(r) for r in kept]
    kept = as_rows(docs)

    docs = common.materialize(stages["mixing"](spark, docs, sf_dir))
    assert [tuple(r) for r in as_rows(docs)] == brute_mix(kept)

    with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = stages["bpe"](spark, docs, sf_dir).select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip").collect()
    expected = [(r.doc_id, r.lang, r.source, len(x), x, True) for r in docs.collect() for x in [enc.encode_ordinary(r.text or "")]]
    assert sorted(map(str, map(tuple, coded))) == sorted(map(str, expected))


def test_two_runs_at_once_and_what_they_leave(spark, sf_dir):
    from concurrent.futures import ThreadPoolExecutor

    def run(_):
        with common.Tables(spark) as own:
            out = corpus_pipeline.run(spark, sf_dir).collect()
            assert len(own.paths) == 1  # the last stage's input
        return out

    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(run, range(2))
    assert sorted(map(str, one)) == sorted(map(str, two))
    ids = {r.doc_id for r in one}
    assert not ids & set(range(260, 270)) and not ids & corpus()[1] and all(r.round_trip for r in one)


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = common.load(spark, sf_dir, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_keep_clashing_columns_out(spark, sf_dir):
    docs = common.load(spark, sf_dir, "documents").limit(40).withColumns({c: F.lit("clash") for c in ("kept", "n_words", "size", "toxicity", "ids")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == list(corpus_pipeline.COLUMNS), name
