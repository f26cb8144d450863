"""Queries with SQL agree with DuckDB; the pipeline's stages against what they promise."""

import base64
import hashlib
import math
import re
import zlib

import duckdb
import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import license_scan, registry, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cursor = c.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    ours = sorted(str([plain(r[n]) for n in names]) for r in df.collect())
    assert ours == sorted(str([plain(v) for v in r]) for r in cursor.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF).cache()
        if name != "bpe":
            assert docs.columns == columns
        if name in ("toxicity", "near_duplicates"):
            assert 0 < docs.count() <= n and docs.join(before, ["doc_id", "text"], "left_anti").count() == 0
        if name == "substring_dedup":
            again = substring_dedup.repeated(before, window=corpus_pipeline.PASSAGE).where("n_removed = 0").select("doc_id", "text")
            assert again.join(docs, ["doc_id", "text"], "left_anti").count() == 0
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        n = docs.count()
    assert docs.where("NOT round_trip").count() == 0 and n > 0


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_bpe_query_rows(spark):
    with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = {i: enc.encode_ordinary(t) for i, t in documents(spark).items()}
    want = {(i, len(x), sha(" ".join(map(str, x)).encode()), sha(enc.decode_bytes(x))) for i, x in ids.items()}
    rows = registry.QUERIES["op10_bpe"](spark, SF).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def descended(tokens):
    """(licences, chosen, permitted) of a licence expression by recursive descent; None if it isn't one."""
    at = 0

    def level(k):
        nonlocal at
        if k == 3:
            if at < len(tokens) and tokens[at] == "(":
                at += 1
                out = level(0)
                if at >= len(tokens) or tokens[at] != ")":
                    raise ValueError
                at += 1
                return out
            if at >= len(tokens) or tokens[at] in ("and", "or", "with", "(", ")") or not re.fullmatch(r"[a-z0-9.+:-]+", tokens[at]):
                raise ValueError
            name = license_scan.ALIASES.get(tokens[at], tokens[at])
            at += 1
            return {name}, [name], name in license_scan.ALLOWED
        out = level(k + 1)
        while at < len(tokens) and tokens[at] == ("or", "and", "with")[k]:
            at += 1
            more = level(k + 1)
            if k == 0:
                first = (out[2], -len(out[1])) >= (more[2], -len(more[1]))
                out = (out[0] | more[0], *(out if first else more)[1:])
            elif k == 1:
                out = out[0] | more[0], out[1] + [x for x in more[1] if x not in out[1]], out[2] and more[2]
        return out

    try:
        out = level(0)
    except ValueError:
        return None
    return out if at == len(tokens) else None


def plain_expression(line):
    """What stands behind a tag on its line: all of it, or the longest expression of identifiers that it begins with."""
    raw = re.findall(r"[()]|[^\s()]+", re.sub(r"^[ \t]*[:=]?[ \t]*", "", line))
    ends = re.compile(r"(?:\*/|-->|[,;.\"'`*#])+$")
    clean = [t if t in "()" else ends.sub("", t) for t in raw]
    body = [t for t in clean if t]
    stop = next((i for i, t in enumerate(raw) if t not in "()" and clean[i] != t), None)  # what ends a sentence ends the expression
    if body and (stop is None or not any(clean[stop + 1 :])) and (found := descended(body)):
        return found
    if stop is not None:
        clean = clean[: stop + 1]
    upto = next((i for i, t in enumerate(clean) if t not in ("(", ")", "and", "or", "with") and not license_scan.looks_like(t)), len(clean))
    some = clean[:upto]
    twice = any(a in ("and", "or", "with") and b in ("and", "or", "with") for a, b in zip(some, some[1:]))
    if twice or upto == len(clean) and some and some[-1] in ("and", "or", "with"):
        return None
    return next((found for k in range(len(some), 0, -1) if (found := descended(some[:k]))), None)


def plain_licenses(text):
    """Phrases by comparing words at every place, expressions by recursive descent."""
    t = "".join(c.lower() if c < "\x7f" else c for c in text)
    words = [(m[0], m.end()) for m in re.finditer(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)]
    w = [x for x, _ in words]
    places = lambda phrase: [k for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    base = sorted((k, x) for p, x in license_scan.BASE.items() for k in places(p))
    labels, kinds = {x for _, x in base}, {"base"} if base else set()
    for p, x in license_scan.NOTICES.items():
        if places(p):
            labels.add(x)
            kinds.add("notice")
    chosen, permitted = set(), []
    for tag in license_scan.TAGS:
        for k in places(tag):
            end = words[k + len(tag.split()) - 1][1]
            found = plain_expression(re.split(r"[\r\n]", t[end:], maxsplit=1)[0])
            if found:
                labels |= found[0]
                chosen |= set(found[1])
                permitted.append(found[2])
                kinds.add("tag")
    at = [k for k, _ in base]
    score = 1 - math.prod(1 - license_scan.SURE[k] for k in sorted(kinds))
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 12), ",".join(sorted(chosen)), all(permitted) if permitted else None


LINES = [
    "MIT", "MIT OR GPL-3.0-only", "(MIT AND BSD-3-Clause) or apache-2.0", "GPL-2.0-only WITH Classpath-exception-2.0 and mit", "mit or or bsd-2-clause", "mit and", "(mit", "mit)", "Apache-2.0.", "Apache-2.0 is what we use",
    "mit */", "gpl-3.0-only or (mit and isc) or zlib", "LicenseRef-own and mit", "prose only here", "apache-2.0, then mit", "(mit or isc) and (bsd-2-clause or gpl-3.0-only)", "mit bsd-3-clause", "= mit -->", "",
]


def test_license_query_rows(spark, tmp_path):
    made = {100_000 + i: f"head\n// SPDX-License-Identifier: {x}\nunder the MIT license tail" for i, x in enumerate(LINES)} | {200_000: "License-Expression: mit\n cc by\nnc cc by nc. Mozilla public license", 200_001: ""}
    docs = documents(spark) | made
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = registry.QUERIES["op3_licenses"](spark, str(tmp_path)).collect()
    got = {r.doc_id: (*tuple(r)[1:7], round(r.score, 12), r.chosen, r.permitted) for r in rows}
    assert len(rows) == len(docs)
    for i, t in docs.items():
        assert got[i] == plain_licenses(t), (i, t[-80:])


def test_sharding_query_rows(spark):
    texts = documents(spark)
    rows = registry.QUERIES["op6_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key") and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def plain_clause(kinds):
    """A clause's score by looking around every word, without states: (score, aimed, insults)."""
    t = toxicity
    people = (t.SUBJECT, t.OBJECT, t.PERSON)
    is_ = [k for k, _ in kinds]
    within = lambda i, n, some: any(is_[j] in some for j in range(max(0, i - n), i))

    def weight(i):
        """What target, negation and report make of a word at i."""
        near = is_[i] in people or within(i, t.REACH, people)
        out = 1.5 if near else 0.8
        # A negation's scope, which no other word ends; the negation itself is outside of it.
        if is_[i] != t.NEGATION and within(i, 3, (t.NEGATION,)):
            out *= 0.25
        if is_[i] != t.REPORT and t.REPORT in is_[:i]:
            out *= 0.5
        return out

    score, aimed, insults = 0.0, False, 0
    lacking = None  # the last insult that nobody is aimed at yet
    for i, (k, w) in enumerate(kinds):
        if k == t.INSULT:
            insults += 1
            # A lead aims the next two words, unless a person or an insult before it reached further and it cut that short.
            last = next((j for j in range(i - 1, -1, -1) if is_[j] in (*people, t.INSULT, t.LEAD)), None)
            aims = last is not None and i - last <= (2 if is_[last] == t.LEAD else t.REACH)
            score += weight(i) * w * (1.0 if aims else t.UNAIMED)
            aimed = aimed or aims
            lacking = None if aims else i
        elif k in people and lacking is not None:
            if i - lacking <= t.REACH:
                score += weight(i) * kinds[lacking][1] * (1 - t.UNAIMED)
                aimed = True
            lacking = None
        if k == t.THREAT and within(i, t.REACH, (t.WILL,)):
            hit = i if within(i, t.REACH, (t.OBJECT,)) else next((j for j in range(i + 1, min(len(is_), i + 1 + t.STRIKES)) if is_[j] in (t.OBJECT, t.PERSON, t.THREAT)), None)
            if hit is not None and (hit == i or is_[hit] != t.THREAT):
                score += weight(hit) * t.SEED_WEIGHT
                aimed = True
    return score, aimed, insults


def plain_toxicity(model, text):
    """Clauses by regular expressions, classes by look-up, and the logistic function."""
    t = toxicity
    listed = {w: k for k, some in ((t.WILL, t.WILLS), (t.LEAD, t.LEADS), (t.REPORT, t.REPORTS), (t.NEGATION, t.NEGATIONS), (t.SUBJECT, t.SUBJECTS), (t.OBJECT, t.OBJECTS), (t.PERSON, t.PERSONS), (t.THREAT, t.THREATS)) for w in some}

    def kind(word):
        if word in model.words:
            return t.INSULT, model.words[word]
        if word in listed:
            return listed[word], 0.0
        stem = max((s for s in model.stems if word.startswith(s) and len(word.encode()) > len(s.encode())), key=lambda s: len(s.encode()), default=None)
        return (t.INSULT, model.stems[stem]) if stem else (t.OTHER, 0.0)

    plain = (text or "").replace("\u2019", "'").replace("\u2026", ".").lower()
    found = [plain_clause([kind(w) for w in re.findall(r"[a-z'\u0080-\U0010ffff]+", re.sub("[\u201c\u201d\u00ab\u00bb\u201e\u2014\u2013\u00a0\u00bf\u00a1]", " ", c))]) for c in re.split(r"[.!?;\n]", plain)]
    scores = [s for s, *_ in found if s > 0]
    if not any(a for _, a, _ in found) and sum(n for *_, n in found) < 2:
        scores = []
    z = model.weights[0] + model.weights[1] * max(scores, default=0.0) + model.weights[2] * math.log1p(sum(scores))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxicity_query_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    want = {}
    for i, t in documents(spark).items():
        score = plain_toxicity(model, t)
        want[i] = (zlib.crc32(str(i).encode()) % 5 == 0, round(score, 9), int(score >= 0.5))
    rows = registry.QUERIES["op1_toxicity"](spark, SF).collect()
    assert len(rows) == len(want) and {r.doc_id: (r.held_out, round(r.score, 9), r.predicted) for r in rows} == want
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped)
    assert (again.words, again.stems, again.weights) == (model.words, model.stems, model.weights)
    for harmless in ("take out the trash", "the idiot by dostoevsky", "a clown at the circus", "they stab the meat", "it's a stupid idea"):
        assert model.score(harmless)[0] < 0.5
    for toxic in ("you are an idiot", "such a moron", "I will hurt you"):
        assert model.score(toxic)[0] >= 0.5


def test_toxicity_machine_against_words_around():
    """The composed machine and the plain version agree on clauses of random words of all classes."""
    import random

    rnd = random.Random(8)
    words = ["w", "x", "idiot", "scum", "kill", "he", "him", "you", "never", "said", "such", "will", "dullx"]
    model = toxicity.Model({"idiot": 3.0, "scum": 2.0}, {"dull": 4.0}, (-3.0, 0.8, 0.8))
    for _ in range(3000):
        text = ". ".join(" ".join(rnd.choices(words, k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 2)))
        assert model.score(text)[0] == pytest.approx(plain_toxicity(model, text), abs=1e-9), text


def test_license_query_evaluates(spark, tmp_path):
    rows = [(1, "SPDX-License-Identifier: MIT OR GPL-3.0-only"), (2, "SPDX-License-Identifier: MIT AND GPL-3.0-only"), (3, "none"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.labels, r.chosen, r.permitted) for r in registry.QUERIES["op3_licenses"](spark, str(tmp_path)).collect()}
    assert got == {1: ("gpl-3.0-only,mit", "mit", True), 2: ("gpl-3.0-only,mit", "gpl-3.0-only,mit", False), 3: ("", "", None), 4: ("", "", None)}
