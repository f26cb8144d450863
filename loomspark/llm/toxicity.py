"""Toxicity: a weighted finite-state pattern grammar over clauses.

Five small transducers read a clause's word classes and are composed once into one machine, whose output is the
clause's score. What scores are patterns:

- insult: an insult that is aimed, that is, with a person at most four words before or behind it, behind such, what or
  a call ("such a ...", "what a ...", "hey ..."), or heaped on another insult. An insult that is aimed at nobody weighs
  0.6, and nothing at all where it is its text's only insult and nothing there is aimed;
- threat: somebody's will, then a threat, then its victim at most two words behind ("I will ... you"), or an object
  pronoun before it ("te voy a ..."). Pronouns that do the deed, it's, that, is and are no victims;
- target: what falls near a person weighs half more, what has none 0.8;
- negation: what falls in the three words behind one weighs a quarter;
- reported speech: what falls behind a verb of speech weighs half.

So a word list alone scores nothing: every score is the output of a matched pattern. A document's
features are its best clause and the sum over its clauses; a logistic model turns them into a score.

Insult words and stems come from a seed list and from labelled documents: words, and beginnings of
words, whose document counts differ between the labels by more than chance allows. Words with more than
5 % as many clean as toxic documents (beginnings: 60 %) are left out, and with them insults that clean texts
often negate or quote. Labels are read
only from training rows (crc32 of the id modulo 5 is not 0), from a sample of at most ``sample_rows``
of them, which is the bound of what is fitted; labels, languages, sources and ids are no inputs.

Nulls and empty texts have no clause and get the model's score for that. Texts of any length are
scanned whole. Repeated rows score alike; of a document each distinct label counts once, and of several texts under one
id the least is learned from. Without
labels the seed grammar scores with fixed weights. An empty table gives no rows. All input columns are
kept; those named like a result column are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, load, materialize, slices

OTHER, INSULT, THREAT, SUBJECT, OBJECT, PERSON, NEGATION, REPORT, LEAD, WILL = range(10)
#: Words between an insult and a person, and between a will and a threat.
REACH = 4
#: Words between a threat and its victim behind it.
STRIKES = 2
#: What an insult weighs that is aimed at nobody.
UNAIMED = 0.6
INSULTS = "idiot idiots moron morons loser losers scum trash pathetic worthless stupid disgusting clown dumb fool jerk bastard idiota imbécil estúpido estúpida asqueroso basura dummkopf arschloch abschaum wertlos imbécile abruti connard crétin salaud".split()
THREATS = "kill hurt destroy beat stab shoot punch burn matar golpear umbringen töten verletzen tuer frapper".split()
#: Persons who act, who suffer, and who may do either.
SUBJECTS = "he she they tú tu du sie il elle eres".split()
OBJECTS = "him her them dich euch ihn te os toi".split()
PERSONS = "you your you're vous usted ustedes ihr".split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't nicht kein keine nie ni nunca jamás pas jamais aucun".split()
REPORTS = "said says wrote claimed called quoted quote reported according dijo llamó sagte schrieb nannte dit écrit appelé".split()
LEADS = "such what hey qué quel quelle welch".split()
WILLS = "i we i'll we'll i'm will gonna going shall would voy vamos werde werden vais allons".split()
SEED_WEIGHT = 3.0
_PLAIN = str.maketrans({"’": "'", "“": " ", "”": " ", "«": " ", "»": " ", "„": " ", "…": ".", "—": " ", "–": " ", " ": " ", "¿": " ", "¡": " "})
#: Bytes of lower-case text: letters and apostrophes stay, clause ends become full stops, the rest spaces.
_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 or b == 39 else 46 if b in b".!?;\n" else 32 for b in range(256))


# --- transducers: each starts in state 0
# Matchers: step(state, class) -> (state, what comes out). Weighers: step(state, class) -> (state, factor).
def _insult(state: int, kind: int) -> tuple[int, float]:
    """Passes the last insult's weight, or what an unaimed one lacks once a person follows. States: words in which a person,
    a lead or an insult still aims the next insult, and words in which a person still aims the last."""
    aims, lacks = divmod(state, REACH + 1)
    out = 0.0
    if kind == INSULT:
        out = 1.0 if aims else UNAIMED
        aims, lacks = REACH, 0 if aims else REACH
    elif kind in (SUBJECT, OBJECT, PERSON):
        out = 1.0 - UNAIMED if lacks else 0.0
        aims, lacks = REACH, 0
    else:
        aims, lacks = (2 if kind == LEAD else max(0, aims - 1)), max(0, lacks - 1)
    return aims * (REACH + 1) + lacks, out


def _threat(state: int, kind: int) -> tuple[int, float]:
    """Puts out a threat once it has its victim. States: words in which a will still holds, in which an object still is
    a threat's victim, and in which a threat still finds one."""
    rest, strikes = divmod(state, STRIKES + 1)
    will, victim = divmod(rest, REACH + 1)
    out = 0.0
    if kind == THREAT:
        out = 1.0 if will and victim else 0.0
        strikes = STRIKES if will and not victim else 0
    elif kind in (OBJECT, PERSON) and strikes:
        out, strikes = 1.0, 0
    else:
        strikes = max(0, strikes - 1)
    will = REACH if kind == WILL else max(0, will - 1)
    victim = REACH if kind == OBJECT else max(0, victim - 1)
    return (will * (REACH + 1) + victim) * (STRIKES + 1) + strikes, out


def _target(state: int, kind: int) -> tuple[int, float]:
    """Near a person (REACH words) a word weighs half more; far from any, 0.8."""
    if kind in (SUBJECT, OBJECT, PERSON):
        return REACH, 1.5
    return max(0, state - 1), 1.5 if state else 0.8


def _negation(state: int, kind: int) -> tuple[int, float]:
    """A negation's scope is three words."""
    if kind == NEGATION:
        return 3, 1.0
    return max(0, state - 1), 0.25 if state else 1.0


def _report(state: int, kind: int) -> tuple[int, float]:
    """From a verb of speech to the clause's end, words are somebody else's."""
    return (1, 1.0) if kind == REPORT else (state, 0.5 if state else 1.0)


def compose(insult, threat, *weighers) -> dict[tuple[int, int], tuple[int, float, float, bool]]:
    """The product of two matchers and of weighers of what they put out, over the states that can be reached:
    (state, class) -> (state, factor of the last insult's weight, factor of a threat's, whether something is aimed)."""
    start = (0,) * (2 + len(weighers))
    number, queue, table = {start: 0}, [start], {}
    fresh = count(1)
    while queue:
        states = queue.pop()
        for kind in range(10):
            out = [step(s, kind) for step, s in zip((insult, threat, *weighers), states)]
            to, factor = tuple(s for s, _ in out), float(np.prod([f for _, f in out[2:]]))
            if to not in number:
                number[to] = next(fresh)
                queue.append(to)
            aimed = out[1][1] > 0 or out[0][1] > 0 and (kind != INSULT or out[0][1] == 1.0)
            table[number[states], kind] = number[to], out[0][1] * factor, out[1][1] * factor, aimed
    return table


@lru_cache(1)
def machine():
    return compose(_insult, _threat, _target, _negation, _report)


def clause_score(kinds: list[tuple[int, float]]) -> tuple[float, bool, int]:
    """What the machine puts out for a clause's (class, weight) pairs, whether any of it is aimed, and the insults."""
    table, state, score, aimed, insults, held = machine(), 0, 0.0, False, 0, 0.0
    for kind, weight in kinds:
        if kind == INSULT:
            insults, held = insults + 1, weight
        state, insult, threat, hits = table[state, kind]
        score += insult * held + threat * SEED_WEIGHT
        aimed = aimed or hits
    return score, aimed, insults


def normal(text: str) -> bytes:
    """Lower-case bytes: words of letters, full stops for clause ends, spaces."""
    return text.translate(_PLAIN).lower().encode("utf-8", "replace").translate(_BYTES)


class Grammar:
    """Word classes and the automaton that finds clauses worth reading.

    words: weights of insults that match whole words; stems: of beginnings of longer words.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        import ahocorasick

        self.kinds = {}
        for kind, some in ((WILL, WILLS), (LEAD, LEADS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (SUBJECT, SUBJECTS), (OBJECT, OBJECTS), (PERSON, PERSONS), (THREAT, THREATS)):
            self.kinds.update({w.encode(): (kind, SEED_WEIGHT if kind == THREAT else 0.0) for w in some})
        self.kinds.update({w.encode(): (INSULT, x) for w, x in words.items()})
        self.stems = {s.encode(): x for s, x in stems.items()}
        self.sizes = sorted({len(s) for s in self.stems}, reverse=True)
        self.found = ahocorasick.Automaton()
        for w, (kind, _) in self.kinds.items():
            if kind in (INSULT, THREAT):
                self.found.add_word(" " + w.decode("latin-1"), (True, len(w) + 1))
        for s in self.stems:
            key = " " + s.decode("latin-1")
            self.found.add_word(key, (False, len(key)))
        self.found.make_automaton()

    def kind(self, word: bytes) -> tuple[int, float]:
        known = self.kinds.get(word)
        if known is not None:
            return known
        for n in self.sizes:
            if len(word) > n and (weight := self.stems.get(word[:n])) is not None:
                return INSULT, weight
        return OTHER, 0.0

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the clauses of a text in which a pattern matches."""
        if not text:
            return []
        raw = b" " + normal(text).replace(b".", b" . ") + b" "
        out, upto, aims, insults = [], 0, False, 0
        for end, (whole, _) in self.found.iter(raw.decode("latin-1")):
            if end < upto or whole and raw[end + 1] != 32:
                continue
            a, b = raw.rfind(b" . ", 0, end) + 1, raw.find(b" . ", end)
            b = len(raw) if b < 0 else b
            upto = b
            score, aimed, n = clause_score([self.kind(w) for w in raw[a:b].split() if w != b"."])
            aims, insults = aims or aimed, insults + n
            if score > 0:
                out.append(score)
        return out if aims or insults > 1 else []

    def features(self, text: str | None) -> tuple[float, float]:
        scores = self.clauses(text)
        return (max(scores), float(np.log1p(sum(scores)))) if scores else (0.0, 0.0)


class Model:
    """A grammar and the logistic weights (intercept, best clause, log of 1 + sum)."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: tuple[float, float, float]):
        self.words, self.stems, self.weights = words, stems, weights
        self._grammar: Grammar | None = None

    def __getstate__(self):
        return {**self.__dict__, "_grammar": None}

    @property
    def grammar(self) -> Grammar:
        if self._grammar is None:
            self._grammar = Grammar(self.words, self.stems)
        return self._grammar

    def score(self, text: str | None) -> tuple[float, float, int]:
        """Score, best clause and number of clauses that count."""
        scores = self.grammar.clauses(text)
        best = max(scores, default=0.0)
        z = self.weights[0] + self.weights[1] * best + self.weights[2] * float(np.log1p(sum(scores)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), best, len(scores)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Weights (intercept first) by Newton steps with a small ridge on all but the intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    pull = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + pull @ w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + pull, grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text is 0 modulo 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _word_counts(sample: DataFrame) -> DataFrame:
    """(word, t, c): toxic and clean documents of the sample that hold the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array([w.decode("utf-8", "replace") for w in words]), *(pa.array([k[w] for w in words], pa.int64()) for k in (counts[1], counts[0]))]
            counts[0].clear(), counts[1].clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "t", "c"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                counts[toxic.as_py()].update(set(normal(text.as_py() or "").replace(b".", b" ").split()))
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield out()
        yield out()

    return sample.select("text", "toxic").mapInArrow(frugal(run), "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _chosen(counts: DataFrame, toxic: int, clean: int, least_g2: float, most: int, pure: float) -> dict[str, float]:
    """Terms far more frequent in toxic documents than chance allows, with log-odds weights.

    pure: clean documents with the term for each toxic one at most. Stems, which several words
    bear out, may be less pure than single words, which copies of one document can feign.
    """
    n = float(toxic + clean)
    part = lambda k, total: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * n / ((F.col("t") + F.col("c")) * F.lit(float(total))))).otherwise(0.0)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    rows = counts.withColumn("g2", 2 * (part("t", toxic) + part("c", clean))).withColumn("odds", odds)
    rows = rows.where((F.col("g2") >= least_g2) & (F.col("odds") > 2.5) & (F.col("t") >= 4) & (F.col("c") <= pure * F.col("t")) & (F.length("term") >= 3))
    found = rows.orderBy(F.desc("g2"), "term").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} terms tell the labels apart; raise most_terms")
    return {r.term: min(8.0, r.odds) for r in found}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, most_terms: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``sample_rows`` labelled training rows. More than ``most_terms`` learned words, or
    stems, are an error."""
    seeds = dict.fromkeys(INSULTS, SEED_WEIGHT)
    train = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
    train = train.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    met = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(train), "_id")
    sample = materialize(met.groupBy("_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))  # no more rows than labels
    totals = sample.groupBy("toxic").count().collect()
    by = {r.toxic: r["count"] for r in totals}
    toxic, clean = by.get(1, 0), by.get(0, 0)
    if not toxic or not clean:
        return Model(seeds, {}, (-3.0, 0.8, 0.8))
    counts = materialize(_word_counts(sample))
    least = 2 * float(np.log(max(2, counts.count()))) + 6
    # Stems stand for several words; a word of its own is no evidence for what begins it.
    cut = F.explode(F.transform(F.sequence(F.lit(4), F.lit(7)), lambda n: F.when(F.length("word") > n, F.substring("word", F.lit(1), n))))
    begins = counts.where((F.length("word") > 4) & ~F.col("word").isin(INSULTS)).select(cut.alias("term"), "t", "c").where("term IS NOT NULL")
    begins = begins.groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum((F.col("t") > F.col("c")).cast("int")).alias("n")).where("n >= 5")
    stems = _chosen(begins, toxic, clean, least, most_terms, pure=0.6)
    # A longer stem says nothing that a stem which begins it doesn't.
    stems = {s: w for s, w in stems.items() if not any(s[:n] in stems for n in range(4, len(s)))}
    words = _chosen(counts.withColumnRenamed("word", "term"), toxic, clean, least, most_terms, pure=0.05)
    words = {w: x for w, x in words.items() if not any(w[:n] in stems for n in range(4, len(w)))}
    model = Model({**seeds, **words}, stems, (0.0, 0.0, 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [model.grammar.features(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x[0] for x in both], pa.float64()), pa.array([x[1] for x in both], pa.float64())], names=["y", "a", "b"])

    rows = sample.select("text", "toxic").mapInArrow(frugal(run), "y int, a double, b double").collect()
    rows.sort()  # sums in a fixed order
    table = np.array([tuple(r) for r in rows], float)
    model.weights = logistic(table[:, 1:], table[:, 0])
    if min(model.weights[1:]) < 0:  # more evidence never lowers a score
        model.weights = (*logistic(table[:, 1:2], table[:, 0]), 0.0)
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity (0 to 1), best_clause and n_clauses."""
    own = ("toxicity", "best_clause", "n_clauses")
    docs = docs.drop(*[c for c in own if c != text_col])
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("best_clause", T.DoubleType()), T.StructField("n_clauses", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                out = [model.score(x) for x in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                kinds = (pa.float64(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], names=[*part.schema.names, *own])

    return docs.mapInArrow(frugal(run), schema)


def accepted(docs: DataFrame, model: Model, most: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score below ``most``, with their own columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return scored(docs, model, text_col).where(F.col("toxicity") < most).select(*columns)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of this corpus's training labels."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
