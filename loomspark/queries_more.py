"""Registered queries of single operators: record transforms, formulas, masks, stream statistics, reports.

Raw records are cut from ``documents`` (fields in part empty, blank or null), so that every rule has rows
that it keeps and rows that it drops.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric
from .functions import text as tx
from .operators import chat, metrics, packing, probes, splits, tokenizer, transforms
from .queries import _CLEAN, _MSGS, _conversations, _docs, _stored, query
from .sources import pieces, readers, sinks
from .storage import shared_dir


def _strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^[{tx.SPACE}]+|[{tx.SPACE}]+$', '', 'g')"


def _raw(spark: SparkSession, sf: str, **fields: str) -> DataFrame:
    return _docs(spark, sf, "text", "source", "lang").select("doc_id", *[F.expr(v).alias(k) for k, v in fields.items()])


_ALPACA = {"instruction": "CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE lang END", "input": "CASE WHEN doc_id % 3 = 0 THEN source END", "output": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE substring(text, 1, 40) END"}


def _fields(fields: dict[str, str]) -> str:
    return "r AS (SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in fields.items()) + " FROM documents)"


@query(f"WITH {_fields(_ALPACA)}, s AS (SELECT doc_id, {_strip('instruction')} AS i, {_strip('input')} AS x, {_strip('output')} AS o FROM r) "
       "SELECT doc_id, CASE WHEN x <> '' THEN i || chr(10) || chr(10) || x ELSE i END AS asked, o AS answered FROM s WHERE i <> '' AND o <> ''")  # fmt: skip
def record_alpaca(spark, sf):
    out = transforms.alpaca(_raw(spark, sf, **_ALPACA), ("doc_id",))
    return out.select("doc_id", F.col("messages")[0].content.alias("asked"), F.col("messages")[1].content.alias("answered"))


_WORKED = {"question": "CASE WHEN doc_id % 9 = 0 THEN '' ELSE substring(text, 1, 50) END", "answer": "CASE WHEN doc_id % 4 = 0 THEN concat(lang, ' #### ', source) ELSE lang END"}


@query(f"WITH {_fields(_WORKED)} SELECT doc_id, {_strip('question')} AS question, {_strip('answer')} AS answer FROM r WHERE {_strip('question')} <> '' AND contains(answer, '####')")
def record_worked_answer(spark, sf):
    return transforms.worked_answer(_raw(spark, sf, **_WORKED), ("doc_id",))


_PLAIN = {"text": "CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE substring(text, 1, 30) END"}


@query(f"WITH {_fields(_PLAIN)} SELECT doc_id, {_strip('text')} AS text FROM r WHERE {_strip('text')} <> ''")
def record_story(spark, sf):
    return transforms.plain_text(_raw(spark, sf, **_PLAIN), ("doc_id",))


_PREFERENCE = {"instruction": "lang", "chosen": "substring(text, 1, 20)", "rejected": "CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE source END"}


@query(f"WITH {_fields(_PREFERENCE)} SELECT doc_id, {_strip('instruction')} AS instruction, {_strip('chosen')} AS chosen, {_strip('rejected')} AS rejected FROM r WHERE {_strip('instruction')} <> '' AND {_strip('chosen')} <> '' AND {_strip('rejected')} <> ''")
def record_preference(spark, sf):
    return transforms.preference(_raw(spark, sf, **_PREFERENCE), ("doc_id",))


_CHART = {"question": "CASE WHEN doc_id % 2 = 0 THEN '' WHEN doc_id % 3 = 0 THEN ' ' ELSE substring(text, 1, 20) END", "query": "lang", "label": "{list}", "human_or_machine": "CAST(doc_id % 2 AS INT)"}


@query(f"WITH {_fields({**_CHART, 'label': '[source, chr(32), lang]'})} SELECT doc_id, {_strip('coalesce(nullif(question, chr(0)[1:0]), query)')} AS question, source_ AS answer, 'swift' AS type, human_or_machine "
       f"FROM (SELECT r.*, array_to_string(list_filter(list_transform(label, lambda x: {_strip('x')}), lambda x: x <> ''), ', ') AS source_ FROM r) WHERE {_strip('coalesce(nullif(question, chr(0)[1:0]), query)')} <> ''")  # fmt: skip
def record_chart_question(spark, sf):
    return transforms.chart_question(_raw(spark, sf, **{**_CHART, "label": "array(source, ' ', lang)"}), ("doc_id",))


_EXAM = {"id": "CAST(doc_id AS VARCHAR(20))", "question": "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE substring(text, 1, 25) END", "A": "lang", "B": "source", "C": "substring(text, 2, 3)", "D": "NULL", "answer": "'A'", "explanation": "CASE WHEN doc_id % 2 = 0 THEN ' why ' END"}


@query(f"WITH {_fields(_EXAM)} SELECT doc_id, " + ", ".join(f"{_strip(f'CAST({c} AS VARCHAR)')} AS {c}" for c in _EXAM) + f" FROM r WHERE {_strip('question')} <> ''")
def record_exam(spark, sf):
    return transforms.exam(_raw(spark, sf, **_EXAM), ("doc_id",))


_COMPLETION = {"activity_label": "source", "ctx": "CASE WHEN doc_id % 8 = 0 THEN '' ELSE substring(text, 1, 30) END", "endings": "{list}", "label": "doc_id % 4"}


@query(f"WITH {_fields({**_COMPLETION, 'endings': 'CASE WHEN doc_id % 3 <> 0 THEN [lang, source] END'})} SELECT doc_id, {_strip('activity_label')} AS activity_label, {_strip('ctx')} AS ctx, "
       f"coalesce(array_to_string(endings, '|'), '') AS endings, coalesce(len(endings), 0)::INT AS n_endings, CASE WHEN label = 0 THEN '' ELSE label::VARCHAR END AS label FROM r WHERE {_strip('ctx')} <> ''")  # fmt: skip
def record_completion(spark, sf):
    out = transforms.completion(_raw(spark, sf, **{**_COMPLETION, "endings": "CASE WHEN doc_id % 3 <> 0 THEN array(lang, source) END"}), ("doc_id",))
    return out.withColumn("n_endings", F.size("endings")).withColumn("endings", F.array_join("endings", "|"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / 0.7) AS z, (vec_id * 37 % 1000 + 0.5)::DOUBLE / 1000 AS draw FROM embeddings),
e AS (SELECT vec_id, draw, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM v), p AS (SELECT vec_id, draw, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
SELECT vec_id, least(len(list_filter(range(1, len(p) + 1), lambda i: list_sum(p[1:i]) < draw)), len(p) - 1)::INT AS token FROM p""")
def sampled_token(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    draw = (F.pmod(F.col("vec_id") * 37, F.lit(1000)) + 0.5) / 1000
    return v.select("vec_id", numeric.sample_next("v", draw, 0.7).alias("token"))


@query("""SELECT l_orderkey, l_linenumber, (l_linenumber * l_partkey * 512)::BIGINT AS batch_tokens, (l_linenumber * l_partkey * 512 * l_suppkey)::BIGINT AS budget_tokens FROM lineitem""")
def budget_tokens(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    batch = numeric.batch_tokens(F.col("l_linenumber").cast("long"), "l_partkey", F.lit(512))
    return t.select("l_orderkey", "l_linenumber", batch.alias("batch_tokens"), (batch * F.col("l_suppkey")).alias("budget_tokens"))


@query("""WITH p AS (SELECT p_partkey, p_size * 64 AS h, p_size % 12 + 1 AS layers, 16000 AS vocab, p_partkey % 2 = 0 AS tied FROM part),
c AS (SELECT *, (CASE WHEN tied THEN 1 ELSE 2 END * vocab * h + 512 * h)::BIGINT AS embedding, layers * (4 * h * h + 8 * h * h + 9 * h + 4 * h) + 2 * h AS rest FROM p)
SELECT p_partkey, (embedding + rest)::BIGINT AS params, CASE WHEN tied THEN 1 ELSE 2 END * vocab * h / (embedding + rest)::DOUBLE AS embedding_share, embedding + rest BETWEEN 1000000 AND 50000000 AS within_budget FROM c""")
def parameter_counts(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_size") * 64).cast("long").alias("h"), (F.col("p_size") % 12 + 1).alias("layers"), (F.col("p_partkey") % 2 == 0).alias("tied"))
    params = numeric.decoder_params(F.lit(16000), "h", "layers", F.col("h") * 4, F.lit(512), F.col("tied"))
    share = numeric.embedding_share(F.lit(16000), "h", params, F.col("tied"))
    return p.select("p_partkey", params.alias("params"), share.alias("embedding_share"), params.between(1_000_000, 50_000_000).alias("within_budget"))


@query("WITH p AS (SELECT user_id % 5 AS series, ln(event_id + 1) AS x, ln(value + 1) AS y FROM events WHERE value >= 0), f AS (SELECT series, -regr_slope(y, x) AS alpha, exp(regr_intercept(y, x)) AS c FROM p GROUP BY 1) "
       "SELECT event_id, round(c * pow(event_id + 1, -alpha), 6) AS predicted FROM events JOIN f ON user_id % 5 = series")  # fmt: skip
def predicted_losses(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("series", F.col("user_id") % 5)
    fit = metrics.power_law(e.where("value >= 0").select("series", (F.col("event_id") + 1).alias("n_params"), (F.col("value") + 1).alias("loss")), by=["series"])
    rows = e.join(F.broadcast(fit.select("series", "alpha", "c")), "series")  # five series
    return rows.select("event_id", F.round(numeric.predicted_loss("c", "alpha", F.col("event_id") + 1), 6).alias("predicted"))


@query("SELECT doc_id AS ord, length(text)::INT AS chars FROM documents ORDER BY doc_id LIMIT 25")
def doc_cap(spark, sf):
    """The first 25 documents in order: a cap is what this operator is for."""
    return splits.first_rows(_docs(spark, sf, "text").select(F.col("doc_id").alias("ord"), F.length("text").alias("chars")), 25)


_WORD_IDS = "list_transform(list_filter(string_split_regex({}, ' +'), lambda w: w <> ''), lambda w: 4 + length(w))"
_PAIRS = f"""t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, text AS u, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
i AS (SELECT conv_id * 1000 + place AS ord, {_WORD_IDS.format('u')} AS ui, {_WORD_IDS.format('a')} AS ai FROM t WHERE role = 'user' AND next_role = 'assistant' AND u <> '' AND a <> ''),
m AS (SELECT ord, list_concat([0], ui, [1], ai, [1]) AS ids, list_concat(list_transform(range(len(ui) + 1), lambda x: 0), list_transform(range(len(ai) + 2), lambda x: 1)) AS mask FROM i),
s AS (SELECT *, (sum(len(ids)) OVER (ORDER BY ord))::BIGINT AS stream_end FROM m)"""


def _pair_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Answered turns as ids (lengths of words) with their mask, one behind the other."""
    pairs = chat.answered_turns(_conversations(spark, sf))
    ids = lambda k: F.transform(F.filter(F.split(F.col("messages")[k].content, " +"), lambda w: w != ""), lambda w: F.length(w) + 4)
    both, mask = chat.pair_ids(ids(0), ids(1), 0, 1)
    return packing.stream_offsets(pairs.select((F.col("ord") * 1000 + F.col("place")).alias("ord"), both.alias("ids"), mask.alias("mask")))


@query(f"""WITH {_PAIRS}, n AS (SELECT max(stream_end) AS n FROM s), o AS (SELECT range AS block_id, range * 128 AS "offset" FROM range((SELECT (n - 33) // 128 + 1 FROM n))),
f AS (SELECT stream_end - len(ids) + k - 1 AS position, ids[k] AS token, mask[k] AS mask FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS k FROM s)),
w AS (SELECT block_id, "offset", "offset" + unnest(range(1, 33)) AS position FROM o)
SELECT block_id, array_to_string(list(CASE WHEN mask = 0 THEN -100 ELSE token END ORDER BY position), ' ') AS label FROM w JOIN f USING (position) GROUP BY 1""")
def masked_labels(spark, sf):
    stream = _pair_stream(spark, sf)
    n = stream.agg(F.max("stream_end")).first()[0] or 0
    offsets = spark.range(max(0, (n - 33) // 128 + 1)).select(F.col("id").alias("block_id"), (F.col("id") * 128).alias("offset"))
    out = packing.blocks(stream, offsets, 32, mask_col="mask")
    return out.select("block_id", F.array_join(F.transform("label", lambda x: x.cast("string")), " ").alias("label"))


@query(f"WITH {_PAIRS} SELECT count(*)::BIGINT AS docs, sum(len(ids))::BIGINT AS tokens, sum(list_sum(mask))::BIGINT AS assistant_tokens FROM s")
def stream_stats(spark, sf):
    return packing.stream_stats(_pair_stream(spark, sf))


_TURNS = _MSGS + """, g AS (SELECT ord, messages, list_transform(string_split(array_to_string(list_transform(messages[1:len(messages) - 1], lambda m: m.role || ': ' || coalesce(m.content, '')), chr(10)), ''), lambda c: unicode(c)) AS p,
 list_transform(string_split(array_to_string(list_transform(messages, lambda m: m.role || ': ' || coalesce(m.content, '')), chr(10)), ''), lambda c: unicode(c)) AS f FROM m WHERE len(messages) >= 2 AND messages[len(messages)].content <> '')"""


def _prefix_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt (all turns but the last) and whole conversation as ids of characters."""
    c = _conversations(spark, sf).where((F.size("messages") >= 2) & (F.element_at("messages", -1).content != ""))
    line = lambda m: F.concat(m.role, F.lit(": "), F.coalesce(m.content, F.lit("")))
    ids = lambda turns: F.transform(F.split(F.array_join(F.transform(turns, line), "\n"), ""), lambda x: F.ascii(x))
    return c.select("ord", ids(F.slice("messages", F.lit(1), F.size("messages") - 1)).alias("p"), ids(F.col("messages")).alias("f"))


@query(f"WITH {_TURNS} SELECT ord, len(f)::INT AS n, (len(f) - len(p))::INT AS trained FROM g")
def prefix_mask(spark, sf):
    masked = _prefix_ids(spark, sf).withColumn("mask", chat.prefix_mask("p", "f"))
    return masked.select("ord", F.size("mask").alias("n"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("trained"))


@query(f"WITH {_TURNS} SELECT ord, (len(f) + 2)::INT AS n, 0 AS first_id, 1 AS last_id, (len(f) - len(p) + 1)::INT AS trained, list_sum(f)::BIGINT + 1 AS checksum FROM g")
def conversation_frame(spark, sf):
    ids, mask = chat.framed_mask(F.col("f"), chat.prefix_mask("p", "f"), 0, 1)
    rows = _prefix_ids(spark, sf).select("ord", ids.alias("i"), mask.alias("m"))
    total = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    return rows.select("ord", F.size("i").alias("n"), F.element_at("i", 1).alias("first_id"), F.element_at("i", -1).alias("last_id"), total("m", F.lit(0)).alias("trained"), total("i", F.lit(0).cast("long")).alias("checksum"))


@query(f"WITH {_MSGS}, u AS (SELECT ord, {_WORD_IDS.format('messages[1].content')} AS u FROM m WHERE messages[1].content <> '') SELECT ord, array_to_string(list_concat([0], u, [1], [15]), ' ') AS context FROM u")
def generation_context(spark, sf):
    c = _conversations(spark, sf).where(F.col("messages")[0].content != "")
    ids = F.transform(F.filter(F.split(F.col("messages")[0].content, " +"), lambda w: w != ""), lambda w: F.length(w) + 4)
    return c.select("ord", F.array_join(F.transform(chat.generation_context(ids, F.array(F.lit(15)), 0, 1), lambda x: x.cast("string")), " ").alias("context"))


@query("""WITH l AS (SELECT avg(value) FILTER (WHERE event_id % 2 = 0) / 1e4 AS a, avg(value) FILTER (WHERE event_id % 2 = 1) / 1e4 AS b FROM events),
p AS (SELECT 'as it is' AS merged, text AS x, text AS y FROM conversations WHERE text IS NOT NULL UNION ALL SELECT 'one line', text, replace(text, chr(10), ' ') FROM conversations WHERE text IS NOT NULL)
SELECT merged, count(*)::BIGINT AS pairs, count(*) FILTER (WHERE x = y)::BIGINT AS equal, count(*) = count(*) FILTER (WHERE x = y) AND abs(any_value(a) - any_value(b)) < 1e-2 AS consistent FROM p, l GROUP BY 1""")
def merge_consistency(spark, sf):
    """All turns as generations before a merge; after it they come from the gathered conversations as they are, or on one
    line. Losses are means of the events of even and of odd number."""
    before = spark.read.parquet(f"{sf}/conversations.parquet").where("text IS NOT NULL")
    key = F.struct("conv_id", "turn", "role").alias("prompt_index")
    after = before.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("m")).select("conv_id", F.explode("m").alias("t")).select("conv_id", "t.*")
    mean = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("value"))) / 1e4
    losses = spark.read.parquet(f"{sf}/events.parquet").agg(mean(0).alias("a"), mean(1).alias("b")).first()
    out = None
    for name, text in (("as it is", F.col("text")), ("one line", F.replace("text", F.lit("\n"), F.lit(" ")))):
        row = metrics.merge_consistency(before.select(key, F.col("text").alias("generated")), after.select(key, text.alias("generated")), losses.a, losses.b)
        row = row.select(F.lit(name).alias("merged"), "pairs", "equal", "consistent")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {_CLEAN}, q AS (SELECT source, CASE WHEN ord % 10 = 0 THEN 'validation' ELSE 'train' END AS p FROM c) SELECT source AS key FROM q GROUP BY 1 HAVING count(DISTINCT p) > 1""")
def leaks_found(spark, sf):
    """A split by document leaks sources into both sides; each that does is found."""
    parted = _stored(spark, sf).withColumn("partition", F.when(F.col("ord") % 10 == 0, "validation").otherwise("train"))
    return splits.leaks(parted, F.col("source"))


class _WithoutDigits:
    """A tokenizer that loses digits, so that round trips fail."""

    name, vocab_size = "no-digits", 0x110000

    def encode(self, text: str) -> list[int]:
        return [ord(c) for c in text if c not in "0123456789"]

    def decode(self, ids) -> str:
        return "".join(map(chr, ids))


@query("SELECT count(*)::BIGINT AS checked, count(*) FILTER (WHERE bad) = 0 AS ok, count(*) FILTER (WHERE bad)::BIGINT AS failed FROM (SELECT regexp_matches(text, '[0-9]') AS bad FROM documents)")
def round_trip_failures(spark, sf):
    return tokenizer.round_trip(_docs(spark, sf, "text"), _WithoutDigits()).select("checked", "ok", "failed")


_PROBES = "p AS (SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(c, t.replace("'", "''")) for c, some in probes.PROBES.items() for t in some) + ") AS v(category, text))"


def _as_bytes(text: str) -> list[int]:
    return list(text.encode())


def _from_bytes(ids: list[int]) -> str:
    return bytes(ids).decode("utf-8", "replace")


@query(f"WITH {_PROBES}, a AS (SELECT * FROM p UNION ALL SELECT lang, text FROM documents), c AS (SELECT 'bytes' AS tokenizer, category, text, octet_length(encode(text)) AS t, false AS lost FROM a UNION ALL SELECT 'no-digits', category, text, length(regexp_replace(text, '[0-9]', '', 'g')), regexp_matches(text, '[0-9]') FROM a) "
       "SELECT tokenizer, coalesce(category, 'overall') AS category, sum(t)::BIGINT AS n_tokens, sum(length(text))::BIGINT AS n_chars, sum(t) / sum(length(text))::DOUBLE AS tokens_per_char, count(*) FILTER (WHERE lost)::BIGINT AS failed FROM c GROUP BY tokenizer, ROLLUP (category)")  # fmt: skip
def probe_report(spark, sf):
    """Tokenizers over the fixed probe texts and all documents by language."""
    texts = probes.probe_texts(spark).unionByName(_docs(spark, sf, "text", "lang").select(F.col("lang").alias("category"), "text"))
    lossy = _WithoutDigits()
    return probes.probe_report(texts, {"bytes": (_as_bytes, _from_bytes), "no-digits": (lossy.encode, lossy.decode)})


@query("""WITH s AS (SELECT lang AS name, sum(CASE WHEN doc_id % 10 = 0 THEN octet_length(encode(text)) END)::BIGINT AS vt, count(CASE WHEN doc_id % 10 = 0 THEN 1 END) AS docs, (16000 + length(lang) * 1000)::BIGINT AS vocab FROM documents GROUP BY 1),
k AS (SELECT sum(CASE WHEN doc_id % 10 <> 0 THEN length(text) END)::BIGINT AS tc, sum(CASE WHEN doc_id % 10 = 0 THEN length(text) END)::BIGINT AS vc FROM documents)
SELECT name, vocab * 512 * 2 AS embedding_lm_head_params, round_even(vt * (tc::DOUBLE / vc), 0)::BIGINT AS train_tokens_estimated, ceil(round_even(vt * (tc::DOUBLE / vc), 0) / 1024)::BIGINT AS sequences_for_train_estimate, vt / docs::DOUBLE AS avg_tokens_per_doc_validation FROM s, k""")
def impact_report(spark, sf):
    d = _docs(spark, sf, "text", "lang").withColumn("v", F.col("doc_id") % 10 == 0)
    rows = d.groupBy(F.col("lang").alias("name")).agg(F.sum(F.when(F.col("v"), F.octet_length("text"))).alias("tokens"), F.count(F.when(F.col("v"), 1)).alias("docs")).withColumn("vocab_size", (16000 + F.length("name") * 1000).cast("long"))
    chars = d.agg(F.sum(F.when(~F.col("v"), F.length("text"))).alias("train"), F.sum(F.when(F.col("v"), F.length("text"))).alias("validation")).first()
    return probes.impact_report(rows, chars.train, chars.validation, 512, 1024)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}"


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id, length(text)::INT AS chars FROM documents")
def scan_json_lines(spark, sf):
    """All documents written as JSON lines in order, and scanned back with their places."""
    path = _folder(spark)
    _docs(spark, sf, "text").orderBy("doc_id").write.json(path)
    return readers.jsonl(spark, path, "doc_id long, text string").select("ord", "doc_id", F.length("text").alias("chars"))


@query("SELECT doc_id::VARCHAR AS doc_id, text, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS lang FROM documents")
def scan_csv(spark, sf):
    """All documents through a CSV file with line breaks and quotes in fields, some of them empty."""
    path = _folder(spark)
    rows = _docs(spark, sf, "text", "lang").withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    rows.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return readers.csv(spark, path, ["doc_id", "text", "lang"], ordered=False)


@query("SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 2 <> 0")
def scan_splits(spark, sf):
    """Two Parquet splits one behind the other, with a projection."""
    path = _folder(spark)
    for name, odd in (("train", False), ("validation", True)):
        _docs(spark, sf, "text", "source").where((F.col("doc_id") % 2 != 0) == F.lit(odd)).write.parquet(f"{path}/{name}.parquet")
    parts = {"train": ("train.parquet",), "validation": ("validation.parquet",)}
    return readers.load_raw(spark, path, parts, None, ["doc_id", "source"]).select("doc_id", "source")


@query(f"WITH {_PAIRS} SELECT stream_end - len(ids) + k - 1 AS position, ids[k]::INT AS token FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS k FROM s)")
def scan_flat_stream(spark, sf):
    """A token stream written as one flat file and read back by ranges of bytes."""
    path = f"{_folder(spark)}/stream.bin"
    sinks.write_stream(_pair_stream(spark, sf), path)
    return readers.binary_stream(spark, path, range_items=1 << 16)


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id, md5(text) AS text, lang FROM documents")
def scan_json_array(spark, sf):
    """All documents in JSON arrays, one a range of them, with other elements in between, read by ranges of bytes."""
    path = _folder(spark)

    def arrays(batches):
        yield pa.RecordBatch.from_arrays([pa.array(["[7"])], names=["value"])
        for batch in pieces.few(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([f", null,\n{x}" for x in batch.column(0).to_pylist()], pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    rows = _docs(spark, sf, "text", "lang").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.select(F.to_json(F.struct("doc_id", "text", "lang"))).mapInArrow(arrays, "value string").write.text(path)
    rows = readers.json_array(spark, path, "doc_id long, text string, lang string")
    return rows.select("ord", "doc_id", F.md5(F.col("text").cast("binary")).alias("text"), "lang")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text NOT LIKE '%' || chr(13) || '%')
SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS ord, md5(t) AS text FROM l""")
def scan_text_lines(spark, sf):
    """The lines of all documents (without carriage returns) written in order, and scanned back with their places."""
    path = _folder(spark)
    _docs(spark, sf, "text").where("NOT contains(text, '\\r')").orderBy("doc_id").select("text").write.text(path)
    return readers.text_lines(spark, path).select("ord", F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"SELECT ord, length(text)::INT AS chars FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, {_strip('text')} AS text FROM documents) WHERE text <> '' ORDER BY ord LIMIT 40")
def scan_capped(spark, sf):
    """The first forty texts of a governed split that are not blank: a cap is what this scan is for."""
    root = _folder(spark)
    _docs(spark, sf, "text").orderBy("doc_id").write.parquet(f"{root}/corpus/train.parquet")
    return readers.corpus_texts(spark, root, "corpus", "train", 40).select("ord", F.length("text").alias("chars"))


@query(f"""WITH {_PAIRS}, n AS (SELECT max(stream_end) AS n FROM s), o AS (SELECT range AS block_id, ('0x' || substr(sha256('7|' || range::VARCHAR), 1, 15))::BIGINT % (n - 16) AS "offset" FROM n, range((SELECT (n - 1) // 50 + 1 FROM n))),
w AS (SELECT block_id, "offset", "offset" + unnest(range(17)) AS position FROM o),
f AS (SELECT stream_end - len(ids) + k - 1 AS position, ids[k] AS token FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS k FROM s))
SELECT block_id, array_to_string(list(token ORDER BY position) FILTER (WHERE position < "offset" + 16), ' ') AS input, array_to_string(list(token ORDER BY position) FILTER (WHERE position > "offset"), ' ') AS label FROM w JOIN f USING (position) GROUP BY 1""")
def random_access(spark, sf):
    """Blocks read where they lie in a flat stream of several files, an offset for each fifty tokens."""
    path = f"{_folder(spark)}/stream"
    n = sinks.write_stream(_pair_stream(spark, sf), path, layout="parts")
    out = readers.stream_blocks(spark, path, packing.spread_offsets(spark, n, 16, 50, 7), 16)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return out.select("block_id", text("input").alias("input"), text("label").alias("label"))


@query("SELECT doc_id, source, (doc_id % 3)::INT AS k FROM documents")
def records_fallback(spark, sf):
    """Records of which one column has no type that Parquet stores go out as JSON lines, the others as Parquet; both are read back."""
    path, rows = _folder(spark), _docs(spark, sf, "source").withColumn("k", (F.col("doc_id") % 3).cast("int"))
    kinds = [sinks.write_records(rows.where("doc_id % 2 = 0"), f"{path}/a.parquet", None), sinks.write_records(rows.where("doc_id % 2 <> 0").withColumn("none", F.lit(None)), f"{path}/b.parquet", None)]
    assert kinds == ["parquet", "jsonl"]
    return spark.read.parquet(f"{path}/a.parquet").unionByName(spark.read.schema("doc_id long, source string, k int").json(f"{path}/b.jsonl"))


@query(f"WITH {_PAIRS} SELECT stream_end - len(ids) + k - 1 AS position, ids[k]::INT AS token FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS k FROM s)")
def flatten_documents(spark, sf):
    return packing.flat_stream(_pair_stream(spark, sf))


@query("""WITH n AS (SELECT DISTINCT source AS dataset FROM documents WHERE source IS NOT NULL), a AS (SELECT unnest(['no-such-corpus']) AS dataset UNION ALL SELECT dataset FROM n)
SELECT dataset, CASE WHEN dataset <> 'no-such-corpus' THEN 'license of ' || dataset END AS license, CASE WHEN dataset <> 'no-such-corpus' THEN substr(md5(dataset), 1, 7) END AS revision, CASE WHEN dataset <> 'no-such-corpus' THEN length(dataset)::BIGINT END AS seed FROM a""")
def manifest_lookup(spark, sf):
    """Manifests of all sources as corpora, looked up by name; one name has none."""
    from .plans import artifacts

    path = _folder(spark)
    names = sorted(r.source for r in _docs(spark, sf, "source").where("source IS NOT NULL").select("source").distinct().collect())
    for n in names:
        sinks.write_json(spark, {"dataset": n, "license": f"license of {n}", "revision": hashlib.md5(n.encode()).hexdigest()[:7], "seed": len(n)}, f"{path}/{n}.json")
    return artifacts.manifest_lookup(spark, ["no-such-corpus", *names], path)


@query("""WITH l AS (SELECT user_id::VARCHAR AS run, event_id AS ord, event_id % 50 AS global_step, CASE WHEN event_id % 4 <> 0 THEN value END AS train_loss FROM events), b AS (SELECT *, lag(global_step) OVER (PARTITION BY run ORDER BY ord) AS before FROM l)
SELECT run, count(*)::BIGINT AS rows, arg_min(train_loss, ord) FILTER (WHERE train_loss IS NOT NULL) AS first_loss, min(train_loss) AS best_loss, (list(global_step ORDER BY train_loss, ord) FILTER (WHERE train_loss IS NOT NULL))[1] AS best_step,
arg_max(train_loss, ord) FILTER (WHERE train_loss IS NOT NULL) AS last_loss, arg_max(global_step, ord) AS last_step, sum(greatest(0, coalesce(global_step - before - 1, 0)))::BIGINT AS gaps, count(*) FILTER (WHERE global_step <= before)::BIGINT AS repeats FROM b GROUP BY run""")
def run_progress(spark, sf):
    """What a stream's state comes to for every run: rows, first, best and last loss, skipped and repeated steps."""
    from .streaming.logs import progress_of

    e = spark.read.parquet(f"{sf}/events.parquet")
    return progress_of(e.select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("ord"), (F.col("event_id") % 50).alias("global_step"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("train_loss")))
