"""Registered queries over the driver's tables, and the SQL that states their results.

``documents`` stands for a text corpus, ``conversations`` for chats, ``events`` for a metrics log
(user_id is the run, event_id the order, value the loss).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric
from .functions import text as tx
from .operators import chat, dedup, metrics, packing, splits, tokenizer, transforms
from .operators.overlap import overlap
from .storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_STRIP = f"regexp_replace(coalesce(text, ''), '^[{tx.SPACE}]+|[{tx.SPACE}]+$', '', 'g')"
_LOW32 = " + ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT * {pow(pow(2, 32, 1000), 7 - i, 1000)}" for i in range(8))


def _bucket_sql(key: str) -> str:
    return f"(SELECT ({_LOW32}) % 1000 FROM (SELECT sha256({key}) AS h))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", *columns)


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of ten code points or more, first of equal texts."""
    rows = _docs(spark, sf, "text", "source").select(F.col("doc_id").alias("ord"), tx.pystrip(F.coalesce("text", F.lit(""))).alias("text"), "source").where(F.length("text") >= 10)
    return dedup.dedupe_records(rows, ["text"], ["ord"])


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """``_clean`` written once, for plans that read it more than once."""
    return materialize(_clean(spark, sf))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), (F.col("event_id") % 50).alias("global_step"), F.col("value").alias("train_loss"), (F.col("value") + 1).alias("tokens_s"), (F.col("value") / 10).alias("step_time_s"), F.when(F.col("event_id") % 5 == 0, F.col("value") + 0.5).alias("val_loss"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("peak_mem_gb"))


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    return chat.to_messages(spark.read.parquet(f"{sf}/conversations.parquet")).withColumnRenamed("conv_id", "ord")


_CLEAN = f"""p AS (SELECT doc_id AS ord, {_STRIP} AS text, source FROM documents),
c AS (SELECT ord, text, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY ord) AS k FROM p WHERE length(text) >= 10) WHERE k = 1)"""
_SHUFFLED = "row_number() OVER (ORDER BY sha256('{seed}|' || ord::VARCHAR), ord)"
_RUNS = """l AS (SELECT user_id AS run, event_id AS ord, event_id % 50 AS global_step, value AS train_loss, value + 1 AS tokens_s, value / 10 AS step_time_s,
  CASE WHEN event_id % 5 = 0 THEN value + 0.5::DOUBLE END AS val_loss, CASE WHEN event_id % 3 = 0 THEN value END AS peak_mem_gb FROM events)"""
_MSGS = "m AS (SELECT conv_id AS ord, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"


@query(f"WITH {_CLEAN}, r AS (SELECT *, {_SHUFFLED.format(seed=42)} AS rank, count(*) OVER () AS n FROM c), "
       "q AS (SELECT *, CASE WHEN rank <= floor(n::DOUBLE * 0.8::DOUBLE) THEN 'train' WHEN rank <= floor(n::DOUBLE * 0.8::DOUBLE) + floor(n::DOUBLE * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS partition FROM r) "
       "SELECT partition, count(*)::BIGINT AS records, sum(length(text))::BIGINT AS chars, min(ord) AS first_ord FROM q GROUP BY 1")  # fmt: skip
def govern_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: strip, length filter, first-wins dedupe, seeded split, statistics by partition."""
    parts = splits.shuffle_split(_stored(spark, sf), (0.8, 0.1, 0.1), 42)
    return parts.groupBy("partition").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars"), F.min("ord").alias("first_ord"))


@query(f"SELECT doc_id, {_STRIP} AS text FROM documents WHERE length({_STRIP}) >= 10")
def normalize_text(spark, sf):
    return transforms.long_text(_docs(spark, sf, "text"), carry=("doc_id",))


@query(f"SELECT doc_id, {_STRIP} AS text, coalesce(source, '') AS title FROM documents WHERE {_STRIP} <> ''")
def titled_documents(spark, sf):
    return transforms.titled_text(_docs(spark, sf, F.col("text").alias("content"), F.col("source").alias("title")), carry=("doc_id",))


@query(f"WITH {_CLEAN} SELECT ord FROM c")
def dedupe_first(spark, sf):
    return _clean(spark, sf).select("ord")


@query("SELECT count(*)::BIGINT AS rows, count(DISTINCT text)::BIGINT AS kept, (count(*) - count(DISTINCT text))::BIGINT AS removed FROM documents")
def dedupe_report(spark, sf):
    rows = _docs(spark, sf, "text")
    kept = dedup.dedupe_records(rows, ["text"], ["doc_id"])
    return rows.agg(F.count("*").alias("rows")).join(F.broadcast(kept.agg(F.count("*").alias("kept")))).withColumn("removed", F.col("rows") - F.col("kept"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_grouped(spark, sf):
    return dedup.dedupe_grouped(_docs(spark, sf, "text", "source"), "source", "text", ["doc_id"]).select("doc_id")


@query("SELECT doc_id, coalesce(nullif(trim(source), ''), '__record__' || substr(sha256(text), 1, 16)) AS k, '__record__' || substr(sha256(text), 1, 16) AS own FROM documents")
def group_keys(spark, sf):
    return _docs(spark, sf, "text", "source").select("doc_id", tx.group_key("source", "text").alias("k"), tx.group_key(F.lit(" "), "text").alias("own"))


@query("SELECT doc_id, " + _bucket_sql("text") + "::INT AS bucket FROM documents")
def hash_bucket(spark, sf):
    return _docs(spark, sf, "text").select("doc_id", tx.sha256_bucket("text").alias("bucket"))


@query(f"""WITH {_CLEAN}, b AS (SELECT *, {_bucket_sql("source")} AS bucket FROM c WHERE trim(coalesce(source, '')) <> ''),
q AS (SELECT *, CASE WHEN bucket < 571 THEN 'a' WHEN bucket < 714 THEN 'b' ELSE 'c' END AS partition FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY sha256('42|' || ord::VARCHAR), ord)::BIGINT AS rank FROM q)
SELECT ord, partition, rank FROM r WHERE rank <= CASE partition WHEN 'a' THEN 400 WHEN 'b' THEN 100 ELSE 200 END""")  # fmt: skip
def group_split_quota(spark, sf):
    return splits.group_split(_stored(spark, sf), F.col("source"), {"a": 400, "b": 100, "c": 200}).select("ord", "partition", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_CLEAN}, r AS (SELECT ord, {_SHUFFLED.format(seed=7)} AS rank, least(300, count(*) OVER ()) AS n FROM c) SELECT ord, rank::BIGINT AS rank, CASE WHEN rank <= floor(n::DOUBLE * 0.95::DOUBLE) THEN 'train' ELSE 'validation' END AS partition FROM r WHERE rank <= 300")
def shuffle_split_budget(spark, sf):
    return splits.shuffle_split(_stored(spark, sf), (0.95, 0.05, 0.0), 7, 300).select("ord", F.col("rank").cast("long").alias("rank"), "partition")


@query(f"""WITH d AS (SELECT doc_id AS ord, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents),
r AS (SELECT *, {_SHUFFLED.format(seed=42)} AS k FROM d WHERE split = 'train')
SELECT ord, split AS partition FROM r WHERE k <= 200 UNION ALL SELECT ord, split FROM d WHERE split <> 'train'""")  # fmt: skip
def official_budget(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train").alias("split"))
    return splits.official_split(d, budget=200).select("ord", "partition")


@query("""WITH d AS (SELECT doc_id AS ord, sum(greatest(1, length(text) // 2)) OVER (ORDER BY doc_id) AS running FROM documents)
SELECT ord, running::BIGINT AS running_tokens FROM d WHERE running <= 500000""")
def token_cap(spark, sf):
    d = _docs(spark, sf, "text").withColumnRenamed("doc_id", "ord")
    return splits.token_cap(d, tx.record_counter(F.array("text")), 500_000).select("ord", "running_tokens")


@query(f"""WITH {_CLEAN}, g AS (SELECT source, row_number() OVER (ORDER BY sha256('11|' || source), source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM c))
SELECT c.ord, CASE WHEN k <= floor(n::DOUBLE * 0.75::DOUBLE) THEN 'train' ELSE 'validation' END AS partition FROM c JOIN g USING (source)""")  # fmt: skip
def document_split(spark, sf):
    return splits.split_by_groups(_stored(spark, sf), F.col("source"), 0.25, 11).select("ord", "partition")


@query(f"""WITH {_CLEAN}, g AS (SELECT source, row_number() OVER (ORDER BY sha256('11|' || source), source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM c)),
q AS (SELECT c.source, CASE WHEN k <= floor(n::DOUBLE * 0.75::DOUBLE) THEN 'train' ELSE 'validation' END AS p FROM c JOIN g USING (source)) SELECT source AS key FROM q GROUP BY 1 HAVING count(DISTINCT p) > 1""")
def leak_check(spark, sf):
    return splits.leaks(splits.split_by_groups(_stored(spark, sf), F.col("source"), 0.25, 11), F.col("source"))


@query(f"WITH p AS (SELECT doc_id, {_STRIP} AS t FROM documents), m AS (SELECT DISTINCT t FROM p WHERE doc_id % 2 = 0 AND t <> ''), s AS (SELECT count(*)::BIGINT AS total, count(m.t)::BIGINT AS overlap FROM p LEFT JOIN m USING (t) WHERE doc_id % 2 = 1 AND p.t <> '') "
       "SELECT total, overlap, round(overlap::DOUBLE / total, 4) AS overlap_ratio, CASE WHEN overlap::DOUBLE / total >= 0.9 THEN 'exclude' ELSE 'include' END AS verdict FROM s")  # fmt: skip
def overlap_exact(spark, sf):
    d = _docs(spark, sf, "text")
    return overlap(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"))


@query(f"""WITH {_CLEAN}, q AS (SELECT *, CASE WHEN ord % 10 = 0 THEN 'validation' ELSE 'train' END AS partition FROM c)
SELECT n AS partition, count(ord)::BIGINT AS records, sum(CASE WHEN ord IS NOT NULL THEN greatest(1, length(text) // 2) END)::BIGINT AS tokens, coalesce(sum(length(text)), 0)::BIGINT AS chars
FROM (SELECT unnest(['train', 'validation', 'test']) AS n) LEFT JOIN q ON n = partition GROUP BY 1""")  # fmt: skip
def partition_manifest(spark, sf):
    d = _clean(spark, sf).withColumn("partition", F.when(F.col("ord") % 10 == 0, "validation").otherwise("train"))
    texts = F.array("text")
    return metrics.partition_stats(d, ["train", "validation", "test"], tx.record_counter(texts), tx.chars_of(texts))


@query("""SELECT conv_id, array_to_string(list(role || ':' || coalesce(text, '') ORDER BY turn), chr(10)) AS turns, count(*)::INT AS n FROM conversations GROUP BY conv_id""")
def to_messages(spark, sf):
    m = chat.to_messages(spark.read.parquet(f"{sf}/conversations.parquet"))
    return m.select("conv_id", F.array_join(F.transform("messages", lambda x: F.concat(x.role, F.lit(":"), F.coalesce(x.content, F.lit("")))), "\n").alias("turns"), F.size("messages").alias("n"))


@query(f"WITH {_MSGS}, f AS (SELECT ord, list_filter(messages, lambda x: x.content IS NOT NULL AND x.content <> '') AS k FROM m) SELECT ord, len(k)::INT AS n FROM f WHERE len(k) >= 2")
def messages_filtered(spark, sf):
    return chat.valid_conversations(_conversations(spark, sf)).select("ord", F.size("messages").alias("n"))


@query(f"""WITH {_MSGS}, p AS (SELECT ord, regexp_replace(messages[1].content, '^[{tx.SPACE}]+|[{tx.SPACE}]+$', '', 'g') AS prompt FROM m),
g AS (SELECT prompt, row_number() OVER (ORDER BY sha256('5|' || prompt), prompt) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT prompt FROM p))
SELECT ord, CASE WHEN k <= floor(n::DOUBLE * 0.9::DOUBLE) THEN 'train' ELSE 'validation' END AS partition FROM p JOIN g USING (prompt)""")  # fmt: skip
def prompt_split(spark, sf):
    return splits.split_by_prompt(_conversations(spark, sf), 0.1, 5).select("ord", "partition")


@query(f"""WITH {_MSGS}, p AS (SELECT regexp_replace(messages[1].content, '^[{tx.SPACE}]+|[{tx.SPACE}]+$', '', 'g') AS prompt, min(ord) AS ord FROM m GROUP BY 1),
r AS (SELECT prompt, {_SHUFFLED.format(seed=2026)} AS k FROM p) SELECT (k - 1)::INT AS prompt_index, prompt FROM r WHERE k <= 50""")  # fmt: skip
def prompt_set_50(spark, sf):
    return splits.prompt_set(_conversations(spark, sf))


@query("SELECT conv_id AS ord, sum(length(role) + coalesce(length(text), 0))::BIGINT AS chars, (count(*) + count(CASE WHEN text <> '' THEN 1 END))::INT AS texts FROM conversations GROUP BY 1")
def extract_texts(spark, sf):
    m = _conversations(spark, sf)
    texts = tx.texts_of(m.select("messages").schema)
    return m.select("ord", tx.chars_of(texts).alias("chars"), F.size(texts).alias("texts"))


@query("SELECT coalesce(lang, 'overall') AS category, sum(len(string_split_regex(trim(text, ' '), ' +')))::BIGINT AS n_tokens, sum(length(text))::BIGINT AS n_chars, sum(len(string_split_regex(trim(text, ' '), ' +')))::DOUBLE / sum(length(text)) AS tokens_per_char FROM documents GROUP BY ROLLUP (lang)")
def tokens_per_char(spark, sf):
    return tokenizer.tokens_per_char(_docs(spark, sf, "text", "lang"), F.size(F.split(F.trim("text"), " +")), "text", "lang")


@query("""WITH t AS (SELECT lang AS category, sum(octet_length(encode(text)))::DOUBLE / sum(length(text)) AS a, sum(length(text) - length(replace(text, ' ', '')))::DOUBLE / sum(length(text)) AS b FROM documents GROUP BY 1
UNION ALL SELECT 'overall', sum(octet_length(encode(text)))::DOUBLE / sum(length(text)), sum(length(text) - length(replace(text, ' ', '')))::DOUBLE / sum(length(text)) FROM documents)
SELECT category, a AS custom_tokens_per_char, b AS reference_tokens_per_char, CASE WHEN b <> 0 THEN a / b ELSE 0 END AS ratio_custom_over_reference FROM t""")
def compare_tokens_per_char(spark, sf):
    d = _docs(spark, sf, "text", "lang")
    own = tokenizer.tokens_per_char(d, F.octet_length("text"), "text", "lang")
    other = tokenizer.tokens_per_char(d, F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))), "text", "lang")
    return tokenizer.compare_tokens_per_char(own, other)


@query("SELECT count(*)::BIGINT AS docs, sum(octet_length(encode(text)))::BIGINT AS tokens, avg(octet_length(encode(text))) AS mean_tokens FROM documents")
def corpus_stats(spark, sf):
    return tokenizer.corpus_stats(_docs(spark, sf, "text"), F.octet_length("text"))


@query("""WITH s AS (SELECT sum(CASE WHEN doc_id % 10 = 0 THEN octet_length(encode(text)) END)::BIGINT AS v, sum(CASE WHEN doc_id % 10 <> 0 THEN length(text) END)::BIGINT AS tc, sum(CASE WHEN doc_id % 10 = 0 THEN length(text) END)::BIGINT AS vc FROM documents),
k AS (SELECT unnest([16000, 32000])::INT AS vocab)
SELECT vocab, vocab::BIGINT * 512 * 2 AS vocab_params, (vocab::BIGINT * 512 * 2) / 65400000::DOUBLE AS share, round_even(v * (tc::DOUBLE / vc), 0)::BIGINT AS train_tokens, ceil(round_even(v * (tc::DOUBLE / vc), 0) / 512)::BIGINT AS sequences FROM s, k""")
def vocab_impact(spark, sf):
    d = _docs(spark, sf, "text").withColumn("v", F.col("doc_id") % 10 == 0)
    s = d.agg(F.sum(F.when(F.col("v"), F.octet_length("text"))).alias("vt"), F.sum(F.when(~F.col("v"), F.length("text"))).alias("tc"), F.sum(F.when(F.col("v"), F.length("text"))).alias("vc"))
    rows = s.withColumn("vocab", F.explode(F.array(F.lit(16000), F.lit(32000))))
    train = numeric.scaled_tokens("vt", "tc", "vc")
    params = numeric.embedding_head_params(F.col("vocab").cast("long"), F.lit(512))
    return rows.select("vocab", params.alias("vocab_params"), (params / F.lit(65400000.0)).alias("share"), train.alias("train_tokens"), numeric.sequences_for(train, F.lit(512)).cast("long").alias("sequences"))


@query()
def pretoken_counts(spark, sf):
    """Look-ahead keeps this pattern out of the oracle's regex dialect; tests hold it against ``regex``."""
    return tokenizer.pretoken_counts(_docs(spark, sf, "text"))


@query()
def bpe_vocabulary(spark, sf):
    """(id, token in hexadecimal) of a 400-entry vocabulary; tests hold it against the tokenizers library."""
    vocab = tokenizer.train_on(_docs(spark, sf, "text"), 400)
    return spark.createDataFrame([(i, b.hex()) for b, i in vocab.ids.items()], "id int, token string")


@query("SELECT count(*)::BIGINT AS checked, true AS ok, 0 AS failures FROM documents")
def bpe_round_trip(spark, sf):
    d = _docs(spark, sf, "text")
    out = tokenizer.round_trip(d, tokenizer.train_on(d, 400))
    return out.select("checked", "ok", F.col("failed").cast("int").alias("failures"))


_WORDS = "list_filter(string_split_regex(text, ' +'), lambda w: w <> '')"
_STREAM = f"""i AS (SELECT doc_id AS ord, list_concat([0], list_transform({_WORDS}, lambda w: 4 + length(w)), [1]) AS ids FROM documents),
s AS (SELECT *, (sum(len(ids)) OVER (ORDER BY ord))::BIGINT AS stream_end FROM i)"""


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream with word lengths as ids."""
    words = F.filter(F.split("text", " +"), lambda w: w != "")
    ids = packing.framed(F.transform(words, lambda w: F.length(w) + 4), 0, 1)
    return packing.stream_offsets(_docs(spark, sf, "text").select(F.col("doc_id").alias("ord"), ids.alias("ids")))


@query(f"WITH {_STREAM} SELECT ord, len(ids)::INT AS n, stream_end - len(ids) AS stream_start, stream_end FROM s")
def doc_offsets(spark, sf):
    return _stream(spark, sf).select("ord", F.size("ids").alias("n"), "stream_start", "stream_end")


@query(f"""WITH {_STREAM}, n AS (SELECT max(stream_end) AS n FROM s), o AS (SELECT range AS block_id, range * 997 AS "offset" FROM range((SELECT greatest(0, (n - 65) // 997 + 1) FROM n))),
w AS (SELECT block_id, "offset", "offset" + unnest(range(65)) AS position FROM o),
f AS (SELECT (stream_end - len(ids)) + k - 1 AS position, ids[k] AS token FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS k FROM s))
SELECT block_id, array_to_string(list(token ORDER BY position) FILTER (WHERE position < "offset" + 64), ' ') AS input, array_to_string(list(token ORDER BY position) FILTER (WHERE position > "offset"), ' ') AS label
FROM w JOIN f USING (position) GROUP BY 1""")  # fmt: skip
def blocks(spark, sf):
    """Blocks at every 997th token of the whole stream."""
    stream = _stream(spark, sf)
    n = stream.agg(F.sum(F.size("ids"))).first()[0] or 0
    offsets = spark.range(max(0, (n - 65) // 997 + 1)).select(F.col("id").alias("block_id"), (F.col("id") * 997).alias("offset"))
    out = packing.blocks(stream, offsets, 64)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return out.select("block_id", text("input").alias("input"), text("label").alias("label"))


@query(f"""WITH {_STREAM}, n AS (SELECT max(stream_end) AS n FROM s),
o AS (SELECT range AS block_id, ('0x' || substr(sha256('42|' || range::VARCHAR), 1, 15))::BIGINT % (n - 64) AS "offset" FROM n, range((SELECT (n - 1) // 997 + 1 FROM n))),
w AS (SELECT block_id, "offset", "offset" + unnest(range(65)) AS position FROM o),
f AS (SELECT (stream_end - len(ids)) + k - 1 AS position, ids[k] AS token FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS k FROM s))
SELECT block_id, any_value("offset")::BIGINT AS "offset", array_to_string(list(token ORDER BY position) FILTER (WHERE position < "offset" + 64), ' ') AS input, array_to_string(list(token ORDER BY position) FILTER (WHERE position > "offset"), ' ') AS label
FROM w JOIN f USING (position) GROUP BY 1""")  # fmt: skip
def stream_blocks(spark, sf):
    """Blocks at seeded offsets over the whole stream, one for each 997 tokens."""
    stream = _stream(spark, sf)
    length = stream.agg(F.sum(F.size("ids"))).first()[0] or 0
    out = packing.blocks(stream, packing.spread_offsets(spark, length, 64, 997, 42), 64)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return out.select("block_id", "offset", text("input").alias("input"), text("label").alias("label"))


@query("""WITH t AS (SELECT conv_id AS ord, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, text AS u, lead(text) OVER w AS a, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT ord, place::INT AS place, 'user: ' || u || chr(10) || 'assistant: ' || a AS rendered, (length(u) + length(a) + 3)::INT AS tokens, (length(a) + 2)::INT AS assistant_tokens FROM t WHERE next_role IS NOT NULL AND u <> '' AND a <> ''""")
def assistant_mask(spark, sf):
    """The small template over every turn and the one that follows it, whatever their roles, one id a character;
    ``assistant_pairs`` goes by role."""
    c = _conversations(spark, sf)
    at = c.select("ord", "messages", F.explode(F.when(F.size("messages") > 1, F.sequence(F.lit(0), F.size("messages") - 2))).alias("place"))
    two = at.select("ord", "place", F.slice("messages", F.col("place") + 1, 2).alias("messages"))
    return _masked(two.where("messages[0].content <> '' AND messages[1].content <> ''"), "ord", "place")


def _masked(pairs: DataFrame, *columns: str) -> DataFrame:
    ids = lambda k: F.transform(F.split(F.col("messages")[k].content, ""), lambda c: F.ascii(c))
    tokens, mask = chat.pair_ids(ids(0), ids(1), 0, 1)
    return pairs.select(*columns, chat.render_pair("messages").alias("rendered"), F.size(tokens).alias("tokens"), F.aggregate(mask, F.lit(0), lambda n, x: n + x).alias("assistant_tokens"))


@query("""WITH t AS (SELECT conv_id AS ord, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, text AS u,
lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations)
SELECT ord, place::INT AS place, 'user: ' || u || chr(10) || 'assistant: ' || a AS rendered, (length(u) + length(a) + 3)::INT AS tokens, (length(a) + 2)::INT AS assistant_tokens
FROM t WHERE role = 'user' AND next_role = 'assistant' AND u <> '' AND a <> ''""")
def assistant_pairs(spark, sf):
    """The small template over every user turn (place counts turns from 0) with the assistant turn that follows it."""
    pairs = chat.answered_turns(_conversations(spark, sf))
    return _masked(pairs, "ord", "place")


_GRAMS = f"""w AS (SELECT doc_id, list_filter(string_split_regex(text, '[{tx.SPACE}]+'), lambda x: x <> '') AS w FROM documents),
r AS (SELECT doc_id, len(w) AS words, CASE WHEN len(w) < 4 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) / (len(w) - 3)::DOUBLE END AS ratio FROM w)"""


@query(f"WITH {_GRAMS} SELECT doc_id, ratio FROM r")
def diversity(spark, sf):
    return _docs(spark, sf, "text").select("doc_id", tx.ngram_ratio("text").alias("ratio"))


@query(f"WITH {_GRAMS} SELECT count(*)::BIGINT AS n_texts, avg(words) AS mean_words, round(avg(ratio), 9) AS mean_distinct_4gram_ratio FROM r")
def diversity_summary(spark, sf):
    out = metrics.generation_diversity(_docs(spark, sf, "text"), "text")
    return out.withColumn("mean_distinct_4gram_ratio", F.round("mean_distinct_4gram_ratio", 9))


_ROUND = ("avg_tokens_s", "avg_step_time_s")


@query(f"""WITH {_RUNS} SELECT run, count(*)::BIGINT AS steps, round(avg(tokens_s), 6) AS avg_tokens_s, round(avg(step_time_s), 6) AS avg_step_time_s, arg_min(train_loss, ord) AS first_train_loss, arg_max(train_loss, ord) AS last_train_loss,
min(val_loss) AS best_val_loss, (list(global_step ORDER BY val_loss, ord) FILTER (WHERE val_loss IS NOT NULL))[1] AS best_step, arg_max(val_loss, ord) FILTER (WHERE val_loss IS NOT NULL) AS last_val_loss, max(peak_mem_gb) AS peak_mem_gb,
arg_max(val_loss - train_loss, ord) FILTER (WHERE val_loss IS NOT NULL) AS val_train_gap FROM l GROUP BY run""")  # fmt: skip
def run_summary(spark, sf):
    out = metrics.run_summary(_runs(spark, sf), "run", "ord")
    return out.withColumns({c: F.round(c, 6) for c in _ROUND})


@query(f"""WITH {_RUNS} SELECT run, arg_max(train_loss, ord) FILTER (WHERE global_step = 20) AS before, arg_max(train_loss, ord) FILTER (WHERE global_step = 21) AS after FROM l GROUP BY run""")
def resume_continuity(spark, sf):
    return metrics.resume_continuity(_runs(spark, sf), "run", "global_step", "ord", 20)


@query("SELECT event_id, CASE WHEN value > 0 THEN 6.0::DOUBLE * 1000 * value / (1e6 * value) END AS mfu FROM events")
def mfu(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", numeric.mfu(numeric.training_flops(F.lit(1000.0), "value"), F.lit(1e6), "value").alias("mfu"))


_EVALS = """e AS (SELECT CASE WHEN user_id % 7 = 0 THEN 'domain_val' ELSE 'general_' || (user_id % 7) END AS eval_name, event_id % 2 AS side, value / 100 AS loss FROM events),
b AS (SELECT eval_name, avg(loss) AS l FROM e WHERE side = 0 GROUP BY 1), t AS (SELECT eval_name, avg(loss) AS l FROM e WHERE side = 1 GROUP BY 1),
c AS (SELECT eval_name, b.l AS bl, exp(b.l) AS bp, t.l AS tl, exp(t.l) AS tp, CASE WHEN eval_name = 'domain_val' THEN 'domain' ELSE 'general' END AS kind FROM b JOIN t USING (eval_name))"""


def _comparison(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    name = F.when(F.col("user_id") % 7 == 0, "domain_val").otherwise(F.concat(F.lit("general_"), (F.col("user_id") % 7).cast("string")))
    rows = e.select(name.alias("eval_name"), (F.col("event_id") % 2).alias("side"), (F.col("value") / 100).alias("loss"))
    side = lambda k: metrics.mean_loss(rows.where(F.col("side") == k), ["eval_name"])
    return metrics.compare_models(side(0), side(1))


@query(f"WITH {_EVALS} SELECT eval_name, round(bl, 7) AS base_val_loss, round(bp, 7) AS base_ppl, round(tl, 7) AS cpt_val_loss, round(tp, 7) AS cpt_ppl, round(tp - bp, 7) AS delta_ppl, round(100.0::DOUBLE * (tp - bp) / bp, 6) AS delta_pct, kind FROM c")
def model_compare(spark, sf):
    out = _comparison(spark, sf)
    return out.select("eval_name", *[F.round(c, 7).alias(c) for c in ("base_val_loss", "base_ppl", "cpt_val_loss", "cpt_ppl", "delta_ppl")], F.round("delta_pct", 6).alias("delta_pct"), "kind")


@query(f"WITH {_EVALS} SELECT coalesce(max(tp - bp) FILTER (WHERE kind = 'domain') < 0, false) AS domain_ppl_improved, round(max(tp - bp) FILTER (WHERE kind = 'domain'), 7) AS domain_ppl_delta, round(coalesce(max(tp - bp) FILTER (WHERE kind = 'general'), 0), 7) AS general_ppl_max_degradation, round(avg(tp - bp) FILTER (WHERE kind = 'general'), 7) AS general_ppl_mean_delta, count(*) FILTER (WHERE kind = 'general') > 0 AS general_degradation_quantified FROM c")
def compare_summary(spark, sf):
    out = metrics.compare_summary(_comparison(spark, sf))
    return out.withColumns({c: F.round(c, 7) for c in ("domain_ppl_delta", "general_ppl_max_degradation", "general_ppl_mean_delta")})


@query("""WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)
SELECT count(*)::BIGINT AS pairs, count(*) FILTER (WHERE text = next)::BIGINT AS equal FROM t WHERE next IS NOT NULL""")
def exact_match(spark, sf):
    """Every turn as one generation, and the turn that follows it as the other."""
    two = F.transform("messages", lambda m, i: F.struct(i.alias("i"), m.content.alias("a"), F.get("messages", i + 1).content.alias("b")))
    c = _conversations(spark, sf).select("ord", F.explode(two).alias("t")).where("t.b IS NOT NULL")
    key = F.struct("ord", "t.i").alias("prompt_index")
    return metrics.exact_matches(c.select(key, F.col("t.a").alias("generated")), c.select(key, F.col("t.b").alias("generated")))


@query("WITH p AS (SELECT user_id % 5 AS series, ln(event_id + 1) AS x, ln(value + 1) AS y FROM events WHERE value >= 0) SELECT series, count(*)::BIGINT AS n_points, round(-regr_slope(y, x), 7) AS alpha, round(exp(regr_intercept(y, x)), 7) AS c, round(regr_r2(y, x), 7) AS r2, -regr_slope(y, x) BETWEEN 0.01 AND 1 AS in_literature_range FROM p GROUP BY 1")
def powerlaw_fit(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("value >= 0")
    points = e.select((F.col("user_id") % 5).alias("series"), (F.col("event_id") + 1).alias("n_params"), (F.col("value") + 1).alias("loss"))
    out = metrics.power_law(points, by=["series"])
    return out.select("series", "n_points", *[F.round(c, 7).alias(c) for c in ("alpha", "c", "r2")], "in_literature_range")


@query("""WITH n AS (SELECT user_id AS run, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, count(*) OVER (PARTITION BY user_id) AS total FROM events), w AS (SELECT *, total // 10 AS warm FROM n)
SELECT run, ord, step, round(CASE WHEN step < warm THEN 3e-4 * (step + 1) / warm WHEN step >= total THEN 3e-5 ELSE 3e-5 + 2.7e-4 * 0.5 * (1 + cos(pi() * (step - warm) / greatest(1, total - warm))) END, 12)::DOUBLE AS lr FROM w""")
def lr_schedule(spark, sf):
    """The rate of every logged step, for runs of their own lengths, a tenth of which warm up."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"))
    own = Window.partitionBy("run")
    n = e.withColumns({"step": (F.row_number().over(own.orderBy("ord")) - 1).cast("long"), "total": F.count("*").over(own)})
    rate = numeric.warmup_cosine("step", "total", F.floor(F.col("total") / 10), 3e-4, 0.1)
    return n.select("run", "ord", "step", F.round(rate, 12).alias("lr"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / 0.5) AS z FROM embeddings), e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM v),
p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e), k AS (SELECT vec_id, list_transform(p, lambda x: CASE WHEN x >= list_sort(p, 'DESC')[5] THEN x ELSE 0 END) AS k FROM p)
SELECT vec_id, round(list_max(k) / list_sum(k), 9) AS top, len(list_filter(k, lambda x: x > 0))::INT AS kept, (list_position(k, list_max(k)) - 1)::INT AS greedy FROM k""")
def softmax_topk(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    p = v.withColumn("p", numeric.top_k_filter(numeric.softmax("v", 0.5), 5))
    return p.select("vec_id", F.round(F.array_max("p"), 9).alias("top"), F.size(F.filter("p", lambda x: x > 0)).alias("kept"), numeric.sample_next("v", F.lit(0.5), 0.0).alias("greedy"))


@query("""WITH d AS (SELECT p_size % 5 AS grp, 28 * sum(p_size * 16 + (p_partkey % 64 + 1) * 16) AS one FROM part GROUP BY 1), t AS (SELECT p_size % 5 AS grp, sum(l_quantity * 1000) AS tokens FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
c AS (SELECT grp, r, r * one AS params, tokens / 20.0::DOUBLE AS target FROM d JOIN t USING (grp), (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS r)), q AS (SELECT *, round_even(params / target, 2) AS ratio FROM c)
SELECT grp, r::INT AS rank, params::BIGINT AS params, round(target, 3) AS target, ratio, row_number() OVER (PARTITION BY grp ORDER BY abs(ratio - 1), r) = 1 AS chosen FROM q""")
def lora_rank(spark, sf):
    """Adapters on the parts as modules (widths from size and key), five groups of them, sized by what was sold of each."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    dims = part.select((F.col("p_size") % 5).alias("grp"), F.col("p_partkey").alias("module"), (F.col("p_size") * 16).alias("d_in"), ((F.col("p_partkey") % 64 + 1) * 16).alias("d_out"))
    sold = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("p_partkey"), "l_quantity").join(part, "p_partkey")
    tokens = sold.groupBy((F.col("p_size") % 5).alias("grp")).agg(F.sum(F.col("l_quantity") * 1000).alias("tokens"))
    out = metrics.recommend_ranks(dims, 28, tokens, ["grp"])
    return out.select("grp", "rank", "params", F.round("target", 3).alias("target"), "ratio", "chosen")


@query("SELECT quality, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def quality_by_label(spark, sf):
    """An extension: labels joined to the corpus."""
    d, labels = _docs(spark, sf, "n_chars"), spark.read.parquet(f"{sf}/labels.parquet")
    return d.join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


from . import queries_more  # noqa: E402, F401  registers its own
