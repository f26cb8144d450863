"""Quality rules with host-level verdicts.

Each whole text is measured by built-in functions: words, characters in words, symbols, repeated
lines, words in repeated 8-word windows, words equal to the one before. Rules turn the measures into
failures. Failures are aggregated by host (``source``); an empirical beta prior, fitted by moments to
all hosts' rates, shrinks each host's rate; the verdict joins back to the documents. A host is suspect
whose shrunk rate is twice the hosts' mean or more, or one half. A document is kept unless the base rule
fails, a strong rule fails, or a weak rule fails on a suspect host. A clean document is kept on any host.

Nulls: a null text has no words, so the base rule fails; null hosts form one host. Empty and very
long texts are measured alike. Repeated rows are measured each by itself. An empty table gives no
rows. All input columns are kept; those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, load, materialize

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_words")
_OWN = (*MEASURES, "base_failed", "strong_failed", "weak_failed", "host_docs", "host_rate", "host_suspect", "kept")


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _measures_sql(text: str, window: int) -> str:
    # Of the hashes of all windows, with places: those equal to a neighbour in sorted order. Then, of these, those
    # whose words are equal too.
    beside = lambda a, *of: " OR ".join(f"({edge} AND {' AND '.join(f'get({a}, j {step}).{x} = e.{x}' for x in of)})" for edge, step in (("j > 0", "- 1"), (f"j < size({a}) - 1", "+ 1")))
    hashed = _let("s", "array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i)))", f"filter(s, (e, j) -> {beside('s', 'h')})")
    worded = f"array_sort(transform({hashed}, e -> named_struct('h', e.h, 'g', array_join(slice(w, e.i + 1, {window}), ' '), 'i', e.i)))"
    places = f"array_sort(transform(filter(r, (e, j) -> {beside('r', 'h', 'g')}), e -> e.i))"
    covered = f"aggregate({places}, named_struct('last', {-window}, 'n', 0L), (a, i) -> named_struct('last', i, 'n', a.n + least({window}, i - a.last)), a -> a.n)"
    repeats = _let("r", worded, covered)
    hashes = f"transform(sequence(1, size(w) - {window - 1}), i -> xxhash64(slice(w, i, {window})))"
    repeat = f"CASE WHEN size(w) <= {window} THEN 0L ELSE {_let('h', hashes, f'CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {repeats} END')} END"
    same = "cast(size(filter(w, (x, i) -> i > 0 AND get(w, i - 1) = x)) as long)"
    of_words = f"named_struct('n_words', cast(size(w) as long), 'word_chars', cast(length(array_join(w, '')) as long), 'n_repeat_words', {repeat}, 'n_same_words', {same})"
    words = _let("w", rf"filter(split({text}, '[\\x20\\x09-\\x0D]+'), x -> x <> '')", of_words)
    lines = _let("l", rf"filter(split({text}, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')", "named_struct('n_lines', cast(size(l) as long), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) as long))")
    return f"named_struct('w', {words}, 'l', {lines}, 'n_symbols', cast(regexp_count({text}, '[#*$%&|<>]') as long))"


def measured(df: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """``df`` with the measures of MEASURES."""
    df = df.drop(*[c for c in _OWN if c != text_col])
    m = df.withColumn("_m", F.expr(_measures_sql(f"coalesce(`{text_col}`, '')", window)))
    where = {"n_symbols": "_m.n_symbols", "n_dup_lines": "_m.l.n_dup_lines", "n_lines": "_m.l.n_lines"}
    return m.withColumns({c: F.expr(where.get(c, f"_m.w.{c}")) for c in MEASURES}).drop("_m")


def ruled(df: DataFrame, min_words: int = 20, repeat_percent: int = 30, symbol_share: float = 0.08, same_share: float = 0.3, line_share: float = 0.5) -> DataFrame:
    """Measures to failures: base_failed, strong_failed and weak_failed (half of a strong limit)."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    over = lambda k: (
        (F.col("n_symbols") > k * symbol_share * F.col("word_chars"))
        | (F.col("n_same_words") > k * same_share * F.col("n_words"))
        | (F.col("n_dup_lines") > k * line_share * F.col("n_lines"))
    )
    return df.withColumns({"base_failed": base, "strong_failed": over(1.0), "weak_failed": over(0.5)})


def host_verdicts(rules: DataFrame, host_col: str = "source", suspect_rate: float = 0.5, suspect_ratio: float = 2.0) -> DataFrame:
    """(host, host_docs, host_rate, host_suspect): rates shrunk to an empirical beta prior.

    The prior's mean is the hosts' mean rate; its strength comes from the rates' variance beyond
    that of sampling (method of moments). A host is suspect from ``suspect_rate`` on, or from ``suspect_ratio``
    times the mean, whichever is less.
    """
    failed = F.col("base_failed") | F.col("strong_failed")
    hosts = rules.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("host_docs"), F.sum(failed.cast("long")).alias("_failed"))
    moments = hosts.agg(F.avg(F.col("_failed") / F.col("host_docs")).alias("_mean"), F.var_pop(F.col("_failed") / F.col("host_docs")).alias("_var"), F.avg(1 / F.col("host_docs")).alias("_inverse"))
    spread = "_mean * (1 - _mean)"
    beyond = f"greatest(_var - {spread} * _inverse, 1e-9D)"
    strength = f"greatest(1D, least(1e6D, {spread} / ({beyond}) - 1))"
    rate = F.expr(f"(_failed + _mean * {strength}) / (host_docs + {strength})")
    # One row of moments beside each host.
    out = hosts.join(F.broadcast(moments)).withColumn("host_rate", rate)
    limit = F.least(F.lit(suspect_rate), F.lit(suspect_ratio) * F.col("_mean"))
    return out.select("host", "host_docs", "host_rate", (F.col("host_rate") >= limit).alias("host_suspect"))


def assess(df: DataFrame, text_col: str = "text", host_col: str = "source", keep_text: bool = True, **limits) -> DataFrame:
    """``df`` with measures, failures, the host's shrunk rate and verdict, and kept.

    What the rules need is measured once and kept in the shared folder, beside all other columns; without
    ``keep_text`` the text is left out there and in what is returned.
    """
    found = ruled(measured(df, text_col), **limits)
    rules = materialize(found if keep_text or text_col == host_col else found.drop(text_col))
    key = lambda c: F.concat(F.when(F.col(c).isNull(), "n").otherwise("v"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    hosts = host_verdicts(rules, host_col).withColumn("_host", key("host")).drop("host")
    out = join_small(rules.withColumn("_host", key(host_col)), hosts, "_host").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("strong_failed") & ~(F.col("weak_failed") & F.col("host_suspect")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts for all documents."""
    out = assess(load(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS k FROM documents),
g AS (SELECT k, i, w[i:i + 7] AS gram FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT k, sum(least(8, i - last))::BIGINT AS n FROM (SELECT k, i, lag(i, 1, -8) OVER (PARTITION BY k ORDER BY i) AS last FROM r) GROUP BY k),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
  coalesce(c.n, 0) AS n_repeat_words,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_same
  FROM d LEFT JOIN c USING (k)),
f AS (SELECT *, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (SELECT *, n_symbols > 0.08::DOUBLE * word_chars OR n_same > 0.3::DOUBLE * n_words OR n_dup_lines > 0.5::DOUBLE * len(l) AS strong,
  n_symbols > 0.04::DOUBLE * word_chars OR n_same > 0.15::DOUBLE * n_words OR n_dup_lines > 0.25::DOUBLE * len(l) AS weak FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed OR strong)::DOUBLE AS x FROM v GROUP BY source),
p AS (SELECT avg(x / n) AS mean, var_pop(x / n) AS var, avg(1 / n) AS inv FROM h),
q AS (SELECT mean, greatest(1, least(1e6, mean * (1 - mean) / greatest(var - mean * (1 - mean) * inv, 1e-9) - 1)) AS strength FROM p),
j AS (SELECT source, (x + mean * strength) / (n + strength) >= least(0.5, 2 * mean) AS suspect FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT strong AND NOT (weak AND suspect) AS kept
FROM v JOIN j ON v.source IS NOT DISTINCT FROM j.source
"""
