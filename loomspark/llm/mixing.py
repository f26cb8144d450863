"""Mixing sources to target weights: words per source, repetition rates, then whole copies of documents.

A document's size is its number of words. Sources in code-point order, null last, weigh 5, 2, 1,
repeating, and share the target (by default 100 % of all words). A source's target stops at
``max_repeat`` times its size; the excess goes to the others by weight until none is above. Each
document is emitted floor(rate) times plus once more with probability equal to the fraction, decided
by a seeded MD5 of its id and text, so reruns agree.

Nulls: a null text has size 0; null sources form one source, last. Empty texts keep their expected
number of copies. Repeated rows draw alike. A source without words has target 0 and rate 1 (its rows
add no words). An empty table gives no rows. Columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, join_small, load, materialize

WEIGHTS = (5, 2, 1)
_OWN = ("size", "source_size", "target", "rate", "copies", "taken")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeat: float = 3.0) -> DataFrame:
    """(source, source_size, target, rate) from one row (source, source_size) per source. Windows order all
    sources in one task, a row of a few dozen bytes each: sources are thought to number millions at most.

    Water-filling in closed form: in the order of cap over weight, the capped sources are a prefix,
    which ends where the rest's common level no longer reaches the next cap. ``share`` of all
    words is given out, or as much as the caps allow.
    """
    by_name = "row_number() OVER (ORDER BY source IS NULL, source)"
    weight = f"element_at(array({', '.join(f'{float(w)}D' for w in weights)}), cast(({by_name} - 1) % {len(weights)} as int) + 1)"
    w = sizes.withColumns({"_w": F.expr(weight), "_cap": F.expr(f"{float(max_repeat)}D * source_size")})
    w = w.withColumns({"_all": F.expr(f"{float(share)}D * sum(source_size) OVER ()"), "_order": F.expr("row_number() OVER (ORDER BY _cap / _w, source IS NULL, source)")})
    before = "OVER (ORDER BY _order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    rest = "OVER (ORDER BY _order ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    w = w.withColumn("_level", F.expr(f"(_all - coalesce(sum(_cap) {before}, 0D)) / sum(_w) {rest}"))
    w = w.withColumn("_fits", F.expr("min(CASE WHEN _cap >= _level * _w THEN _order END) OVER ()"))
    w = w.withColumn("_final", F.expr("max(CASE WHEN _order = _fits THEN _level END) OVER ()"))
    w = w.withColumn("target", F.expr("CASE WHEN _fits IS NULL OR _order < _fits THEN _cap ELSE least(_cap, _final * _w) END"))
    rate = F.expr(f"CASE WHEN source_size > 0 THEN least(target / source_size, {float(max_repeat)}D) ELSE 1D END")
    return w.select("source", "source_size", "target", rate.alias("rate"))


def sized(df: DataFrame, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``df`` with size (words) and draw (0 to 1, by a seeded MD5 of id and text)."""
    df = df.drop(*[c for c in (*_OWN, "draw") if c not in (id_col, text_col, source_col)])
    size = F.coalesce(F.expr(f"regexp_count(`{text_col}`, '{WORD.replace(chr(92), chr(92) * 2)}')"), F.lit(0)).cast("long")
    drawn = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    return df.withColumns({"size": size, "draw": F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))})


def planned(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeat: float = 3.0, source_col: str = "source") -> DataFrame:
    """Rows of ``sized`` with source_size, target, rate, copies and taken = size * copies.

    The sources' targets are written once, a row a source; ``rows`` is read once for them, and once more here
    (where its sizes are not counted again unless they are asked for).
    """
    sizes = rows.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, max_repeat))
    # Null-safe: the key is the source behind a flag, so that a null source is a value like others.
    key = lambda c: F.concat(F.when(F.col(c).isNull(), "n").otherwise("v"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = join_small(rows.withColumn("_source_key", key(source_col)), targets.withColumn("_source_key", key("source")).drop("source"), "_source_key")
    copies = (F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("_source_key", "draw")


def plan(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeat: float = 3.0, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``df`` with size, source_size, target, rate, copies and taken."""
    return planned(sized(df, seed, id_col, text_col, source_col), weights, share, max_repeat, source_col)


def mix(df: DataFrame, **options) -> DataFrame:
    """The mixture: the columns of ``df``, each row as often as its source's rate says."""
    columns = df.columns
    out = plan(df, **options)
    return out.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"`{c}`") for c in columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, one row for each with the words it gives."""
    rows = sized(load(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
    return planned(materialize(rows)).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE AS total, row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS k FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT *, (SELECT min(k) FROM l WHERE cap >= level * w) AS fits FROM l),
t AS (SELECT source, source_size, CASE WHEN fits IS NULL OR k < fits THEN cap ELSE least(cap, (SELECT level FROM l WHERE k = fits) * w) END AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3) ELSE 1 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5(concat_ws('|', '29', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
