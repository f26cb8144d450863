"""Experiment logs: run summaries, resume checks, model comparison, fits and sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import perplexity


def mean_loss(blocks: DataFrame, by: list[str], loss: str = "loss") -> DataFrame:
    """Mean of block means (not weighted by tokens), perplexity and number of blocks."""
    return blocks.groupBy(*by).agg(F.avg(loss).alias("val_loss"), F.count("*").alias("val_blocks")).withColumn("val_ppl", perplexity("val_loss"))


def run_summary(log: DataFrame, run: str, ord_col: str, gap_from: str = "validated") -> DataFrame:
    """One row a run from its log (global_step, train_loss, tokens_s, step_time_s, val_loss, peak_mem_gb).

    gap_from: "validated" subtracts the train loss of the last validated row from its validation loss,
    "last" that of the log's last row.
    """
    val = F.col("val_loss").isNotNull()
    at = lambda f, c, when=None: f(F.struct(ord_col, c) if when is None else F.when(when, F.struct(ord_col, c))).getField(c)
    best = F.min(F.when(val, F.struct(F.col("val_loss"), F.col(ord_col), F.col("global_step"))))
    out = log.groupBy(run).agg(
        F.count("*").alias("steps"),
        F.avg("tokens_s").alias("avg_tokens_s"),
        F.avg("step_time_s").alias("avg_step_time_s"),
        at(F.min, "train_loss").alias("first_train_loss"),
        at(F.max, "train_loss").alias("last_train_loss"),
        best.getField("val_loss").alias("best_val_loss"),
        best.getField("global_step").alias("best_step"),
        at(F.max, "val_loss", val).alias("last_val_loss"),
        at(F.max, "train_loss", val).alias("_val_train"),
        F.max("peak_mem_gb").alias("peak_mem_gb"),
    )
    base = F.col("_val_train") if gap_from == "validated" else F.col("last_train_loss")
    return out.withColumn("val_train_gap", F.col("last_val_loss") - base).drop("_val_train")


def resume_continuity(log: DataFrame, run: str, step: str, ord_col: str, loaded: int, value: str = "train_loss") -> DataFrame:
    """(run, before, after): the value at the loaded step and at the next; of repeated steps the last
    row counts, a missing one is null."""
    at = lambda k: F.max(F.when(F.col(step) == k, F.struct(ord_col, value))).getField(value)
    return log.groupBy(run).agg(at(loaded).alias("before"), at(loaded + 1).alias("after"))


def compare_models(base: DataFrame, tuned: DataFrame, domain: str = "domain_val") -> DataFrame:
    """Evaluations (eval_name, val_loss, val_ppl) that both have: differences, percent and kind."""
    b = base.select("eval_name", F.col("val_loss").alias("base_val_loss"), F.col("val_ppl").alias("base_ppl"))
    t = tuned.select("eval_name", F.col("val_loss").alias("cpt_val_loss"), F.col("val_ppl").alias("cpt_ppl"))
    delta = F.col("cpt_ppl") - F.col("base_ppl")
    pct = F.when(F.col("base_ppl") != 0, 100.0 * delta / F.col("base_ppl"))
    return b.join(t, "eval_name").withColumns({"delta_ppl": delta, "delta_pct": pct, "kind": F.when(F.col("eval_name") == domain, "domain").otherwise("general")})


def compare_summary(comparison: DataFrame) -> DataFrame:
    """One row: whether the domain improved, by how much, and what general text lost (greatest, mean)."""
    domain = F.max(F.when(F.col("kind") == "domain", F.col("delta_ppl")))
    general = F.when(F.col("kind") == "general", F.col("delta_ppl"))
    return comparison.agg(
        F.coalesce(domain < 0, F.lit(False)).alias("domain_ppl_improved"),
        domain.alias("domain_ppl_delta"),
        F.coalesce(F.max(general), F.lit(0.0)).alias("general_ppl_max_degradation"),
        F.avg(general).alias("general_ppl_mean_delta"),
        (F.count(general) > 0).alias("general_degradation_quantified"),
    )


def exact_matches(before: DataFrame, after: DataFrame, index: str = "prompt_index", text: str = "generated") -> DataFrame:
    """One row: pairs by index and how many are equal."""
    a, b = before.select(index, F.col(text).alias("_a")), after.select(index, F.col(text).alias("_b"))
    return a.join(b, index).agg(F.count("*").alias("pairs"), F.coalesce(F.sum((F.col("_a") == F.col("_b")).cast("long")), F.lit(0)).alias("equal"))


def compare_generations(base: DataFrame, runs: dict[str, DataFrame], index: str = "prompt_index", text: str = "generated") -> DataFrame:
    """(run, prompt_index, before, after, equal): every run's generations beside the base's, by prompt; prompts that one
    side lacks have a null there and are not equal."""
    out, b = None, base.select(index, F.col(text).alias("before"))
    for name, df in runs.items():
        some = b.join(df.select(index, F.col(text).alias("after")), index, "full").select(F.lit(name).alias("run"), index, "before", "after", F.coalesce(F.col("before") == F.col("after"), F.lit(False)).alias("equal"))
        out = some if out is None else out.unionByName(some)
    return out


def generation_diversity(df: DataFrame, text: str = "generated") -> DataFrame:
    """``diversity`` of a run's generations."""
    from ..functions.text import distinct_ratio, pysplit

    split = df.select(pysplit(F.coalesce(text, F.lit(""))).alias("_w"))
    return diversity(split, distinct_ratio("_w"), F.col("_w"))


def merge_consistency(before: DataFrame, after: DataFrame, loss_before: float, loss_after: float, tolerance: float = 1e-2) -> DataFrame:
    """Whether all generations agree and losses differ by less than the tolerance."""
    out = exact_matches(before, after)
    return out.withColumn("consistent", (F.col("pairs") == F.col("equal")) & F.lit(abs(loss_before - loss_after) < tolerance))


def power_law(points: DataFrame, n: str = "n_params", loss: str = "loss", by: list[str] | None = None, alpha_range: tuple[float, float] = (0.01, 1.0)) -> DataFrame:
    """loss = c * n ** -alpha by least squares on logarithms: alpha, c, r2, n_points, in_literature_range.

    Fewer than two points, values of 0 or less, or no spread raise an error.
    """
    x, y = F.ln(F.col(n).cast("double")), F.ln(F.col(loss).cast("double"))
    slope, icept = F.regr_slope(y, x), F.regr_intercept(y, x)
    spread = F.regr_syy(y, x)
    out = points.groupBy(*(by or [])).agg(
        F.count("*").alias("n_points"),
        F.coalesce(F.sum(((F.col(n) <= 0) | (F.col(loss) <= 0)).cast("int")), F.lit(0)).alias("_bad"),
        F.min(n).alias("_lo"),
        F.max(n).alias("_hi"),
        (-slope).alias("alpha"),
        F.exp(icept).alias("c"),
        F.when(spread > 0, F.regr_r2(y, x)).alias("r2"),
    )
    wrong = F.when(F.col("n_points") < 2, "a fit needs two points").when(F.col("_bad") > 0, "parameters and losses must be above 0").when(F.col("_lo") == F.col("_hi"), "a fit needs different sizes")
    alpha = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("double")).otherwise(F.col("alpha"))
    return out.withColumn("alpha", alpha).withColumn("in_literature_range", F.col("alpha").between(*alpha_range)).drop("_bad", "_lo", "_hi")


def adapter_params(dims: DataFrame, layers: int, rank: Column | int) -> DataFrame:
    """One row: trainable parameters of low-rank adapters on modules (module, d_in, d_out)."""
    per = F.sum((F.col("d_in") + F.col("d_out")).cast("long"))
    return dims.agg((per * F.lit(layers) * rank).alias("lora_params"))


def recommend_rank(dims: DataFrame, layers: int, tokens: int, candidates: tuple[int, ...] = (1, 2, 4, 8, 16, 32, 64)) -> DataFrame:
    """Candidates (rank, params, target, ratio to 2 digits, chosen): chosen is the first whose ratio is nearest to 1."""
    if tokens < 1:
        raise ValueError("tokens must be 1 or more")
    whole = dims.sparkSession.range(1).select(F.lit(tokens).cast("long").alias("tokens"))
    return recommend_ranks(dims, layers, whole, [], candidates)


def recommend_ranks(dims: DataFrame, layers: int, tokens: DataFrame, by: list[str], candidates: tuple[int, ...] = (1, 2, 4, 8, 16, 32, 64)) -> DataFrame:
    """``recommend_rank`` for each group of modules with its tokens (by, tokens)."""
    one = dims.groupBy(*by).agg(F.sum((F.col("d_in") + F.col("d_out")).cast("long") * layers).alias("_one"))
    met = one.join(tokens, by) if by else one.join(F.broadcast(tokens))  # one row each
    rows = met.select(*by, "_one", (F.col("tokens") / 20.0).alias("target"), F.posexplode(F.array(*map(F.lit, candidates))).alias("_i", "rank"))
    rows = rows.withColumn("params", F.col("rank") * F.col("_one"))
    rows = rows.withColumn("ratio", F.bround(F.col("params") / F.col("target"), 2))
    best = F.min(F.struct(F.abs(F.col("ratio") - 1), "_i")).over(Window.partitionBy(*by))
    return rows.withColumn("chosen", best.getField("_i") == F.col("_i")).select(*by, "rank", "params", "target", "ratio", "chosen")


def training_cost(params: int, tokens: int, epochs: int, peak_flops: float, utilisation: float) -> dict[str, float]:
    """FLOPs (4ND per epoch) and seconds of training with a frozen base."""
    if min(params, tokens, epochs) < 1 or peak_flops <= 0 or utilisation <= 0:
        raise ValueError("all inputs must be above 0")
    flops = 4.0 * params * tokens * epochs
    return {"flops": flops, "seconds": flops / (peak_flops * utilisation)}


def partition_stats(df: DataFrame, names: list[str], tokens: Column | None, chars: Column, partition: str = "partition") -> DataFrame:
    """(partition, records, tokens, chars) with a row for each declared partition, empty ones too."""
    declared = df.sparkSession.createDataFrame([(n,) for n in names], "partition string")
    token_sum = F.lit(None).cast("long") if tokens is None else F.sum(tokens.cast("long"))
    sums = df.groupBy(F.col(partition).alias("partition")).agg(F.count("*").alias("records"), token_sum.alias("tokens"), F.sum(chars).alias("chars"))
    return declared.join(sums, "partition", "left").select("partition", F.coalesce("records", F.lit(0)).alias("records"), "tokens", F.coalesce("chars", F.lit(0)).alias("chars"))


def diversity(df: DataFrame, ratio: Column, words: Column) -> DataFrame:
    """One row: n_texts, mean words (0 without texts) and the mean of the texts' own ratios (null without)."""
    return df.agg(F.count("*").alias("n_texts"), F.coalesce(F.avg(F.size(words)), F.lit(0.0)).alias("mean_words"), F.avg(ratio).alias("mean_distinct_4gram_ratio"))


def parameter_count(vocab: int, hidden: int, layers: int, intermediate: int, positions: int, tied: bool = True) -> int:
    """Parameters of a decoder with biases: embeddings, per layer attention, a two-matrix MLP and two norms, a final norm."""
    heads = 1 if tied else 2
    per_layer = 4 * hidden * hidden + 2 * hidden * intermediate + 9 * hidden + intermediate
    return heads * vocab * hidden + positions * hidden + layers * per_layer + 2 * hidden
