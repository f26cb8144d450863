"""Numeric expressions: sampling from logits, schedules, utilisation, parameter counts, fits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(logits: Column | str, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits; the largest is subtracted first."""
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    scaled = F.transform(_col(logits), lambda x: x / F.lit(float(temperature)))
    # Arrays of one element bind what is computed once.
    shifted = F.transform(F.array(F.struct(scaled.alias("s"), F.array_max(scaled).alias("m"))), lambda b: F.transform(b.s, lambda x: F.exp(x - b.m)))
    return F.element_at(_normalised(shifted), 1)


def _normalised(arrays: Column) -> Column:
    """Each array of an array divided by its sum."""
    return F.transform(F.transform(arrays, lambda a: F.struct(a.alias("a"), _sum(a).alias("n"))), lambda b: F.transform(b.a, lambda x: x / b.n))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def top_k_filter(probs: Column | str, k: int) -> Column:
    """Probabilities below the k-th largest become 0, the rest sum to 1; ties at the k-th stay."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    bound = F.transform(F.array(_col(probs)), lambda p: F.struct(p.alias("p"), F.element_at(F.sort_array(p, asc=False), F.least(F.lit(k), F.size(p))).alias("cut")))
    kept = F.transform(bound, lambda b: F.transform(b.p, lambda x: F.when(x >= b["cut"], x).otherwise(0.0)))
    sums = F.transform(kept, _sum)
    out = F.when((F.size(_col(probs)) <= k) | (F.element_at(sums, 1) <= 0), _col(probs))
    return out.otherwise(F.element_at(_normalised(kept), 1))


def sample_next(logits: Column | str, draw: Column | str, temperature: float = 1.0, top_k: int | None = None) -> Column:
    """Index (from 0) of the next token: the first largest logit at temperature 0 or less, else where the
    cumulated probabilities reach ``draw``; the last one if rounding keeps them below."""
    a = _col(logits)
    if temperature <= 0:
        return (F.array_position(a, F.array_max(a)) - 1).cast("int")
    p = softmax(a, temperature)
    p = p if top_k is None else top_k_filter(p, top_k)
    walk = F.aggregate(
        p,
        F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(-1).alias("hit")),
        lambda s, x: F.struct((s.i + 1).alias("i"), (s["sum"] + x).alias("sum"), F.when((s.hit < 0) & (_col(draw) <= s["sum"] + x), s.i).otherwise(s.hit).alias("hit")),
        lambda s: F.when(s.hit < 0, s.i - 1).otherwise(s.hit),
    )
    return walk.cast("int")


def warmup_cosine(step: Column | str, total_steps: Column | str | int, warmup_steps: Column | str | int, peak: float, min_ratio: float) -> Column:
    """Learning rate: linear warm-up to the peak, then a half cosine to the minimum. Steps given as columns aren't checked."""
    plain = isinstance(total_steps, int) and isinstance(warmup_steps, int)
    if plain and (total_steps < 1 or not 0 <= warmup_steps < total_steps) or peak <= 0 or not 0 <= min_ratio < 1:
        raise ValueError("need total_steps >= 1, 0 <= warmup_steps < total_steps, peak > 0, 0 <= min_ratio < 1")
    s, total, warm = (F.lit(x) if isinstance(x, int) else _col(x) for x in (step, total_steps, warmup_steps))
    low = peak * min_ratio
    cosine = low + (peak - low) * (0.5 * (1 + F.cos(F.lit(math.pi) * (s - warm) / F.greatest(total - warm, F.lit(1)).cast("double"))))
    rising = F.lit(peak) * (s + 1) / F.greatest(warm, F.lit(1)).cast("double")
    return F.when(s < warm, rising).when(s >= total, F.lit(low)).otherwise(cosine)


def mfu(flops: Column | str, peak_flops: Column | str, seconds: Column | str) -> Column:
    """Achieved over possible FLOPs; null when any input is not above 0."""
    f, p, s = _col(flops), _col(peak_flops), _col(seconds)
    return F.when((f > 0) & (p > 0) & (s > 0), f / (p * s))


def training_flops(params: Column | str, tokens: Column | str, frozen_base: bool = False) -> Column:
    """6ND of full training, 4ND with a frozen base."""
    return F.lit(4.0 if frozen_base else 6.0) * _col(params) * _col(tokens)


def batch_tokens(micro_batch: Column | str, accumulation: Column | str, seq_len: Column | str) -> Column:
    return _col(micro_batch) * _col(accumulation) * _col(seq_len)


def perplexity(loss: Column | str) -> Column:
    return F.exp(_col(loss))


def predicted_loss(c: Column | str, alpha: Column | str, n_params: Column | str) -> Column:
    """c * N ** -alpha; null where the fit is."""
    return _col(c) * F.pow(_col(n_params), -_col(alpha))


def decoder_params(vocab: Column | str, hidden: Column | str, layers: Column | str, intermediate: Column | str, positions: Column | str, tied: Column) -> Column:
    """Parameters of a decoder with biases: embeddings, per layer attention, a two-matrix MLP and two norms, a final norm."""
    v, h, n, i, p = (_col(c).cast("long") for c in (vocab, hidden, layers, intermediate, positions))
    return F.when(tied, v * h).otherwise(2 * v * h) + p * h + n * (4 * h * h + 2 * h * i + 9 * h + i) + 2 * h


def embedding_share(vocab: Column | str, hidden: Column | str, params: Column | str, tied: Column) -> Column:
    """Share of the vocabulary's matrices (one if tied, else two) in all parameters."""
    one = _col(vocab).cast("long") * _col(hidden)
    return F.when(tied, one).otherwise(2 * one) / _col(params)


def guarded_params(params: Column | str, low: int, high: int) -> Column:
    """The count itself; an error if it lies outside [low, high]."""
    n = _col(params)
    return F.when(n.between(low, high), n).otherwise(F.raise_error(F.concat(F.lit("parameters outside the budget: "), n.cast("string"))).cast("long"))


def embedding_head_params(vocab: Column | str, hidden: Column | str, tied: bool = False) -> Column:
    return _col(vocab) * _col(hidden) * F.lit(1 if tied else 2)


def sequences_for(tokens: Column | str, seq_len: Column | str) -> Column:
    return F.ceil(_col(tokens) / _col(seq_len))


def scaled_tokens(validation_tokens: Column | str, train_chars: Column | str, validation_chars: Column | str) -> Column:
    """Tokens of the training part by the ratio of characters, rounded half to even; 0 without any."""
    v, t, c = _col(validation_tokens), _col(train_chars), _col(validation_chars)
    return F.when(c <= 0, F.lit(0)).otherwise(F.rint(v * (t / c))).cast("long")
