"""Conversations: loading, templates and assistant masks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transforms import MESSAGES


def valid_conversations(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Conversations of two or more turns once turns without content are gone; only ``messages`` (and ord) stay."""
    turns = F.filter(F.col(messages), lambda m: m.isNotNull() & m.content.isNotNull() & (m.content != ""))
    kept = [c for c in ("ord", "split") if c in df.columns]
    return df.where(F.size(F.coalesce(F.col(messages), F.array().cast(MESSAGES))) > 0).select(*kept, turns.alias("messages")).where(F.size("messages") >= 2)


def to_messages(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row a conversation from one row a turn (a conversation is bounded by its turns)."""
    row = F.struct(F.col(turn_col).alias("turn"), F.col("role").alias("role"), F.col("text").alias("content"))
    out = turns.groupBy(id_col).agg(F.sort_array(F.collect_list(row)).alias("_t"))
    return out.select(id_col, F.transform("_t", lambda t: F.struct(t.role.alias("role"), t.content.alias("content"))).alias("messages"))


def answered_turns(df: DataFrame, messages: str = "messages") -> DataFrame:
    """One row a user turn that an assistant turn follows, both with content: ``messages`` holds the two, place
    is the user turn's place from 0. System turns and turns without an answer stay out."""
    m = F.col(messages)
    full = lambda x, role: (x.role == role) & (x.content != "")
    pair = lambda x, i: F.struct(i.alias("place"), F.array(x, F.get(m, i + 1)).alias("pair"))
    found = F.filter(F.transform(m, pair), lambda p: full(p.pair[0], "user") & full(p.pair[1], "assistant"))
    return df.withColumn("_p", F.explode(found)).withColumns({messages: F.col("_p.pair"), "place": F.col("_p.place")}).drop("_p")


def render_pair(messages: Column | str) -> Column:
    """The small template: one user turn, one assistant turn; anything else is an error."""
    m = F.col(messages) if isinstance(messages, str) else messages
    right = (F.size(m) == 2) & (m[0].content != "") & (m[1].content != "")
    text = F.concat(F.lit("user: "), m[0].content, F.lit("\nassistant: "), m[1].content)
    return F.when(right, text).otherwise(F.raise_error(F.lit("the template takes one user and one assistant turn, both with content")).cast("string"))


def pair_ids(user_ids: Column, assistant_ids: Column, bos: int, eos: int) -> tuple[Column, Column]:
    """Ids and mask of a framed pair: [bos, user, eos, assistant, eos]; the answer, and the two ends of
    turn around it, count."""
    ids = F.concat(F.array(F.lit(bos)), user_ids, F.array(F.lit(eos)), assistant_ids, F.array(F.lit(eos)))
    mask = F.concat(F.array_repeat(F.lit(0), F.size(user_ids) + 1), F.array_repeat(F.lit(1), F.size(assistant_ids) + 2))
    return ids, mask


def prefix_mask(prompt_ids: Column | str, full_ids: Column | str) -> Column:
    """0 for the prompt's ids, 1 for the rest; an error unless the prompt is a proper prefix."""
    p = F.col(prompt_ids) if isinstance(prompt_ids, str) else prompt_ids
    f = F.col(full_ids) if isinstance(full_ids, str) else full_ids
    right = (F.slice(f, F.lit(1), F.size(p)) == p) & (F.size(f) > F.size(p))
    mask = F.concat(F.array_repeat(F.lit(0), F.size(p)), F.array_repeat(F.lit(1), F.size(f) - F.size(p)))
    return F.when(right, mask).otherwise(F.raise_error(F.lit("the prompt is no prefix of the conversation, or nothing follows it")).cast("array<int>"))


def framed_mask(ids: Column, mask: Column, bos: int, eos: int) -> tuple[Column, Column]:
    """Both arrays with the stream's frame: bos counts 0, eos counts 1."""
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos))), F.concat(F.array(F.lit(0)), mask, F.array(F.lit(1)))


def rendered(df: DataFrame, template: Callable[[list[dict], bool], str], messages: str = "messages") -> DataFrame:
    """``df`` with rendered (all turns) and prompt (all but the last, plus the generation prompt) by a
    template function of (turns, add_generation_prompt), in Arrow batches."""
    @F.pandas_udf("struct<rendered:string,prompt:string>")
    def both(turns: pd.Series) -> pd.DataFrame:
        lists = [[dict(role=m["role"], content=m["content"]) for m in t] for t in turns]
        return pd.DataFrame({"rendered": [template(t, False) for t in lists], "prompt": [template(t[:-1], True) for t in lists]})

    return df.withColumn("_r", both(messages)).withColumns({"rendered": F.col("_r.rendered"), "prompt": F.col("_r.prompt")}).drop("_r")


def generation_context(prompt_ids: Column, assistant_ids: Column, bos: int, eos: int) -> Column:
    """[bos, user turn, eos, opening of the assistant's turn]."""
    return F.concat(F.array(F.lit(bos)), prompt_ids, F.array(F.lit(eos)), assistant_ids)
