"""Record transforms: a raw row to one record of fixed columns, or no row.

Each takes a DataFrame and returns one with the record's columns and those named in ``carry``
(split tag, order). Columns that a raw source lacks count as null, like missing keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import coerced, pystrip

CARRY = ("split", "ord")
MESSAGES = "array<struct<role:string,content:string>>"


def _text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    return coerced(name, isinstance(df.schema[name].dataType, T.NumericType))


def _out(df: DataFrame, keep: Column | None, carry: tuple[str, ...], **columns: Column) -> DataFrame:
    carried = [F.col(c).alias(c) for c in carry if c in df.columns]
    made = df.select(*carried, *[c.alias(n) for n, c in columns.items()])
    return made if keep is None else made.where(keep)


def alpaca(df: DataFrame, carry: tuple[str, ...] = CARRY) -> DataFrame:
    """Instruction, optional input and output as a two-turn conversation."""
    i, x, o = (_text(df, c) for c in ("instruction", "input", "output"))
    user = F.when(x != "", F.concat(i, F.lit("\n\n"), x)).otherwise(i)
    turns = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), o.alias("content")))
    made = _out(df, None, carry, messages=turns, _i=i)
    return made.where((F.col("_i") != "") & (F.col("messages")[1].content != "")).drop("_i")


def titled_text(df: DataFrame, carry: tuple[str, ...] = CARRY) -> DataFrame:
    """Content and title of a document."""
    return _out(df, F.col("text") != "", carry, text=_text(df, "content"), title=_text(df, "title"))


def worked_answer(df: DataFrame, carry: tuple[str, ...] = CARRY) -> DataFrame:
    """A question whose answer marks its final number with ####."""
    return _out(df, (F.col("question") != "") & F.col("answer").contains("####"), carry, question=_text(df, "question"), answer=_text(df, "answer"))


def plain_text(df: DataFrame, carry: tuple[str, ...] = CARRY, min_chars: int = 1) -> DataFrame:
    """The stripped text, if it has ``min_chars`` code points."""
    return _out(df, F.length("text") >= min_chars, carry, text=_text(df, "text"))


def long_text(df: DataFrame, carry: tuple[str, ...] = CARRY) -> DataFrame:
    """Texts of ten code points or more."""
    return plain_text(df, carry, 10)


def preference(df: DataFrame, carry: tuple[str, ...] = CARRY) -> DataFrame:
    """An instruction with a chosen and a rejected answer, none of them empty."""
    keep = (F.col("instruction") != "") & (F.col("chosen") != "") & (F.col("rejected") != "")
    return _out(df, keep, carry, **{c: _text(df, c) for c in ("instruction", "chosen", "rejected")})


def chart_question(df: DataFrame, carry: tuple[str, ...] = CARRY) -> DataFrame:
    """A question about a chart; a list of labels becomes one answer."""
    # Falsy coercion comes before stripping: a question of blanks doesn't fall back to the query.
    raw = lambda n: F.nullif(F.col(n).cast("string"), F.lit("")) if n in df.columns else F.lit(None).cast("string")
    question = pystrip(F.coalesce(raw("question"), raw("query"), F.lit("")))
    if "label" in df.columns and isinstance(df.schema["label"].dataType, T.ArrayType):
        items = F.filter(F.transform("label", lambda x: pystrip(F.coalesce(x.cast("string"), F.lit("None")))), lambda x: x != "")
        answer = F.when(F.col("label").isNotNull(), F.array_join(items, ", ")).otherwise(_text(df, "answer"))
    else:
        answer = pystrip(F.coalesce(raw("answer"), raw("label"), F.lit("")))
    kind = pystrip(F.coalesce(raw("type"), F.lit("swift")))
    who = F.col("human_or_machine") if "human_or_machine" in df.columns else F.lit(None).cast("int")
    return _out(df, F.col("question") != "", carry, question=question, answer=answer, type=kind, human_or_machine=who)


def exam(df: DataFrame, carry: tuple[str, ...] = CARRY) -> DataFrame:
    """A multiple-choice question with its options."""
    return _out(df, F.col("question") != "", carry, **{c: _text(df, c) for c in ("id", "question", "A", "B", "C", "D", "answer", "explanation")})


def completion(df: DataFrame, carry: tuple[str, ...] = CARRY) -> DataFrame:
    """A context with possible endings. A numeric label 0 becomes empty, like any falsy value."""
    endings = F.coalesce(F.col("endings"), F.array().cast("array<string>")) if "endings" in df.columns else F.array().cast("array<string>")
    return _out(df, F.col("ctx") != "", carry, activity_label=_text(df, "activity_label"), ctx=_text(df, "ctx"), endings=endings, label=_text(df, "label"))


TRANSFORMS: dict[str, Callable[..., DataFrame]] = {
    "alpaca": alpaca,
    "tigerbot": titled_text,
    "gsm8k": worked_answer,
    "tinystories": plain_text,
    "wikitext": long_text,
    "minimind": long_text,
    "ultrafeedback": preference,
    "chartqa": chart_question,
    "ceval": exam,
    "hellaswag": completion,
}
