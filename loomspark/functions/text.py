"""Text expressions with Python's meaning: stripping, falsy coercion, words, hashes, n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.strip`` and ``str.split`` have it (fixed values, regex class body).
SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same characters as text.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c: Column | str) -> Column:
    """``str.strip()``: Unicode white space off both ends, which alone are read."""
    return F.btrim(_col(c), F.lit(SPACES))


def coerced(c: Column | str, numeric: bool = False) -> Column:
    """``str(x or "").strip()``: null is empty, and so is 0 in a numeric column."""
    c = _col(c)
    text = F.when(c.isNull() | (c == 0), "").otherwise(c.cast("string")) if numeric else F.coalesce(c.cast("string"), F.lit(""))
    return pystrip(text)


def pysplit(c: Column | str) -> Column:
    """``str.split()``: the words between Unicode white space."""
    return F.filter(F.split(_col(c), f"[{SPACE}]+"), lambda w: w != "")


def sha256_bucket(key: Column | str, buckets: int = 1000) -> Column:
    """The SHA-256 of the key as one large integer, modulo ``buckets`` (Horner over 32-bit parts)."""
    digest = F.sha2(_col(key), 256)
    out = F.lit(0).cast("long")
    step = pow(2, 32, buckets)
    for i in range(8):
        part = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        out = (out * step + part) % buckets
    return out.cast("int")


def text_hash(c: Column | str) -> Column:
    """SHA-256 in hexadecimal."""
    return F.sha2(_col(c), 256)


def group_key(key: Column | str, text: Column | str) -> Column:
    """The stripped key, or a key of the record's own made of its text's hash."""
    stripped = coerced(key)
    return F.when(stripped != "", stripped).otherwise(F.concat(F.lit("__record__"), F.substring(text_hash(F.coalesce(_col(text), F.lit(""))), 1, 16)))


def tokenizer_dir_name(c: Column | str) -> Column:
    """A tokenizer's directory name as used in stream names."""
    return F.replace(F.lower(_col(c)), F.lit("-"), F.lit("_"))


def ngram_ratio(c: Column | str, n: int = 4) -> Column:
    """Distinct word n-grams over all, 0 for texts of fewer words."""
    return F.element_at(F.transform(F.array(pysplit(c)), lambda w: distinct_ratio(w, n)), 1)


def distinct_ratio(words: Column | str, n: int = 4) -> Column:
    """Distinct n-grams over all of an array of words, 0 for fewer words."""
    words = _col(words)
    total = F.size(words) - (n - 1)
    # Words hold no blanks, so joined ones are as good as arrays, and strings are told apart by hashing.
    grams = F.transform(F.sequence(F.lit(0), total - 1), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))
    return F.when(total < 1, 0.0).otherwise(F.size(F.array_distinct(grams)) / total)


def prompt_of(messages: Column | str) -> Column:
    """The first message's content, stripped; empty without messages."""
    return coerced(F.try_element_at(_col(messages), F.lit(1)).getField("content"))


def texts_of_messages(messages: Column | str) -> Column:
    """All non-empty strings of a conversation in order, roles included."""
    flat = F.flatten(F.transform(F.coalesce(_col(messages), F.array().cast("array<struct<role:string,content:string>>")), lambda m: F.array(m.role, m.content)))
    return F.filter(flat, lambda x: x.isNotNull() & (x != ""))


def texts_of(schema, column_of=F.col) -> Column:
    """All non-empty strings of a record, nested ones in order; keys and other types are left out.

    schema: the record's StructType; column_of: column by name.
    """
    from pyspark.sql import types as T

    none = F.array().cast("array<string>")

    def strings(c: Column, kind) -> Column | None:
        if isinstance(kind, T.StringType):
            return F.array(c)
        if isinstance(kind, T.StructType):
            parts = [x for f in kind.fields if (x := strings(c.getField(f.name), f.dataType)) is not None]
            return F.when(c.isNull(), none).otherwise(F.concat(*parts)) if parts else None
        if isinstance(kind, T.ArrayType):
            inner = strings(F.lit(None), kind.elementType)
            return None if inner is None else F.coalesce(F.flatten(F.transform(c, lambda x: strings(x, kind.elementType))), none)
        return None

    parts = [x for f in schema.fields if (x := strings(column_of(f.name), f.dataType)) is not None]
    return F.filter(F.concat(*parts) if parts else none, lambda x: x.isNotNull() & (x != ""))


def chars_of(texts: Column) -> Column:
    """Code points of all strings of an array."""
    return F.aggregate(texts, F.lit(0).cast("long"), lambda n, x: n + F.length(x))


def dedupe_key(columns: list[str]) -> Column:
    """One canonical string for a record: JSON of its columns in the order of their names, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})


def record_counter(texts: Column) -> Column:
    """A token counter without a tokenizer: half a text's characters, one at least, summed."""
    return F.aggregate(texts, F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.lit(1), F.floor(F.length(x) / 2)).cast("long"))
