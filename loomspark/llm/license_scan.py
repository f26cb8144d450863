"""License scans: Aho-Corasick over the words of whole texts, then licence expressions by shunting-yard.

A text is lower-cased (A-Z), cut into words and joined by single spaces; one automaton finds base
phrases, licence notices and identifier tags there, so that spaces and punctuation between words don't
matter. Where a tag occurs, an expression of identifiers, and, or, with and parentheses follows it on its
line; a shunting-yard parser checks and evaluates it. If the rest of the line isn't one expression, the
longest one counts that the line begins with and whose words look like identifiers (``looks_like``), so
that prose behind it stays out. A valid expression is evaluated from its postfix form: its licences become
labels, placed at their tag; of alternatives the one is chosen that ``allowed`` permits with the fewest
licences, and the expression is permitted if all it then asks for is allowed. Two operators in a row, an operator at the line's end or an open parenthesis before any whole expression give none. The score is 1 minus the product of what each kind of
evidence leaves open.

Nulls and empty texts have no words, matches or labels and score 0. Texts of any length are scanned
whole. Repeated rows are scanned alike; an empty table gives no rows. All input columns are kept; those
named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, slices

#: Base phrases and their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that name a licence or reserve rights, with labels of our own.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "bsd 2 clause": "bsd-2",
    "bsd 3 clause": "bsd-3",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released into the public domain": "public-domain",
    "cc0 1 0 universal": "cc0",
    "all rights reserved": "all-rights-reserved",
}
#: Tags whose line holds an expression, as words.
TAGS = ("spdx license identifier", "license expression")
#: Licences that ask for little more than their notice: what an expression may come down to, unless the
#: caller allows others.
ALLOWED = frozenset("mit apache-2 bsd bsd-2 bsd-3 isc zlib unlicense 0bsd cc0 cc-by public-domain".split())
#: How sure one match of a kind makes us; several combine as independent evidence.
SURE = {"base": 0.9, "notice": 0.7, "tag": 0.95}
#: Identifiers that mean the same as a label above (fixed values).
ALIASES = {"apache-2.0": "apache-2", "cc-by-nc-1.0": "cc-by-nc", "cc-by-nc-2.0": "cc-by-nc", "cc-by-nc-2.5": "cc-by-nc", "cc-by-nc-3.0": "cc-by-nc", "cc-by-nc-4.0": "cc-by-nc", "bsd-2-clause": "bsd-2", "bsd-3-clause": "bsd-3"}

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, table in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in table.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    found.make_automaton()
    return found


_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list[str] | None:
    """Postfix form of a licence expression in lower case, by shunting-yard; None if malformed."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # whether an operand must come next
    for token in re.findall(r"[()]|[^\s()]+", text):
        if token == "(":
            if not operand:
                return None
            waiting.append(token)
        elif token == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif token in _PRECEDENCE:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        else:
            if not operand or not re.fullmatch(r"[a-z0-9.+:-]+", token):
                return None
            out.append(token)
            operand = False
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(postfix: list[str], allowed: frozenset[str] = ALLOWED) -> tuple[set[str], list[str], bool]:
    """An expression's licences, those chosen among its alternatives, and whether they are all allowed.

    Each operator combines what its operands came to, so time is linear however many choices there are:
    ``or`` takes the permitted operand, of two the one of fewer licences, of equals the first; ``and`` asks for
    both; behind ``with`` stands an exception, which is no licence.
    """
    stack: list[tuple[set[str], list[str], bool]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            name = ALIASES.get(token, token)
            stack.append(({name}, [name], name in allowed))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            stack.append(a)
        elif token == "and":
            stack.append((a[0] | b[0], list(dict.fromkeys(a[1] + b[1])), a[2] and b[2]))
        else:
            best = min(a, b, key=lambda x: (not x[2], len(x[1])))
            stack.append((a[0] | b[0], best[1], best[2]))
    return stack[0]


#: Identifiers without both a hyphen and a digit that stand for licences also where prose may follow.
PLAIN = frozenset("mit isc zlib unlicense wtfpl ncsa curl openssl postgresql beerware libpng x11 0bsd gplv2 gplv3 lgplv2 lgplv3 agplv3".split())
_TOKEN = re.compile(rb"[()\r\n]|[^\s()]+")
#: Comment ends and sentence ends don't belong to the expression.
_ENDS = re.compile(r"(?:\*/|-->|[,;.\"'`*#])+$")
#: Spaces beyond ASCII, as bytes.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def looks_like(name: str) -> bool:
    """Whether a word in lower case is a licence's or an exception's identifier rather than prose."""
    return name in PLAIN or name.startswith(("licenseref-", "documentref-")) or name.endswith("-exception") or "-" in name and re.search("[a-z]", name) is not None and re.search("[0-9]", name) is not None


def _leading(raw: bytes, at: int, strict: bool) -> list[str] | None:
    """Postfix form of the longest expression at a place of a lower-case text; strict: of the line's whole rest."""
    tokens: list[str] = []
    depth = whole = 0  # open parentheses; tokens of the longest whole expression so far
    operand, ended = True, False
    for m in _TOKEN.finditer(raw, at):
        token = m[0].decode("utf-8", "replace")
        if token in "\r\n":
            break
        name = _ENDS.sub("", token)
        if strict and not name:  # ends only
            ended = True
            continue
        if ended:
            return None
        if token == "(" and operand:
            depth += 1
        elif token == ")" and not operand and depth:
            depth -= 1
        elif name in _PRECEDENCE and name == token:
            if operand:
                return None
            operand = True
        elif token not in "()" and operand and re.fullmatch(r"[a-z0-9.+:-]+", name) and (strict or looks_like(name)):
            operand, ended = False, name != token
        elif strict:
            return None
        else:
            return parse_expression(" ".join(tokens[:whole]))
        tokens.append(name if token not in "()" else token)
        if not operand and not depth:
            whole = len(tokens)
        if ended and not strict:
            return parse_expression(" ".join(tokens[:whole]))
    if operand or strict and depth:
        return None
    return parse_expression(" ".join(tokens[:whole]))


def _expressions(raw: bytes, ends: list[int]) -> list[list[str] | None]:
    """Of each tag of a lower-case text, given where it ends: the postfix form of the valid expression behind it."""
    raw = _WIDE.sub(lambda m: b" " * len(m[0]), raw)
    out = []
    for end in ends:
        at = re.compile(rb"[ \t]*[:=]?[ \t]*").match(raw, end).end()
        postfix = _leading(raw, at, True) or _leading(raw, at, False)
        out.append(postfix or None)
    return out


def _word_ends(plain: bytes, numbers: list[int]) -> list[int]:
    """Where the words of the given numbers (ascending) end in a translated text."""
    out, words = [], enumerate(re.finditer(rb"[^ ]+", plain))
    for n in numbers:
        out.append(next(m.end() for k, m in words if k == n))
    return out


def scan_text(raw: bytes, allowed: frozenset[str] = ALLOWED) -> tuple[int, list[tuple[str, str, int]], list[tuple[str, list[str], bool]], float]:
    """Number of words, matches (kind, label, first word), expressions (postfix form, chosen licences, permitted)
    and score of one text."""
    plain = raw.translate(_TABLE)
    words = plain.split()
    joined = b" %b " % b" ".join(words)
    matches, expressions, kinds = [], [], set()
    at = upto = 0
    tags: list[tuple[int, int]] = []  # first and last word
    for end, (kind, label, size) in sorted(_automaton().iter(joined.decode("latin-1")), key=lambda x: x[0] - x[1][2]):
        start = end - size + 1
        at += joined.count(b" ", upto, start)
        upto = start
        if kind == "tag":
            tags.append((at, at + joined.count(b" ", start + 1, end)))
        else:
            matches.append((kind, label, at))
            kinds.add(kind)
    if tags:
        tags.sort(key=lambda x: x[1])
        for (first, _), found in zip(tags, _expressions(raw.translate(_LOWER), _word_ends(plain, [x for _, x in tags]))):
            if found is None:
                continue
            licences, chosen, permitted = evaluate(found, allowed)
            expressions.append((" ".join(found), sorted(chosen), permitted))
            matches += [("tag", x, first) for x in sorted(licences)]
            kinds.add("tag")
    rest = 1.0
    for kind in sorted(kinds):
        rest *= 1 - SURE[kind]
    return len(words), matches, expressions, 1 - rest


_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))),
    T.StructField("expressions", T.ArrayType(T.StructType([T.StructField("postfix", T.StringType()), T.StructField("chosen", T.ArrayType(T.StringType())), T.StructField("permitted", T.BooleanType())]))),
    T.StructField("license_score", T.DoubleType()),
])
_ARROW = pa.schema([("n_words", pa.int64()), ("matches", pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64())]))), ("expressions", pa.list_(pa.struct([("postfix", pa.string()), ("chosen", pa.list_(pa.string())), ("permitted", pa.bool_())]))), ("license_score", pa.float64())])


def scan(df: DataFrame, text_col: str = "text", keep_text: bool = True, allowed: frozenset[str] = ALLOWED) -> DataFrame:
    """``df`` with n_words, matches (kind base, notice or tag; label; first word), expressions (postfix, chosen,
    permitted), license_score."""
    df = df.drop(*[c for c in _RESULT.names if c != text_col])
    kept = [f for f in df.schema.fields if keep_text or f.name != text_col]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(part.schema.get_field_index(text_col)).cast(pa.large_binary()).to_pylist()
                found = [scan_text(x or b"", allowed) for x in texts]
                named = {1: ("kind", "label", "word"), 2: ("postfix", "chosen", "permitted")}
                columns = [pa.array([[dict(zip(named[k], m)) for m in x[k]] if k in named else x[k] for x in found], f.type) for k, f in enumerate(_ARROW)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), *columns], names=[*names, *_ARROW.names])

    return df.mapInArrow(run, T.StructType([*kept, *_RESULT.fields]))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and all labels of every document."""
    out = scan(load(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("matches", lambda m: m.kind == "base")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda m: m.label))), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m.word)).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m.word)).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.col("license_score").alias("score"),
        # Of all expressions: what they ask for once choices are made, and whether that is allowed.
        joined(F.flatten(F.transform("expressions", lambda e: F.transform(e.chosen, lambda x: F.struct(x.alias("label")))))).alias("chosen"),
        F.when(F.size("expressions") > 0, F.forall("expressions", lambda e: e.permitted)).alias("permitted"),
    )
