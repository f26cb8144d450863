"""Conversation structure repair: the cheapest edits that make turns alternate, by a DP shared along a trie.

A conversation's rows become a signature, one letter a row: whose turn it is (s, u, a, or o for other roles; a
capital where the text is cut off), or x where a fault (blank, duplicate) requires that the row goes. What edits are
best hangs on the signature alone, so it is worked out once for each distinct one. Signatures are dealt by ranges and
walked in order, as one would walk the trie that holds them: the branch from the root to the last signature is a
stack of DP layers, the next signature keeps the layers of the prefix that it shares, adds its own, and is answered at
its end, its terminal node. A layer holds the least costs of having written nothing, a system turn, a user turn or
an assistant turn so far. The answer is the ASCII-least of the cheapest edits: states that lie on a cheapest way are
found from the end backwards, and the least letter that leads to one is taken from the front.

Answers return by signature. A signature that more than a thousandth of all conversations have is joined by broadcast
(there are at most a thousand such, and together they are no longer than a thousand conversations of mean length);
the rest is shuffled. Texts pass through tasks in the order of conversation and turn and are never gathered; a
task holds one signature (one letter a row) at a time, and as many layers.

Order within a conversation: turn, nulls first, then role, the text's first 64 characters, and a digest of role and
text. Nulls in role and text count as one space; rows without a conversation's id are one conversation. Texts of any
length are read whole. Empty tables give no rows. Columns other than the four named ones are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize

USER, ASSISTANT = "user", "assistant"
#: Costs of the edits (fixed values), and what an undeleted row that is cut off adds.
KEEP, INSERT, REROLE, DELETE, CUT_OFF = 0, 2, 2, 3, 1
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state behind a turn of this role, by state (None: not allowed there).
_BEHIND = {"s": (_SYSTEM, None, None, None), "u": (_USER, _USER, None, _USER), "a": (None, None, _ASSISTANT, None)}
_NEVER = 1 << 60


def _closed(cost: list[int]) -> tuple[int, ...]:
    """Least costs when turns may be inserted behind."""
    user = min(cost[_USER], min(cost[_NOTHING], cost[_SYSTEM], cost[_ASSISTANT]) + INSERT)
    return cost[_NOTHING], cost[_SYSTEM], user, min(cost[_ASSISTANT], user + INSERT)


def _moves(letter: str) -> list[tuple[str, int, int, int]]:
    """Edits of a row: (letter of the edit, state before, state behind, cost)."""
    out = [("D", s, s, DELETE) for s in range(4)]
    role = letter.lower()
    if role == "x":
        return out
    more = CUT_OFF if letter.isupper() else 0
    for s in range(4):
        if role in _BEHIND and _BEHIND[role][s] is not None:
            out.append(("K", s, _BEHIND[role][s], KEEP + more))
        out += [("R", s, _BEHIND[to][s], REROLE + more) for to in "ua" if _BEHIND[to][s] is not None]
    return out


_MOVES = {letter: _moves(letter) for letter in "xsuaoSUAO"}
_INSERTS = [("I", s, _BEHIND[to][s], INSERT) for s in range(4) for to in "ua" if _BEHIND[to][s] is not None]
_ROOT = _closed([0, _NEVER, _NEVER, _NEVER])


class Branch:
    """The branch of the trie that ends in the last signature, with its DP layers."""

    def __init__(self) -> None:
        self.signature, self.layers, self.made = "", [_ROOT], 0

    def answer(self, signature: str) -> tuple[int, str]:
        """Least cost and the ASCII-least cheapest edits; ``made`` counts the layers worked out."""
        old, shared = self.signature, 0
        limit = min(len(old), len(signature))
        while shared < limit and old[shared] == signature[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for letter in signature[shared:]:
            before, cost = self.layers[-1], [_NEVER] * 4
            for _, a, b, c in _MOVES[letter]:
                if before[a] + c < cost[b]:
                    cost[b] = before[a] + c
            self.layers.append(_closed(cost))
        self.made += len(signature) - shared
        self.signature = signature
        return self._edits()

    def _edits(self) -> tuple[int, str]:
        layers, signature = self.layers, self.signature
        best = min(layers[-1][_NOTHING], layers[-1][_ASSISTANT])
        on = [{s for s in (_NOTHING, _ASSISTANT) if layers[-1][s] == best}]
        for i in range(len(signature), -1, -1):
            here, cost = on[-1], layers[i]
            for _ in range(3):  # no cheapest way inserts more than three turns in one place
                here |= {a for _, a, b, c in _INSERTS if b in here and cost[a] + c == cost[b]}
            if i:
                on.append({a for _, a, b, c in _MOVES[signature[i - 1]] if b in here and layers[i - 1][a] + c == cost[b]})
        on.reverse()
        out, state, i = [], _NOTHING, 0
        while True:
            steps = [("I", b, i) for _, a, b, c in _INSERTS if a == state and b in on[i] and layers[i][a] + c == layers[i][b]]
            if i < len(signature):
                steps += [(e, b, i + 1) for e, a, b, c in _MOVES[signature[i]] if a == state and b in on[i + 1] and layers[i][a] + c == layers[i + 1][b]]
            if not steps:
                return best, "".join(out)
            edit, state, i = min(steps)
            out.append(edit)


def damaged(df: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults put in by the CRC-32 of ``conv_id:turn``, and ``alive``:
    false where the row is gone and only tells that there was such a conversation."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), k.alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_k") == 4, USER).otherwise(F.col("role")), "alive": F.col("_k") != 0})
    return rows.withColumn("_n", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_k", "_n")


def _ordered(df: DataFrame) -> DataFrame:
    """The rows with what orders them."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    alive = F.coalesce("alive", F.lit(False)) if "alive" in df.columns else F.lit(True)
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), alive.alias("alive"))
    both = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumns({"head": F.substring("text", 1, 64), "digest": F.unhex(F.sha2(both, 256))})


_ORDER = ("turn", "role", "head", "digest")


def signatures(df: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal): each row's first fault counts."""
    from pyspark.sql import Window

    rows = _ordered(df)
    last = F.substring(F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1), 1, 1)
    light = rows.select("conv_id", *_ORDER, "alive", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    # Rows that are gone must not make others duplicates.
    seen = Window.partitionBy("conv_id", "digest", "alive").orderBy("turn")
    light = light.withColumn("again", F.row_number().over(seen) > 1)
    fault = F.when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("cut"), "t").otherwise("")
    streamed = light.select("conv_id", *_ORDER, "alive", "again", fault.alias("fault")).repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER, "again")  # of equal rows the first stays first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv, letters = False, None, []
        counts = {"b": 0, "d": 0, "t": 0, "illegal": 0, "turns": 0}
        first = last = before = None
        out: list[tuple] = []

        def finished() -> tuple:
            gaps = last - first + 1 - counts["turns"] if first is not None else 0
            return conv, "".join(letters), gaps, counts["b"], counts["d"], counts["t"], counts["illegal"]

        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "alive", "fault"))
            for c, turn, role, alive, fault in zip(*columns):
                if not started or c != conv:
                    if started:
                        out.append(finished())
                    started, conv, letters = True, c, []
                    counts = dict.fromkeys(counts, 0)
                    first = last = before = None
                if not alive:
                    continue
                if turn is not None:
                    counts["turns"] += turn != last
                    first, last = turn if first is None else first, turn
                initial = role[:1]
                if letters and before + initial not in ("su", "ua", "au"):
                    counts["illegal"] += 1
                before = initial
                if fault:
                    counts[fault] += 1
                letter = initial if initial in ("s", "u", "a") else "o"
                letters.append("x" if fault in ("b", "d") else letter.upper() if fault == "t" else letter)
            if len(out) > 1000:
                yield table(out)
                out = []
        if started:
            out.append(finished())
        if out:
            yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa_conv, pa.string(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    names = ["conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]
    kind = df.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    pa_conv = to_arrow_type(kind)
    return streamed.mapInArrow(run, f"conv_id {kind.simpleString()}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


def answers(found: DataFrame) -> DataFrame:
    """(signature, cost, audit) for rows of distinct signatures, by branches of the trie within ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch = Branch()
        for batch in batches:
            some = batch.column(0).to_pylist()
            got = [branch.answer(s) for s in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([c for c, _ in got], pa.int64()), pa.array([e for _, e in got], pa.string())], names=["signature", "cost", "audit"])

    return found.select("signature").repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(run, "signature string, cost long, audit string")


def repairs(df: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    df: conv_id, turn, role, text and, if there, alive (a row that isn't only names its conversation).
    """
    convs = materialize(signatures(df))
    counted = materialize(convs.groupBy("signature").agg(F.count("*").alias("n")))
    known = materialize(answers(counted))
    limit = max(1000, (counted.agg(F.sum("n")).first()[0] or 0) // 1000)
    common = F.broadcast(counted.where(F.col("n") > limit).select("signature"))
    often, rest = convs.join(common, "signature", "left_semi"), convs.join(common, "signature", "left_anti")
    joined = often.join(F.broadcast(known.join(common, "signature", "left_semi")), "signature").unionByName(rest.join(known, "signature"))
    return joined.drop("signature")


def _streamed(df: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's answer, and behind it its rows in order."""
    rows = _ordered(df).where("alive").drop("alive").withColumn("kind", F.lit(1))
    lead = found.withColumn("kind", F.lit(0))
    return lead.unionByName(rows, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER)


class _Edits:
    """Applies the edits of one conversation to its rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _NOTHING

    def _turn(self) -> str:
        to = "a" if self.state == _USER else "u"
        self.state = _BEHIND[to][self.state]
        return ASSISTANT if to == "a" else USER

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """Turns inserted before the next row, or behind the last."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._turn(), "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._turn(), text, edit
        elif edit == "K":
            self.state = _BEHIND[role[0]][self.state]
            yield role, text, edit


def repaired(df: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(conv_id, place, role, text, edit): the rows of the repaired conversations; edit is K, R or I. found: ``repairs`` of df."""
    found = repairs(df) if found is None else found
    kind = df.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    pa_conv = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, conv, place = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for c, k, audit, role, text in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("conv_id", "kind", "audit", "role", "text"))):
                turns = list(edits.inserted() if k == 0 else edits.row(role, text)) if edits else []
                out += [(conv, place + i, *t) for i, t in enumerate(turns)]
                place += len(turns)
                if k == 0:
                    edits, conv, place = _Edits(audit), c, 0
            yield table(out)
        if edits:
            yield table([(conv, place + i, *t) for i, t in enumerate(edits.inserted())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa_conv, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "place", "role", "text", "edit"])

    return _streamed(df, found).select("conv_id", "kind", "audit", "role", "text").mapInArrow(run, f"conv_id {kind.simpleString()}, place long, role string, text string, edit string")


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digested(df: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with repaired_sha256: of the repaired rows as ``role:text``, one a line."""
    kind = df.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    pa_conv = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits = lead = sha = None
        any_turn = False

        def take(turns: Iterator[tuple[str, str, str]]) -> None:
            nonlocal any_turn
            for role, text, _ in turns:
                sha.update((b"\n" if any_turn else b"") + f"{role}:{text}".encode())
                any_turn = True

        for batch in batches:
            out: list[tuple] = []
            for c, k, audit, role, text, *counts in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("conv_id", "kind", "audit", "role", "text", *_REPORT))):
                if k:
                    take(edits.row(role, text))
                    continue
                if edits:
                    take(edits.inserted())
                    out.append((*lead, sha.hexdigest()))
                edits, lead, sha, any_turn = _Edits(audit), (c, *counts, audit), hashlib.sha256(), False
            yield table(out)
        if edits:
            take(edits.inserted())
            yield table([(*lead, sha.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa_conv, *[pa.int64()] * len(_REPORT), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", *_REPORT, "audit", "repaired_sha256"])

    return _streamed(df, found).mapInArrow(run, f"conv_id {kind.simpleString()}, {', '.join(f'{c} long' for c in _REPORT)}, audit string, repaired_sha256 string")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with its faults and its cheapest repair."""
    rows = damaged(load(spark, sf_dir, "conversations"))
    return digested(rows, repairs(rows))


def _sql() -> str:
    def put(v: str, cost: str, letter: str) -> str:
        # Eight digits of cost in front of the edits: the least string is the ASCII-least cheapest one.
        return f"lpad((substr({v}, 1, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({v}, 9) || '{letter}'"

    go = lambda v: put(v, "3", "D")
    keep = lambda role, v: f"CASE WHEN NOT gone AND role[1] = '{role}' THEN {put(v, 'late', 'K')} END"
    change = lambda v: f"CASE WHEN NOT gone THEN {put(v, '2 + late', 'R')} END"
    before_user = ("n", "s", "a")
    moved = ", ".join([
        f"{go('n')} AS n1", f"least({go('s')}, {keep('s', 'n')}) AS s1",
        f"least({go('u')}, {', '.join(keep('u', v) + ', ' + change(v) for v in before_user)}) AS u1", f"least({go('a')}, {keep('a', 'u')}, {change('u')}) AS a1",
    ])
    return rf"""
WITH RECURSIVE tbl AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hit AS (SELECT raw.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: xor(crc[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) % 20 AS k FROM raw, tbl),
dmg AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM dmg),
row AS (SELECT *, blank OR again AS gone, (cut AND NOT blank AND NOT again)::INT AS late, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS two FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM num)),
rep AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank)::BIGINT AS blank, count(*) FILTER (WHERE again AND NOT blank)::BIGINT AS duplicate, sum(late)::BIGINT AS truncated,
  count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS m FROM row GROUP BY conv_id),
way(conv_id, i, n, s, u, a) AS (SELECT conv_id, 0::BIGINT, '00000000', NULL::VARCHAR, '00000002I', '00000004II' FROM rep
  UNION ALL SELECT conv_id, i, n1, s1, u2, least(a1, {put('u2', '2', 'I')}) FROM (SELECT *, least(u1, {put('n1', '2', 'I')}, {put('s1', '2', 'I')}, {put('a1', '2', 'I')}) AS u2 FROM (SELECT way.conv_id, row.i, {moved} FROM way JOIN row ON way.conv_id = row.conv_id AND row.i = way.i + 1))),
fin AS (SELECT conv_id, least(n, a) AS v FROM way JOIN rep USING (conv_id) WHERE i = m),
let AS (SELECT conv_id, j, substr(v, j + 8, 1) AS edit, sum((substr(v, j + 8, 1) <> 'I')::INT) OVER w AS i, sum((substr(v, j + 8, 1) <> 'D')::INT) OVER w AS e FROM (SELECT conv_id, v, unnest(range(1, length(v) - 7)) AS j FROM fin) WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
lin AS (SELECT let.*, row.role AS old, row.text, max(CASE WHEN e = 1 AND edit = 'K' AND row.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY let.conv_id) AS lead FROM let LEFT JOIN row ON let.conv_id = row.conv_id AND let.i = row.i AND edit <> 'I' WHERE edit <> 'D'),
txt AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN old WHEN (e - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS t FROM lin GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(substr(v, 1, 8)::BIGINT, 0) AS cost, coalesce(substr(v, 9), '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rep USING (conv_id) LEFT JOIN fin USING (conv_id) LEFT JOIN txt USING (conv_id)
"""


OP12_SQL = _sql()
