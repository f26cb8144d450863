"""Conversation repair against a search over all edits, and rows with nulls, ties, copies and long conversations."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

from loomspark.llm import conv_repair

FORM = re.compile(r"(s?(ua)+)?\Z")


def prefixes(n):
    """All beginnings of allowed role sequences up to n turns."""
    out = {""}
    for lead in ("", "s"):
        for k in range(n + 1):
            w = lead + "ua" * k
            out |= {w[:i] for i in range(len(w) + 1)} if k else set()
    return out


ALLOWED = prefixes(12)


def searched(letters):
    """Least (cost, audit) by a uniform-cost search over edit sequences, and the roles written."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(letters) and FORM.match(roles):
            return cost, audit, roles
        if (i, roles, audit) in done:
            continue
        done.add((i, roles, audit))
        steps = [(2, "I", i, r) for r in "ua"]
        if i < len(letters):
            x = letters[i]
            steps.append((3, "D", i + 1, ""))
            if x != "x":
                late = int(x.isupper())
                steps += [(late, "K", i + 1, x.lower())] + [(2 + late, "R", i + 1, r) for r in "ua"]
        for c, e, j, r in steps:
            if roles + r in ALLOWED and cost + c <= 3 * len(letters):
                heapq.heappush(heap, (cost + c, audit + e, j, roles + r))
    raise AssertionError


def test_branch_against_search():
    rnd = random.Random(12)
    some = ["".join(p) for n in range(4) for p in product("xsuaoUA", repeat=n)] + ["".join(rnd.choice("xsuaoSUAO") for _ in range(5)) for _ in range(150)]
    some.sort()
    branch = conv_repair.Branch()
    for s in some:
        assert branch.answer(s) == searched(s)[:2], s
    # Shared prefixes are worked out once: as many layers as the trie has nodes.
    assert branch.made == len({s[:i] for s in some for i in range(1, len(s) + 1)})


def plain_report(rows):
    """The contract over (conv_id, turn, role, text) in Python."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        some = convs.setdefault(conv, [])
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        some += [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    out = set()
    for conv, some in convs.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, letters, counts = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in some:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("b", "d") else letter.upper() if fault else letter
        turns = [t for t, *_ in some if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        cost, audit, roles = searched(letters)
        lines, i, r = [], 0, 0
        for e in audit:
            if e != "D":
                name = {"u": "user", "a": "assistant"}.get(roles[r])
                lines.append(f"{some[i][1] if e == 'K' else name}:{'' if e == 'I' else some[i][2]}")
                r += 1
            i += e != "I"
        out.add((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def rows_of():
    rnd = random.Random(5)
    texts = ["Yes.", "No!", "a", " ", "", None, "é?\n", "tail", "漢。", "x" * 500 + ".", "x" * 500 + "!"]
    rows = []
    for c in range(120):
        for t in range(rnd.randint(1, 5)):
            turn = None if rnd.random() < 0.1 else rnd.randint(0, 6)
            rows.append((c, turn, rnd.choice(["user", "assistant", "system", "tool", "", None, "umpire"]), rnd.choice(texts)))
    rows += [(None, 0, "user", "hm."), (None, 1, "assistant", "yes."), (500, None, None, None), rows[0], rows[0]]
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "never seen")]


def test_report_and_rows(spark, tmp_path):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, gaps int").repartition(3)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = conv_repair.op12_conversations(spark, str(tmp_path)).collect()
    assert len(got) == len({r[0] for r in rows}) and {tuple(r) for r in got} == plain_report(rows)
    hurt = conv_repair.damaged(df)
    out = {}
    for r in conv_repair.repaired(hurt).orderBy("conv_id", "place").collect():
        out.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}", r.edit))
    for r in got:
        lines = out.get(r.conv_id, [])
        assert [p for p, *_ in lines] == list(range(len(lines))) and "".join(e for *_, e in lines) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(x for _, x, _ in lines).encode()).hexdigest() == r.repaired_sha256


def test_long_conversation_and_empty_table(spark):
    n = 30_000
    long = spark.range(n).selectExpr("'one' AS conv_id", "id AS turn", "CASE WHEN id % 7 = 3 THEN 'tool' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id, '.') AS text")
    r = conv_repair.repairs(long).first()
    assert (r.conv_id, r.gaps, r.blank, r.duplicate) == ("one", 0, 0, 0) and len(r.audit) >= n - 1 and r.cost == 2 * r.audit.count("R") + 3 * r.audit.count("D") + 2 * r.audit.count("I")
    roles = "".join(x.role[0] for x in conv_repair.repaired(long).orderBy("place").collect())
    assert FORM.match(roles) and len(roles) == len(r.audit.replace("D", ""))
    assert conv_repair.repairs(long.where("false")).count() == 0 and conv_repair.repaired(long.where("false")).count() == 0
