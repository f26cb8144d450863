"""A job that breaks off between any two stages is taken up by a rerun, with the same result."""

import json
import os

import pytest

from loomspark.functions.text import record_counter
from loomspark.plans import govern as module
from loomspark.plans import journal, specs

SPEC = {"provenance": {"license": "l", "revision": "r", "upstream": "u"}, "source": {"files": "d.jsonl", "schema": "text string", "transform": "tinystories"}, "split": {"by": "shuffle"}, "limits": {"records": 30}}


def without_time(m):
    return {k: v for k, v in m.items() if k != "processed_at"}


def test_a_kill_between_stages(spark, tmp_path, monkeypatch):
    (tmp_path / "d.jsonl").write_text("".join(json.dumps({"text": f"t{i % 37}"}) + "\n" for i in range(45)))
    spec = specs.dataset("d", SPEC)
    run = lambda out, **more: module.govern(spark, spec, str(tmp_path), str(tmp_path / out), str(tmp_path / "m"), record_counter, **more)
    want = without_time(run("plain"))
    commit, made = journal.Journal._commit, []
    folder = str(tmp_path / "journal")

    def dies_after(n):
        def committed(self, stage, record):
            commit(self, stage, record)
            made.append(stage)
            if len(made) > n:
                raise KeyboardInterrupt

        return committed

    for n in range(3):
        made.clear()
        monkeypatch.setattr(journal.Journal, "_commit", dies_after(n))
        with pytest.raises(KeyboardInterrupt):
            run("out", journal=folder)
        # What an attempt wrote and did not commit goes with the next start.
        os.makedirs(f"{folder}/parts-leftover", exist_ok=True)
    monkeypatch.setattr(journal.Journal, "_commit", commit)
    done = [p for p in os.listdir(folder) if p.endswith(".json") and not p.startswith(".")]
    assert {"clean.json", "parts.json", "stats.json"} <= set(done)
    calls = []
    monkeypatch.setattr(module, "dedupe_records", lambda *a: calls.append(a))
    got = without_time(run("out", journal=folder))
    assert got == want and not calls and not os.path.exists(folder)
    rows = lambda out, part: sorted(r.text for r in spark.read.parquet(str(tmp_path / out / f"d/{part}.parquet")).collect())
    assert all(rows("out", p) == rows("plain", p) for p in ("train", "validation", "test"))


def test_another_identity_starts_anew(spark, tmp_path):
    folder = str(tmp_path / "j")
    one = journal.Journal(spark, folder, {"a": 1})
    assert one.value("v", lambda: 3) == 3 and one.value("v", lambda: 4) == 3
    table, found = one.table("t", lambda: spark.range(3), found=lambda: {"n": 3})
    assert found == {"n": 3} and table.count() == 3 and one.table("t", lambda: spark.range(9))[0].count() == 3
    again = journal.Journal(spark, folder, {"a": 1})
    assert again.record("v")["found"] == 3 and again.table("t", lambda: spark.range(9))[0].count() == 3
    other = journal.Journal(spark, folder, {"a": 2})
    assert other.record("v") is None and [p for p in os.listdir(folder) if not p.startswith(".")] == []
    (tmp_path / "x").write_text("12345")
    assert journal.inputs(spark, [str(tmp_path / "x")])[0][1] == 5
