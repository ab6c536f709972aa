"""The reply ledger: no prompt with a reply is asked again, whatever happens to a run."""

import hashlib
import json
import os
from collections import Counter

import pytest

from lexifold.operators.replies import ReplyLedger, answers_with_ledger, read_replies


def counting(folder, kill_at=None):
    """A generator that notes every call, and kills its worker once at the given prompt."""
    folder.mkdir(exist_ok=True)
    calls, flag = str(folder / "calls"), str(folder / "killed")

    def generate(messages):
        prompt = messages[1]["content"]
        with open(calls, "a") as out:
            out.write(prompt + "\n")
        if prompt == kill_at and not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(1)
        if prompt.startswith("down"):
            raise OSError("down")
        text = "no json" if prompt.startswith("odd") else json.dumps({"answer": hashlib.md5(prompt.encode()).hexdigest()})
        return {"text": text, "model": "g", "input_tokens": len(prompt), "output_tokens": 1}

    return generate


def calls(folder):
    return Counter((folder / "calls").read_text().split("\n")[:-1])


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, prompt string")


def test_a_killed_attempt_repeats_one_wave_at_most(spark, tmp_path):
    asked = prompts(spark, [f"p{i}" for i in range(60)])
    ledger = ReplyLedger(str(tmp_path / "ledger"), "g", calls_per_commit=3)
    generate = counting(tmp_path / "log", kill_at="p25")
    with pytest.raises(Exception):
        answers_with_ledger(asked, generate, ledger, parallel_calls=2)
    written = {r.call_key for r in read_replies(spark, ledger.path).collect()}
    got = answers_with_ledger(asked, generate, ledger, parallel_calls=2).collect()
    assert {r.query_id: json.loads(r.reply)["answer"] for r in got} == {i: hashlib.md5(f"p{i}".encode()).hexdigest() for i in range(60)}
    assert sum(r.kept for r in got) == len(written)
    made = calls(tmp_path / "log")
    again = {p for p, n in made.items() if n > 1}
    assert len(made) == 60 and max(made.values()) <= 2
    # Ten waves of about six prompts (split by hash, so some are longer): only that of p25 was asked twice.
    assert 1 <= len(again) <= 20 and len(written) + len(again) <= 60
    assert not {r.query_id for r in got if r.kept} & {int(p[1:]) for p in again}


def test_equal_prompts_failures_and_later_runs(spark, tmp_path):
    ledger = ReplyLedger(str(tmp_path / "ledger"), "g")
    generate = counting(tmp_path / "log")
    asked = prompts(spark, ["same"] * 200 + ["down", "odd", None, ""])
    first = {r.query_id: r for r in answers_with_ledger(asked, generate, ledger).collect()}
    assert len(first) == 204 and not any(r.kept for r in first.values())
    assert len({first[i].reply for i in range(200)}) == 1 and first[202].reply == first[203].reply
    assert (first[200].failure, first[200].attempts, first[201].failure, first[201].attempts) == ("unavailable", 1, "invalid_output", 2)
    assert calls(tmp_path / "log") == {"same": 1, "down": 1, "odd": 2, "": 1}

    second = {r.query_id: r for r in answers_with_ledger(asked, generate, ledger).collect()}
    assert calls(tmp_path / "log") == {"same": 1, "down": 2, "odd": 4, "": 1}
    assert second[0].kept and second[0].latency_ms == 0 and second[0].reply == first[0].reply
    assert not second[200].kept and second[201].failure == "invalid_output"

    # Another model or another system text is another call.
    other = answers_with_ledger(prompts(spark, ["same"]), generate, ReplyLedger(ledger.path, "h")).collect()
    system = answers_with_ledger(prompts(spark, ["same"]), generate, ledger, system="x").collect()
    assert not other[0].kept and not system[0].kept and calls(tmp_path / "log")["same"] == 3


def test_no_prompts(spark, tmp_path):
    ledger = ReplyLedger(str(tmp_path / "ledger"), "g")
    none = spark.createDataFrame([], "query_id bigint, prompt string")
    assert answers_with_ledger(none, counting(tmp_path / "log"), ledger).collect() == []
    assert read_replies(spark, ledger.path).count() == 0
