"""Every model call is kept as it is answered and paid once."""

import os
import threading
import time

import pandas as pd
import pytest
from pyspark import cloudpickle

from siltlog.plans import ledger, model
from siltlog.plans.ledger import Ledger, read_ledger
from siltlog.plans.model import TOKEN_COLUMNS, ask, read_audit, save_audit

cloudpickle.register_pickle_by_value(ledger)
cloudpickle.register_pickle_by_value(model)


def requests(spark, prompts, stage="s"):
    rows = [(stage, i, "sys", p) for i, p in enumerate(prompts)]
    return spark.createDataFrame(rows, "stage string, batch_id long, system_prompt string, user_prompt string")


def logging_model(folder, dies_on=None, fails_on=None, name="logged"):
    """Answers with the prompt and leaves a file for each prompt it was asked."""

    class Died(BaseException):
        pass

    def answer(frame):
        for prompt in frame["user_prompt"]:
            asked = len([f for f in os.listdir(folder) if f.startswith(f"{prompt}-")])
            open(f"{folder}/{prompt}-{asked}-{os.getpid()}-{time.monotonic_ns()}", "w").close()
            if prompt == dies_on and asked == 0:
                raise Died("the worker is gone")
            if prompt == fails_on:
                raise RuntimeError("down")
        return frame.assign(text='{"p": "' + frame["user_prompt"] + '"}', **{c: 1 for c in TOKEN_COLUMNS})

    answer.name = name
    return answer


def asked(folder):
    return sorted(f.split("-")[0] for f in os.listdir(folder))


def test_what_was_answered_before_a_task_died_is_not_asked_again(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    prompts = [f"p{i}" for i in range(6)]
    dying = logging_model(str(calls), dies_on="p5")
    with pytest.raises(Exception, match="gone"):
        ask(requests(spark, prompts).coalesce(1), dying, 1, ledger=path).collect()
    answered = [p for p in asked(calls) if p != "p5"]
    again = ask(requests(spark, prompts), dying, 3, ledger=path).collect()
    assert sorted(r["text"] for r in again) == [f'{{"p": "{p}"}}' for p in prompts]
    assert asked(calls) == sorted([*prompts, "p5"]) and set(answered) <= set(prompts)
    assert read_ledger(spark, path).count() == 6
    assert sorted(r["parsed"] for r in read_audit(spark, path).collect()) == [f'{{"p":"{p}"}}' for p in prompts]
    # Another stage, other models or another prompt are other calls.
    ask(requests(spark, ["p0"], "t"), dying, 1, ledger=path)
    ask(requests(spark, ["p0"]), logging_model(str(calls), name="other"), 1, ledger=path)
    assert asked(calls).count("p0") == 3 and read_ledger(spark, path).count() == 8


def test_failures_are_kept_apart_and_asked_again(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    assert read_ledger(spark, path).count() == 0
    first, second = logging_model(str(calls), fails_on="b", name="first"), logging_model(str(calls), fails_on="c", name="second")
    rows = {r["user_prompt"]: r for r in ask(requests(spark, ["a", "b", "c"]), [first, second], ledger=path).collect()}
    assert [(rows[p]["model_ord"], rows[p]["error"]) for p in "abc"] == [(0, None), (1, None), (0, None)]
    failed = ask(requests(spark, ["b"]), first, ledger=path).collect()
    assert failed[0]["text"] is None and failed[0]["error"] == "RuntimeError: down"
    told = read_ledger(spark, path, ledger.FAILURES).collect()
    assert sorted((r["user_prompt"], r["model"], r["error"]) for r in told) == [("b", "first", "RuntimeError: down")] * 2
    before = len(asked(calls))
    same = ask(requests(spark, ["a", "b", "c"]), [first, second], ledger=path).collect()
    assert {r["user_prompt"]: (r["text"], r["model_ord"], r["total_token_count"]) for r in same} == {
        p: (rows[p]["text"], rows[p]["model_ord"], 1) for p in "abc"
    }
    assert len(asked(calls)) == before
    ask(requests(spark, ["b"]), first, ledger=path)
    assert len(asked(calls)) == before + 1


def test_calls_of_a_task_overlap_up_to_a_bound(spark):
    lock, state = threading.Lock(), {"now": 0, "most": 0}

    def slow(frame):
        with lock:
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
        time.sleep(0.05)
        with lock:
            state["now"] -= 1
        return frame.assign(text="ok", **{c: 1 for c in TOKEN_COLUMNS})

    frame = pd.DataFrame({"stage": "s", "batch_id": range(12), "system_prompt": "x", "user_prompt": [f"p{i}" for i in range(12)]})
    with model.ThreadPoolExecutor(4) as pool:
        out = list(pool.map(lambda part: model._answer(part, [slow]), [frame.iloc[i : i + 1] for i in range(12)]))
    assert 2 <= state["most"] <= 4 and all((o["text"] == "ok").all() for o in out)


def test_ask_with_several_calls_at_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    found = ask(requests(spark, [f"q{i}" for i in range(20)]), logging_model(str(calls)), 1, ledger=str(tmp_path / "ledger"), at_once=5)
    assert sorted(r["batch_id"] for r in found.collect()) == list(range(20)) and len(asked(calls)) == 20


def test_records_written_twice_are_one(spark, tmp_path):
    responses = ask(requests(spark, ["a", "b"]), logging_model(str(tmp_path)))
    for _ in range(2):
        save_audit(responses, str(tmp_path / "audit"))
    save_audit(responses.where("batch_id = 1"), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2


def test_a_call_written_twice_is_one_file(tmp_path):
    kept = Ledger(str(tmp_path))
    for text in ("x", "x"):
        kept.keep("abc", {"text": text, "error": None})
    assert kept.answer("abc")["text"] == "x" and kept.answer("abd") is None
    assert [f for _, _, names in os.walk(tmp_path) for f in names] == ["abc.json"]
