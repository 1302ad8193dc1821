"""U2 with a ledger: bounded calls, no prompt twice, restarts; ids beyond 2^53 beside null ones."""

import os
import time

import pytest
from pyspark.sql import functions as F

from escalade.operators import routing as R
from escalade.operators import scoring as U

IDS = [2**53 + 1, None, 2**62 + 3, 7]


def logged(folder, name, fail=(), pause=0.0, kill=()):
    """A model that writes down each call, and when."""
    def model(prompt):
        start = time.time()
        if prompt in kill:
            raise SystemExit(f"killed at {prompt}")
        time.sleep(pause)
        with open(f"{folder}/{name}-{os.getpid()}-{time.time_ns()}", "w") as f:
            f.write(f"{prompt},{start},{time.time()}")
        if prompt in fail:
            raise TimeoutError("no answer")
        return f"{name} {prompt}"
    return model


def calls(folder, name):
    read = [open(f"{folder}/{x}").read().split(",") for x in os.listdir(folder) if x.startswith(name + "-")]
    return sorted(p for p, _, _ in read), [(float(a), float(b)) for _, a, b in read]


def prompts(spark, n):
    return spark.createDataFrame([(i, f"p{i}") for i in range(n)] + [(None, "no key")], "pair_id bigint, prompt string")


def test_at_most_so_many_calls_at_once(spark, tmpdir_path):
    os.mkdir(f"{tmpdir_path}/log")
    weak = logged(f"{tmpdir_path}/log", "weak", pause=0.05)
    out = U.collect_with_ledger(prompts(spark, 24), weak, lambda p: p, f"{tmpdir_path}/ledger", max_concurrent=2, wave_rows=10)
    assert out.where("error is null").count() == 24
    _, spans = calls(f"{tmpdir_path}/log", "weak")
    assert max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= 2


def test_restart_calls_no_prompt_twice(spark, tmpdir_path):
    os.mkdir(f"{tmpdir_path}/log")
    ledger, log = f"{tmpdir_path}/ledger", f"{tmpdir_path}/log"
    strong = logged(log, "strong", fail={"p3"})
    with pytest.raises(Exception):
        U.collect_with_ledger(prompts(spark, 30), logged(log, "weak", kill={"p11"}), strong, ledger, max_concurrent=3, wave_rows=6, retries=0)
    before = calls(log, "weak")[0]
    out = {r.pair_id: r for r in U.collect_with_ledger(prompts(spark, 30), logged(log, "weak"), strong, ledger, max_concurrent=3, wave_rows=6,
                                                       retries=1, backoff_s=0.0).collect()}
    asked = calls(log, "weak")[0]
    assert len(out) == 30 and len(asked) == len(set(asked)) and set(before) < set(asked)
    cut = {i for i, r in out.items() if r.error == "interrupted"}
    assert 11 in cut and len(cut) <= 6 and "p11" not in asked
    assert all(r.weak_response == f"weak p{i}" for i, r in out.items() if i not in cut)
    again = U.collect_with_ledger(prompts(spark, 30), logged(log, "weak"), strong, ledger, retry_interrupted=True, retries=0)
    assert again.where("error = 'interrupted'").count() == 0 and again.count() == 30
    assert {r.pair_id for r in again.where("error is not null").collect()} == {3}


def test_failed_calls_are_tried_again(spark, tmpdir_path):
    os.mkdir(f"{tmpdir_path}/log")
    weak = logged(f"{tmpdir_path}/log", "weak", fail={"p1"})
    out = {r.pair_id: r for r in U.collect_with_ledger(prompts(spark, 3), weak, lambda p: p, f"{tmpdir_path}/l", retries=2, backoff_s=0.01).collect()}
    assert (out[1].error, out[1].attempts, out[0].error, out[0].attempts) == ("TimeoutError: no answer", 4, None, 2)
    assert calls(f"{tmpdir_path}/log", "weak")[0].count("p1") == 3
    empty = U.collect_with_ledger(prompts(spark, 0), weak, weak, f"{tmpdir_path}/e")
    assert empty.count() == 0


def test_large_ids_beside_null_ones(spark):
    rows = spark.createDataFrame([(i, "p", "r", True) for i in IDS], "pair_id bigint, prompt string, response string, need boolean").coalesce(1)
    told = lambda df: sorted((r.pair_id for r in df.collect()), key=str)
    want = sorted(IDS, key=str)
    assert told(U.collect_responses(rows, str.upper, str.lower)) == want
    assert told(U.score_batch(rows, U.containment_batch)) == want
    assert told(U.judge_labels(rows, lambda p, r: 5.0, 4.0, response="response")) == want
    assert told(R._call_where(rows, str.upper, "need", "answer")) == want
    assert U.score_batch(rows.withColumn("score", F.lit("old")), U.containment_batch).first().score == 0.0
