"""An outcome for every request: statuses, billing, the trained evaluator, and requests that wait on a stream."""

import datetime as dt

from pyspark.sql import functions as F

from escalade.operators import metrics, outcomes as O
from escalade.operators.training import train_adequacy
from escalade.streaming import runner as S

REQUEST = "request_id bigint, prompt string, is_valid boolean, force_model string, disable_evaluator boolean, ts timestamp"
ANSWER = ("request_id bigint, weak_response string, strong_response string, weak_error string, strong_error string, "
          "weak_latency_ms double, strong_latency_ms double")
AT = dt.datetime(2024, 5, 1, 12)


def tables(spark):
    requests = [(1, "a b c", True, None, False, AT), (2, "", True, None, False, AT), (3, None, True, None, False, AT), (4, "a", False, None, False, AT),
                (5, "a b", True, None, False, AT), (6, "a b", True, None, None, None), (7, "a b", True, "strong", False, AT),
                (8, "a b", True, None, False, AT), (9, "a b", True, "weak", False, AT), (10, "a b", True, None, True, AT)]
    answers = [(1, "a b c", "d e", None, None, 5.0, 9.0), (4, "x", "y", None, None, 1.0, 1.0), (6, "zz", "full answer", None, None, 5.0, 7.0),
               (7, None, "s", "timeout", None, 1.0, 4.0), (8, None, "s", "timeout", None, 3.0, 4.0), (9, "w", None, None, "overloaded", 2.0, 4.0),
               (10, "zz", None, None, "overloaded", 2.0, 4.0), (99, "nobody", "asked", None, None, 1.0, 1.0)]
    return spark.createDataFrame(requests, REQUEST), spark.createDataFrame(answers, ANSWER)


def judge(prompt, response):
    return F.when(response == "zz", F.lit(0.1)).otherwise(F.lit(0.9))


def test_every_request_has_one_outcome(spark):
    requests, answers = tables(spark)
    out = O.settle(O.with_responses(requests, answers), judge)
    assert out.columns == list(O.RESULT)
    got = {r.request_id: r for r in out.collect()}
    assert {i: (r.status, r.model_used, r.latency_ms) for i, r in got.items()} == {
        1: ("served", "weak", 5.0), 2: ("no_user_message", None, None), 3: ("no_user_message", None, None), 4: ("invalid", None, None),
        5: ("no_response", None, None), 6: ("served", "weak_then_strong", 12.0), 7: ("served", "strong", 4.0), 8: ("failed", "weak", 3.0),
        9: ("served", "weak", 2.0), 10: ("served", "weak", 2.0)}
    assert got[6].response == "full answer" and got[6].evaluator_triggered and got[6].tokens_used.strong_output == 2
    assert got[8].error == "timeout" and got[8].response is None and got[8].cost_usd == 0.0 and got[8].weak_quality_score is None
    assert got[7].tokens_used.weak_input == 0 and got[4].error == "request" and got[1].ts == AT


def test_failed_strong_call_after_escalation(spark):
    requests = spark.createDataFrame([(1, "p", True, None, False, AT)], REQUEST)
    answers = spark.createDataFrame([(1, "zz", None, None, "overloaded", 2.0, 4.0)], ANSWER)
    row = O.settle(O.with_responses(requests, answers), judge).first()
    assert (row.status, row.error, row.model_used, row.weak_quality_score, row.latency_ms) == ("failed", "overloaded", "weak_then_strong", 0.1, 6.0)


def test_reports_run_on_outcomes(spark):
    requests, answers = tables(spark)
    out = O.settle(O.with_responses(requests, answers), judge)
    m = metrics.routing_metrics(O.served_results(out)).first()
    assert (m.total_requests, m.weak_only, m.strong_only, m.weak_then_strong) == (5, 3, 1, 1)
    counts = {(r.status, r.error): r.requests for r in O.outcome_counts(out).collect()}
    assert sum(counts.values()) == 10 and counts[("failed", "timeout")] == 1 and counts[("no_user_message", "no_user_message")] == 2


def test_trained_scorer_judges_only_who_is_to_be_judged(spark):
    words = "alpha beta gamma delta".split()
    rows = [(i, f"ask {words[i % 4]}", f"good {words[i % 4]} answer" if i % 2 else "bad", float(i % 2)) for i in range(60)]
    model = train_adequacy(spark.createDataFrame(rows, "id int, prompt string, response string, label double"), num_features=64)
    requests = [(1, "ask beta", True, None, False, None), (2, "ask beta", True, "weak", False, None), (3, "ask beta", True, None, True, None),
                (4, "ask beta", True, None, False, None), (5, "ask beta", True, None, False, None)]
    answers = [(i, r, "strong", None, None, 1.0, 1.0) for i, r in ((1, "good beta answer"), (2, "bad"), (3, "bad"), (4, "bad"))]
    joined = O.with_responses(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(answers, ANSWER))
    clash = joined.withColumns({"response": F.lit("mine"), "features": F.lit(1), "probability": F.lit("p")})
    for rows in (joined, clash):
        got = {r.request_id: r for r in O.settle(rows, O.ModelScorer(model)).collect()}
        assert {i: r.model_used for i, r in got.items()} == {1: "weak", 2: "weak", 3: "weak", 4: "weak_then_strong", 5: None}
        assert {i for i, r in got.items() if r.weak_quality_score is not None} == {1, 4}
        assert got[1].weak_quality_score > 0.6 > got[4].weak_quality_score
    added = O.ModelScorer(model).add(clash, F.lit(True), "q")
    assert set(added.columns) == {*clash.columns, "q"} and {r.response for r in added.collect()} == {"mine"}


def test_stream_emits_unanswered_requests_when_their_time_is_over(spark, tmpdir_path):
    ask = "request_id bigint, prompt string, ts timestamp"
    reply = "request_id bigint, weak_response string, responded_at timestamp"
    minute = lambda m: AT + dt.timedelta(minutes=m)
    folders = [f"{tmpdir_path}/ask", f"{tmpdir_path}/reply"]
    spark.createDataFrame([(1, "a", AT), (2, "b", AT), (3, "c", minute(300)), (None, "d", AT)], ask).write.parquet(folders[0])
    spark.createDataFrame([(1, "in time", minute(9)), (2, "late", minute(11)), (8, "nobody", AT)], reply).write.parquet(folders[1])
    build = lambda: S.awaited_responses(*[S.file_stream(spark, f, "*.parquet") for f in folders], "10 minutes", "1 minute")
    out = S.run_to_close(build, "waiting", list(zip(folders, ("ts", "responded_at"))))
    assert sorted((r.request_id, r.answered, r.weak_response) for r in out.collect()) == [(1, True, "in time"), (2, None, None), (3, None, None)]


def test_thresholds_and_prices_from_settings(spark):
    import pytest

    from escalade.schemas import RoutingConfig, routing_config
    assert routing_config({}) == RoutingConfig()
    config = routing_config({"router_threshold": "0.4", "strong_output": 31})
    assert (config.router_threshold, config.evaluator_threshold, config.prices.strong_output, config.prices.weak_input) == (0.4, 0.7, 31.0, 0.5)
    spark.conf.set("escalade.evaluator_threshold", "0.05")
    try:
        loose = routing_config(spark.conf)
    finally:
        spark.conf.unset("escalade.evaluator_threshold")
    requests, answers = tables(spark)
    got = {r.request_id: r.model_used for r in O.settle_by(loose, O.with_responses(requests, answers), judge).collect()}
    assert loose.evaluator_threshold == 0.05 and got[6] == "weak"
    for bad in ({"router_threshold": 2}, {"weak_input": "cheap"}):
        with pytest.raises(ValueError):
            routing_config(bad)
