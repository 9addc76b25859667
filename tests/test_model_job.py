from __future__ import annotations

import os
import sys
import uuid

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tillview.plans import model_job

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def counting(folder, broken=()):
    """A model that leaves a file for every prompt it is asked, and raises for some prompts."""

    def model(prompts: pd.Series) -> pd.Series:
        for prompt in prompts:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as file:
                file.write(prompt)
        if prompts.isin(broken).any():
            raise RuntimeError("model is out")
        return "re: " + prompts

    return model


def asked(folder):
    return sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def test_a_rerun_asks_only_what_is_missing(spark, tmp_path):
    calls, store = [str(tmp_path / c) for c in "abcd"], str(tmp_path / "store")
    for folder in calls:
        os.mkdir(folder)
    prompts = spark.createDataFrame([(i, None if i == 7 else f"p{i % 5}") for i in range(20)], "id long, prompt string").repartition(3)
    first = {r.id: r.reply for r in model_job.run_model_job(prompts, counting(calls[0]), store).collect()}
    assert first == {i: None if i == 7 else f"re: p{i % 5}" for i in range(20)}
    # Every distinct prompt once, however many rows share it.
    assert asked(calls[0]) == [f"p{k}" for k in range(5)]
    again = {r.id: r.reply for r in model_job.run_model_job(prompts, counting(calls[1]), store).collect()}
    assert again == first and asked(calls[1]) == []
    more = prompts.unionByName(spark.createDataFrame([(90, "new")], "id long, prompt string"))
    assert model_job.run_model_job(more, counting(calls[2]), store).where("id = 90").first().reply == "re: new"
    assert asked(calls[2]) == ["new"]
    # Another model has replies of its own.
    model_job.run_model_job(prompts, counting(calls[3]), store, "other").collect()
    assert len(asked(calls[3])) == 5


def test_failed_prompts_are_kept_apart_and_asked_again(spark, tmp_path):
    calls, store = [str(tmp_path / c) for c in "ab"], str(tmp_path / "store")
    for folder in calls:
        os.mkdir(folder)
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "id long, prompt string").repartition(2)
    bad = ("p3", "p17")
    got = {r.id: r.reply for r in model_job.run_model_job(prompts, counting(calls[0], bad), store).collect()}
    assert {i for i, reply in got.items() if reply is None} == {3, 17}
    failed = {r.prompt: (r.error, r.tries) for r in model_job.failed_prompts(spark, store).collect()}
    assert failed == {p: ("RuntimeError: model is out", 1) for p in bad}
    got = {r.id: r.reply for r in model_job.run_model_job(prompts, counting(calls[1]), store).collect()}
    assert got == {i: f"re: p{i}" for i in range(30)} and asked(calls[1]) == sorted(bad)
    assert model_job.failed_prompts(spark, store).count() == 0


def test_a_model_that_drops_replies(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string").coalesce(1)
    got = model_job.run_model_job(prompts, lambda p: p.where(p != "a").dropna(), str(tmp_path / "store"), waves=1)
    assert {r.id: r.reply for r in got.collect()} == {1: None, 2: "b"}
    assert [r.prompt for r in model_job.failed_prompts(spark, str(tmp_path / "store")).collect()] == ["a"]


def test_personas_and_no_rows(spark, tmp_path):
    base = spark.createDataFrame([(1, 5, 2, 10.0, 10.0)], "customer_id long, Recency int, Frequency long, Monetary double, total_spent double")
    model = lambda p: p.map(lambda text: "at risk" if "Recency=5" in text else "?")
    assert [tuple(r) for r in model_job.resumed_personas(base, model, str(tmp_path / "s")).collect()] == [(1, "At Risk")]
    none = base.where(F.lit(False))
    assert model_job.resumed_personas(none, model, str(tmp_path / "t")).count() == 0
