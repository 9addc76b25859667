"""A text-model job that can be stopped and run again: every distinct prompt is asked once.

Replies are kept in a folder of their own by a hash of model name and prompt. A run asks only what the
folder has no reply to, in waves that are written one by one, so a stopped run loses at most one wave
and a lost task repeats its own prompts only. A prompt the model raises an error for is kept with the
error, does not stop the others, and is asked again by the next run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.plans.campaign import TextModel, parse_persona, persona_prompt

STORE = "prompt_key string, prompt string, reply string, error string"
WAVES = 4


def prompt_key(prompt: Column | str, model_name: str) -> Column:
    """Equal for equal prompts to the same model; NULL for no prompt."""
    text = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.sha2(F.concat(F.lit(model_name + "\n"), text), 256)


def kept_answers(spark: SparkSession, store: str) -> DataFrame:
    """All that was ever kept, replies and errors."""
    return spark.read.schema(STORE).parquet(store)


def kept_replies(spark: SparkSession, store: str) -> DataFrame:
    """One reply per prompt, whatever runs overlapped."""
    replies = kept_answers(spark, store).filter(F.col("reply").isNotNull())
    return replies.groupBy("prompt_key").agg(F.min("reply").alias("reply"))


def failed_prompts(spark: SparkSession, store: str) -> DataFrame:
    """Prompts without a reply so far, with the last error by its text and how often they were asked."""
    errors = kept_answers(spark, store).filter(F.col("error").isNotNull())
    open_ones = errors.join(kept_replies(spark, store), "prompt_key", "left_anti")
    return open_ones.groupBy("prompt_key", "prompt").agg(F.max("error").alias("error"), F.count(F.lit(1)).alias("tries"))


def _answers(model: TextModel):
    def asked(prompts: pd.Series) -> tuple[list, list]:
        try:
            replies = list(model(prompts))
            if len(replies) != len(prompts):
                raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
        except Exception as problem:
            if len(prompts) == 1:
                return [None], [f"{type(problem).__name__}: {problem}"]
            # Halves find the prompts at fault; the others are answered.
            cut = len(prompts) // 2
            parts = [asked(prompts.iloc[:cut]), asked(prompts.iloc[cut:])]
            return [r for part in parts for r in part[0]], [e for part in parts for e in part[1]]
        return replies, [None if isinstance(r, str) else "no reply" for r in replies]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, errors = asked(batch["prompt"])
            yield batch.assign(reply=[r if isinstance(r, str) else None for r in replies], error=errors)

    return run


def run_model_job(prompts: DataFrame, model: TextModel, store: str, model_name: str = "model", waves: int = WAVES) -> DataFrame:
    """``prompts`` with ``reply``, asking the model for what ``store`` has no reply to.

    ``store`` is a folder that all executors reach; it is made if absent. Rows without a prompt, and those
    whose prompt failed, have a NULL reply. A prompt many rows share is asked once.
    """
    spark = prompts.sparkSession
    spark.createDataFrame([], STORE).write.mode("append").parquet(store)
    keyed = prompts.withColumn("prompt_key", prompt_key("prompt", model_name))
    wanted = keyed.filter(F.col("prompt_key").isNotNull()).select("prompt_key", "prompt").distinct()
    # Wave of a prompt: 32 bits of its hash.
    wave = F.conv(F.substring("prompt_key", 1, 8), 16, 10).cast("long") % waves
    for number in range(waves):
        missing = wanted.filter(wave == number).join(kept_replies(spark, store), "prompt_key", "left_anti")
        missing.mapInPandas(_answers(model), STORE).write.mode("append").parquet(store)
    return keyed.join(kept_replies(spark, store), "prompt_key", "left").drop("prompt_key")


def resumed_personas(base: DataFrame, model: TextModel, store: str, model_name: str = "model") -> DataFrame:
    """Persona of every customer of ``base``; a second run asks for new or failed customers only."""
    replies = run_model_job(persona_prompt(base), model, store, model_name)
    return replies.select("customer_id", parse_persona(F.col("reply")).alias("persona"))
