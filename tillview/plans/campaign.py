"""Batch campaign job: prompts, replies of a text model, and the sheet for the outreach system."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.functions.lists import split_list, strip
from tillview.plans.customers import PREDICTED

# Persona labels in the order they are looked for, and the prompt texts.
PERSONAS = (
    "Champions",
    "Loyal Customers",
    "Potential Loyalists",
    "Big Spenders",
    "New Customers",
    "At Risk",
    "Hibernating",
)
NO_PERSONA = "Unclassified"
PERSONA_PROMPT = (
    "\nReturn ONLY ONE label.\n\nAllowed:\n" + "\n".join(PERSONAS) + "\n\nMetrics:\n"
    "Recency=%s\nFrequency=%s\nMonetary=%s\nTotalSpent=%s\n"
)
OFFER_PROMPT = (
    "\nGenerate ONE short promotional message.\nMention ONLY this product.\nNo explanation.\n\n"
    "Product: %s\nTone: catchy, friendly, urgency-driven.\n"
)

TextModel = Callable[[pd.Series], pd.Series]


def persona_prompt(base: DataFrame) -> DataFrame:
    text = F.format_string(PERSONA_PROMPT, *[
        F.col(c).cast("string") for c in ("Recency", "Frequency", "Monetary", "total_spent")
    ])
    return base.select("customer_id", text.alias("prompt"))


def parse_persona(reply: Column) -> Column:
    """The first of the known labels that occurs in the reply, whatever its case."""
    found = F.when(reply.isNull(), F.lit(NO_PERSONA))
    for name in PERSONAS:
        found = found.when(F.contains(F.lower(reply), F.lit(name.lower())), F.lit(name))
    return found.otherwise(F.lit(NO_PERSONA))


def offer_product(base: DataFrame, seed: int = 0) -> DataFrame:
    """One recommended product per customer: of the own category if any, else of the others.

    The pick is spread by a hash of customer and seed, so a rerun picks the same.
    """
    # 60 bits of a hash that any SQL engine has, so that a sheet can be checked elsewhere.
    digest = F.md5(F.concat_ws(":", F.col("customer_id").cast("string"), F.lit(str(seed))))
    draw = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def pick(column: str) -> Column:
        items = split_list(column)
        return F.when(F.size(items) > 0, F.get(items, F.pmod(draw, F.size(items)).cast("int")))

    return base.select(
        "customer_id", "name", F.coalesce(*[pick(c) for c in PREDICTED]).alias("product")
    )


def offer_prompt(offers: DataFrame) -> DataFrame:
    """Prompt text for each customer's product; NULL without a product."""
    text = F.when(F.col("product").isNotNull(), F.format_string(OFFER_PROMPT, "product"))
    return offers.withColumn("prompt", text)


def parse_offer(reply: Column) -> Column:
    """First line of the trimmed reply."""
    return F.substring_index(strip(reply), "\n", 1)


def batch_text_model(df: DataFrame, model: TextModel, prompt: str = "prompt") -> DataFrame:
    """Add ``reply``: the user's own batch function over the prompts, one Arrow batch at a time."""
    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(reply=model(batch[prompt]))

    return df.mapInPandas(run, schema)


def personas(base: DataFrame, model: TextModel) -> DataFrame:
    replies = batch_text_model(persona_prompt(base), model)
    return replies.select("customer_id", parse_persona(F.col("reply")).alias("persona"))


def campaign_sheet(base: DataFrame, model: TextModel, seed: int = 0) -> DataFrame:
    """Customer, product and offer text for every customer that has a product to offer."""
    offers = offer_prompt(offer_product(base, seed)).filter(F.col("product").isNotNull())
    replies = batch_text_model(offers, model)
    return replies.select("customer_id", "name", "product", parse_offer(F.col("reply")).alias("offer"))
