"""Next-purchase page: filters, paging, lists, profiles and the campaign job."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from registry import tables as t
from registry.business import label
from registry.core import query
from registry.tables import SPEND
from tillview.functions import lists, numbers
from tillview.operators import filters, postings, rank_directory, ranking, scoring
from tillview.plans import campaign, model_job
from tillview.plans import customers as c
from tillview.session import new_folder

# The stand-in text model travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WANTED = ["Small Ring #0", "red widget #1", "blue anvil #17"]
WHOLE = " OR ".join(
    f"list_contains(string_split(lower(purchased_products_names), ', '), '{w.lower()}')" for w in WANTED
)
PATTERNS = ["red .*#1[0-9]$", "anvil #7"]
FOUND = " OR ".join(f"regexp_matches(purchased_products_names, '{p}', 'i')" for p in PATTERNS)
RECS = {"gender": "MACHINERY", "similarity": (0.5, 0.95), "spent": (100000.0, 5000000.0)}
RECS_SQL = "gender = 'MACHINERY' AND Similarity_Score BETWEEN 0.5 AND 0.95 AND total_spent BETWEEN 100000 AND 5000000"


def size(column: str) -> str:
    """Number of items of a comma list column."""
    return f"(CASE WHEN {column} IS NULL THEN 0 ELSE CAST(len(string_split({column}, ', ')) AS INTEGER) END)"


def as_lists(df):
    """Array columns as comma lists, which every engine hands out alike."""
    arrays = [name for name, kind in df.dtypes if kind.startswith("array")]
    return df.withColumns({a: F.array_join(a, ", ") for a in arrays})


# -- filters --------------------------------------------------------------------------------

RECS_FILTERS = {
    "fil_13_by_customer_id": (lambda df: filters.by_customer(df, customer_id=7), "customer_id = 7"),
    "fil_13_by_name": (lambda df: filters.by_customer(df, name="Customer#000000011"), "name = 'Customer#000000011'"),
    "fil_13_by_gender": (lambda df: filters.by_customer(df, gender="MACHINERY"), "gender = 'MACHINERY'"),
    "fil_14_by_state": (lambda df: filters.by_place(df, state="NATION_3"), "state = 'NATION_3'"),
    "fil_14_by_city": (lambda df: filters.by_place(df, city="NATION_8"), "city_name = 'NATION_8'"),
    "fil_15_bought_any_of_exact": (lambda df: filters.bought_any_of(df, WANTED), WHOLE),
    "fil_15_bought_any_of_regex": (lambda df: filters.bought_any_of(df, PATTERNS, "regex"), FOUND),
    "fil_16_by_similarity": (lambda df: filters.by_similarity(df, (0.6, 0.8)), "Similarity_Score BETWEEN 0.6 AND 0.8"),
    "fil_17_by_total_spent": (lambda df: filters.by_total_spent(df, (1e6, 2.5e6)), "total_spent BETWEEN 1000000 AND 2500000"),
    "fil_19_recs_filter": (lambda df: filters.recs_filter(df, **RECS), RECS_SQL),
}
for _name, (_filter, _where) in RECS_FILTERS.items():
    @query(_name, f"SELECT * FROM t_recs WHERE {_where}", "t_recs")
    def _(spark, sf, keep=_filter):
        return keep(t.recs(spark, sf))


def index_of(spark, sf):
    recs = t.recs(spark, sf)
    return recs, postings.read_postings(spark, postings.write_postings(recs, new_folder(spark, "postings")))


@query("fil_15_bought_any_of_indexed", f"SELECT * FROM t_recs WHERE {WHOLE}", "t_recs")
def _(spark, sf):
    return postings.bought_any_of_indexed(*index_of(spark, sf), WANTED)


@query("ded_04_indexed_vocabulary", "SELECT DISTINCT product FROM t_pairs", "t_pairs")
def _(spark, sf):
    return postings.indexed_vocabulary(index_of(spark, sf)[1])


@query("str_05_contains_ci", f"SELECT customer_id, coalesce({FOUND}, false) AS found FROM t_recs", "t_recs")
def _(spark, sf):
    found = lists.contains_any(c.PURCHASED, PATTERNS, "regex")
    return t.recs(spark, sf).select("customer_id", found.alias("found"))


@query("fil_22_customer_by_id", "SELECT * FROM t_recs WHERE customer_id = 42", "t_recs")
def _(spark, sf):
    return filters.customer_by_id(t.recs(spark, sf), 42)


@query("fil_23_customer_by_name", "SELECT customer_id, name, gender, state, city_name FROM t_recs WHERE name = 'Customer#000000042' ORDER BY customer_id LIMIT 1", "t_recs")
def _(spark, sf):
    return filters.customer_by_name(t.recs(spark, sf), "Customer#000000042")


@query("ded_04_purchased_product_vocabulary", "SELECT DISTINCT unnest(string_split(purchased_products_names, ', ')) AS product FROM t_recs", "t_recs")
def _(spark, sf):
    return filters.product_vocabulary(t.recs(spark, sf))


@query("agg_41_recs_bounds", "SELECT min(Similarity_Score) AS min_Similarity_Score, max(Similarity_Score) AS max_Similarity_Score, min(total_spent) AS min_total_spent, max(total_spent) AS max_total_spent FROM t_recs", "t_recs")
def _(spark, sf):
    return filters.bounds(t.recs(spark, sf), ["Similarity_Score", "total_spent"])


# -- order and pages ------------------------------------------------------------------------

@query("srt_03_order_by_spent", "SELECT customer_id, name, total_spent FROM t_recs ORDER BY total_spent DESC, customer_id", "t_recs")
def _(spark, sf):
    return c.order_by_spent(t.recs(spark, sf).select("customer_id", "name", "total_spent"))


NUMBERED = "(SELECT *, row_number() OVER (ORDER BY total_spent DESC NULLS LAST, customer_id) AS number FROM t_recs)"


@query("srt_04_page", f"SELECT * FROM {NUMBERED} WHERE number BETWEEN 31 AND 40", "t_recs")
def _(spark, sf):
    return ranking.page(t.recs(spark, sf), 4)


@query("srt_04_page_beyond_the_last", f"SELECT * FROM {NUMBERED} WHERE number > (SELECT (ceil(count(*) / 7.0) - 1) * 7 FROM t_recs)", "t_recs")
def _(spark, sf):
    return ranking.page(t.recs(spark, sf), 10**9, 7)


@query("srt_04_deep_page", """SELECT *, row_number() OVER (ORDER BY total_spent DESC NULLS LAST, transaction_id) AS number
  FROM t_orders QUALIFY number BETWEEN 12001 AND 13000""", "t_orders")
def _(spark, sf):
    return ranking.page_by_rank(t.orders(spark, sf), 13, 1000, tie="transaction_id")


@query("srt_04_page_after", "SELECT * FROM t_recs WHERE total_spent < 2000000 ORDER BY total_spent DESC, customer_id LIMIT 10", "t_recs")
def _(spark, sf):
    return ranking.page_after(t.recs(spark, sf), 2000000.0, 10**9)


@query("srt_04_directory_page", """SELECT *, row_number() OVER (ORDER BY total_spent DESC NULLS LAST, transaction_id) AS number
  FROM t_orders QUALIFY number BETWEEN 12001 AND 13000""", "t_orders")
def _(spark, sf):
    path = new_folder(spark, "rank_directory")
    rank_directory.write_rank_directory(t.orders(spark, sf), path, tie="transaction_id")
    return rank_directory.directory_page(spark, path, 13, 1000)


@query("srt_05_default_customer", "SELECT * FROM t_recs ORDER BY total_spent DESC, customer_id LIMIT 1", "t_recs")
def _(spark, sf):
    return c.default_customer(t.recs(spark, sf))


# -- lists ----------------------------------------------------------------------------------

@query("str_01_split_list", "SELECT customer_id, unnest(string_split(purchased_products_names, ', ')) AS item FROM t_recs", "t_recs")
def _(spark, sf):
    return t.recs(spark, sf).select("customer_id", F.explode(lists.split_list(c.PURCHASED)).alias("item"))


@query("str_02_split_cart", "SELECT customer_id, unnest(string_split(in_cart_other_category, ', ')) AS item FROM t_recs WHERE in_cart_other_category IS NOT NULL", "t_recs")
def _(spark, sf):
    literal = F.concat(F.lit("['"), F.replace("in_cart_other_category", F.lit(", "), F.lit("', '")), F.lit("']"))
    carts = t.recs(spark, sf).select("customer_id", literal.alias("cart"))
    return carts.select("customer_id", F.explode(lists.split_cart("cart")).alias("item"))


@query("str_03_list_sizes", f"""SELECT customer_id, {size(c.PURCHASED)} AS purchases, {size(c.CARTS[0])} + {size(c.CARTS[1])} AS cart_items,
  {size(c.PREDICTED[0])} + {size(c.PREDICTED[1])} AS recommendations FROM t_recs""", "t_recs")
def _(spark, sf):
    return c.list_sizes(t.recs(spark, sf))


@query("str_04_numbered_items", """SELECT customer_id, CAST(generate_subscripts(x, 1) AS INTEGER) AS number, unnest(x) AS item
  FROM (SELECT customer_id, string_split(Predicted_Products_from_Other_Categories, ', ') AS x FROM t_recs)""", "t_recs")
def _(spark, sf):
    return c.numbered_items(t.recs(spark, sf), c.PREDICTED[1])


@query("str_06_similarity_text", "SELECT customer_id, coalesce(format('{:,.1f}%', Similarity_Score * 100), '') AS similarity FROM t_matches", "t_matches")
def _(spark, sf):
    matches = t.star.customer_matches(t.features(spark, sf))
    return matches.select("customer_id", numbers.similarity_text("Similarity_Score").alias("similarity"))


# -- cards and profiles ---------------------------------------------------------------------

@query("prj_13_customer_card", "SELECT name, customer_id, total_spent, city_name, gender, days_since_last_visit AS recency_days FROM t_recs", "t_recs")
def _(spark, sf):
    return c.customer_card(t.recs(spark, sf))


@query("prj_14_frequency_or_zero", "SELECT customer_id, CAST(coalesce(nullif(Frequency, 10), 0) AS INTEGER) AS frequency FROM t_rfm", "t_rfm")
def _(spark, sf):
    rfm = t.rfm(spark, sf).withColumn("Frequency", F.nullif(F.col("Frequency"), F.lit(10)))
    return rfm.select("customer_id", c.frequency_or_zero(rfm).alias("frequency"))


BAND = "CASE WHEN {0} < 30 THEN 'recent' WHEN {0} < 90 THEN 'cooling' WHEN {0} IS NOT NULL THEN 'stale' END"


@query("prj_15_recency_band", f"SELECT customer_id, {BAND.format('Recency')} AS band FROM t_rfm", "t_rfm")
def _(spark, sf):
    return t.rfm(spark, sf).select("customer_id", scoring.recency_band().alias("band"))


CATEGORY_SPEND = " UNION ALL ".join(f"SELECT customer_id, '{label(s, '_spend')}' AS category, {s} AS amount FROM t_features WHERE {s} > 0" for s in SPEND)


@query("agg_46_customer_category_spend", f"""SELECT customer_id, category, amount,
  amount / CAST(sum(CAST(amount AS DECIMAL(18,4))) OVER (PARTITION BY customer_id) AS DOUBLE) AS share FROM ({CATEGORY_SPEND})""", "t_features")
def _(spark, sf):
    return c.customer_category_spend(t.features(spark, sf))


SIMILAR = "coalesce(format('{:,.1f}%', a.Similarity_Score * 100), '') AS similarity"


@query("joi_07_similar_customers", f"""SELECT a.customer_id, a.Matched_Customer_ID, {SIMILAR}, b.name AS matched_name,
  {size('b.' + c.PURCHASED)} AS matched_purchases FROM t_recs a LEFT JOIN t_recs b ON b.customer_id = a.Matched_Customer_ID""", "t_recs")
def _(spark, sf):
    return c.similar_customers(t.recs(spark, sf))


@query("cmp_08_customer_profile", f"""SELECT a.customer_id, a.name, a.gender, a.city_name, a.total_spent, a.days_since_last_visit AS recency_days,
  {BAND.format('a.days_since_last_visit')} AS recency_band, CAST(a.Frequency AS INTEGER) AS frequency, a.Monetary,
  coalesce(a.purchased_products_names, '') AS purchased, coalesce(a.in_cart_same_category, '') AS cart_same,
  coalesce(a.in_cart_other_category, '') AS cart_other, coalesce(a.{c.PREDICTED[0]}, '') AS recommended_same,
  coalesce(a.{c.PREDICTED[1]}, '') AS recommended_other, a.Matched_Customer_ID, {SIMILAR}, b.name AS matched_name,
  coalesce(b.purchased_products_names, '') AS matched_purchased, {size('a.' + c.PURCHASED)} AS n_purchased,
  {size('a.' + c.CARTS[0])} + {size('a.' + c.CARTS[1])} AS n_cart, {size('a.' + c.PREDICTED[0])} + {size('a.' + c.PREDICTED[1])} AS n_recommended
  FROM t_recs_base a LEFT JOIN t_recs b ON b.customer_id = a.Matched_Customer_ID""", "t_recs_base")
def _(spark, sf):
    return as_lists(c.customer_profile(t.recs_base(spark, sf)))


# -- campaign -------------------------------------------------------------------------------

PERSONA_TEXT = campaign.PERSONA_PROMPT.split("%s")
@query("cmp_01_persona_prompt", "SELECT customer_id, '" + PERSONA_TEXT[0] + "' || Recency || '" + PERSONA_TEXT[1] + "' || Frequency || '"
       + PERSONA_TEXT[2] + "' || CAST(floor(Monetary) AS BIGINT) || '" + PERSONA_TEXT[3] + "' || CAST(floor(Monetary) AS BIGINT) || '"
       + PERSONA_TEXT[4] + "' AS prompt FROM t_rfm", "t_rfm")
def _(spark, sf):
    rfm = t.rfm(spark, sf).withColumn("Monetary", F.floor("Monetary"))
    return campaign.persona_prompt(rfm.withColumn("total_spent", F.col("Monetary")))


REPLY = """CASE Frequency % 4 WHEN 0 THEN 'I would say: LOYAL customers!' WHEN 1 THEN 'both at risk and Champions'
  WHEN 2 THEN 'no idea' ELSE 'big spenders' || chr(10) || 'hibernating' END"""


@query("cmp_02_parse_persona", """SELECT customer_id, CASE Frequency % 4 WHEN 0 THEN 'Loyal Customers' WHEN 1 THEN 'Champions'
  WHEN 2 THEN 'Unclassified' ELSE 'Big Spenders' END AS persona FROM t_rfm""", "t_rfm")
def _(spark, sf):
    replies = t.rfm(spark, sf).select("customer_id", F.expr(REPLY).alias("reply"))
    return replies.select("customer_id", campaign.parse_persona(F.col("reply")).alias("persona"))


def drawn(column: str) -> str:
    items = f"string_split({column}, ', ')"
    draw = "CAST('0x' || substr(md5(concat_ws(':', CAST(customer_id AS VARCHAR), '0')), 1, 15) AS BIGINT)"
    return f"{items}[CAST({draw} % len({items}) AS INTEGER) + 1]"


OFFERS = f"SELECT customer_id, name, coalesce({', '.join(drawn(column) for column in c.PREDICTED)}) AS product FROM t_recs"


@query("cmp_03_offer_product", OFFERS, "t_recs")
def _(spark, sf):
    return campaign.offer_product(t.recs(spark, sf))


OFFER_TEXT = campaign.OFFER_PROMPT.split("%s")


@query("cmp_04_offer_prompt", f"SELECT category, product, '{OFFER_TEXT[0]}' || product || '{OFFER_TEXT[1]}' AS prompt FROM t_catalog", "t_catalog")
def _(spark, sf):
    return campaign.offer_prompt(t.catalog(spark, sf).select("category", "product"))


@query("cmp_04_prompts_of_offers", f"SELECT *, '{OFFER_TEXT[0]}' || product || '{OFFER_TEXT[1]}' AS prompt FROM ({OFFERS})", "t_recs")
def _(spark, sf):
    return campaign.offer_prompt(campaign.offer_product(t.recs(spark, sf)))


@query("cmp_05_parse_offer", "SELECT product, 'Only today: ' || product AS offer FROM t_catalog", "t_catalog")
def _(spark, sf):
    reply = F.concat(F.lit(" \n\tOnly today: "), F.col("product"), F.lit("\nSecond line\n"))
    return t.catalog(spark, sf).select("product", campaign.parse_offer(reply).alias("offer"))


def shout(prompts: pd.Series) -> pd.Series:
    """A stand-in text model: the product line of the prompt in capitals."""
    return prompts.str.extract(r"Product: (.*)", expand=False).str.upper() + "!\nsecond line"


@query("cmp_06_batch_text_model", "SELECT product, upper(product) || '!' || chr(10) || 'second line' AS reply FROM t_catalog", "t_catalog")
def _(spark, sf):
    prompts = campaign.offer_prompt(t.catalog(spark, sf).select("product"))
    return campaign.batch_text_model(prompts, shout).select("product", "reply")


@query("cmp_07_campaign_sheet", f"SELECT *, upper(product) || '!' AS offer FROM ({OFFERS}) WHERE product IS NOT NULL", "t_recs")
def _(spark, sf):
    return campaign.campaign_sheet(t.recs(spark, sf), shout)


def persona_of(prompts: pd.Series) -> pd.Series:
    """A stand-in text model: a persona by the frequency in the prompt."""
    replies = ["I would say: LOYAL customers!", "both at risk and Champions", "no idea", "big spenders\nhibernating"]
    return prompts.str.extract(r"Frequency=(\d+)", expand=False).astype(int).map(lambda n: replies[n % 4])


@query("cmp_06_resumed_personas", """SELECT customer_id, CASE Frequency % 4 WHEN 0 THEN 'Loyal Customers' WHEN 1 THEN 'Champions'
  WHEN 2 THEN 'Unclassified' ELSE 'Big Spenders' END AS persona FROM t_rfm""", "t_rfm")
def _(spark, sf):
    base, store = t.rfm(spark, sf).withColumn("total_spent", F.col("Monetary")), new_folder(spark, "replies")
    # A first run over some customers, then one over all, which asks for the others only.
    model_job.resumed_personas(base.where("customer_id % 3 = 0"), persona_of, store)
    return model_job.resumed_personas(base, persona_of, store)


@query("cmp_06_model_personas", """SELECT customer_id, CASE Frequency % 4 WHEN 0 THEN 'Loyal Customers' WHEN 1 THEN 'Champions'
  WHEN 2 THEN 'Unclassified' ELSE 'Big Spenders' END AS persona FROM t_rfm""", "t_rfm")
def _(spark, sf):
    return campaign.personas(t.rfm(spark, sf).withColumn("total_spent", F.col("Monetary")), persona_of)
