"""Input tables of the analytics pages, built from a TPC-H-like star schema.

The pages take these tables as given; the rules below are this library's own stand-ins, plain
enough to be checked by SQL. Customer-level facts are reduced to one row per customer before any
join, so a customer with very many rows costs map-side work and not one large task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.functions.lists import joined
from tillview.functions.numbers import MONEY, money_sum
from tillview.operators.matching import best_matches
from tillview.operators.neighbours import projected_matches
from tillview.schemas import PCT_SUFFIX, SPEND_SUFFIX
from tillview.session import dropped, written_once

# The anchor date recency is counted to, and the 25 categories of the star schema.
ANCHOR = "2001-08-02"
CATEGORIES = tuple(f"brand_{i}" for i in range(1, 26))


# Columns of the star schema tables. Declared, so that no job reads footers first.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_extendedprice double, "
                "l_discount double, l_linestatus string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, value double",
}


def star(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def _category() -> Column:
    return F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_"))


def _product() -> Column:
    return F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string"))


def customer_places(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with name, segment and place.

    Nation and region are tiny, so the planner's own size check broadcasts them.
    """
    place = star(spark, folder, "nation").join(
        star(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        star(spark, folder, "customer")
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("gender"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("state"),
            F.col("n_name").alias("city_name"),
        )
    )


def plain_orders(spark: SparkSession, folder: str) -> DataFrame:
    return star(spark, folder, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("mode_of_payment"),
        F.col("o_totalprice").alias("total_spent"),
        F.col("o_orderdate").alias("order_date"),
        F.quarter("o_orderdate").alias("order_quarter"),
    )


def orders_with_place(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the customer's name, segment and place: the columns most reports need."""
    return plain_orders(spark, folder).join(customer_places(spark, folder), "customer_id").select(
        "transaction_id", "customer_id", "name", "gender", "region", "state", "city_name",
        "mode_of_payment", "total_spent", "order_date", "order_quarter",
    )


def _amount() -> Column:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return (price * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast(MONEY)


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line: order, customer, product, category, amount, price and line status."""
    orders = star(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return (
        star(spark, folder, "lineitem")
        .join(star(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderkey").alias("transaction_id"),
            _product().alias("product"),
            _category().alias("category"),
            _amount().alias("amount"),
            F.col("p_retailprice").alias("price_inr"),
            F.col("l_linestatus").alias("line_status"),
        )
    )


def bought_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The amount of each customer and part; lines are added up where they meet their orders."""
    orders = star(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return (
        star(spark, folder, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("customer_id"), "l_partkey")
        .agg(F.sum(_amount()).alias("amount"))
    )


def bought_products(spark: SparkSession, folder: str, parts: DataFrame | None = None) -> DataFrame:
    """Each customer and product once, with category, list price and the amount of the pair.

    Lines are added up by the two keys before products are looked up, so a product or customer
    with very many lines is small by the time it is joined. ``parts`` saves adding up ``bought_parts``.
    """
    pairs = bought_parts(spark, folder) if parts is None else parts
    return pairs.join(star(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "customer_id", _product().alias("product"), _category().alias("category"),
        F.col("p_retailprice").alias("price_inr"), "amount",
    )


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line: customer, product, category, amount and list price."""
    return order_lines(spark, folder).select(
        "customer_id", "product", "category", "amount", "price_inr"
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return star(spark, folder, "part").select(
        _category().alias("category"), _product().alias("product"),
        F.col("p_retailprice").alias("price_inr"),
    )


def rfm(transactions: DataFrame, anchor: str = ANCHOR) -> DataFrame:
    """Days since the last order, number of orders and money spent, per customer."""
    return transactions.groupBy("customer_id").agg(
        F.datediff(F.lit(anchor).cast("date"), F.max("order_date")).alias("Recency"),
        F.count(F.lit(1)).alias("Frequency"),
        money_sum("total_spent").alias("Monetary"),
    )


def category_features(bought: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Spend per customer and category as one wide row, with the share of the row total.

    Money is added up per customer and category first; the wide step then only places doubles.
    A category that is not in ``categories`` raises, as shares of the total would leave it out.
    """
    spend = bought.withColumn("category", _listed(categories)).groupBy("customer_id", "category").agg(F.sum("amount").alias("_amount"))
    return _wide_features(spend, categories)


def _listed(categories: Sequence[str]) -> Column:
    """The category; one that is not listed raises."""
    known = F.col("category").isNull() | F.col("category").isin(*categories)
    unlisted = F.raise_error(F.concat(F.lit("unlisted category: "), "category")).cast("string")
    return F.when(known, F.col("category")).otherwise(unlisted)


def _wide_features(spend: DataFrame, categories: Sequence[str], *more: Column) -> DataFrame:
    """One row per customer of ``_amount`` by category; ``more`` are further aggregates to keep."""
    placed = [
        F.expr(f"coalesce(max(CAST(_amount AS double)) FILTER (WHERE category = '{c}'), 0D) "
               f"AS `{c}{SPEND_SUFFIX}`")
        for c in categories
    ]
    wide = spend.groupBy("customer_id").agg(*placed, F.sum("_amount").cast("double").alias("_total"), *more)
    return wide.select(
        "customer_id",
        *[f"`{c}{SPEND_SUFFIX}`" for c in categories],
        *[F.expr(f"try_divide(`{c}{SPEND_SUFFIX}`, _total) AS `{c}{PCT_SUFFIX}`") for c in categories],
        *wide.columns[len(categories) + 2:],
    )


def holdings(bought: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """``category_features`` with ``held``: the products of each customer, by category.

    Purchases are dealt by customer once and added up where they lie; a list holds each purchase row once,
    so its length is bounded by the catalog.
    """
    placed = bought.select("customer_id", _listed(categories).alias("category"), "product", "amount").repartition("customer_id")
    spend = placed.groupBy("customer_id", "category").agg(
        F.sum("amount").alias("_amount"), F.collect_list("product").alias("_products")
    )
    group = F.struct("category", F.col("_products").alias("products"))
    return _wide_features(spend, categories, F.collect_list(group).alias("held"))


def spend_array(categories: Sequence[str] = CATEGORIES) -> Column:
    return F.expr("array(" + ", ".join(f"`{c}{SPEND_SUFFIX}`" for c in categories) + ")")


def ranked_categories(categories: Sequence[str] = CATEGORIES) -> Column:
    """All categories of a wide row by descending spend, ties by name."""
    entries = ", ".join(
        f"struct(-`{c}{SPEND_SUFFIX}` AS below, '{c}' AS category)" for c in categories
    )
    return F.expr(f"sort_array(array({entries})).category")


def spend_norm(categories: Sequence[str] = CATEGORIES) -> Column:
    """Length of the spend vector, added up in category order."""
    return F.sqrt(F.aggregate(spend_array(categories), F.lit(0.0), lambda total, x: total + x * x))


def top_category(features: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    return features.select("customer_id", ranked_categories(categories)[0].alias("top_category"))


def _list_of(wanted: Column) -> Column:
    return joined(F.array_sort(F.collect_list(F.when(wanted, F.col("product")))))


def latest_order(transactions: DataFrame) -> DataFrame:
    """Id and date of each customer's latest order; of two on one date, the higher id."""
    key = F.struct("order_date", "transaction_id")
    return transactions.groupBy("customer_id").agg(F.max(key).alias("_last")).select(
        "customer_id",
        F.col("_last.order_date").alias("last_date"),
        F.col("_last.transaction_id").alias("transaction_id"),
    )


def latest_open_lines(spark: SparkSession, folder: str, orders: DataFrame) -> DataFrame:
    """Customer, product and category of the open lines of each customer's latest order, each once.

    Lines meet the latest orders before products are looked up, so only lines of those are joined.
    """
    latest = latest_order(orders).select("customer_id", "transaction_id")
    return (
        star(spark, folder, "lineitem")
        .filter(F.col("l_linestatus") == "O")
        .join(latest, F.col("l_orderkey") == F.col("transaction_id"))
        .join(star(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select("customer_id", _product().alias("product"), _category().alias("category"))
        .repartition("customer_id")
        .distinct()
    )


def carts(open_items: DataFrame, features: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Open items of each customer's latest order (``latest_open_lines``), split by the customer's top category."""
    top = top_category(features, categories)
    same = F.col("category") == F.col("top_category")
    return (
        open_items.join(top, "customer_id")
        .groupBy("customer_id")
        .agg(
            _list_of(same).alias("in_cart_same_category"),
            _list_of(~same).alias("in_cart_other_category"),
        )
    )


def transactions(
    spark: SparkSession, folder: str, anchor: str = ANCHOR, features: DataFrame | None = None,
    categories: Sequence[str] = CATEGORIES,
) -> DataFrame:
    """One row per order, with days since the customer's last visit and the cart lists.

    ``features`` saves building the category features where the caller has them.
    """
    if features is None:
        features = category_features(bought_products(spark, folder), categories)
    orders = plain_orders(spark, folder)
    visits = orders.groupBy("customer_id").agg(
        F.datediff(F.lit(anchor).cast("date"), F.max("order_date")).alias("days_since_last_visit")
    )
    baskets = carts(latest_open_lines(spark, folder, orders), features, categories)
    people = customer_places(spark, folder).join(visits, "customer_id").join(baskets, "customer_id", "left")
    return orders.join(people, "customer_id").select(
        "transaction_id", "customer_id", "name", "gender", "region", "state", "city_name",
        "mode_of_payment", "total_spent", "order_date", "order_quarter", "days_since_last_visit",
        "in_cart_same_category", "in_cart_other_category",
    )


def predictions(
    spark: SparkSession, folder: str, categories: Sequence[str] = CATEGORIES, bought: DataFrame | None = None,
    features: DataFrame | None = None,
) -> DataFrame:
    """One row per customer and product bought, with a propensity and a similarity.

    Propensity is the pair's amount over the customer's largest; similarity is the cosine between
    the customer's category spend and the product's category. Everything known per customer is
    joined to one row first and meets the pairs in a single join, which deals them by customer at every
    size, as the tables they go on to are stored and joined by it. ``bought`` and ``features`` save
    building them where the caller has them.
    """
    bought = bought_products(spark, folder) if bought is None else bought
    features = category_features(bought, categories) if features is None else features
    pairs = bought.withColumn("amount", F.col("amount").cast("double"))
    largest = pairs.groupBy("customer_id").agg(F.max("amount").alias("_largest"))
    spent = plain_orders(spark, folder).groupBy("customer_id").agg(
        money_sum("total_spent").alias("total_spent"),
        F.count(F.lit(1)).alias("total_transactions"),
    )
    names = F.lit(list(categories))
    vectors = features.select(
        "customer_id",
        F.map_from_arrays(names, spend_array(categories)).alias("_spend"),
        spend_norm(categories).alias("_norm"),
    )
    people = customer_places(spark, folder).select(
        "customer_id", "region", F.col("city_name").alias("city"), "gender"
    )
    facts = largest.join(spent, "customer_id").join(vectors, "customer_id").join(people, "customer_id")
    similarity = F.try_divide(F.try_element_at("_spend", F.col("category")), F.col("_norm"))
    return pairs.join(facts.hint("merge"), "customer_id").select(
        "customer_id", "product", "category",
        F.try_divide("amount", "_largest").alias("propensity_score"),
        similarity.alias("embedding_similarity"),
        "total_spent", "total_transactions", "region", "city", "gender", "price_inr",
    )


def profiles(features: DataFrame, depth: int = 1, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Unit spend vectors for matching; a block holds customers with the same ``depth`` top categories."""
    unit = F.transform("spend", lambda s: F.coalesce(F.try_divide(s, F.col("norm")), F.lit(0.0)))
    ranked = features.select(
        F.col("customer_id").alias("id"),
        ranked_categories(categories).alias("ranked"),
        spend_array(categories).alias("spend"),
        spend_norm(categories).alias("norm"),
    )
    return ranked.select(
        "id",
        F.array_join(F.slice("ranked", 1, depth), "|").alias("block"),
        F.array_join(F.slice("ranked", 1, 3), "|").alias("near"),
        unit.alias("vector"),
    )


def customer_matches(
    features: DataFrame, depth: int = 1, categories: Sequence[str] = CATEGORIES, exact: bool = True
) -> DataFrame:
    """Most similar other customer among those with the same ``depth`` top categories.

    Similarity is the cosine of category spend, to nine decimals; the lower id wins a tie. All customers
    of a block are compared (``best_matches``), in cells of bounded size. ``exact=False`` is a cheaper
    search that looks only at neighbours along fixed lines (``projected_matches``) and misses better ones.
    """
    vectors = profiles(features, depth, categories)
    search = best_matches if exact else projected_matches
    return search(vectors, len(categories)).select(
        F.col("id").alias("customer_id"),
        F.col("match").alias("Matched_Customer_ID"),
        F.col("similarity").alias("Similarity_Score"),
    )


def recommended_items(
    matches: DataFrame, bought: DataFrame, features: DataFrame, categories: Sequence[str] = CATEGORIES
) -> DataFrame:
    """The matched customer's products the customer has not bought, one row each.

    ``same`` tells whether the product is of the customer's own top category. Purchases stored in buckets of
    the customer are not moved: the matches come to them by the matched customer, as rows without products,
    and only what is offered goes on to the customer. A customer many others are matched to is then read once,
    but the rows matched to it are made in one task; otherwise adaptive execution splits that hot key.
    A customer's own products meet the offers as one list, at most the catalog.
    """
    theirs = bought.select(F.col("customer_id").alias("Matched_Customer_ID"), "product", "category")
    own = bought.groupBy("customer_id").agg(F.collect_set("product").alias("_own"))
    top = top_category(features, categories)
    # The planner takes a list for a few bytes and would broadcast all of them.
    offered = matches.join(top, "customer_id").join(theirs.hint("merge"), "Matched_Customer_ID")
    known = F.coalesce(F.array_contains("_own", F.col("product")), F.lit(False))
    return offered.join(own.hint("merge"), "customer_id", "left").where(~known).select(
        "customer_id", "product", (F.col("category") == F.col("top_category")).alias("same")
    )


def shared_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases per customer and product, built and written once, in buckets of the customer.

    All products of a customer lie in one bucket; they are as many as the catalog has at most. Amounts are
    written before products are looked up, so the lines' shuffle files are gone when the names are dealt.
    """
    parts = written_once(bought_parts(spark, folder), "parts")
    bought = written_once(bought_products(spark, folder, parts).repartition("customer_id"), "bought", "customer_id")
    dropped(parts)
    return bought


def shared_inputs(spark: SparkSession, folder: str, categories: Sequence[str] = CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """Purchases per customer and product, and category features, each built and written once, in the same buckets."""
    bought = shared_purchases(spark, folder)
    return bought, written_once(category_features(bought, categories), "features", "customer_id")


def shared_holdings(spark: SparkSession, folder: str, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Category features and products per customer, built and written once, in buckets of the customer."""
    return written_once(holdings(bought_products(spark, folder), categories), "holdings", "customer_id")


def _without(items: Column, own: Column) -> Column:
    """``items`` that are not in ``own``; an item that comes twice stays twice."""
    once = F.size(F.array_distinct(items)) == F.size(items)
    return F.when(once, F.array_except(items, own)).otherwise(F.filter(items, lambda x: ~F.array_contains(own, x)))


def customer_recs(
    spark: SparkSession, folder: str, matches: DataFrame | None = None, anchor: str = ANCHOR, held: DataFrame | None = None,
    categories: Sequence[str] = CATEGORIES,
) -> DataFrame:
    """One row per customer: place, spend, lists of purchases and carts, match, recommendations.

    A list column holds each product once, so its length is bounded by the catalog. ``held`` saves building
    ``holdings`` where the caller has them; ``matches`` has one row per customer. The recommendations are
    those of ``recommended_items``, taken from whole lists: the matched customer's list is sent to the
    customer once, and no purchase row is sent again. Lists stored in buckets of the customer are not moved
    to meet the matches: these come to them by the matched customer as rows without lists. A customer many
    others are matched to is then read once, but the rows matched to it are made in one task.
    """
    orders = plain_orders(spark, folder)
    if held is None:
        held = shared_holdings(spark, folder, categories)
    if matches is None:
        matches = written_once(customer_matches(held, categories=categories), "matches")
    spent = orders.groupBy("customer_id").agg(
        money_sum("total_spent").alias("total_spent"),
        F.datediff(F.lit(anchor).cast("date"), F.max("order_date")).alias("days_since_last_visit"),
    )
    # The planner takes a list column for a few bytes and would broadcast whole tables of lists.
    own = held.select("customer_id", F.col("held").alias("_own")).hint("merge")
    theirs = held.select(F.col("customer_id").alias("Matched_Customer_ID"), F.col("held").alias("_theirs")).hint("merge")
    paired = matches.join(top_category(held, categories).withColumnRenamed("top_category", "_top"), "customer_id")
    joined_rows = (
        customer_places(spark, folder)
        .join(spent, "customer_id")
        .join(own, "customer_id", "left")
        .join(carts(latest_open_lines(spark, folder, orders), held, categories), "customer_id", "left")
        .join(paired.join(theirs, "Matched_Customer_ID", "left"), "customer_id", "left")
    )

    def offered(wanted: Callable[[Column], Column]) -> Column:
        groups = F.filter("_theirs", lambda x: wanted(x["category"] == F.col("_top")))
        return F.flatten(F.transform(groups, lambda x: x["products"]))

    lists = joined_rows.select(
        "*",
        F.flatten(F.transform("_own", lambda x: x["products"])).alias("_bought"),
        offered(lambda same: same).alias("_same"),
        offered(lambda same: ~same).alias("_other"),
    )
    return lists.select(
        "customer_id", "name", "gender", "state", "city_name", "total_spent", "days_since_last_visit",
        joined(F.array_sort("_bought")).alias("purchased_products_names"),
        "in_cart_same_category", "in_cart_other_category", "Matched_Customer_ID", "Similarity_Score",
        joined(F.array_sort(_without(F.col("_same"), F.col("_bought")))).alias("Predicted_Products_from_Same_Category"),
        joined(F.array_sort(_without(F.col("_other"), F.col("_bought")))).alias("Predicted_Products_from_Other_Categories"),
    )
