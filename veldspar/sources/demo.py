"""Two seeded demo shops of nine tables each, made by column expressions: the same seed gives the same rows, on any cluster.

Shop A has plain names, dates without times and no nulls; shop B has prefixed names, ordered times per order, real nulls
(an order that isn't shipped has no dates of its shipping) and skewed statuses and scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declared keys of shop A: (table, column, parent table, parent column); B has the same with its prefix.
EDGES = [
    ("orders", "customer_id", "customers", "customer_id"), ("order_items", "order_id", "orders", "order_id"), ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"), ("order_payments", "order_id", "orders", "order_id"), ("order_reviews", "order_id", "orders", "order_id"),
]
KEYS = {"customers": ("customer_id",), "sellers": ("seller_id",), "products": ("product_id",), "orders": ("order_id",), "order_items": ("order_id", "order_item_id"), "order_payments": ("order_id", "payment_sequential"), "order_reviews": ("review_id",)}
_A = {"customers": 100, "sellers": 30, "products": 50, "orders": 200, "geolocation": 50}
_B = {"customers": 500, "sellers": 100, "products": 300, "orders": 1000, "geolocation": 10}
_PLACES = [("Lisbon", "LI", 38.7, -9.1), ("Porto", "PO", 41.1, -8.6), ("Braga", "BR", 41.5, -8.4), ("Coimbra", "CO", 40.2, -8.4), ("Faro", "FA", 37.0, -7.9)]
_GOODS = [("ferramentas", "tools"), ("livros", "books"), ("brinquedos", "toys"), ("jardim", "garden"), ("cozinha", "kitchen"), ("desporto", "sports"), ("roupa", "clothing")]
_PAID = ("card", "transfer", "voucher", "cash")
_SAID = ("Arrived in time.", "Just as described.", "Took long.", "Broken on arrival.", None, None)


class _Draws:
    """Values from hashes of (seed, stream, row), so rows don't depend on partitions."""

    def __init__(self, seed: int):
        self.seed, self.stream = seed, 0

    def share(self, *of: str) -> Column:
        self.stream += 1
        return F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit(self.stream), *of), 11).cast("double") * F.lit(2.0**-53)

    def whole(self, lo: int, hi: int, *of: str) -> Column:
        return (F.floor(self.share(*of) * (hi - lo + 1)) + lo).cast("int")

    def real(self, lo: float, hi: float, digits: int, *of: str) -> Column:
        return F.round(self.share(*of) * (hi - lo) + lo, digits)

    def one_of(self, values, *of: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), self.whole(1, len(values), *of))

    def key(self, kind: str, number: Column) -> Column:
        return F.md5(F.concat(F.lit(f"{self.seed}{kind}"), number.cast("string")).cast("binary"))

    def day(self, *of: str) -> Column:
        return F.date_add(F.lit("2024-01-01").cast("date"), self.whole(0, 365, *of)).cast("string")


def _place(d: _Draws, prefix: str, zip_name: str, *of: str) -> list[Column]:
    at = d.whole(1, len(_PLACES), *of)
    pick = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in _PLACES]), at)
    return [d.whole(10_000, 99_999, *of).cast("string").alias(f"{prefix}_{zip_name}"), pick(0).alias(f"{prefix}_city"), pick(1).alias(f"{prefix}_state")]


def shop(spark: SparkSession, kind: str = "a", seed: int = 42, scale: int = 1) -> dict[str, DataFrame]:
    """The nine tables of shop a or b; scale multiplies customers, sellers, products and orders."""
    if kind not in ("a", "b"):
        raise ValueError("a shop is a or b")
    b, d = kind == "b", _Draws(seed)
    n = {t: (k if t == "geolocation" else k * scale) for t, k in (_B if b else _A).items()}
    zip_name = "zip_code_prefix" if b else "zip_code"
    rows = lambda t: spark.range(n[t])
    customers = rows("customers").select(d.key("customer", F.col("id")).alias("customer_id"), d.key("person", F.col("id")).alias("customer_unique_id"), *_place(d, "customer", zip_name, "id"))
    sellers = rows("sellers").select(d.key("seller", F.col("id")).alias("seller_id"), *_place(d, "seller", zip_name, "id"))
    products = rows("products").select(
        d.key("product", F.col("id")).alias("product_id"), d.one_of([g[0 if b else 1] for g in _GOODS], "id").alias("product_category_name"), d.whole(10, 60, "id").alias("product_name_length"), d.whole(100, 900, "id").alias("product_description_length"),
        d.whole(1, 6, "id").alias("product_photos_qty"), d.real(100, 5000, 1, "id").alias("product_weight_g"), d.real(10, 100, 1, "id").alias("product_length_cm"), d.real(5, 50, 1, "id").alias("product_height_cm"), d.real(5, 50, 1, "id").alias("product_width_cm"),
    )
    status = d.one_of(("delivered", "delivered", "delivered", "shipped", "processing", "canceled") if b else ("delivered", "shipped", "processing", "canceled"), "id").alias("order_status")
    orders = rows("orders").select("id", d.key("order", F.col("id")).alias("order_id"), d.key("customer", d.whole(0, n["customers"] - 1, "id")).alias("customer_id"), status)
    names = ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date")
    if b:
        bought = F.timestamp_seconds(F.lit(1_672_531_200) + d.whole(0, 63_000_000, "id"))
        later = lambda t, seconds: F.timestamp_seconds(F.unix_timestamp(t) + seconds)
        approved = later(bought, d.whole(3600, 86_400, "id"))
        carried = F.when(F.col("order_status").isin("delivered", "shipped"), later(approved, d.whole(86_400, 432_000, "id")))
        given = F.when(F.col("order_status") == "delivered", later(carried, d.whole(86_400, 864_000, "id")))
        dates = [bought, approved, carried, given, later(bought, d.whole(604_800, 2_592_000, "id"))]
        orders = orders.select("id", "order_id", "customer_id", "order_status", *[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(x) for c, x in zip(dates, names)])
    else:
        orders = orders.select("id", "order_id", "customer_id", "order_status", *[d.day("id").alias(x) for x in names])
    items = rows("orders").withColumn("order_item_id", F.explode(F.sequence(F.lit(1), d.whole(1, 5 if b else 3, "id"))))
    of = ("id", "order_item_id")
    items = items.select(d.key("order", F.col("id")).alias("order_id"), "order_item_id", d.key("product", d.whole(0, n["products"] - 1, *of)).alias("product_id"), d.key("seller", d.whole(0, n["sellers"] - 1, *of)).alias("seller_id"), d.day(*of).alias("shipping_limit_date"), d.real(20, 500, 2, *of).alias("price"), d.real(10, 100, 2, *of).alias("freight_value"))
    parts = F.when(d.share("id") < (0.1 if b else 0.0), 2).otherwise(1)
    payments = rows("orders").withColumn("payment_sequential", F.explode(F.sequence(F.lit(1), parts)))
    of = ("id", "payment_sequential")
    payments = payments.select(d.key("order", F.col("id")).alias("order_id"), "payment_sequential", d.one_of(_PAID, *of).alias("payment_type"), d.whole(1, 12, *of).alias("payment_installments"), d.real(50, 1000, 2, *of).alias("payment_value"))
    score = F.least(F.lit(5), d.whole(1, 5, "id") + d.whole(0, 2, "id")) if b else d.whole(1, 5, "id")
    said = d.one_of(_SAID, "id") if b else F.lit("")
    reviews = rows("orders").filter(d.share("id") < (0.8 if b else 0.7)).select(
        d.key("review", F.col("id")).alias("review_id"), d.key("order", F.col("id")).alias("order_id"), score.alias("review_score"), (F.when(said.isNotNull(), F.split(said, " ")[0]) if b else said).alias("review_comment_title"),
        said.alias("review_comment_message"), d.day("id").alias("review_creation_date"), d.day("id").alias("review_answer_timestamp"),
    )
    at = d.whole(1, len(_PLACES), "id")
    place = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in _PLACES]), at)
    geolocation = rows("geolocation").select(d.whole(10_000, 99_999, "id").cast("string").alias(f"geolocation_{zip_name}"), F.round(place(2) + d.real(-0.1, 0.1, 6, "id"), 6).alias("geolocation_lat"), F.round(place(3) + d.real(-0.1, 0.1, 6, "id"), 6).alias("geolocation_lng"), place(0).alias("geolocation_city"), place(1).alias("geolocation_state"))
    category = spark.createDataFrame([(g[0 if b else 1], g[1] if b else g[1].title()) for g in _GOODS], "product_category_name string, product_category_name_english string")
    tables = {"customers": customers, "sellers": sellers, "products": products, "orders": orders.drop("id"), "order_items": items, "order_payments": payments, "order_reviews": reviews, "geolocation": geolocation}
    if not b:
        return tables | {"product_category": category}
    return {f"shop_{t}": df for t, df in tables.items()} | {"product_category_name_translation": category}


def keys(kind: str = "a") -> tuple[dict[str, tuple[str, ...]], list[tuple[str, str, str, str]]]:
    """Primary keys and edges of a shop."""
    if kind == "a":
        return KEYS | {"product_category": ("product_category_name",)}, EDGES
    name = lambda t: f"shop_{t}"
    link = ("shop_products", "product_category_name", "product_category_name_translation", "product_category_name")
    return {name(t): k for t, k in KEYS.items()} | {"product_category_name_translation": ("product_category_name",)}, [(name(t), c, name(p), k) for t, c, p, k in EDGES] + [link]
