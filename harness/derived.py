"""Raw marketplace tables derived from order / line item / part / customer / supplier Parquet files.

The check data has no deliveries, payments or reviews. They are derived here row by row with whole-number
arithmetic on the keys, so any engine derives the same rows, and the number of rows follows the input.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.operators import star
from stallmark.operators.durable import keep
from stallmark.operators.labelling import label_reviews
from stallmark.schemas import LABEL_COLUMNS, MONEY
from stallmark.taxonomy import SENTIMENTS, TOPICS

# Review texts, one is chosen per review by its key.
PHRASES = [
    "Produto ótimo, chegou antes do prazo",
    "Ainda não recebi o meu pedido",
    "Veio errado, pedi azul e mandaram preto",
    "A peça chegou quebrada e amassada",
    "Demorou demais para chegar",
    "Não gostei da qualidade, material ruim",
    "Quero a devolução do dinheiro, o atendimento é péssimo",
    "Recomendo a loja, tudo certo",
    "Normal",
    "Excelente! Amei o produto, parabéns",
    "Não recomendo, me senti enganado",
    "Faltando um item na caixa",
    "Nunca chegou e ninguém responde",
    "O aparelho parou de funcionar no segundo dia",
    "Fora do prazo combinado",
    "Diferente da foto do anúncio",
    "Pedi reembolso e estou sem resposta",
    "Lindo, perfeito, nota 10",
    "Entrega dentro do esperado, ok",
    "Adorei, lindo, excelente, mas veio com defeito",
    "Recebi apenas uma unidade de três",
    "Péssimo, horrível, nunca mais compro",
    "Bom produto pelo preço",
    "Prazo não cumprido, que vergonha",
    "Mercadoria falsificada, não é original",
    "Gostaria de trocar, como faço a troca?",
    "Satisfeita com a compra, obrigada",
    "Chegou rápido, super rápido mesmo",
    "Cadê o produto que comprei?",
    "Sem comentários",
    "Embalagem danificada, porém o conteúdo está bom",
    "Tamanho errado e cor diferente",
]
PHRASE_STEP = 13

_TABLES = ("orders", "lineitem", "part", "customer", "supplier", "nation", "documents")


def _key(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _div(number: Column, by: int) -> Column:
    return F.call_function("div", number, F.lit(by).cast("bigint"))


def _money(hundredths: Column) -> Column:
    return (hundredths.cast("decimal(16,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def _timed_orders(orders: DataFrame) -> DataFrame:
    k, u, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    minutes = (k * 37) % 1440
    hours = _div(minutes, 60) + 24 + (k * 7919 + u * 31) % 720
    return orders.select(
        k.alias("k"), u.alias("u"), "o_orderstatus",
        F.timestamp_add("MINUTE", minutes.cast("int"), day).alias("purchased"),
        F.when((F.col("o_orderstatus") == "F") & (k % 97 != 0),
               F.timestamp_add("HOUR", hours.cast("int"), day)).alias("delivered"),
        F.timestamp_add("DAY", (18 + u % 9).cast("int"), day).alias("estimated"))


def read_input(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def derive_raw(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    src = {name: read_input(spark, path, name) for name in _TABLES}
    timed = _timed_orders(src["orders"])

    orders = timed.select(
        _key("o", F.col("k")).alias("order_id"),
        _key("c", F.col("k")).alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped").otherwise("processing").alias("order_status"),
        F.col("purchased").alias("order_purchase_timestamp"),
        F.col("delivered").alias("order_delivered_customer_date"),
        F.col("estimated").alias("order_estimated_delivery_date"))

    # A line number that occurs more than once in an order is one item with the summed price.
    price = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    freight = _div(price * F.rint(F.col("l_tax") * 100).cast("bigint"), 100)
    lines = src["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"),
        F.sum(price).alias("price"), F.sum(freight).alias("freight"))
    items = lines.select(
        _key("o", F.col("l_orderkey")).alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        _key("p", F.col("part")).alias("product_id"),
        _key("s", F.col("supp")).alias("seller_id"),
        _money(F.col("price")).alias("price"),
        _money(F.col("freight")).alias("freight_value"))

    payments = (src["lineitem"].groupBy("l_orderkey", "l_returnflag")
                .agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(price).alias("value"))
                .select(
                    _key("o", F.col("l_orderkey")).alias("order_id"),
                    F.when(F.col("l_returnflag") == "R", "boleto")
                    .when(F.col("l_returnflag") == "A", "credit_card").otherwise("voucher").alias("payment_type"),
                    F.col("n").alias("payment_installments"),
                    _money(F.col("value")).alias("payment_value")))

    people = (src["customer"].join(src["nation"], F.col("c_nationkey") == F.col("n_nationkey"), "left")
              .select("c_custkey", "c_mktsegment", "n_name"))
    customers = (src["orders"].join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
                 .select(
                     _key("c", F.col("o_orderkey")).alias("customer_id"),
                     _key("u", F.col("o_custkey")).alias("customer_unique_id"),
                     F.col("c_mktsegment").alias("customer_city"),
                     F.col("n_name").alias("customer_state")))

    products = src["part"].select(
        _key("p", F.col("p_partkey")).alias("product_id"),
        F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand")).alias("product_category_name"),
        F.col("p_size").cast("double").alias("product_weight_g"),
        (F.col("p_partkey") % 6).cast("int").alias("product_photos_qty"))
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    translation = (src["part"].filter(brand % 3 != 0).select("p_brand").distinct()
                   .select(F.col("p_brand").alias("product_category_name"),
                           F.concat(F.lit("category_"), brand.cast("string")).alias("product_category_name_english")))

    sellers = (src["supplier"].join(src["nation"], F.col("s_nationkey") == F.col("n_nationkey"), "left")
               .select(
                   _key("s", F.col("s_suppkey")).alias("seller_id"),
                   _key("city_", F.col("s_suppkey") % 10).alias("seller_city"),
                   F.col("n_name").alias("seller_state")))

    return {
        "orders": orders, "items": items, "payments": payments, "customers": customers,
        "products": products, "translation": translation, "sellers": sellers,
        "reviews": _reviews(timed, src["documents"]),
    }


def _reviews(timed: DataFrame, documents: DataFrame) -> DataFrame:
    """Most orders have one review, some a second one, some an exact copy, some share a review id.

    An order whose number is that of a document gets the whole document appended to its review text.
    """
    k, copy = F.col("k"), F.col("copy")
    written = timed.join(documents.select(F.col("doc_id").alias("k"), "text"), "k", "left")
    copies = written.withColumn("copy", F.explode(F.array_compact(F.array(
        F.when(k % 50 != 0, F.lit(1)), F.when(k % 41 == 0, F.lit(2)), F.when(k % 97 == 0, F.lit(3))))))
    second = copy == 2
    late = F.coalesce(F.col("delivered") > F.col("estimated"), F.lit(False))
    score = (F.when(k % 131 == 0, F.lit(None))
             .when(second, 1 + k % 5)
             .when(late, 1 + (k * 7919) % 3)
             .otherwise(5 - _div((k * 31) % 10, 3)))
    phrase = _pick(PHRASES, (k * PHRASE_STEP + F.when(second, 5).otherwise(0)) % len(PHRASES))
    full = F.when(F.col("text").isNotNull() & ~second, F.concat(phrase, F.lit(" "), F.col("text"))).otherwise(phrase)
    message = (F.when(k % 7 == 3, F.lit(None))
               .when(k % 101 == 0, F.lit("  \n"))
               .when(k % 11 == 5, F.concat(F.lit("\n "), full, F.lit(" \t")))
               .otherwise(full))
    return copies.select(
        F.when(second, _key("x", k)).when(k % 211 == 0, _key("r", k - 1)).otherwise(_key("r", k)).alias("review_id"),
        _key("o", k).alias("order_id"),
        score.cast("int").alias("review_score"),
        F.when(k % 3 == 0, F.lit(" Avaliação ")).when(k % 3 == 1, F.lit(" ")).alias("review_comment_title"),
        message.alias("review_comment_message"),
        F.timestamp_add("DAY", F.lit(1), F.coalesce("delivered", "purchased")).alias("review_creation_date"))


def order_number(order_id: Column) -> Column:
    return F.substring(order_id, 2, 20).cast("bigint")


def derive_labels(reviews: DataFrame) -> DataFrame:
    """Labels of two sources: the word rules, and a second opinion that differs on every seventh order."""
    ruled = label_reviews(reviews.filter(F.length("comment_message") >= 5)).select(*LABEL_COLUMNS)
    n = order_number(F.col("order_id"))
    other = n % 7 == 0
    source = F.explode(F.array(F.lit("rules"), F.lit("ollama"))).alias("provider")
    both = ruled.select(*[c for c in LABEL_COLUMNS if c != "provider"], source)
    swap = other & (F.col("provider") == "ollama")
    return both.select(
        "review_id", "order_id",
        F.when(swap, _pick(SENTIMENTS, n % 3)).otherwise(F.col("sentiment")).alias("sentiment"),
        F.when(swap, _pick(TOPICS, n % 8)).otherwise(F.col("topic")).alias("topic"),
        "urgency",
        F.when(F.col("provider") == "ollama", F.concat(F.lit("about "), "topic")).otherwise(F.col("summary_en"))
        .alias("summary_en"),
        "provider")


def derive_gold(spark: SparkSession, path: str, reviews: DataFrame) -> DataFrame:
    """Reviews of orders that have a human label in ``labels``; the human view differs from the rules there.

    ``gold_no`` is the order of the rows.
    """
    human = read_input(spark, path, "labels").select(
        _key("o", F.col("doc_id")).alias("order_id"), "doc_id", "quality", "toxic")
    ruled = label_reviews(reviews.filter(F.length("comment_message") >= 5).join(human, "order_id"))
    n = F.col("doc_id")
    return ruled.select(
        "review_id", "order_id", "review_score", "comment_message",
        F.when(F.col("toxic") == 1, F.lit("negative")).when(n % 5 == 0, _pick(SENTIMENTS, n % 3))
        .otherwise(F.col("sentiment")).alias("gold_sentiment"),
        F.when(F.col("quality") == 0, _pick(TOPICS, (n + 3) % 8)).otherwise(F.col("topic")).alias("gold_topic"),
        n.alias("gold_no"))


def derive_star(spark: SparkSession, path: str, labels: bool = True) -> dict[str, DataFrame]:
    """The star; with labels, reviews and labels are kept, so that texts are searched once however often they are read."""
    tables = star.build_star(derive_raw(spark, path))
    if labels:
        tables["fact_reviews"] = keep(tables["fact_reviews"])
        tables["review_ai_labels"] = keep(derive_labels(tables["fact_reviews"]).filter(F.col("provider") == "rules"))
    return tables


def kept_star(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The star with labels, each table derived once: for plans that read it several times."""
    tables = derive_star(spark, path)
    return {name: df if name in ("fact_reviews", "review_ai_labels") else keep(df) for name, df in tables.items()}
