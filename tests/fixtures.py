"""Small literal tables."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from stallmark.operators.star import build_star
from stallmark.schemas import RAW_SCHEMAS


def raw(spark, **rows):
    """Raw tables from literal rows; a table that is not given is empty."""
    out = {}
    for name, schema in RAW_SCHEMAS.items():
        values = [tuple(row) for row in rows.get(name, [])]
        money = [i for i, f in enumerate(schema.fields) if f.dataType.typeName() == "decimal"]
        values = [tuple(Decimal(str(v)) if i in money and v is not None else v for i, v in enumerate(row))
                  for row in values]
        out[name] = spark.createDataFrame(values, schema)
    return out


def order(n, bought="2018-01-01 00:00:00", arrived="2018-01-05 00:00:00", promised="2018-01-10 00:00:00",
          status="delivered", customer=None):
    return (f"o{n}", customer or f"c{n}", status, bought, arrived, promised)


def item(n, number=1, price="10.00", product="p1", seller="s1", freight="1.00"):
    return (f"o{n}", number, product, seller, price, freight)


def review(n, score, rid=None, text="texto longo", title=None, created="2018-01-06 00:00:00"):
    return (rid or f"r{n}-{score}", f"o{n}", score, title, text, created)


def customer(n, person=None, city="x", state="SP"):
    return (f"c{n}", person or f"u{n}", city, state)


def star(spark, **rows):
    rows.setdefault("products", [("p1", "cat", 1.0, 1)])
    rows.setdefault("sellers", [("s1", "x", "SP")])
    rows.setdefault("customers", [customer(int(o[0][1:])) for o in rows.get("orders", [])])
    return build_star(raw(spark, **rows))


def labels(spark, *rows):
    return spark.createDataFrame(
        [(*row, "", "rules") for row in rows],
        "review_id string, order_id string, sentiment string, topic string, urgency string, summary_en string, provider string")


def ts(text):
    return datetime.fromisoformat(text)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
