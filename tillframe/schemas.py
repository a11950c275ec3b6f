"""Declared schemas: of the generated retail tables, and of what counts as valid in them."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_TS, _DATE, _MONEY = T.TimestampNTZType(), T.DateType(), T.DecimalType(18, 2)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


ITEM = _table(product_id=_L, qty=_I, unit_price=_MONEY, discount=_D)

TABLES: dict[str, T.StructType] = {
    "customers": _table(customer_id=_L, name=_S, region_id=_I, segment=_S, signup_date=_DATE),
    "orders": _table(order_id=_L, customer_id=_L, store_id=_L, payment_method_id=_I, order_ts=_TS, status=_S, items=T.ArrayType(ITEM)),
    "products": _table(product_id=_L, name=_S, category_id=_I, unit_price=_MONEY, unit_cost=_MONEY),
    "stores": _table(store_id=_L, name=_S, region_id=_I, opened_date=_DATE),
    "regions": _table(region_id=_I, name=_S, parent_region_id=_I),
    "returns": _table(return_id=_L, order_id=_L, product_id=_L, return_ts=_TS, qty=_I, reason=_S),
    "discounts": _table(discount_id=_I, code=_S, pct=_D, start_date=_DATE, end_date=_DATE),
    "shipping": _table(order_id=_L, ship_ts=_TS, delivered_ts=_TS, carrier=_S, cost=_MONEY),
    "categories": _table(category_id=_I, name=_S, parent_id=_I),
    "payment_methods": _table(payment_method_id=_I, name=_S),
    "time_dimension": _table(date_key=_I, date=_DATE, year=_I, quarter=_I, month=_I, week=_I, dow=_I, is_weekend=T.BooleanType(), is_holiday=T.BooleanType()),
}
