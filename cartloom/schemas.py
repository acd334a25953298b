"""Declared schemas; no reader infers one."""

from __future__ import annotations

ORDER = "id BIGINT, clientTel STRING, basket ARRAY<STRUCT<goodsId: BIGINT, quantity: DOUBLE>>"

ORDER_LINES = "id BIGINT, item BIGINT, quantity DOUBLE"

TILL_SALES = (
    "Date TIMESTAMP, receipt_number BIGINT, warehouse_number BIGINT, "
    "quantity DOUBLE, goodsId BIGINT, sum DOUBLE"
)

CATALOGUE = (
    "id BIGINT, name STRING, normalized_name STRING, tradeName STRING, "
    "medForm STRING, company_name STRING, atx STRING"
)

RULES_TEXT = (
    "antecedents STRING, consequents STRING, confidence DOUBLE, lift DOUBLE, support DOUBLE"
)

POPULAR = "item BIGINT, rank INT"

QUOTA = "api_key STRING, quota BIGINT, requests_done BIGINT"
