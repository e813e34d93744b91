"""Explicit schemas of the driver tables and of the message payloads."""

from __future__ import annotations

RAW = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
              " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
                " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING,"
                " l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}

INTERACTION = "user_id STRING, item_id STRING, rating DOUBLE, ts TIMESTAMP, weight DOUBLE"

ENVELOPE = "topic STRING, key STRING, value STRING, timestamp TIMESTAMP"

PAYLOADS = {
    "user-events": "user_id STRING, event_type STRING, item_id STRING, category_id STRING, price DOUBLE,"
                   " timestamp DOUBLE, session_id STRING, _corrupt_record STRING",
    "purchases": "user_id STRING, item_ids ARRAY<STRING>, total_amount DOUBLE, timestamp DOUBLE,"
                 " _corrupt_record STRING",
    "inventory-updates": "item_id STRING, inventory BIGINT, timestamp DOUBLE, _corrupt_record STRING",
    "embedding-updates": "item_id STRING, embedding ARRAY<DOUBLE>, timestamp DOUBLE, _corrupt_record STRING",
    "cache-invalidation": "key STRING, timestamp DOUBLE, _corrupt_record STRING",
    "fraud-alerts": "seller_id STRING, probability DOUBLE, timestamp DOUBLE, _corrupt_record STRING",
}

EVENT_TYPES = ["view", "click", "purchase", "add_to_cart", "return"]
SURFACES = ["homepage", "product_detail", "cart", "post_purchase"]
