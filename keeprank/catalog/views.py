"""DuckDB text of the domain tables, used only by the checking SQL."""

VIEWS = {
    "items": """
SELECT p_partkey AS item_id, p_name AS name, lower(p_type) AS category, p_brand AS brand,
       round(p_retailprice - 895, 2) AS price, round(1 + 4.0::DOUBLE * (p_size - 1) / 49, 1) AS rating,
       (p_partkey * 37) % 1001 AS inventory, p_partkey % (SELECT count(*) FROM supplier) AS seller_id
FROM part""",
    "items_with_reviews": """
SELECT i.*, coalesce(l.n, 0)::BIGINT AS review_count
FROM items i LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_partkey = i.item_id""",
    "users": """
SELECT c_custkey AS user_id, c_name AS name, lower(c_mktsegment) AS user_segment, c_nationkey AS ip_group,
       CASE WHEN c_acctbal < 2000 THEN 'high' WHEN c_acctbal < 6000 THEN 'medium' ELSE 'low' END AS price_sensitivity
FROM customer""",
    "purchases": """
SELECT o.o_custkey AS user_id, l.l_partkey AS item_id, l.l_suppkey AS seller_id, lower(p.p_type) AS category,
       l.l_extendedprice / 1000 AS price, l.l_quantity AS quantity, l.l_discount AS discount,
       o.o_orderdate AS purchase_ts, l.l_linenumber AS seq, o.o_orderkey AS order_id,
       l.l_returnflag = 'R' AS is_returned,
       CASE WHEN l.l_returnflag = 'R' THEN CAST(CAST(o.o_orderdate AS DATE) + (1 + l.l_linenumber * 5)::INT AS TIMESTAMP) END AS return_ts,
       CASE WHEN l.l_returnflag = 'R' THEN 1 + l.l_linenumber % 2 END AS regret_rating
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "interactions": """
SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id,
       CASE event_type WHEN 'error' THEN 'return' ELSE event_type END AS event_type,
       CASE event_type WHEN 'view' THEN 1.0::DOUBLE WHEN 'click' THEN 1.0::DOUBLE WHEN 'purchase' THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS rating,
       value AS price, ts
FROM events WHERE event_type <> 'signup'""",
    "item_vectors": """
SELECT vec_id AS item_id, embedding::DOUBLE[] AS embedding, concat('cat_', label::VARCHAR) AS category FROM embeddings""",
    "affinities": """
SELECT user_id, category, n, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS affinity
FROM (SELECT user_id, category, count(*) AS n FROM purchases GROUP BY ALL)""",
    "history": "SELECT DISTINCT user_id, item_id FROM purchases",
    "daily_units": """
SELECT item_id, CAST(ts AS DATE) AS day, count(*) AS units, avg(price) AS price
FROM interactions WHERE event_type <> 'return' GROUP BY ALL""",
    "reviews": """
SELECT pu.seller_id, pu.user_id, pu.item_id, pu.purchase_ts AS ts, i.rating, u.ip_group
FROM purchases pu JOIN items i ON pu.item_id = i.item_id JOIN users u ON pu.user_id = u.user_id""",
    "edges": """
SELECT concat('u:', user_id) AS src, concat('p:', item_id) AS dst, 'bought' AS edge_type, count(*)::DOUBLE AS weight, max(purchase_ts) AS ts
FROM purchases GROUP BY user_id, item_id
UNION ALL
SELECT concat('u:', user_id), concat('p:', item_id), 'returned', count(*)::DOUBLE, max(return_ts)
FROM purchases WHERE is_returned GROUP BY user_id, item_id
UNION ALL
SELECT concat('u:', user_id), concat('p:', item_id), 'viewed', count(*)::DOUBLE, max(ts)
FROM interactions WHERE event_type = 'view' GROUP BY user_id, item_id
UNION ALL
SELECT concat('s:', seller_id), concat('p:', item_id), 'sells', count(*)::DOUBLE, max(purchase_ts)
FROM purchases GROUP BY seller_id, item_id
UNION ALL
SELECT concat('p:', item_id), concat('c:', category), 'belongs_to', 1.0::DOUBLE, NULL::TIMESTAMP FROM items""",
    "seller_risk": """
SELECT seller_id, (sum(is_returned::INT)::DOUBLE / count(*)) AS probability FROM purchases GROUP BY seller_id""",
}
