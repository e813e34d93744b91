"""Operator defaults. Every operator takes them as keyword arguments."""

from __future__ import annotations

# Published defaults of the operators.
DEFAULT_TOP_K = 50
MAX_TOP_K = 200
HALF_LIFE_DAYS = 14
RING_BUCKETS = 8760

RETURN_RATE_THRESHOLD = 0.02
REGRET_LAMBDA = 0.3
REGRET_MIN_PURCHASES = 10
REGRET_FLOOR = 0.1
RETURN_WINDOW_DAYS = 90

INJECT_EVERY = 7
INJECT_FACTOR = 0.9
DISCOVERY_DISTANCE = 0.6
DISCOVERY_TARGET = 0.15
DISCOVERY_POOL = 50

TASTE_SIMILARITY = 0.80
DIVERGENCE_THRESHOLD = 0.25
DIVERGENCE_WINDOW = 5
EVENT_CONFIDENCE = 0.6

FRAUD_SUSPECT = 0.75
FRAUD_DEMOTION = 0.1
IP_OVERLAP = 0.8
TIMING_CORRELATION = 0.9

BANDIT_ALPHA = 1.0
BANDIT_WARM = 50
BANDIT_FEATURES = [
    "hour_of_day", "day_of_week", "is_weekend", "device_type", "is_new_user", "referrer_type",
]

NEGATIVES_PER_USER = 100
SEQUENCE_LENGTH = 50
SAFETY_DAYS = 7
FORECAST_DAYS = 30
NEIGHBORS_PER_HOP = 50
SUBGRAPH_SAMPLES = 20
SHARDS = 128
VIRTUAL_NODES = 100
REPLICAS = 3
TEMPERATURE = 0.05
LINK_MARGIN = 0.5
SHADOW_RATIO = 0.05

TTL_SECONDS = {"default": 300, "user": 86400, "item": 3600, "recs": 60}
TOPICS = [
    "user-events", "purchases", "inventory-updates", "embedding-updates",
    "cache-invalidation", "fraud-alerts",
]
