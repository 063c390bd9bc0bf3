"""Arguments of the registered queries that depend on the check data: thresholds and periods."""

CATEGORY_ORDERS = 180
STATE_ORDERS = 190
SELLER_ORDERS = 145
TOPIC_REVIEWS = 5
PACK_CATEGORY_ORDERS = 150
FIRST, LAST = "1996-03", "2000-10"
YEAR = 1998
MONTH = "1999-05"
SAMPLE_ROWS = 2000
SEED = 42
