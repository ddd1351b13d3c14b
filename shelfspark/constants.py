"""Fixed values that must equal the reference's for right results.

FIXED VALUES — bin edges, labels, thresholds and defaults, stated as given.
"""

from __future__ import annotations

# --- fixed values: price tiers (right-closed bins; <=0 or null -> unknown) ---
PRICE_TIER_EDGES = [0.0, 500.0, 2000.0, 10000.0, float("inf")]
PRICE_TIER_LABELS = ["budget", "mid", "premium", "luxury"]

# --- fixed values: profile histogram edges and labels (right-closed) ---
PRICE_HIST_EDGES = [0.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0, 50000.0, float("inf")]
PRICE_HIST_LABELS = ["0-500", "500-1K", "1K-2K", "2K-5K", "5K-10K", "10K-50K", "50K+"]
RATING_HIST_EDGES = [0.0, 1.0, 2.0, 3.0, 4.0, 4.5, 5.01]
RATING_HIST_LABELS = ["0-1", "1-2", "2-3", "3-4", "4-4.5", "4.5-5"]
DISCOUNT_HIST_EDGES = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0, 90.0, 101.0]
DISCOUNT_HIST_LABELS = ["0-10%", "10-20%", "20-30%", "30-40%", "40-50%",
                        "50-60%", "60-70%", "70-80%", "80-90%", "90-100%"]

# --- fixed values: notebook revenue-by-discount bins ---
NB_DISCOUNT_EDGES = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 100.0]
NB_DISCOUNT_LABELS = ["0-10%", "10-20%", "20-30%", "30-40%", "40-50%", "50-60%", "60-100%"]

# --- fixed values: search, drift and model defaults ---
DEFAULT_TOP_K = 5
DEFAULT_SIMILARITY_THRESHOLD = 0.7
DEFAULT_DRIFT_THRESHOLD = 0.1
PSI_DRIFT_THRESHOLD = 0.2
PSI_HIGH = 0.25
PSI_MEDIUM = 0.1
PSI_BINS = 10
PSI_EPS = 0.001
PREDICTION_DRIFT_MAE_RISE = 0.5
CV_TARGET = 0.3
MIN_ROWS_FOR_RETRAIN = 100

# --- fixed values: column lists used by the profile and the model ---
CORRELATION_COLUMNS = [
    "actual_price", "discounted_price", "discount_percentage",
    "rating", "rating_count", "category_depth", "name_length",
    "description_length", "rating_count_log",
]
SUMMARY_NUMERIC_COLUMNS = ["actual_price", "discounted_price", "discount_percentage",
                           "rating", "rating_count"]
CATEGORICAL_FEATURES = ["main_category", "sub_category", "price_tier"]
NUMERIC_FEATURES = [
    "actual_price", "rating", "rating_count", "rating_count_log",
    "category_depth", "name_length", "description_length", "review_sentiment",
]
TARGET = "discount_percentage"
TOP_PRODUCT_METRICS = ["rating", "discount_percentage", "rating_count", "actual_price"]

# --- fixed values: scoring defaults for sparse request rows ---
SCORING_DEFAULTS = {
    "category_depth": 3,
    "name_length": 50,
    "description_length": 200,
    "review_sentiment": 0.5,
}

# --- fixed values: canonical column aliases (first alias present wins) ---
COLUMN_ALIASES = {
    "product_id": ["product_id", "productid", "id"],
    "product_name": ["product_name", "productname", "name", "title"],
    "category": ["category", "main_category", "category_name"],
    "actual_price": ["actual_price", "actualprice", "original_price", "price"],
    "discounted_price": ["discounted_price", "discountedprice", "sale_price"],
    "discount_percentage": ["discount_percentage", "discountpercentage", "discount"],
    "rating": ["rating", "ratings", "avg_rating", "average_rating"],
    "rating_count": ["rating_count", "ratingcount", "num_ratings"],
    "about_product": ["about_product", "description", "product_description"],
    "user_id": ["user_id", "userid"],
    "user_name": ["user_name", "username"],
    "review_id": ["review_id", "reviewid"],
    "review_title": ["review_title", "reviewtitle"],
    "review_content": ["review_content", "reviews", "review_text"],
    "img_link": ["img_link", "image_link", "image_url"],
    "product_link": ["product_link", "product_url", "url"],
}

# --- fixed values: extra stop words added for review term counts ---
DOMAIN_STOPWORDS = ["product", "amazon", "bought", "use", "item"]

# --- fixed values: request-latency histogram buckets (seconds) ---
LATENCY_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
# --- fixed values: alert rules (threshold, sustained minutes) ---
ERROR_RATE_ALERT = (0.1, 5)
P95_LATENCY_ALERT_SECONDS = (2.0, 5)
