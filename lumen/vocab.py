"""Name vocabularies and thresholds that results must agree on."""

from __future__ import annotations

# Column names that mean an identifier, and endings that do.
ID_SUFFIXES = ["_id", "_uuid", "_key", "_code", "_no", "_seq", "id"]
ID_EXACT = ["id", "uuid", "index", "row_num", "row_id", "serial", "sequence", "record_id", "entry_id", "passengerid", "customerid", "userid", "accountid", "ticketnumber"]
ID_COMPACT = ["id", "uuid", "invoiceno", "stockcode"]

DATE_WORDS = ["date", "time", "timestamp", "datetime", "day", "month", "year", "hour", "minute", "second", "period", "epoch", "era", "calendar", "schedule", "deadline", "start", "end", "begin", "finish", "created", "updated", "modified", "published", "released", "birth", "death", "anniversary", "holiday", "event"]

# Names of targets, strong ones, usual ones and further ones; each list is whole, so some names repeat.
STRONG_TARGETS = ["target", "label", "y", "outcome", "prediction", "response", "dependent", "ground_truth"]
TARGETS = ["target", "label", "outcome", "result", "prediction", "y", "response", "dependent", "output", "class", "minutes", "hours", "quality", "score", "rating"]
MORE_TARGETS = ["charges", "cost", "price", "premium", "claim", "amount", "total", "payment", "fee", "expenditure", "spending", "revenue", "sales", "income", "salary", "wage", "earnings", "profit", "loss", "survived", "survival", "death", "mortality", "outcome", "result", "response", "label", "class", "category", "prediction", "forecast"]
# A single test for all of them.
ALL_TARGETS = [*STRONG_TARGETS, *TARGETS, *MORE_TARGETS]
CATEGORICAL_TARGETS = ["sentiment", "satisfaction", "churn", "status", "severity", "diagnosis", "rating", "class", "category", "segment", "quality"]
NEGATIVE = ["id", "uuid", "index", "row", "key", "code", "identifier", "serial", "numbering", "sequence", "order", "date", "timestamp", "created", "updated", "modified", "name", "email", "phone", "address", "location", "coordinates", "description", "note", "comment", "text", "message", "content", "url", "path", "file", "link", "reference", "source", "image", "photo", "video", "audio", "document", "attachment", "outlierflag", "outlier_flag", "outliers", "flag"]

PERCENTAGE_NAMES = ["percent", "percentage", "pct"]
PROBABILITY_NAMES = ["probability", "prob", "likelihood"]
COUNT_NAMES = ["count", "qty", "quantity", "num", "number_of", "total_count"]
AGE_NAMES = ["age"]
PRICE_NAMES = ["price", "fare", "cost", "fee", "amount", "charge", "payment", "revenue", "salary", "wage", "adr", "avg_daily_rate", "daily_rate", "room_rate", "unit_price", "list_price"]
LATITUDE_NAMES, LONGITUDE_NAMES = ["lat", "latitude"], ["lon", "lng", "longitude"]
AGGREGATE_NAMES = ["score", "index"]
WEEKDAY_NAMES = ["weekday", "dow"]
ORDERED_PAIRS = [("start", "end"), ("begin", "finish"), ("begin", "end"), ("from", "to"), ("min", "max"), ("lower", "upper"), ("first", "last"), ("earliest", "latest"), ("departure", "arrival"), ("checkin", "checkout"), ("check_in", "check_out"), ("opened", "closed"), ("created", "resolved")]

MISSING_TOKENS = ["?", "na", "n/a", "nan", "null", "missing", "not applicable", "n.a.", "n.a"]
SUPPRESSION_TOKENS = ["s", "suppressed", "suppression", "not available", "na (suppressed)", "withheld", "redacted", "masked"]
SENTINELS = ["nan", "<na>", "nat", "none", "null"]
BOOLEAN_WORDS = ["true", "false", "yes", "no", "on", "off"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
TITLES = {"Mr": "Mr", "Mrs": "Mrs", "Miss": "Miss", "Master": "Master", "Mlle": "Miss", "Ms": "Miss", "Mme": "Mrs", "Dr": "Officer", "Rev": "Officer", "Col": "Officer", "Major": "Officer", "Capt": "Officer", "Sir": "Royalty", "Lady": "Royalty", "Don": "Royalty", "Dona": "Royalty", "Countess": "Royalty", "Jonkheer": "Royalty"}

# Cleaning.
FILL_CAP, FILL_LIMIT, FILL_LEAST, DOMINANT, UNKNOWN = 0.50, 0.20, 10, 0.50, "Unknown"
DROP_SHARE = 0.50
DERIVED_SURE, DERIVED_SUSPECT, DERIVED_ROWS, DERIVED_OFFSETS, PRODUCT_SHARE, PRODUCT_NONZERO = 0.98, 0.90, 8, [-2, -1, 0, 1, 2], 0.95, 0.15
NEAR_CONSTANT, NEAR_CONSTANT_VALUES = 0.98, 5
NEAR_DUPLICATE, NEAR_DUPLICATE_HIGH = 0.02, 0.20
CO_MISSING_LIFT, MISSING_SUPPORT, MISSING_GAP = 3.0, 10, 0.30
UNIT_GAP, UNIT_SHARE, UNIT_LEAST = 2.0, 0.15, 8
SEPARATOR_DOMINANCE = 0.80
AGE_RANGE = (0, 130)
PLAUSIBLE_AGE, PLAUSIBLE_COUNT = 16, 3
SEMANTIC_ROWS, NO_RELATION, MUTUAL = 15, 0.05, 0.20

# Statistics.
OUTLIER_LEAST, OUTLIER_HIGH, OUTLIER_MEDIUM = 8, 10.0, 1.0
PAIR_ROWS, PAIR_ROWS_CATEGORICAL, PAIR_MISSING, PAIR_RATIO, PAIR_CATEGORIES, GROUP_ROWS = 10, 20, 0.30, 0.20, 100, 5
ID_RATIO, ID_ROWS = 0.98, 20
