"""Bar analytics on Spark: panels of OHLCV-style bars from raw events to features, labels, splits, metrics and drift."""
