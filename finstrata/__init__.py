"""finstrata: a Spark-first analytics engine for market and filing data."""
