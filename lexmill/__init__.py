"""lexmill: a Spark-first engine for corpora of regulatory documents."""
