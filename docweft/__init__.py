"""docweft: a Spark-first engine for structured documents."""
