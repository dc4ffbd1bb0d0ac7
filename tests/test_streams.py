"""Streams give what one batch gives, however the files lie."""

from docweft.streaming import jobs

KINDS = ["view", "view", "error", "purchase", "error", "view", "error", "error", "error", "view"]


def test_files_out_of_order(spark, tmp_path):
    """Files hold every third day, the latest first."""
    path = f"{tmp_path}/events.parquet"
    for rest in (2, 0, 1):
        days = [d for d in range(29, -1, -1) if d % 3 == rest]
        rows = [(10 * d + u, u, f"2024-01-{d + 1:02d} 0{u}:00:00", KINDS[(d * (u + 1)) % 10], 1.0) for d in days for u in range(3)]
        frame = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").selectExpr("event_id", "user_id", "cast(ts as timestamp) ts", "event_type", "value")
        frame.coalesce(1).write.mode("append").parquet(path)
    out = ["user_id", "event_id", "event_type"]
    makes = [
        (jobs.tumbling_counts, "update", ["w", "event_type"]),
        (lambda e: jobs.changes(e, "user_id", ["ts", "event_id"], "event_type", out, "user_id long, event_id long, event_type string"), "append", []),
        (jobs.retries, "update", ["user_id"]),
    ]
    for make, mode, key in makes:
        whole, apart = (sorted(map(str, jobs.collect_stream(make, spark, str(tmp_path), "events", mode, key, n).collect())) for n in (1000, 1))
        assert apart == whole
