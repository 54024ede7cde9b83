import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def make_lines(spark):
    """Delivered lines (line_id, file_name, slug, batch_id, ingested_at, raw) of records or raw texts."""
    import json
    from datetime import datetime, timezone

    def make(rows, file_name="-p/s.jsonl"):
        data = []
        for i, r in enumerate(rows, 1):
            name, body = r if isinstance(r, tuple) else (file_name, r)
            raw = body if body is None or isinstance(body, str) else json.dumps(body)
            data.append((i, name, "-p", "b", datetime(2026, 1, 1, tzinfo=timezone.utc), raw))
        return spark.createDataFrame(data, "line_id bigint, file_name string, slug string, batch_id string, ingested_at timestamp, raw string")

    return make
