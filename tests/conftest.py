import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp())
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


EDGE_SCHEMA = "interaction_id bigint, source_id string, source_type string, target_id string, target_type string, relation_type string, label int, source_dataset string, raw_score double, split_name string"


@pytest.fixture(scope="session")
def make_edges(spark):
    """Edges from (source, target) or dicts; further columns with names that operators use inside are added to clash with them."""

    def make(rows, **extra):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, dict) else dict(zip(("source_id", "target_id", "relation_type", "split_name"), r))
            base = {"interaction_id": i + 1, "source_type": "drug", "target_type": "protein", "relation_type": "interacts_with", "label": 1, "source_dataset": "bindingdb", "raw_score": None, "split_name": "train"}
            row = base | r
            full.append(tuple(row.get(c.split()[0]) for c in EDGE_SCHEMA.split(", ")))
        df = spark.createDataFrame(full, EDGE_SCHEMA)
        from pyspark.sql import functions as F

        for c in ("a", "b", "rel", "s", "t", "u", "v", "n", "label_2", "rank", "part", "ID", "k1"):
            df = df.withColumn(c, F.lit("clash"))
        return df

    return make
