from collections import Counter

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def most_rows():
    """Runs a DataFrame: the largest number of rows that a node of its plan put out."""

    def run(df):
        df._jdf.queryExecution().toRdd().count()
        plan = df._jdf.queryExecution().executedPlan()
        rows, todo = Counter(), [plan]
        while todo:
            node = todo.pop()
            name = node.nodeName()
            inner = node.executedPlan() if name.startswith("AdaptiveSparkPlan") else node.plan() if "QueryStage" in name else None
            if inner is not None:
                todo.append(inner)
            if node.metrics().contains("numOutputRows"):
                rows[name] = max(rows[name], node.metrics().apply("numOutputRows").value())
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
        assert max(rows.values()) > 0
        return max(rows.values())

    return run
