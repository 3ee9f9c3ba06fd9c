import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "3", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
            # Tiny tables: compiling the generated code would take longer than running it.
            "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def people(spark):
    rows = [
        (1, "Alice", 25, 50000, "Engineering"), (2, "Bob", 30, 60000, "Marketing"), (3, "Charlie", 35, 70000, "Engineering"),
        (4, "Diana", 40, 80000, "Sales"), (5, "Eve", 45, 90000, "Marketing"),
    ]
    return spark.createDataFrame(rows, "id long, name string, age long, salary long, department string")


@pytest.fixture(scope="session")
def gaps(spark):
    rows = [(1, 10.0, "A"), (2, None, None), (3, 30.0, "C"), (4, None, "D"), (5, 50.0, None)]
    return spark.createDataFrame(rows, "id long, value double, category string")


def as_dict(df, key):
    """Rows by the value of a key column."""
    return {r[key]: r.asDict() for r in df.collect()}
