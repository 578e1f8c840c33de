import os

import pytest

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from looseleaf.functions.variants import session

    root = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(root / "warehouse"),
            "spark.checkpoint.dir": f"file://{root}/shared", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
