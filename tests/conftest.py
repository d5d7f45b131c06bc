import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from evenhand.session import local_session

    return local_session("tests", cpus=4, memory="4g")


@pytest.fixture(scope="session")
def frame(spark):
    """Audit frame from parallel lists."""

    def make(y_true, y_pred, grp, **extra):
        names = ["row_id", "y_true", "y_pred", "grp", *extra]
        rows = list(zip(range(len(y_true)), y_true, y_pred, grp, *extra.values()))
        kinds = {int: "bigint", float: "double", str: "string"}
        schema = "row_id bigint, y_true int, y_pred int, grp string"
        for k, v in extra.items():
            first = next((x for x in v if x is not None), "")
            schema += f", {k} {kinds[type(first)]}"
        assert len(names) == 4 + len(extra)
        return spark.createDataFrame(rows, schema)

    return make
