import pytest

SETTINGS = ("spark.sql.maxPlanStringLength", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.fixture(scope="package", autouse=True)
def settings_as_found(spark):
    """The other tests read whole plans, so what ``common.prepare`` sets ends with the text tests."""
    before = {name: spark.conf.get(name) for name in SETTINGS}
    yield
    for name, value in before.items():
        spark.conf.set(name, value)
