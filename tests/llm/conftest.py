import pytest

from terracurve.llm.common import sweep


@pytest.fixture(scope="module", autouse=True)
def swept(spark):
    yield
    sweep(spark)
