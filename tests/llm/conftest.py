import pytest

from confab.llm.texts import configure


@pytest.fixture(autouse=True)
def settings(spark):
    configure(spark)
