import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import session, ship

    spark = session("tests", 4, 4, **{"spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC"})
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    yield spark
    spark.stop()
