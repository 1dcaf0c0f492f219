import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from groundsift.session import local_session

    return local_session("8", shuffle_partitions=4)


class Jts:
    """Exact geometry answers for tests, from the library Spark ships."""

    def __init__(self, spark):
        jvm = spark._jvm
        self.reader = jvm.org.locationtech.jts.io.WKTReader()

    def of(self, wkt):
        return self.reader.read(wkt)

    def polygon(self, *rings):
        return self.of("POLYGON(" + ",".join("(" + ",".join(f"{x!r} {y!r}" for x, y in r) + ")" for r in rings) + ")")


@pytest.fixture(scope="session")
def jts(spark):
    return Jts(spark)
