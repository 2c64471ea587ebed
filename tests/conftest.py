import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

from compare import session


@pytest.fixture(scope="session")
def spark():
    spark = session()
    yield spark
    spark.stop()


REGISTRY_DDL = ("pos long, record_id string, building_name string, road_name string, postal_code string, "
                "operating_hours string, latitude double, longitude double, floor_level string, "
                "location_description string")


@pytest.fixture
def registry(spark):
    """Build a registry from dicts; unnamed fields get harmless values."""
    def build(rows):
        base = dict(building_name="Tower", road_name="Main Road", postal_code="000001",
                    operating_hours="24/7", latitude=1.3, longitude=103.8, floor_level="1",
                    location_description="Lobby")
        full = [{**base, "pos": i, "record_id": f"R{i:03d}", **r} for i, r in enumerate(rows)]
        names = [p.split()[0] for p in REGISTRY_DDL.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], REGISTRY_DDL)
    return build
