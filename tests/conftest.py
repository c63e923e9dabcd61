import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


RAW = "cat2_slug cat3_slug city_slug neighborhood_slug created_at_month user_type description title rent_mode rent_value rent_to_single rent_type price_mode price_value credit_mode credit_value rent_credit_transform transformable_price transformable_credit transformed_credit transformable_rent transformed_rent land_size building_size deed_type has_business_deed floor rooms_count total_floors_count unit_per_floor has_balcony has_elevator has_warehouse has_parking construction_year is_rebuilt has_water has_warm_water_provider has_electricity has_gas has_heating_system has_cooling_system has_restroom has_security_guard has_barbecue building_direction has_pool has_jacuzzi has_sauna floor_material property_type regular_person_capacity extra_person_capacity cost_per_extra_person rent_price_on_regular_days rent_price_on_special_days rent_price_at_weekends location_latitude location_longitude location_radius".split()


@pytest.fixture(scope="session")
def listings(spark):
    """A maker of listings frames from dictionaries; columns not given are NULL, extra ones are kept as texts."""

    def make(rows, extra=()):
        schema = "source_row_id long, " + ", ".join(f"{c} string" for c in [*RAW, *extra])
        return spark.createDataFrame([tuple(r.get(c) for c in ["source_row_id", *RAW, *extra]) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
