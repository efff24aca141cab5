"""Every query of the catalogue against its SQL."""

import pytest

from rallyframe.plans import catalogue
from tests.oracle import same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, name):
    assert same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE[name], SF) > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_every_frame_of_every_video_is_sought(spark):
    large = "/root/testdata/sf0.1"
    last = spark.read.parquet(f"{large}/events.parquet").selectExpr("count(DISTINCT event_id div 4)", "max(event_id) div 400").first()
    found = catalogue.QUERIES["every_frame_at"](spark, large).selectExpr("count(*)", "max(video_id)").first()
    assert tuple(found) == tuple(last)
