"""Queries of objects on the smallest tables."""

from gridspark.plans import catalog
from gridspark.plans.kernel_queries import _mask

SF = "/root/testdata/sf0.001"


def test_every_component_is_an_object(spark):
    """No component is left out, single pixels too: the areas add up to the mask."""
    areas = [r.area for r in catalog.QUERIES["g05_extract_objects"](spark, SF).collect()]
    assert min(areas) == 1 and sum(areas) == _mask(spark, SF).distinct().count()
