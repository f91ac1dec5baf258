import itertools

import pytest
from pyspark.sql import functions as F

from quirefold.config import ConfigError, ReadingOrder, SorterConfig, for_language, overlay
from quirefold.functions.geometry import Box, BoxColumns, Geometry


@pytest.mark.parametrize("order", list(ReadingOrder))
def test_columns_agree_with_plain(spark, order):
    spots = [(0.05, 0.05), (0.14, 0.05), (0.6, 0.05), (0.05, 0.08), (0.55, 0.02), (0.3, 0.9)]
    boxes = [Box(x, y, 0.08, 0.02) for x, y in spots]
    rows = [tuple(a)[:6] + tuple(b)[:6] for a, b in itertools.product(boxes, boxes)]
    names = [f"{p}_{c}" for p in "ab" for c in ("left", "top", "width", "height", "page_width", "page_height")]
    g = Geometry(order, columns=True)
    df = spark.createDataFrame(rows, names).select("*", g.distance(BoxColumns("a_"), BoxColumns("b_")).alias("d"), g.step_class(BoxColumns("a_"), BoxColumns("b_")).alias("c"))
    plain = Geometry(order)
    for r in df.collect():
        a, b = Box(*r[:6]), Box(*r[6:12])
        assert r["d"] == plain.distance(a, b) and r["c"] == plain.step_class(a, b)


def test_step_classes():
    g = Geometry()
    a = Box(0.05, 0.05, 0.08, 0.02)
    assert g.step_class(a, Box(0.14, 0.05, 0.08, 0.02)) == "sequential"
    assert g.step_class(a, Box(0.6, 0.05, 0.08, 0.02)) == "jump"
    assert g.step_class(Box(0.86, 0.05, 0.08, 0.02), Box(0.05, 0.08, 0.08, 0.02)) == "wrap"
    assert g.step_class(Box(0.05, 0.9, 0.08, 0.02), Box(0.55, 0.05, 0.08, 0.02)) == "column"


def test_config():
    assert for_language("arabic").reading_order == ReadingOrder.HORIZONTAL_RTL_TTB
    assert for_language("english").wrap_bridging and not SorterConfig().wrap_bridging
    got = overlay(SorterConfig(), "max_passes=3,enable_holes=true,max_word_distance=0.7")
    assert (got.max_passes, got.enable_holes, got.max_word_distance) == (3, True, 0.7)
    with pytest.raises(ConfigError):
        overlay(SorterConfig(), "nothing=1")
    with pytest.raises(ConfigError):
        SorterConfig(max_hole_fraction=2).validate()
