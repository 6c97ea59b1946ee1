"""What two queries return: whole results, not a part or a checksum of them."""

from landmosaic.plans.fixtures import fx
from landmosaic.plans.registry import QUERIES


def test_background_selection_keeps_all_envelopes_and_metrics(spark, sf):
    out = QUERIES["background_selection"](spark, sf)
    assert {"sightings", "selection_ratio", "classification"} <= set(out.columns)
    assert out.count() == QUERIES["selection_ratio"](spark, sf).count() and out.where("sightings > 0").count() > 0


def test_aligned_layers_keep_every_pixel(spark, sf):
    out = QUERIES["align_layers"](spark, sf)
    assert out.count() == fx(spark, sf, "fx_pixels").count()
    held = out.where("value is not null")
    assert held.count() and not held.where("value <> (floor((row_id + 0.5) / 3) * 17 + floor((col_id + 0.5) / 3) * 3) % 300").count()
