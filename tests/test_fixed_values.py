"""The lists that library and SQL share, against literals: a slip would show in neither."""

from hedonica import fixed_values as fixed


def test_factors_and_models():
    assert " ".join(fixed.FACTORS) == (
        "borough resunits comunits rescom landareacat grossareacat decade tax_class bldg_class day month"
    )
    assert len(fixed.MODEL_NAMES) == 12 and fixed.MODEL_NAMES[0] == "Average model"
    assert "".join(fixed.KEPT_CLASSES) == "ABCDEFGHKORSV"


def test_limits():
    assert (fixed.PRICE_LOW, fixed.PRICE_HIGH, fixed.FIRST_DECADE) == (1e4, 1e9, 1890)
    assert (fixed.CLASS_MIN_ROWS, fixed.TRAIN_SHARE, fixed.STRATA, fixed.HISTOGRAM_BINS) == (100, 0.25, 4, 100)
    assert [x[0] for x in fixed.RES_UNIT_BUCKETS] == fixed.AXIS_LEVELS["resunits"]
    assert fixed.AXIS_LEVELS["day"][0] == "Monday" and len(fixed.AXIS_LEVELS["day"]) == 7
