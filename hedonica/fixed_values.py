"""These must equal the analysis being reproduced for right results."""

# Column names of the raw sales file, by position.
RAW_COLUMNS = [
    "id", "borough", "hood", "bldg_class_cat", "tax_class_present", "block", "lot",
    "easement", "bldg_class_present", "address", "apt_num", "zip", "res_units",
    "com_units", "tot_units", "land_area", "gross_area", "yr_built",
    "tax_class_sale", "bldg_class_sale", "price", "sale_ts",
]

# Raw columns holding whole numbers; the rest stay text until cleaned.
RAW_NUMBERS = {
    "id": "int", "borough": "int", "block": "int", "lot": "int", "zip": "int",
    "res_units": "double", "com_units": "double", "tot_units": "double",
    "yr_built": "int", "tax_class_sale": "int",
}

# Text that stands for a missing amount.
MISSING_AMOUNT = " -  "

# Unit and area categories: (label, lowest, highest, lowest is excluded).
RES_UNIT_BUCKETS = [
    ("0", 0, 0, False),
    ("1", 1, 1, False),
    ("2", 2, 2, False),
    ("3", 3, 3, False),
    ("4:10", 4, 10, False),
    ("11:50", 11, 50, False),
    ("51+", 51, None, False),
]
COM_UNIT_BUCKETS = [
    ("0", 0, 0, False),
    ("1", 1, 1, False),
    ("2", 2, 2, False),
    ("3", 3, 3, False),
    ("4+", 4, None, False),
]
AREA_BUCKETS = [
    ("0", 0, 0, False),
    ("1:2000", 0, 2000, True),
    ("2001:4000", 2000, 4000, True),
    ("4000+", 4000, None, True),
]

# Kept sales: price in [low, high), decade from the first one on, listed classes.
PRICE_LOW = 10000.0
PRICE_HIGH = 1000000000.0
FIRST_DECADE = 1890
KEPT_CLASSES = ["A", "B", "C", "D", "E", "F", "G", "H", "K", "O", "R", "S", "V"]
CLASS_MIN_ROWS = 100

# Factors of the price model, in fitting order.
FACTORS = [
    "borough", "resunits", "comunits", "rescom", "landareacat", "grossareacat",
    "decade", "tax_class", "bldg_class", "day", "month",
]

# Names of the fitted models: the mean alone, then one more factor each.
MODEL_NAMES = [
    "Average model",
    "Borough Effect Model",
    "B + Residential Units Effects Model",
    "B + RU + Commercial Units Effects Model",
    "B + RU + CU + Property Type Effects Model",
    "B + RU + CU + PT + Land Area Effects Model",
    "B + RU + CU + PT + LA + Gross Area Effects Model",
    "B + RU + CU + PT + LA + GA + Decade Effects Model",
    "B + RU + CU + PT + LA + GA + D + Tax Class Effects Model",
    "B + RU + CU + PT + LA + GA + D + TC + Building Class Effects Model",
    "B + RU + CU + PT + LA + GA + D + TC + BC + Day Sold Effects Model",
    "B + RU + CU + PT + LA + GA + D + TC + BC + DS + Month Sold Effects Model",
]

# Levels shown on an axis, in display order; other levels are left out.
AXIS_LEVELS = {
    "resunits": ["0", "1", "2", "3", "4:10", "11:50", "51+"],
    "day": ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"],
}

# Axis limits: prices of the scatter, errors of the error histogram.
SCATTER_LIMITS = (10000.0, 2200000000.0)
ERROR_LIMITS = (1.0, 1000000000.0)
HISTOGRAM_BINS = 100

# Share of rows drawn for training, its seed, and the strata of the outcome.
TRAIN_SHARE = 0.25
SEED = 1
STRATA = 4
