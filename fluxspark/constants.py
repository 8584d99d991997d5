"""Fixed values that are part of the results' meaning.

These are physical constants, published figures and default thresholds. Results only agree
with other work on the same record when these agree, so they are stated here once.
"""

# Missing-value marker of the half-hourly products.
SENTINEL = -9999.0
# Format of the time stamps in those products, as a Spark pattern.
STAMP_FORMAT = "yyyyMMddHHmm"

# Columns, labels and slugs of the three methane series.
PRECEDENCE = ("FCH4", "FCH4_1_1_1", "FCH4_1_1_2")
LABELS = {"FCH4": "site_aggregated", "FCH4_1_1_1": "TGA-100A", "FCH4_1_1_2": "LI-7700"}
SLUGS = {"site_aggregated": "site_aggregated", "TGA-100A": "tga100a", "LI-7700": "li7700"}

# Detection limit of the flux and its uncertainty, nmol m-2 s-1.
DETECTION_LIMIT = 3.0
DETECTION_LIMIT_UNCERTAINTY = 2.0

# Valid half-hours a day needs, and the thresholds compared.
MIN_OBS_PER_DAY = 8
DAILY_THRESHOLDS = (8, 12, 16)
SLOTS_PER_DAY = 48
SLOTS_PER_YEAR = 17520

# Molar masses (g/mol) and the mass of one half-hour at one nmol per square metre and second.
MOLAR_MASS_CH4 = 16.043
MOLAR_MASS_C = 12.011
C_PER_CH4 = MOLAR_MASS_C / MOLAR_MASS_CH4
SECONDS_PER_SLOT = 1800
GRAMS_PER_SLOT = 1e-9 * MOLAR_MASS_CH4 * SECONDS_PER_SLOT
SECONDS_PER_DAY = 86400

# Wind sector left out of the record, degrees, half open.
EXCLUDED_SECTOR = (30.0, 200.0)

# Published figures the results are set against.
PUBLISHED_BUDGET = {2015: 14.3, 2016: 19.0, 2017: 20.0}
PUBLISHED_CARBON = {2009: (11.8, 3.1), 2010: (12.2, 3.0), 2011: (24.9, 5.6)}
PUBLISHED_CARBON_RANGE = (7.8, 15.2, 2.7)
PUBLISHED_RMA = {"slope": 1.08, "slope_se": 0.02, "intercept": -3.0, "intercept_se": 0.8}
PUBLISHED_RETAINED = 15033
PUBLISHED_START = "2015-03-01"
GROWING_SEASONS = (1991, 1992)

# Covariates a month needs for the backward reconstruction.
RECONSTRUCTION_COVARIATES = ("soil_temp_f", "atm_temp_f", "precip_in", "wte_m")
# Months whose water table is an instrument error, and the month its datum changed.
ARTIFACT_MONTHS = ("2019-06-01", "2019-09-01")
DATUM_BREAK = "2020-01-01"
# Known covariate values.
SPOT_CHECKS = {
    "soil_temp_f": {"2009-04": 33.3362, "2009-05": 45.9725, "2009-07": 54.9024},
    "precip_in": {"1990-01": 0.125},
    "fco2": {"2009-01": -0.070729},
    "atm_temp_f": {"1990-01": 18.275},
    "wte_m": {"1990-01": 413.56},
}

# Screens of the paired regression.
SCREEN_QUANTILES = (0.99, 0.98, 0.95, 0.90)
SCREEN_LIMITS = (200, 100, 50)

# Rolling-origin evaluation.
HORIZONS = (1, 3, 6, 12)
MIN_TRAIN = 48
PERIOD = 12
RECENT_LAGS = (1, 2, 3)
COVARIATE_LAGS = (1, 2)
SEASONAL_TERMS = ("sin_year", "cos_year", "year_fraction")
MIN_FOLD_ROWS = 24

# Shadow screening.
SCREEN_REPEATS = 20
SCREEN_ALPHA = 0.05
SCREEN_MIN_SHADOWS = 5

# Stability path.
DROP_SHARES = (0.0, 0.10, 0.20, 0.30, 0.40)
N_BOOTSTRAP = 500
SEED = 6174
