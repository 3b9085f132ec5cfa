"""Column groups, schemas and the fixed value tables of the domain.

Everything below the "fixed values" marker must equal the values the
original pipeline uses, otherwise results differ. They are written out as
plain data, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

DATE = "Date"

# ---------------------------------------------------------------------------
# fixed values: column groups
# ---------------------------------------------------------------------------
POLLUTANTS = ["co", "no2", "o3", "pm10", "pm25", "so2"]
WEATHER = ["Temp", "Rain", "Cloud", "Pressure", "Wind", "Gust"]
TARGETS = POLLUTANTS + WEATHER
WEATHER_ROW_COLUMNS = ["Date", "Time", "Weather", "Temp", "Rain", "Cloud",
                       "Pressure", "Wind", "Gust"]

# order used to break ties between equal sub-indices (first wins)
AQI_ORDER = ["pm25", "pm10", "o3", "no2", "so2", "co"]

# ---------------------------------------------------------------------------
# fixed values: AQI breakpoints (C_lo, C_hi, I_lo, I_hi) per pollutant
# ---------------------------------------------------------------------------
BREAKPOINTS = {
    "pm25": [(0.0, 12.0, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150),
             (55.5, 150.4, 151, 200), (150.5, 250.4, 201, 300),
             (250.5, 350.4, 301, 400), (350.5, 500.4, 401, 500)],
    "pm10": [(0, 54, 0, 50), (55, 154, 51, 100), (155, 254, 101, 150),
             (255, 354, 151, 200), (355, 424, 201, 300), (425, 504, 301, 400),
             (505, 604, 401, 500)],
    "o3": [(0, 54, 0, 50), (55, 70, 51, 100), (71, 85, 101, 150),
           (86, 105, 151, 200), (106, 200, 201, 300)],
    "no2": [(0, 53, 0, 50), (54, 100, 51, 100), (101, 360, 101, 150),
            (361, 649, 151, 200), (650, 1249, 201, 300), (1250, 1649, 301, 400),
            (1650, 2049, 401, 500)],
    "so2": [(0, 35, 0, 50), (36, 75, 51, 100), (76, 185, 101, 150),
            (186, 304, 151, 200), (305, 604, 201, 300), (605, 804, 301, 400),
            (805, 1004, 401, 500)],
    "co": [(0.0, 4.4, 0, 50), (4.5, 9.4, 51, 100), (9.5, 12.4, 101, 150),
           (12.5, 15.4, 151, 200), (15.5, 30.4, 201, 300), (30.5, 40.4, 301, 400),
           (40.5, 50.4, 401, 500)],
}

# ---------------------------------------------------------------------------
# fixed values: health bands (upper AQI bound inclusive, name, original label)
# ---------------------------------------------------------------------------
HEALTH_BANDS = [
    (50, "Good", "Tốt"),
    (100, "Moderate", "Trung bình"),
    (150, "Poor", "Kém"),
    (200, "Bad", "Xấu"),
    (300, "Very bad", "Rất xấu"),
    (None, "Hazardous", "Nguy hại"),
]
HEALTH_ADVICE = {
    "Good": "Air quality is good and poses no health risk.",
    "Moderate": "Acceptable; sensitive groups may feel some effects.",
    "Poor": "Sensitive groups have health problems; others are little affected.",
    "Bad": "Everyone starts to feel effects; sensitive groups more seriously.",
    "Very bad": "Health warning: everyone is affected more seriously.",
    "Hazardous": "Health emergency: the whole population is seriously affected.",
}

# ---------------------------------------------------------------------------
# fixed values: display units per metric
# ---------------------------------------------------------------------------
UNITS = {
    "co": "mg/m³", "pm10": "µg/m³", "pm25": "µg/m³", "no2": "µg/m³",
    "so2": "µg/m³", "o3": "µg/m³", "Temp": "°c", "Wind": "km/h",
    "Gust": "km/h", "Pressure": "mb", "Cloud": "%", "Rain": "\nmm",
}

# ---------------------------------------------------------------------------
# fixed values: physical limits. mode 'null' masks, 'clamp' clips to the range
# ---------------------------------------------------------------------------
POLLUTANT_LIMITS = {
    "o3": (0, 200, "null"), "no2": (0, 120, "null"), "pm10": (0, 500, "null"),
    "pm25": (0, 500, "null"), "so2": (0, 500, "null"), "co": (0, 50, "null"),
}
WEATHER_LIMITS = {
    "Temp": (-10, 50, "null"), "Pressure": (950, 1100, "null"),
    "Wind": (0, 200, "null"), "Gust": (0, 200, "null"),
    "Cloud": (0, 100, "null"), "Rain": (0, 500, "clamp"),
}

# ---------------------------------------------------------------------------
# fixed values: unit texts removed from weather cells, in this order
# ---------------------------------------------------------------------------
UNIT_SUFFIXES = {
    "Temp": ["°c", "°C", "C"],
    "Rain": ["\nmm", "mm"],
    "Cloud": ["%"],
    "Pressure": ["mb", "hPa"],
    "Wind": ["km/h", "kmh"],
    "Gust": ["km/h", "kmh"],
}

# ---------------------------------------------------------------------------
# fixed values: pipeline defaults
# ---------------------------------------------------------------------------
ZERO_IS_MISSING_EXCEPT = ["Rain"]
LAG_STEPS = [1, 2, 3, 7, 14, 30]
ROLLING_WINDOWS = [3, 7, 14, 30]
ROLLING_STATS = ["mean", "std", "min", "max"]
TREND_WINDOWS = [3, 7, 14]
EPS = 1e-6
# (name, numerator, denominator)
RATIOS = [
    ("pm25_pm10_ratio", "pm25", "pm10"),
    ("o3_no2_ratio", "o3", "no2"),
    ("pm25_wind_ratio", "pm25", "Wind"),
    ("pm10_rain_ratio", "pm10", "Rain"),
    ("pm25_temp_ratio", "pm25", "Temp"),
]
# (name, left, right, divisor)
INTERACTIONS = [
    ("wind_pressure_interaction", "Wind", "Pressure", 1000.0),
    ("temp_cloud_interaction", "Temp", "Cloud", 100.0),
    ("rain_wind_interaction", "Rain", "Wind", None),
    ("pm25_wind_interaction", "pm25", "Wind", None),
    ("pm10_wind_interaction", "pm10", "Wind", None),
]
POLLUTANT_SEASONAL_ABOVE = 30.0   # % missing above which seasonal means are used
WEATHER_SEASONAL_ABOVE = 20.0
POLLUTANT_IQR_FACTOR = 3.0
POLLUTANT_Z_THRESHOLD = 4.0
WEATHER_IQR_FACTOR = 3.0
REPORT_IQR_FACTOR = 1.5
MIN_VALID_FOR_STATS = 20          # statistics tests need more than this many values
FORWARD_FILL_LIMIT = 7
HISTORY_START = "2015-01-01"

# ---------------------------------------------------------------------------
# schemas
# ---------------------------------------------------------------------------
SERIES_SCHEMA = T.StructType(
    [T.StructField(DATE, T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in TARGETS])
POLLUTANT_SCHEMA = T.StructType(
    [T.StructField(DATE, T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in POLLUTANTS])
WEATHER_DAILY_SCHEMA = T.StructType(
    [T.StructField(DATE, T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in WEATHER])
WEATHER_ROWS_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in WEATHER_ROW_COLUMNS])
POLLUTANTS_RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["date"] + AQI_ORDER])
