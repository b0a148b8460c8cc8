"""Values the data format and the formulas fix; everything else is a parameter."""

# --- fixed values: observation archive ---------------------------------------
FILE_SUFFIX = "dadesPC_utc.csv"

RAW_HEADER = [
    "nu", "id", "Font", "Data", "Poblacio", "lat", "lon", "Temp", "Temp.Max", "Temp.Min",
    "Amplitud.Termica", "VentDir", "VentFor", "VentMax", "Simbolvent", "Windchill", "Humitat",
    "Humidex", "Pluja", "Alt", "Patm", "WEBCAMS", "NomOK", "Comarca",
]

RAW_TO_CANONICAL = {
    "id": "station_id", "Font": "source", "lat": "lat", "lon": "lon", "Alt": "alt",
    "Temp": "temp", "Humitat": "humidity", "Pluja": "rain", "VentDir": "wind_dir",
    "VentFor": "wind_speed", "Patm": "pressure",
}

OFFICIAL_SOURCES = [
    "Aemet", "METEOCAT", "METEOCAT_WEB", "Meteoclimatic", "Vallsdaneu",
    "SAIH", "avamet", "Meteoprades", "MeteoPirineus", "WLINK_DAVIS",
]

CLEANING_EXCLUDED_DIRS = [
    "tauladades", "vextrems", "Admin_Estacions", "Clima", "Clima METEOCAT",
    "error_VAR", "html", "png", "var_vextrems",
]
AUDIT_EXCLUDED_DIRS = CLEANING_EXCLUDED_DIRS + ["2013", "2014", "2015"]

# --- fixed values: compass text to degrees (calm and variable have no direction) --
COMPASS_DEGREES = {
    "N": 0.0, "NNE": 22.5, "NE": 45.0, "ENE": 67.5,
    "E": 90.0, "ESE": 112.5, "SE": 135.0, "SSE": 157.5,
    "S": 180.0, "SSW": 202.5, "SW": 225.0, "WSW": 247.5,
    "W": 270.0, "WNW": 292.5, "NW": 315.0, "NNW": 337.5,
}

# --- fixed values: physics and geodesy ----------------------------------------
EARTH_RADIUS_KM = 6371.0
KELVIN = 273.15
PRESSURE_REF = 1013.0
POISSON_EXPONENT = 0.286
MAGNUS_A = 17.27
MAGNUS_B = 237.7
SOLAR_TILT = 23.44
ALT_MEAN = 454.3
ALT_STD = 175.61
PLANE_LAT0 = 41.7
HAVERSINE_EPS = 1e-8

# --- fixed values: study area and valid ranges ---------------------------------
BBOX = {"lat": (37.843, 42.85), "lon": (-1.533, 4.324)}
VALID_RANGES = {"humidity": (0.0, 100.0), "wind_speed": (0.0, 200.0), "wind_dir": (0.0, 360.0)}

# --- fixed values: column lists -------------------------------------------------
NUMERIC_COLUMNS = ["temp", "humidity", "alt", "wind_speed", "lat", "lon", "rain", "pressure"]
IMPUTED_COLUMNS = ["temp", "humidity", "wind_dir", "wind_speed", "pressure"]
CANONICAL_COLUMNS = [
    "station_id", "source", "temp", "humidity", "rain", "alt", "wind_dir", "wind_speed",
    "pressure", "lat", "lon", "ts",
]
FEATURE_COLUMNS = [
    "temp", "humidity", "rain", "wind_speed", "pressure", "alt_norm", "wind_dir_sin",
    "wind_dir_cos", "hour_sin", "hour_cos", "day_sin", "day_cos", "cos_sza", "dew_point",
    "potential_temp", "wind_u", "wind_v",
]
TEMPORAL_FEATURES = ["hour_sin", "hour_cos", "day_sin", "day_cos", "cos_sza"]
TARGET_COLUMNS = ["temp", "humidity", "rain", "wind_speed", "pressure", "wind_u", "wind_v"]

# signed differences along an edge: attribute -> node feature
EDGE_DIFFS = {
    "d_temp": "temp", "d_humidity": "humidity", "d_rain": "rain", "d_wind_speed": "wind_speed",
    "d_pressure": "pressure", "d_wind_sin": "wind_dir_sin", "d_wind_cos": "wind_dir_cos",
    "d_dew_point": "dew_point", "d_potential_temp": "potential_temp",
}
EDGE_ATTRIBUTES = [
    "dist_scaled", "d_temp", "d_humidity", "d_rain", "d_wind_speed", "d_pressure", "abs_alt",
    "slope", "d_wind_sin", "d_wind_cos", "d_dew_point", "d_potential_temp",
    "bearing_sin", "bearing_cos",
]

# --- fixed values: map layers ------------------------------------------------------
UNITS = {
    "temp": "°C", "humidity": "%", "rain": "mm", "wind_speed": "km/h", "pressure": "hPa",
    "wind_u": "km/h", "wind_v": "km/h",
}
DISPLAY_LIMITS = {
    "temp": (-20.0, 45.0), "humidity": (0.0, 100.0), "rain": (0.0, 150.0),
    "pressure": (980.0, 1040.0), "wind_speed": (0.0, 200.0),
}
CONTOUR_LEVELS = {
    "temp": [0.0],
    "pressure": [1013.0],
    "rain": [20.0, 50.0],
    "wind_speed": [float(v) for v in range(0, 100, 10)],
    "wind_u": [float(v) for v in range(-50, 51, 10)],
    "wind_v": [float(v) for v in range(-50, 51, 10)],
}
METRICS = ["loss", "rmse", "mae", "r2", "smape"]
