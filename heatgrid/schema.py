"""Declared schemas, valid ranges, code maps and feature groups.

Everything below the marker is a fixed value of the data model: changing one changes results.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Pixel table columns in their published order.
# ---------------------------------------------------------------------------
PIXEL_COLUMNS = [
    "PixelID", "Latitude", "Longitude", "Timestamp", "LST", "NDVI", "NDBI", "NDWI", "MNDWI", "SAVI",
    "Albedo", "LULC_ESA", "LULC_DW", "Impervious_Frac", "Tree_Cover_Pct", "AirTemp", "Humidity",
    "WindSpeed", "WindDirection", "SolarRadiation", "Pressure", "Rainfall", "Elevation", "Slope",
    "Aspect", "Building_Density", "Building_Height", "Building_Volume", "Nighttime_Lights",
    "Population_Density", "Dist_Water", "Dist_Green", "Green_Space_Density", "Surface_Roughness",
    "Anthropogenic_Heat", "Road_Density_Proxy", "UHI_Intensity", "UTFVI", "QualityScore",
]
_NON_DOUBLE = {
    "PixelID": T.LongType(),
    "Timestamp": T.StringType(),
    "LULC_ESA": T.IntegerType(),
    "LULC_DW": T.IntegerType(),
    "Impervious_Frac": T.IntegerType(),
    "QualityScore": T.IntegerType(),
}
PIXEL_SCHEMA = T.StructType(
    [T.StructField(c, _NON_DOUBLE.get(c, T.DoubleType())) for c in PIXEL_COLUMNS]
)

# Ranges used when cleaning (None = open side).
CLEANING_RANGES = {
    "LST": (-10, 70), "NDVI": (-1, 1), "NDBI": (-1, 1), "NDWI": (-1, 1), "MNDWI": (-1, 1),
    "SAVI": (-1, 1.5), "Albedo": (0, 1), "Impervious_Frac": (0, 1), "Tree_Cover_Pct": (0, 100),
    "AirTemp": (-10, 60), "Humidity": (0, 100), "WindSpeed": (0, 30), "WindDirection": (0, 360),
    "SolarRadiation": (0, 500), "Pressure": (800, 1100), "Rainfall": (0, 5000),
    "Elevation": (-100, 9000), "Slope": (0, 90), "Aspect": (0, 360), "Building_Density": (0, None),
    "Building_Height": (0, 500), "Building_Volume": (0, None), "Nighttime_Lights": (0, 500),
    "Population_Density": (0, None), "Dist_Water": (0, None), "Dist_Green": (0, None),
    "Green_Space_Density": (0, 1), "Surface_Roughness": (0, None), "Anthropogenic_Heat": (0, None),
    "Road_Density_Proxy": (-1, 1), "UHI_Intensity": (-25, 30), "UTFVI": (-1, 1),
    "QualityScore": (0, None),
}

# Ranges used when validating a raw export.
VALIDATION_RANGES = {
    **{k: v for k, v in CLEANING_RANGES.items() if k != "SAVI"},
    "PixelID": (0, None), "Latitude": (6.0, 38.0), "Longitude": (68.0, 98.0),
    "LULC_ESA": (10, 100), "LULC_DW": (0, 8), "UHI_Intensity": (-20.0, 25.0),
}

# Physical bounds enforced after every intervention effect.
EFFECT_BOUNDS = {
    "NDVI": (-1.0, 1.0), "NDBI": (-1.0, 1.0), "NDWI": (-1.0, 1.0), "MNDWI": (-1.0, 1.0),
    "SAVI": (-1.0, 1.0), "Albedo": (0.0, 1.0), "Impervious_Frac": (0.0, 1.0),
    "Tree_Cover_Pct": (0.0, 100.0), "AirTemp": (-50.0, 60.0), "Humidity": (0.0, 100.0),
    "WindSpeed": (0.0, None), "SolarRadiation": (0.0, None), "Slope": (0.0, 90.0),
    "Building_Density": (0.0, None), "Building_Height": (0.0, None), "Building_Volume": (0.0, None),
    "Nighttime_Lights": (0.0, None), "Population_Density": (0.0, None), "Dist_Water": (0.0, None),
    "Dist_Green": (0.0, None), "Green_Space_Density": (0.0, 1.0), "Surface_Roughness": (0.0, None),
    "Anthropogenic_Heat": (0.0, None),
}

# Land-cover and heat-class codes.
ESA_LABELS = {
    10: "Trees", 20: "Shrubland", 30: "Grassland", 40: "Cropland", 50: "Built_up",
    60: "Bare", 70: "Snow_Ice", 80: "Water", 90: "Wetland", 95: "Mangroves", 100: "Moss_Lichen",
}
DW_LABELS = {
    0: "Water", 1: "Trees", 2: "Grass", 3: "Flooded_Veg", 4: "Crops", 5: "Shrub", 6: "Built",
    7: "Bare", 8: "Snow_Ice",
}
HEAT_LABELS = {0: "Low", 1: "Moderate", 2: "High", 3: "Extreme"}
HEAT_PRIORITY = {"Extreme": "Critical", "High": "High", "Moderate": "Medium"}
LULC_BUILT_UP = 50

# Weights of the composite heat score.
SCORE_WEIGHTS = {
    "LST": 0.40, "UHI_Intensity": 0.25, "UTFVI": 0.15, "Anthropogenic_Heat": 0.10,
    "Impervious_Frac": 0.10,
}

# Imputation groups.
IMPUTE_MEDIAN = ["Elevation", "Slope", "Aspect"]
IMPUTE_MEAN = ["AirTemp", "Humidity", "WindSpeed", "Pressure", "SolarRadiation"]
IMPUTE_ZERO = [
    "Building_Density", "Building_Height", "Building_Volume", "Nighttime_Lights", "Population_Density",
]
IMPUTE_P95 = ["Dist_Water", "Dist_Green"]

# Scaled features.
ZSCORE_FEATURES = [
    "LST", "AirTemp", "Humidity", "WindSpeed", "SolarRadiation", "Pressure", "Rainfall", "Elevation",
    "Slope", "Building_Density", "Building_Height", "Building_Volume", "Nighttime_Lights",
    "Population_Density", "Dist_Water", "Dist_Green", "Surface_Roughness", "Anthropogenic_Heat",
    "UHI_Intensity", "UTFVI",
]
MINMAX_FEATURES = [
    "NDVI", "NDBI", "NDWI", "MNDWI", "SAVI", "Albedo", "Impervious_Frac", "Tree_Cover_Pct",
    "Green_Space_Density", "Road_Density_Proxy", "QualityScore",
]
CIRCULAR_FEATURES = ["Aspect", "WindDirection"]

# Features compared between hotspots and the city.
PROFILE_FEATURES = [
    "LST", "NDVI", "NDBI", "NDWI", "MNDWI", "Albedo", "LULC_ESA", "Impervious_Frac",
    "Building_Density", "Building_Height", "Road_Density_Proxy", "Population_Density",
    "Tree_Cover_Pct", "Dist_Water", "Dist_Green", "Elevation", "Slope", "AirTemp", "Humidity",
    "WindSpeed", "WindDirection", "SolarRadiation", "Cloud_Cover_Proxy", "Nighttime_Lights",
    "Anthropogenic_Heat", "UHI_Intensity", "UTFVI", "UTCI_Approx", "Surface_Roughness",
    "Building_Volume", "Green_Space_Density",
]

# Column order of the finished dataset (before one-hot and scaled columns).
DATASET_COLUMNS = [
    "PixelID", "Latitude", "Longitude", "Timestamp", "LST", "NDVI", "NDBI", "NDWI", "MNDWI", "SAVI",
    "Albedo", "Impervious_Frac", "LULC_ESA", "LULC_DW", "Population_Density", "Building_Height",
    "Building_Density", "Building_Volume", "Road_Density_Proxy", "Street_Width_Proxy",
    "Tree_Cover_Pct", "Dist_Water", "Dist_Green", "Elevation", "Slope", "Aspect", "AirTemp",
    "Humidity", "WindSpeed", "WindDirection", "SolarRadiation", "Cloud_Cover_Proxy", "Pressure",
    "Rainfall", "Nighttime_Lights", "UHI_Intensity", "UTFVI", "UTCI_Approx", "Anthropogenic_Heat",
    "Green_Space_Density", "Surface_Roughness", "QualityScore",
]

# Columns reported on in summaries.
SUMMARY_FEATURES = [
    "NDVI", "NDBI", "Albedo", "Impervious_Frac", "Building_Density", "Population_Density",
    "Tree_Cover_Pct", "Dist_Green", "WindSpeed", "UHI_Intensity",
]
CHANGE_FEATURES = [
    "NDVI", "NDBI", "Albedo", "Impervious_Frac", "Building_Density", "Tree_Cover_Pct", "WindSpeed",
    "MNDWI", "Green_Space_Density", "Anthropogenic_Heat",
]

# Z-score thresholds that mark a vulnerability (feature, side, threshold).
VULNERABILITY_RULES = {
    "vegetation_deficit": ("NDVI", "below", -0.5),
    "high_imperviousness": ("Impervious_Frac", "above", 0.5),
    "high_building_density": ("Building_Density", "above", 0.5),
    "far_from_green_space": ("Dist_Green", "above", 0.5),
    "far_from_water": ("Dist_Water", "above", 0.5),
    "low_albedo": ("Albedo", "below", -0.3),
    "low_wind": ("WindSpeed", "below", -0.3),
    "low_tree_cover": ("Tree_Cover_Pct", "below", -0.3),
    "high_population": ("Population_Density", "above", 0.5),
    "high_anthro_heat": ("Anthropogenic_Heat", "above", 0.5),
}
