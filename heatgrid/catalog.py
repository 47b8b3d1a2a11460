"""The intervention catalogue as plain tables.

Callers may pass their own rows of the same shape; these are the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from heatgrid.operators.support import local_table

# Share of an effect that remains on the 1st, 2nd, ... hit of one feature; the last repeats.
STACKING_FACTORS = [1.0, 0.80, 0.65, 0.52, 0.42, 0.35]


@dataclass(frozen=True)
class Effect:
    intervention_id: str
    seq: int
    feature: str
    mode: str
    value: float
    lo: float
    hi: float


@dataclass(frozen=True)
class Intervention:
    id: str
    name: str
    category: str
    cool_min: float
    cool_typical: float
    cool_max: float
    unit_cost: float
    cost_unit: str
    feasibility: float
    suitability: str
    applicable_lulc: tuple[int, ...]
    annual_maintenance: float
    months: tuple[int, int]
    lifespan_years: int
    lag_years: float
    scalability: str
    co_benefits: tuple[str, ...]
    effects: tuple[Effect, ...]


# One record per intervention. Cooling in deg C, costs in the unit named, land-cover codes of the ESA map; an effect is
# (intervention, place in order, feature, mode, value, lower and upper bound of the value).
CATALOGUE = (
    Intervention(
        id="street_trees", name="Street Trees", category="green",
        cool_min=1.0, cool_typical=2.0, cool_max=3.5, unit_cost=500.0, cost_unit="USD/tree",
        feasibility=0.85, suitability="high", applicable_lulc=(50, 30, 40),
        annual_maintenance=75.0, months=(3, 12), lifespan_years=30, lag_years=3.0, scalability="high",
        co_benefits=("Air quality improvement", "Carbon sequestration", "Stormwater management", "Aesthetic value", "Mental health benefits", "Biodiversity support"),
        effects=(
            Effect("street_trees", 0, "NDVI", "add", 0.15, 0.1, 0.25),
            Effect("street_trees", 1, "Tree_Cover_Pct", "add", 15.0, 8.0, 25.0),
            Effect("street_trees", 2, "NDBI", "add", -0.05, -0.08, -0.02),
            Effect("street_trees", 3, "Green_Space_Density", "add", 0.1, 0.05, 0.2),
            Effect("street_trees", 4, "Albedo", "add", -0.02, -0.04, -0.01),
            Effect("street_trees", 5, "Surface_Roughness", "add", 0.15, 0.08, 0.25),
            Effect("street_trees", 6, "Anthropogenic_Heat", "multiply", 0.92, 0.88, 0.96),
            Effect("street_trees", 7, "Dist_Green", "multiply", 0.6, 0.4, 0.8),
        ),
    ),
    Intervention(
        id="urban_forests", name="Urban Forests / Miyawaki Forests", category="green",
        cool_min=2.0, cool_typical=3.0, cool_max=5.0, unit_cost=15000.0, cost_unit="USD/hectare",
        feasibility=0.7, suitability="high", applicable_lulc=(60, 30, 40, 50),
        annual_maintenance=2000.0, months=(2, 6), lifespan_years=50, lag_years=2.0, scalability="medium",
        co_benefits=("Major carbon sequestration", "Biodiversity hotspot", "Flood mitigation", "Noise reduction", "Recreational space"),
        effects=(
            Effect("urban_forests", 0, "NDVI", "add", 0.3, 0.2, 0.45),
            Effect("urban_forests", 1, "Tree_Cover_Pct", "add", 40.0, 25.0, 60.0),
            Effect("urban_forests", 2, "NDBI", "add", -0.15, -0.25, -0.08),
            Effect("urban_forests", 3, "Impervious_Frac", "add", -0.2, -0.35, -0.1),
            Effect("urban_forests", 4, "Green_Space_Density", "add", 0.3, 0.2, 0.45),
            Effect("urban_forests", 5, "Albedo", "add", -0.03, -0.05, -0.01),
            Effect("urban_forests", 6, "Surface_Roughness", "add", 0.3, 0.2, 0.45),
            Effect("urban_forests", 7, "Anthropogenic_Heat", "multiply", 0.8, 0.7, 0.9),
            Effect("urban_forests", 8, "Dist_Green", "multiply", 0.2, 0.1, 0.4),
        ),
    ),
    Intervention(
        id="pocket_parks", name="Pocket Parks", category="green",
        cool_min=0.5, cool_typical=1.5, cool_max=2.5, unit_cost=25000.0, cost_unit="USD/park",
        feasibility=0.8, suitability="high", applicable_lulc=(50, 60),
        annual_maintenance=3000.0, months=(3, 9), lifespan_years=25, lag_years=1.0, scalability="high",
        co_benefits=("Community gathering space", "Children's play area", "Stormwater infiltration", "Property value increase"),
        effects=(
            Effect("pocket_parks", 0, "NDVI", "add", 0.12, 0.06, 0.2),
            Effect("pocket_parks", 1, "Tree_Cover_Pct", "add", 10.0, 5.0, 20.0),
            Effect("pocket_parks", 2, "NDBI", "add", -0.06, -0.1, -0.03),
            Effect("pocket_parks", 3, "Impervious_Frac", "add", -0.08, -0.15, -0.04),
            Effect("pocket_parks", 4, "Green_Space_Density", "add", 0.15, 0.08, 0.25),
            Effect("pocket_parks", 5, "Dist_Green", "multiply", 0.4, 0.25, 0.6),
        ),
    ),
    Intervention(
        id="green_roofs", name="Green Roofs", category="green",
        cool_min=0.5, cool_typical=1.5, cool_max=3.0, unit_cost=120.0, cost_unit="USD/sqm",
        feasibility=0.75, suitability="medium", applicable_lulc=(50,),
        annual_maintenance=8.0, months=(1, 4), lifespan_years=20, lag_years=0.5, scalability="high",
        co_benefits=("Building insulation (20-30% energy savings)", "Stormwater retention (50-90%)", "Extended roof lifespan", "Urban agriculture potential", "Noise insulation"),
        effects=(
            Effect("green_roofs", 0, "NDVI", "add", 0.1, 0.05, 0.2),
            Effect("green_roofs", 1, "NDBI", "add", -0.08, -0.15, -0.04),
            Effect("green_roofs", 2, "Albedo", "add", 0.05, 0.02, 0.1),
            Effect("green_roofs", 3, "Impervious_Frac", "add", -0.05, -0.1, -0.02),
            Effect("green_roofs", 4, "Green_Space_Density", "add", 0.05, 0.02, 0.1),
            Effect("green_roofs", 5, "Anthropogenic_Heat", "multiply", 0.9, 0.85, 0.95),
        ),
    ),
    Intervention(
        id="green_walls", name="Green Walls / Living Walls", category="green",
        cool_min=0.3, cool_typical=0.8, cool_max=1.5, unit_cost=200.0, cost_unit="USD/sqm",
        feasibility=0.65, suitability="medium", applicable_lulc=(50,),
        annual_maintenance=15.0, months=(1, 3), lifespan_years=15, lag_years=0.5, scalability="medium",
        co_benefits=("Building cooling load reduction", "Air quality at pedestrian level", "Aesthetic improvement", "Noise reduction"),
        effects=(
            Effect("green_walls", 0, "NDVI", "add", 0.05, 0.02, 0.1),
            Effect("green_walls", 1, "NDBI", "add", -0.03, -0.06, -0.01),
            Effect("green_walls", 2, "Green_Space_Density", "add", 0.03, 0.01, 0.06),
            Effect("green_walls", 3, "Anthropogenic_Heat", "multiply", 0.93, 0.88, 0.97),
        ),
    ),
    Intervention(
        id="vertical_gardens", name="Vertical Gardens", category="green",
        cool_min=0.2, cool_typical=0.5, cool_max=1.0, unit_cost=180.0, cost_unit="USD/sqm",
        feasibility=0.7, suitability="medium", applicable_lulc=(50,),
        annual_maintenance=12.0, months=(1, 2), lifespan_years=10, lag_years=0.3, scalability="medium",
        co_benefits=("Urban beautification", "Food production potential", "Educational value"),
        effects=(
            Effect("vertical_gardens", 0, "NDVI", "add", 0.04, 0.02, 0.08),
            Effect("vertical_gardens", 1, "NDBI", "add", -0.02, -0.04, -0.01),
            Effect("vertical_gardens", 2, "Green_Space_Density", "add", 0.02, 0.01, 0.04),
        ),
    ),
    Intervention(
        id="bioswales", name="Bioswales", category="green",
        cool_min=0.3, cool_typical=0.8, cool_max=1.5, unit_cost=60.0, cost_unit="USD/linear meter",
        feasibility=0.8, suitability="high", applicable_lulc=(50, 30),
        annual_maintenance=5.0, months=(2, 6), lifespan_years=20, lag_years=1.0, scalability="high",
        co_benefits=("Stormwater management", "Water quality improvement", "Flood risk reduction", "Groundwater recharge"),
        effects=(
            Effect("bioswales", 0, "NDVI", "add", 0.06, 0.03, 0.1),
            Effect("bioswales", 1, "MNDWI", "add", 0.03, 0.01, 0.06),
            Effect("bioswales", 2, "Impervious_Frac", "add", -0.04, -0.08, -0.02),
            Effect("bioswales", 3, "NDBI", "add", -0.03, -0.05, -0.01),
            Effect("bioswales", 4, "Green_Space_Density", "add", 0.04, 0.02, 0.08),
        ),
    ),
    Intervention(
        id="urban_agriculture", name="Urban Agriculture", category="green",
        cool_min=0.5, cool_typical=1.0, cool_max=2.0, unit_cost=8000.0, cost_unit="USD/hectare",
        feasibility=0.75, suitability="high", applicable_lulc=(50, 60, 30),
        annual_maintenance=1500.0, months=(2, 6), lifespan_years=15, lag_years=0.5, scalability="medium",
        co_benefits=("Food security", "Community engagement", "Income generation", "Educational value"),
        effects=(
            Effect("urban_agriculture", 0, "NDVI", "add", 0.12, 0.06, 0.2),
            Effect("urban_agriculture", 1, "NDBI", "add", -0.06, -0.1, -0.03),
            Effect("urban_agriculture", 2, "Impervious_Frac", "add", -0.1, -0.18, -0.05),
            Effect("urban_agriculture", 3, "Green_Space_Density", "add", 0.1, 0.05, 0.18),
        ),
    ),
    Intervention(
        id="cool_roofs", name="Cool Roofs", category="white",
        cool_min=0.5, cool_typical=1.5, cool_max=3.0, unit_cost=15.0, cost_unit="USD/sqm",
        feasibility=0.95, suitability="very_high", applicable_lulc=(50,),
        annual_maintenance=1.0, months=(0, 2), lifespan_years=15, lag_years=0.0, scalability="very_high",
        co_benefits=("20-40% AC energy savings", "Extended roof membrane life", "Peak demand reduction", "Quick implementation"),
        effects=(
            Effect("cool_roofs", 0, "Albedo", "set_max", 0.7, 0.55, 0.8),
            Effect("cool_roofs", 1, "NDBI", "add", -0.03, -0.06, -0.01),
            Effect("cool_roofs", 2, "Anthropogenic_Heat", "multiply", 0.8, 0.7, 0.88),
            Effect("cool_roofs", 3, "SolarRadiation", "multiply", 0.85, 0.75, 0.92),
        ),
    ),
    Intervention(
        id="reflective_roof_coatings", name="Reflective Roof Coatings", category="white",
        cool_min=0.3, cool_typical=1.0, cool_max=2.0, unit_cost=5.0, cost_unit="USD/sqm",
        feasibility=0.95, suitability="very_high", applicable_lulc=(50,),
        annual_maintenance=2.0, months=(0, 1), lifespan_years=5, lag_years=0.0, scalability="very_high",
        co_benefits=("Very low cost", "Community-applied (unskilled labor)", "Quick implementation", "Traditional practice in India"),
        effects=(
            Effect("reflective_roof_coatings", 0, "Albedo", "set_max", 0.6, 0.45, 0.7),
            Effect("reflective_roof_coatings", 1, "Anthropogenic_Heat", "multiply", 0.85, 0.78, 0.92),
        ),
    ),
    Intervention(
        id="cool_pavements", name="Cool Pavements", category="white",
        cool_min=0.5, cool_typical=1.2, cool_max=2.5, unit_cost=25.0, cost_unit="USD/sqm",
        feasibility=0.8, suitability="high", applicable_lulc=(50,),
        annual_maintenance=2.0, months=(1, 6), lifespan_years=10, lag_years=0.0, scalability="high",
        co_benefits=("Reduced tire wear", "Better night visibility", "Lower street-level air temperature", "Reduced stormwater runoff"),
        effects=(
            Effect("cool_pavements", 0, "Albedo", "add", 0.15, 0.1, 0.25),
            Effect("cool_pavements", 1, "NDBI", "add", -0.02, -0.05, -0.01),
            Effect("cool_pavements", 2, "Impervious_Frac", "add", -0.02, -0.05, 0.0),
        ),
    ),
    Intervention(
        id="reflective_concrete", name="Reflective Concrete", category="white",
        cool_min=0.3, cool_typical=0.8, cool_max=1.5, unit_cost=35.0, cost_unit="USD/sqm",
        feasibility=0.75, suitability="high", applicable_lulc=(50,),
        annual_maintenance=1.0, months=(1, 4), lifespan_years=20, lag_years=0.0, scalability="high",
        co_benefits=("Durable surface", "Reduced lighting needs (reflective)", "Lower maintenance than asphalt"),
        effects=(
            Effect("reflective_concrete", 0, "Albedo", "add", 0.12, 0.08, 0.2),
            Effect("reflective_concrete", 1, "NDBI", "add", -0.01, -0.03, 0.0),
        ),
    ),
    Intervention(
        id="high_albedo_materials", name="High Albedo Materials", category="white",
        cool_min=0.2, cool_typical=0.7, cool_max=1.5, unit_cost=10.0, cost_unit="USD/sqm",
        feasibility=0.9, suitability="very_high", applicable_lulc=(50,),
        annual_maintenance=1.0, months=(0, 3), lifespan_years=10, lag_years=0.0, scalability="very_high",
        co_benefits=("Reduced cooling energy", "Improved visual comfort", "Low-tech solution"),
        effects=(
            Effect("high_albedo_materials", 0, "Albedo", "add", 0.1, 0.05, 0.18),
            Effect("high_albedo_materials", 1, "Anthropogenic_Heat", "multiply", 0.9, 0.85, 0.95),
        ),
    ),
    Intervention(
        id="lake_restoration", name="Lake Restoration", category="blue",
        cool_min=2.0, cool_typical=3.5, cool_max=6.0, unit_cost=500000.0, cost_unit="USD/lake",
        feasibility=0.5, suitability="very_high", applicable_lulc=(50, 60, 80),
        annual_maintenance=25000.0, months=(12, 36), lifespan_years=50, lag_years=1.0, scalability="low",
        co_benefits=("Groundwater recharge", "Flood buffering", "Biodiversity habitat", "Recreational amenity", "Cultural/heritage value"),
        effects=(
            Effect("lake_restoration", 0, "MNDWI", "add", 0.25, 0.15, 0.4),
            Effect("lake_restoration", 1, "NDVI", "add", 0.05, 0.02, 0.1),
            Effect("lake_restoration", 2, "Impervious_Frac", "add", -0.15, -0.25, -0.08),
            Effect("lake_restoration", 3, "Dist_Water", "multiply", 0.3, 0.15, 0.5),
            Effect("lake_restoration", 4, "Humidity", "add", 3.0, 1.0, 5.0),
        ),
    ),
    Intervention(
        id="urban_wetlands", name="Urban Wetlands", category="blue",
        cool_min=1.5, cool_typical=2.5, cool_max=4.0, unit_cost=100000.0, cost_unit="USD/hectare",
        feasibility=0.55, suitability="high", applicable_lulc=(60, 30, 80),
        annual_maintenance=5000.0, months=(6, 24), lifespan_years=40, lag_years=2.0, scalability="low",
        co_benefits=("Natural water filtration", "Flood attenuation", "Biodiversity habitat", "Carbon sequestration"),
        effects=(
            Effect("urban_wetlands", 0, "MNDWI", "add", 0.2, 0.1, 0.3),
            Effect("urban_wetlands", 1, "NDVI", "add", 0.15, 0.08, 0.25),
            Effect("urban_wetlands", 2, "Impervious_Frac", "add", -0.12, -0.2, -0.06),
            Effect("urban_wetlands", 3, "Dist_Water", "multiply", 0.4, 0.2, 0.6),
            Effect("urban_wetlands", 4, "Humidity", "add", 2.0, 1.0, 4.0),
            Effect("urban_wetlands", 5, "Green_Space_Density", "add", 0.12, 0.06, 0.2),
        ),
    ),
    Intervention(
        id="ponds", name="Ponds / Retention Basins", category="blue",
        cool_min=0.5, cool_typical=1.5, cool_max=2.5, unit_cost=30000.0, cost_unit="USD/pond",
        feasibility=0.7, suitability="high", applicable_lulc=(50, 60, 30),
        annual_maintenance=2000.0, months=(3, 12), lifespan_years=30, lag_years=0.5, scalability="medium",
        co_benefits=("Stormwater retention", "Aesthetic value", "Microclimate regulation", "Aquaculture potential"),
        effects=(
            Effect("ponds", 0, "MNDWI", "add", 0.1, 0.05, 0.18),
            Effect("ponds", 1, "Dist_Water", "multiply", 0.5, 0.3, 0.7),
            Effect("ponds", 2, "Impervious_Frac", "add", -0.05, -0.1, -0.02),
            Effect("ponds", 3, "Humidity", "add", 1.5, 0.5, 3.0),
        ),
    ),
    Intervention(
        id="rain_gardens", name="Rain Gardens", category="blue",
        cool_min=0.3, cool_typical=0.7, cool_max=1.5, unit_cost=40.0, cost_unit="USD/sqm",
        feasibility=0.8, suitability="high", applicable_lulc=(50, 30),
        annual_maintenance=3.0, months=(1, 4), lifespan_years=15, lag_years=1.0, scalability="high",
        co_benefits=("Stormwater infiltration", "Groundwater recharge", "Pollutant removal", "Beautification"),
        effects=(
            Effect("rain_gardens", 0, "NDVI", "add", 0.06, 0.03, 0.12),
            Effect("rain_gardens", 1, "MNDWI", "add", 0.04, 0.02, 0.08),
            Effect("rain_gardens", 2, "Impervious_Frac", "add", -0.05, -0.1, -0.02),
            Effect("rain_gardens", 3, "NDBI", "add", -0.02, -0.04, -0.01),
        ),
    ),
    Intervention(
        id="permeable_pavements", name="Permeable Pavements", category="blue",
        cool_min=0.3, cool_typical=1.0, cool_max=2.0, unit_cost=45.0, cost_unit="USD/sqm",
        feasibility=0.75, suitability="high", applicable_lulc=(50,),
        annual_maintenance=3.0, months=(1, 4), lifespan_years=20, lag_years=0.0, scalability="high",
        co_benefits=("Stormwater infiltration", "Groundwater recharge", "Reduced flooding", "Reduced tire noise"),
        effects=(
            Effect("permeable_pavements", 0, "Impervious_Frac", "add", -0.1, -0.18, -0.05),
            Effect("permeable_pavements", 1, "NDBI", "add", -0.03, -0.06, -0.01),
            Effect("permeable_pavements", 2, "MNDWI", "add", 0.02, 0.01, 0.04),
        ),
    ),
    Intervention(
        id="rainwater_harvesting", name="Rainwater Harvesting", category="blue",
        cool_min=0.1, cool_typical=0.3, cool_max=0.5, unit_cost=2000.0, cost_unit="USD/system",
        feasibility=0.9, suitability="very_high", applicable_lulc=(50,),
        annual_maintenance=100.0, months=(1, 3), lifespan_years=20, lag_years=0.0, scalability="very_high",
        co_benefits=("Water security", "Reduced water bills", "Flood reduction", "Mandatory in many Indian cities"),
        effects=(
            Effect("rainwater_harvesting", 0, "Impervious_Frac", "add", -0.02, -0.05, 0.0),
            Effect("rainwater_harvesting", 1, "Humidity", "add", 0.5, 0.2, 1.0),
        ),
    ),
    Intervention(
        id="water_channels", name="Water Channels / Urban Canals", category="blue",
        cool_min=1.0, cool_typical=1.8, cool_max=3.0, unit_cost=200.0, cost_unit="USD/linear meter",
        feasibility=0.55, suitability="high", applicable_lulc=(50,),
        annual_maintenance=10.0, months=(6, 18), lifespan_years=30, lag_years=0.0, scalability="medium",
        co_benefits=("Transportation (some cases)", "Aesthetic/heritage value", "Linear green corridor potential", "Stormwater conveyance"),
        effects=(
            Effect("water_channels", 0, "MNDWI", "add", 0.08, 0.04, 0.15),
            Effect("water_channels", 1, "Dist_Water", "multiply", 0.5, 0.3, 0.7),
            Effect("water_channels", 2, "Humidity", "add", 1.5, 0.8, 2.5),
            Effect("water_channels", 3, "Impervious_Frac", "add", -0.03, -0.06, -0.01),
        ),
    ),
    Intervention(
        id="fountains", name="Fountains / Water Features", category="blue",
        cool_min=0.5, cool_typical=1.0, cool_max=2.0, unit_cost=10000.0, cost_unit="USD/fountain",
        feasibility=0.75, suitability="medium", applicable_lulc=(50,),
        annual_maintenance=1500.0, months=(1, 6), lifespan_years=15, lag_years=0.0, scalability="high",
        co_benefits=("Aesthetic enhancement", "White noise (masks traffic)", "Psychological cooling", "Tourism attraction"),
        effects=(
            Effect("fountains", 0, "MNDWI", "add", 0.02, 0.01, 0.04),
            Effect("fountains", 1, "Humidity", "add", 1.0, 0.5, 2.0),
        ),
    ),
    Intervention(
        id="misting_systems", name="Misting Systems", category="blue",
        cool_min=1.0, cool_typical=2.5, cool_max=4.0, unit_cost=5000.0, cost_unit="USD/system",
        feasibility=0.8, suitability="medium", applicable_lulc=(50,),
        annual_maintenance=500.0, months=(0, 2), lifespan_years=10, lag_years=0.0, scalability="high",
        co_benefits=("Immediate relief", "Low infrastructure requirement", "Portable/modular", "Dust suppression"),
        effects=(
            Effect("misting_systems", 0, "Humidity", "add", 5.0, 2.0, 10.0),
            Effect("misting_systems", 1, "AirTemp", "add", -1.5, -3.0, -0.5),
        ),
    ),
    Intervention(
        id="wind_corridors", name="Wind Corridors", category="grey",
        cool_min=1.0, cool_typical=2.0, cool_max=3.5, unit_cost=50000.0, cost_unit="USD/corridor",
        feasibility=0.4, suitability="high", applicable_lulc=(50,),
        annual_maintenance=1000.0, months=(12, 60), lifespan_years=50, lag_years=0.0, scalability="low",
        co_benefits=("Improved air quality", "Natural ventilation for buildings", "Reduced AC dependency", "Pedestrian comfort"),
        effects=(
            Effect("wind_corridors", 0, "WindSpeed", "multiply", 1.3, 1.15, 1.5),
            Effect("wind_corridors", 1, "Building_Density", "multiply", 0.85, 0.75, 0.92),
            Effect("wind_corridors", 2, "Surface_Roughness", "multiply", 0.8, 0.7, 0.9),
        ),
    ),
    Intervention(
        id="building_spacing", name="Building Spacing Optimization", category="grey",
        cool_min=0.5, cool_typical=1.5, cool_max=2.5, unit_cost=0.0, cost_unit="policy instrument",
        feasibility=0.45, suitability="medium", applicable_lulc=(50,),
        annual_maintenance=0.0, months=(6, 36), lifespan_years=50, lag_years=0.0, scalability="low",
        co_benefits=("Better daylighting", "Natural ventilation", "Reduced canyon heating effect", "Improved living conditions"),
        effects=(
            Effect("building_spacing", 0, "Building_Density", "multiply", 0.8, 0.7, 0.9),
            Effect("building_spacing", 1, "Building_Volume", "multiply", 0.85, 0.75, 0.92),
            Effect("building_spacing", 2, "WindSpeed", "multiply", 1.15, 1.05, 1.25),
            Effect("building_spacing", 3, "Surface_Roughness", "multiply", 0.85, 0.75, 0.92),
        ),
    ),
    Intervention(
        id="street_canyon_optimization", name="Street Canyon Optimization", category="grey",
        cool_min=0.5, cool_typical=1.0, cool_max=2.0, unit_cost=0.0, cost_unit="policy instrument",
        feasibility=0.4, suitability="medium", applicable_lulc=(50,),
        annual_maintenance=0.0, months=(12, 48), lifespan_years=50, lag_years=0.0, scalability="low",
        co_benefits=("Daytime shading in summer", "Improved pedestrian comfort", "Architectural diversity"),
        effects=(
            Effect("street_canyon_optimization", 0, "Building_Height", "multiply", 0.9, 0.8, 0.95),
            Effect("street_canyon_optimization", 1, "WindSpeed", "multiply", 1.1, 1.05, 1.2),
        ),
    ),
    Intervention(
        id="artificial_shading", name="Artificial Shading Structures", category="grey",
        cool_min=1.0, cool_typical=2.5, cool_max=4.0, unit_cost=80.0, cost_unit="USD/sqm",
        feasibility=0.85, suitability="very_high", applicable_lulc=(50,),
        annual_maintenance=5.0, months=(1, 4), lifespan_years=15, lag_years=0.0, scalability="high",
        co_benefits=("UV protection", "Solar energy generation (if PV panels)", "Rain shelter", "Immediate effect"),
        effects=(
            Effect("artificial_shading", 0, "SolarRadiation", "multiply", 0.7, 0.55, 0.85),
            Effect("artificial_shading", 1, "Anthropogenic_Heat", "multiply", 0.88, 0.8, 0.93),
        ),
    ),
    Intervention(
        id="pergolas", name="Pergolas / Shade Corridors", category="grey",
        cool_min=0.5, cool_typical=1.5, cool_max=2.5, unit_cost=100.0, cost_unit="USD/sqm",
        feasibility=0.8, suitability="high", applicable_lulc=(50,),
        annual_maintenance=5.0, months=(1, 3), lifespan_years=20, lag_years=0.0, scalability="high",
        co_benefits=("Aesthetic improvement", "Pedestrian comfort", "Green corridor potential", "Flexible design"),
        effects=(
            Effect("pergolas", 0, "SolarRadiation", "multiply", 0.75, 0.6, 0.85),
            Effect("pergolas", 1, "NDVI", "add", 0.03, 0.01, 0.06),
        ),
    ),
    Intervention(
        id="jaali_structures", name="Jaali (Lattice Screen) Structures", category="grey",
        cool_min=0.5, cool_typical=1.0, cool_max=2.0, unit_cost=60.0, cost_unit="USD/sqm",
        feasibility=0.75, suitability="very_high", applicable_lulc=(50,),
        annual_maintenance=2.0, months=(1, 4), lifespan_years=25, lag_years=0.0, scalability="medium",
        co_benefits=("Cultural heritage preservation", "Privacy screening", "Wind velocity modulation", "Aesthetic/architectural value"),
        effects=(
            Effect("jaali_structures", 0, "SolarRadiation", "multiply", 0.8, 0.65, 0.9),
            Effect("jaali_structures", 1, "WindSpeed", "multiply", 1.05, 1.02, 1.1),
            Effect("jaali_structures", 2, "Anthropogenic_Heat", "multiply", 0.92, 0.88, 0.96),
        ),
    ),
    Intervention(
        id="building_orientation", name="Building Orientation Optimization", category="grey",
        cool_min=0.3, cool_typical=0.8, cool_max=1.5, unit_cost=0.0, cost_unit="design parameter",
        feasibility=0.6, suitability="high", applicable_lulc=(50,),
        annual_maintenance=0.0, months=(0, 0), lifespan_years=50, lag_years=0.0, scalability="medium",
        co_benefits=("Natural daylighting", "Cross ventilation", "Solar PV optimization", "No additional cost"),
        effects=(
            Effect("building_orientation", 0, "SolarRadiation", "multiply", 0.85, 0.75, 0.92),
            Effect("building_orientation", 1, "WindSpeed", "multiply", 1.1, 1.05, 1.18),
            Effect("building_orientation", 2, "Anthropogenic_Heat", "multiply", 0.9, 0.85, 0.95),
        ),
    ),
    Intervention(
        id="ventilation_corridors", name="Ventilation Corridors", category="grey",
        cool_min=0.5, cool_typical=1.5, cool_max=2.5, unit_cost=30000.0, cost_unit="USD/corridor",
        feasibility=0.35, suitability="medium", applicable_lulc=(50,),
        annual_maintenance=500.0, months=(12, 48), lifespan_years=50, lag_years=0.0, scalability="low",
        co_benefits=("Air quality improvement", "Pedestrian/cyclist pathway", "Green belt potential", "Noise buffering"),
        effects=(
            Effect("ventilation_corridors", 0, "WindSpeed", "multiply", 1.2, 1.1, 1.35),
            Effect("ventilation_corridors", 1, "Building_Density", "multiply", 0.9, 0.8, 0.95),
            Effect("ventilation_corridors", 2, "Surface_Roughness", "multiply", 0.85, 0.75, 0.92),
        ),
    ),
    Intervention(
        id="impervious_surface_reduction", name="Impervious Surface Reduction", category="grey",
        cool_min=0.5, cool_typical=1.2, cool_max=2.5, unit_cost=30.0, cost_unit="USD/sqm",
        feasibility=0.75, suitability="high", applicable_lulc=(50,),
        annual_maintenance=2.0, months=(2, 8), lifespan_years=20, lag_years=0.0, scalability="high",
        co_benefits=("Stormwater management", "Groundwater recharge", "Reduced flooding", "Soil health improvement"),
        effects=(
            Effect("impervious_surface_reduction", 0, "Impervious_Frac", "add", -0.15, -0.25, -0.08),
            Effect("impervious_surface_reduction", 1, "NDBI", "add", -0.05, -0.1, -0.02),
            Effect("impervious_surface_reduction", 2, "NDVI", "add", 0.05, 0.02, 0.1),
            Effect("impervious_surface_reduction", 3, "Albedo", "add", 0.05, 0.02, 0.1),
        ),
    ),
)


def catalogue() -> tuple[Intervention, ...]:
    """All interventions in catalogue order."""
    return CATALOGUE


def interventions_table(spark: SparkSession) -> DataFrame:
    """One row per intervention. A dimension of fixed size: safe to broadcast."""
    rows = [
        (
            pos, i.id, i.name, i.category, (i.cool_min, i.cool_max, i.cool_typical),
            (i.unit_cost, i.cost_unit, i.annual_maintenance), i.months, i.lifespan_years, i.lag_years, i.feasibility, i.scalability, i.suitability, list(i.applicable_lulc),
            list(i.co_benefits), [e.feature for e in i.effects],
        )
        for pos, i in enumerate(catalogue())
    ]
    return local_table(
        spark, rows,
        "pos INT, id STRING, name STRING, category STRING,"
        " cooling_potential_celsius STRUCT<min: DOUBLE, max: DOUBLE, typical: DOUBLE>,"
        " cost_per_unit STRUCT<value: DOUBLE, unit: STRING, annual_maintenance: DOUBLE>,"
        " implementation_time_months STRUCT<min: INT, max: INT>, lifespan_years INT, effectiveness_lag_years DOUBLE,"
        " feasibility_score DOUBLE, scalability STRING, indian_suitability STRING, applicable_lulc ARRAY<INT>, co_benefits ARRAY<STRING>,"
        " effect_features ARRAY<STRING>",
    )


def effects_table(spark: SparkSession) -> DataFrame:
    """Long table of effects, `seq` being the order inside one intervention."""
    rows = [
        (e.intervention_id, e.seq, e.feature, e.mode, e.value, e.lo, e.hi)
        for i in catalogue() for e in i.effects
    ]
    return local_table(
        spark, rows,
        "intervention_id STRING, seq INT, feature STRING, mode STRING, value DOUBLE, lo DOUBLE, hi DOUBLE",
    )
