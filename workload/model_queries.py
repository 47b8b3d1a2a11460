"""Queries on models, composed plans, readers and writers."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F, types as T

from heatgrid import schema as S
from heatgrid.catalog import interventions_table
from heatgrid.functions.numeric import hash_uniform_sql
from heatgrid.operators import composite, hotspots, interventions as iv, ml, sampling, score
from heatgrid.operators.quantiles import column_medians
from heatgrid.operators.support import checkpointed, shared_folder
from heatgrid.plans import cooling, dataset, scene, train
from heatgrid.sources import bundle as bundles, readers, writers
from workload.base import pixels, query, r6, rounded, s6, scenes, table, with_pixels, with_scenes
from workload.clean_queries import clip_sql
from workload.package_queries import FEATURES, hotspots, predictor


def scratch(spark, name: str) -> str:
    """A new folder next to the session's checkpoints (shared storage on a cluster)."""
    return f"{shared_folder(spark).rstrip('/')}/heatgrid-{name}-{uuid.uuid4().hex}"


# --- metrics and selection ---------------------------------------------------------------------------------

_CORR = {"NDVI": '"NDVI"', "veg": '"NDVI" * 0.5e0 + "Albedo" * 0.01e0', "Slope": '"Slope"', "steep": '"Slope" * 3e0 + "NDVI" * 0.1e0', "Humidity": '"Humidity"'}
_CNAMES = list(_CORR)


def _corr_drop() -> str:
    out = []
    for j, b in enumerate(_CNAMES):
        for a in _CNAMES[:j]:
            out.append(f"SELECT CASE WHEN var_samp({b}) >= var_samp({a}) THEN '{a}' ELSE '{b}' END AS f FROM cr HAVING abs(corr({a}, {b})) > 0.95")
    return " UNION ALL ".join(out)


@query("correlation_filter", with_pixels(f"""SELECT "PixelID", (SELECT string_agg(n, ',' ORDER BY i) FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(_CNAMES))}) t(i, n)
    WHERE n NOT IN (SELECT f FROM ({_corr_drop()}))) AS kept FROM px""",
    f"""cr AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _CORR.items())} FROM px WHERE "NDVI" IS NOT NULL)"""))
def correlation_filter(spark, sf):
    df = pixels(spark, sf)
    named = df.select(*[F.expr(e.replace('"', "`")).alias(n) for n, e in _CORR.items()])
    kept, _ = ml.correlation_filter(named, _CNAMES)
    return df.select("PixelID", F.lit(",".join(kept)).alias("kept"))


@query("classification_metrics", f"""WITH k AS (SELECT class, count(*) FILTER (quality = class) AS support, count(*) FILTER (toxic = class) AS predicted,
    count(*) FILTER (quality = class AND toxic = class) AS hit FROM labels, (SELECT unnest([0, 1]) AS class) GROUP BY 1),
    q AS (SELECT *, COALESCE(hit / NULLIF(CAST(predicted AS DOUBLE), 0), 0) AS p, COALESCE(hit / NULLIF(CAST(support AS DOUBLE), 0), 0) AS r FROM k)
    SELECT {s6('sum(hit) / sum(support)')} AS accuracy, {s6('sum(p * support) / sum(support)')} AS precision, {s6('sum(r * support) / sum(support)')} AS recall,
    {s6('sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support)')} AS f1, count(*) - 2 AS roc_auc FROM q""")
def classification_metrics(spark, sf):
    df = table(spark, sf, "labels").select(F.col("quality").cast("double").alias("t"), F.col("toxic").cast("double").alias("p"))
    m = ml.classification_metrics(df, "t", "p")
    return df.limit(1).select(*[r6(F.lit(float(v))).alias(k) for k, v in m.items()])


_P3 = [f"""CAST(("PixelID" * {k}) % {p} AS DOUBLE) / {p}e0""" for k, p in ((7919, 1999), (6151, 1997), (4799, 1993))]


@query("ovr_auc", with_pixels(f"""SELECT class, {s6('sum(pos * (below + 0.5e0 * neg)) / (sum(pos) * sum(neg))')} AS auc, CAST(sum(pos) AS BIGINT) AS support FROM
    (SELECT class, p, pos, neg, COALESCE(sum(neg) OVER (PARTITION BY class ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM
     (SELECT class, p, count(*) FILTER (t = class) AS pos, count(*) FILTER (t <> class) AS neg FROM (""" + " UNION ALL ".join(
    f"""SELECT "LULC_DW" % 3 AS t, {i} AS class, {e} AS p FROM px""" for i, e in enumerate(_P3)) + ") GROUP BY 1, 2)) GROUP BY 1"))
def ovr_auc(spark, sf):
    df = pixels(spark, sf).select((F.col("LULC_DW") % 3).alias("t"), F.array(*[F.expr(e.replace('"', "`")) for e in _P3]).alias("p"))
    return rounded(ml.ovr_auc(df, "t", "p", [0, 1, 2]))


@query("select_model", with_pixels(f"""SELECT model, round_even(0.4e0 * greatest(r2, 0e0) + 0.3e0 * f1 + 0.2e0 * roc_auc + 0.1e0 * (1 - rmse / (SELECT max(rmse) FROM mt)), 4) AS composite FROM mt""",
    f"""mt AS (SELECT CAST("LULC_ESA" AS VARCHAR) AS model, {s6('stddev_samp("LST")')} AS rmse, {s6('corr("LST", "Slope")')} AS r2, {s6('avg("Albedo")')} AS f1, {s6('avg("UTFVI")')} AS roc_auc FROM px GROUP BY 1)"""))
def select_model(spark, sf):
    """Statistics per land cover stand in for the metrics of competing models."""
    m = pixels(spark, sf).groupBy(F.col("LULC_ESA").cast("string").alias("model")).agg(
        F.stddev_samp("LST").alias("rmse"), F.corr("LST", "Slope").alias("r2"), F.avg("Albedo").alias("f1"), F.avg("UTFVI").alias("roc_auc"))
    return ml.select_model(rounded(m)).select("model", "composite")


# --- models: no SQL twin ---------------------------------------------------------------------------------------

MODEL_FEATURES = ["UHI_Intensity", "Anthropogenic_Heat", "NDVI", "NDBI", "Building_Density", "Albedo"]


def small_models():
    return {
        "RandomForest": (RandomForestRegressor(labelCol="HeatScore", featuresCol="_v", numTrees=10, maxDepth=6, seed=42),
                         RandomForestClassifier(labelCol="HeatClass", featuresCol="_v", numTrees=10, maxDepth=6, seed=42)),
        "DecisionTree": (DecisionTreeRegressor(labelCol="HeatScore", featuresCol="_v", maxDepth=6, seed=42),
                         DecisionTreeClassifier(labelCol="HeatClass", featuresCol="_v", maxDepth=6, seed=42)),
    }


def boosted():
    return {"GradientBoosting": (
        GBTRegressor(labelCol="HeatScore", featuresCol="_v", maxIter=5, maxDepth=4, seed=42),
        OneVsRest(labelCol="HeatClass", featuresCol="_v", classifier=GBTClassifier(maxIter=3, maxDepth=3, seed=42)))}


def training(spark, sf):
    df = score.score_and_class(pixels(spark, sf)).where(F.col("HeatScore").isNotNull())
    ready = ml.fill_with_medians(df, MODEL_FEATURES).select("PixelID", *MODEL_FEATURES, "HeatScore", "HeatClass")
    return checkpointed(sampling.stratified_split(ready, label="HeatClass"))


def small_bundle(spark, sf):
    parts = training(spark, sf).where("split = 'train'")
    _, fitted = ml.fit_models(parts, parts, MODEL_FEATURES, {"DecisionTree": small_models()["DecisionTree"]})
    reg, cls = fitted["DecisionTree"]
    medians = {r["feature"]: r["median"] for r in column_medians(pixels(spark, sf), MODEL_FEATURES).collect()}
    return ml.Bundle(reg, cls, MODEL_FEATURES, best_name="DecisionTree", medians=medians)


@query("fit_models")
def fit_models(spark, sf):
    parts = training(spark, sf)
    metrics, _ = ml.fit_models(parts.where("split = 'train'"), parts.where("split = 'test'"), MODEL_FEATURES, small_models() | boosted())
    return rounded(metrics.drop("fit_seconds_reg", "fit_seconds_cls"))


@query("recursive_elimination")
def recursive_elimination(spark, sf):
    parts = training(spark, sf)
    _, history = ml.recursive_elimination(parts, MODEL_FEATURES, min_features=4, folds=2, trees=5, depth=4)
    return rounded(history.withColumn("features", F.array_join("features", ",")))


@query("permutation_importance")
def permutation_importance(spark, sf):
    parts = training(spark, sf)
    _, fitted = ml.fit_models(parts, parts, MODEL_FEATURES, {"DecisionTree": small_models()["DecisionTree"]})
    return rounded(ml.permutation_importance(fitted["DecisionTree"][0], parts, MODEL_FEATURES, repeats=10))


# A tree deep enough for every pair of two land-cover codes predicts the pair's mean; the class is a function of one of them.
_CODES = ["LULC_ESA", "LULC_DW"]
_CODE_CLASS = 'CASE "LULC_ESA" WHEN 10 THEN 0 WHEN 30 THEN 1 WHEN 50 THEN 2 ELSE 3 END'
_CODE_MEANS = 'cm AS (SELECT "LULC_ESA", "LULC_DW", avg("LST") AS m FROM px WHERE "LST" IS NOT NULL GROUP BY 1, 2)'
_CODE_LABELS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.HEAT_LABELS.items())


def fitted_on_codes(spark, sf):
    """Metrics and the fitted pair of a tree over two codes."""
    rows = pixels(spark, sf).where(F.col("LST").isNotNull()).select("PixelID", *_CODES, F.col("LST").alias("HeatScore"), F.expr(_CODE_CLASS.replace('"', "`")).alias("HeatClass"))
    tree = {"DecisionTree": tuple(kind(labelCol=label, featuresCol="_v", maxDepth=20, seed=42) for kind, label in (
        (DecisionTreeRegressor, "HeatScore"), (DecisionTreeClassifier, "HeatClass")))}
    metrics, fitted = ml.fit_models(rows, rows, _CODES, tree)
    return metrics, fitted["DecisionTree"]


@query("fit_on_codes", with_pixels(f"""SELECT 'DecisionTree' AS model, {s6('sqrt(avg(e * e))')} AS rmse, {s6('avg(abs(e))')} AS mae, {s6('1e0 - sum(e * e) / sum((y - a) * (y - a))')} AS r2,
    1e0 AS accuracy, 1e0 AS f1 FROM (SELECT "LST" AS y, "LST" - m AS e, avg("LST") OVER () AS a FROM px JOIN cm USING ("LULC_ESA", "LULC_DW") WHERE "LST" IS NOT NULL)""", _CODE_MEANS))
def fit_on_codes(spark, sf):
    return rounded(fitted_on_codes(spark, sf)[0].select("model", "rmse", "mae", "r2", "accuracy", "f1"))


@query("predict_on_codes", with_pixels(f"""SELECT "PixelID", {s6('round_even(m, 2)')} AS "HeatScore_Predicted", {_CODE_CLASS} AS "HeatClass_Predicted",
    CASE {_CODE_CLASS} {_CODE_LABELS} END AS "HeatClass_Label" FROM px JOIN cm USING ("LULC_ESA", "LULC_DW")""", _CODE_MEANS))
def predict_on_codes(spark, sf):
    """Fit, save, load and predict every pixel."""
    path, (regressor, classifier) = scratch(spark, "bundle"), fitted_on_codes(spark, sf)[1]
    bundles.save_bundle(spark, ml.Bundle(regressor, classifier, _CODES, best_name="DecisionTree", medians={}), path)
    out = ml.predict(pixels(spark, sf), bundles.load_bundle(spark, path))
    return rounded(out.select("PixelID", "HeatScore_Predicted", "HeatClass_Predicted", "HeatClass_Label"))


@query("predict_bundle")
def predict_bundle(spark, sf):
    """Fit, save, load and predict every pixel."""
    path = scratch(spark, "bundle")
    bundles.save_bundle(spark, small_bundle(spark, sf), path)
    out = ml.predict(pixels(spark, sf), bundles.load_bundle(spark, path))
    return out.select("PixelID", "HeatScore_Predicted", "HeatClass_Predicted", "HeatClass_Label")


@query("train_models")
def train_models(spark, sf):
    data = ml.fill_with_medians(pixels(spark, sf).where(F.col("LST").isNotNull()), MODEL_FEATURES)
    _, ranked = train.train_models(data, features=MODEL_FEATURES, models=small_models())
    return rounded(ranked.select("model", "rmse", "r2", "f1", "roc_auc", "composite"))


@query("optimize_packages")
def optimize_packages(spark, sf):
    """As many candidates as there are parts, over all hotspots."""
    hot, city = hotspots(spark, sf)
    n = table(spark, sf, "part").count()
    out = cooling.optimize_packages(hot, FEATURES, predictor(city), n=n)
    return rounded(out.select("package_id", iv.package_label(F.col("items")).alias("label"), "predicted_reduction", "total_cost", "priority_score", "priority_rank"))


@query("run_plan")
def run_plan(spark, sf):
    n = table(spark, sf, "part").count()
    plan = cooling.run_plan(pixels(spark, sf), small_bundle(spark, sf), zones=3, n=n)
    doc = cooling.recommendations(plan, city="sample")
    return doc.select("city", "total_solutions", F.size("zone_analysis").alias("n_zones"), F.size("all_recommendations").alias("n_listed"),
                      F.col("best_recommendation")[0]["predicted_reduction"].alias("best_reduction"), plan.summary.agg(F.first("n_pixels")).scalar().alias("n_pixels"))


# --- dataset plans ------------------------------------------------------------------------------------------------

def _c(c: str) -> str:
    return f'CASE WHEN "{c}" IS NULL THEN NULL ELSE {clip_sql(c, *S.CLEANING_RANGES[c])} END AS "{c}"'


_DS = ("""fl AS (SELECT * FROM px WHERE "LST" > 0 AND "LST" < 65 AND NOT ("NDVI" IS NULL AND "NDBI" IS NULL AND "NDWI" IS NULL)
        AND ("QualityScore" >= 2 OR "QualityScore" IS NULL))""",
       "ck AS (SELECT * REPLACE (" + ", ".join(_c(c) for c in ("LST", "NDVI", "AirTemp", "Albedo", "Nighttime_Lights", "Dist_Water")) + ") FROM fl)")


@query("prepare_dataset", with_pixels(
    f"""SELECT row_number() OVER (ORDER BY "PixelID") - 1 AS "PixelID", {s6('COALESCE("AirTemp", (SELECT avg("AirTemp") FROM ck))')} AS "AirTemp", {s6('COALESCE("Dist_Water", (SELECT quantile_cont("Dist_Water", 0.95) FROM ck))')} AS "Dist_Water",
        {s6('("LST" - (SELECT avg("LST") FROM ck)) / (SELECT stddev_pop("LST") FROM ck)')} AS "LST_zscore",
        {s6('("Albedo" - (SELECT min("Albedo") FROM ck)) / (SELECT max("Albedo") - min("Albedo") FROM ck)')} AS "Albedo_norm",
        {s6('sin(radians("Aspect"))')} AS "Aspect_sin", CAST("LULC_ESA" = 50 AS INT) AS "LULC_ESA_Built_up" FROM ck""", *_DS))
def prepare_dataset(spark, sf):
    done = dataset.prepare_dataset(pixels(spark, sf).drop("row", "col"))
    return rounded(done.data.select("PixelID", "AirTemp", "Dist_Water", "LST_zscore", "Albedo_norm", "Aspect_sin", "LULC_ESA_Built_up"))


@query("dataset_metadata", with_pixels(f"""SELECT 'sample' AS city, count(*) AS total_rows, 41 AS total_columns, 37 AS raw_feature_count, {s6('avg("LST")')} AS lst_mean,
    {s6('median("Slope")')} AS slope_median FROM px"""))
def dataset_metadata(spark, sf):
    doc = dataset.dataset_metadata(pixels(spark, sf), city="sample")
    stats = F.col("feature_statistics")
    return rounded(doc.select("city", "total_rows", "total_columns", "raw_feature_count", stats["LST"]["mean"].alias("lst_mean"), stats["Slope"]["median"].alias("slope_median")))


@query("quality_report", with_pixels("""SELECT count(*) AS rows, 38 AS expected, (SELECT count(*) FROM px WHERE "Latitude" IS NULL) + 2 AS n_extra,
    count(*) - count("NDVI") AS ndvi_missing, count(CASE WHEN "NDBI" < -1 OR "NDBI" > 1 THEN 1 END) AS ndbi_outside FROM px"""))
def quality_report(spark, sf):
    doc = dataset.quality_report(pixels(spark, sf))
    return doc.select("rows", F.col("column_check.expected").alias("expected"), F.size("column_check.extra").cast("bigint").alias("n_extra"),
                      F.col("missing")["NDVI"].alias("ndvi_missing"), F.filter("range_issues", lambda x: x["feature"] == "NDBI")[0]["n_outside"].alias("ndbi_outside"))


_U42 = hash_uniform_sql('"PixelID"', 42)


@query("validated_dataset", with_pixels(f"""SELECT CASE WHEN {_U42} < 0.7 THEN 'train' WHEN {_U42} < 0.8 THEN 'val' ELSE 'test' END AS split, count(*) AS n,
    {s6('avg("LST")')} AS lst, CAST(sum(CASE WHEN "LULC_ESA" = 50 THEN 1 ELSE 0 END) AS BIGINT) AS built FROM px WHERE "LST" > 0 AND "LST" < 65 AND "NDVI" IS NOT NULL
    AND "NDBI" IS NOT NULL AND "NDWI" IS NOT NULL AND "Elevation" IS NOT NULL GROUP BY 1"""))
def validated_dataset(spark, sf):
    out = dataset.validated_dataset(pixels(spark, sf))
    return rounded(out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("LST").alias("lst"), F.sum("LULC_ESA_Built_up").alias("built")))


@query("landsat_composite", with_scenes(
    f"""SELECT "row", "col", {s6('median(b4)', 9)} AS "B4", {s6('median(st)', 6)} AS "ST", count(b4) AS "QualityScore" FROM (SELECT "row", "col",
        CASE WHEN keep THEN least(greatest(d * 0.0000275e0 - 0.2e0, 0e0), 1e0) END AS b4, CASE WHEN keep THEN d * 0.00341802e0 + 149e0 END AS st FROM
        (SELECT *, 7000e0 + "B4" % 9000e0 AS d, "QA_PIXEL" & 30 = 0 AND "QA_RADSAT" = 0 AS keep FROM sc WHERE "ts" >= TIMESTAMP '1994-01-01' AND "ts" < TIMESTAMP '1998-01-01'
         AND "cloud_pct" < 50)) GROUP BY 1, 2"""))
def landsat_composite(spark, sf):
    df = scenes(spark, sf)
    dn = F.lit(7000.0) + F.col("B4") % 9000.0
    bands = df.select("collection", "scene_id", "ts", "cloud_pct", "row", "col", "QA_PIXEL", "QA_RADSAT", *[dn.alias(b) for b in [*scene.LANDSAT_BANDS, "ST"]])
    out = scene.landsat_composite(bands.where("collection = 'landsat8'"), bands.where("collection = 'landsat9'"), start="1994-01-01", end="1998-01-01", max_cloud=50.0)
    return out.select("row", "col", r6("B4", 9).alias("B4"), r6("ST").alias("ST"), "QualityScore")


@query("weather_composite", with_pixels(
    f"""SELECT "LULC_DW" AS "row", "LULC_ESA" AS "col", {s6('avg("AirTemp")')} AS "AirTemp", {s6('sqrt(avg("WindSpeed" - 3e0) * avg("WindSpeed" - 3e0) + avg("Slope" - 6e0) * avg("Slope" - 6e0))')} AS "WindSpeed",
        {s6('sum("Rainfall")', 4)} AS "Rainfall", {s6('avg("Pressure")')} AS "Pressure" FROM px GROUP BY 1, 2"""))
def weather_composite(spark, sf):
    """Rows of one (land cover, code) pair stand in for the hours of one weather cell."""
    hourly = pixels(spark, sf).select(
        F.col("LULC_DW").alias("row"), F.col("LULC_ESA").alias("col"), (F.col("AirTemp") + 273.15).alias("temperature"), (F.col("AirTemp") + 265.0).alias("dewpoint"),
        (F.col("WindSpeed") - 3.0).alias("u_wind"), (F.col("Slope") - 6.0).alias("v_wind"), F.col("SolarRadiation").alias("solar"),
        (F.col("Pressure") * 100.0).alias("pressure"), (F.col("Rainfall") / 1000.0).alias("precipitation"))
    out = scene.weather_composite(hourly)
    return out.select("row", "col", r6("AirTemp").alias("AirTemp"), r6("WindSpeed").alias("WindSpeed"), r6("Rainfall", 4).alias("Rainfall"), r6("Pressure").alias("Pressure"))


@query("build_features")
def build_features(spark, sf):
    """The whole scene plan on the raster: statistics of the finished feature table."""
    px = pixels(spark, sf)
    surface = px.select("row", "col", "QualityScore", *[(F.col(c) / s).alias(b) for b, c, s in (
        ("B2", "Albedo", 1.0), ("B3", "Humidity", 100.0), ("B4", "Rainfall", 300.0), ("B5", "Tree_Cover_Pct", 100.0), ("B6", "Slope", 20.0), ("B7", "Albedo", 2.0))],
        (F.col("LST") + 273.15).alias("ST"))
    coarse = px.groupBy(F.floor(F.col("row") / 10.0).cast("int").alias("row"), F.floor(F.col("col") / 10.0).cast("int").alias("col")).agg(
        *[F.avg(c).alias(c) for c in ("AirTemp", "Humidity", "WindSpeed", "WindDirection", "SolarRadiation", "Pressure", "Rainfall")])
    layers = px.select("row", "col", "LULC_ESA", "LULC_DW", "Elevation", "Building_Density", "Building_Height", "Nighttime_Lights", "Population_Density",
                       F.col("LULC_DW").alias("Impervious_Year"), "Tree_Cover_Pct")
    out = scene.build_features(surface, coarse, layers, weather_ratio=10)
    names = ["LST", "NDVI", "Albedo", "AirTemp", "UHI_Intensity", "UTFVI", "Slope", "Green_Space_Density", "Surface_Roughness", "Dist_Water", "Dist_Green"]
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names]))


# --- readers and writers ------------------------------------------------------------------------------------------------

@query("csv_round_trip", with_pixels(f"""SELECT "PixelID", {s6('"LST"', 4)} AS "LST", {s6('"NDVI"', 4)} AS "NDVI", "QualityScore", "Timestamp" FROM px"""))
def csv_round_trip(spark, sf):
    """Write with four decimals, with an exporter's extra columns; read with the declared schema."""
    path = scratch(spark, "csv")
    df = pixels(spark, sf).select("PixelID", "LST", "NDVI", "QualityScore", "Timestamp", F.lit("x").alias("system:index"), F.lit("{}").alias(".geo"))
    df = df.select(*[F.round(F.col(f"`{c}`"), 4).alias(c) if c in ("LST", "NDVI") else F.col(f"`{c}`") for c in df.columns])
    df.write.option("header", True).csv(path)
    return rounded(readers.read_pixels(spark, path, fmt="csv"), 4)


@query("csv_mixed_headers", with_pixels(f"""SELECT "PixelID", {s6('"LST"', 4)} AS "LST", {s6('"NDVI"', 4)} AS "NDVI", "QualityScore",
    CASE WHEN "PixelID" % 2 = 0 THEN 'Delhi' ELSE 'Pune' END AS city FROM px"""))
def csv_mixed_headers(spark, sf):
    """Files of two cities with their columns in another order, and the city from the file's name."""
    path = scratch(spark, "mixed")
    df = pixels(spark, sf).select("PixelID", F.round("LST", 4).alias("LST"), F.round("NDVI", 4).alias("NDVI"), "QualityScore")
    for city, rest, order in (("Delhi", 0, ["PixelID", "LST", "NDVI", "QualityScore"]), ("Pune", 1, ["NDVI", "QualityScore", "LST", "PixelID"])):
        df.where(F.col("PixelID") % 2 == rest).select(*order).write.option("header", True).csv(f"{path}/{city}_2024")
    read = readers.read_pixels(spark, [f"{path}/Delhi_2024", f"{path}/Pune_2024"], fmt="csv")
    city = readers.city_name(F.regexp_replace(F.input_file_name(), "/[^/]*$", ""))
    return rounded(read.select("PixelID", "LST", "NDVI", "QualityScore", city.alias("city")), 4)


@query("write_csv", with_pixels("""SELECT "PixelID", printf('%.4f', "Slope") AS "Slope", printf('%.4f', "NDVI") AS "NDVI" FROM px"""))
def write_csv(spark, sf):
    path = scratch(spark, "fixed")
    writers.write_csv(pixels(spark, sf).select("PixelID", "Slope", "NDVI"), path)
    return spark.read.schema("PixelID BIGINT, Slope STRING, NDVI STRING").option("header", True).csv(path)


@query("read_collection", with_scenes(f"""SELECT "collection", "row", "col", count(*) AS n, {s6('sum("B4")', 2)} AS total FROM sc WHERE "collection" = 'landsat8' GROUP BY 1, 2, 3"""))
def read_collection(spark, sf):
    path = scratch(spark, "scenes")
    scenes(spark, sf).write.partitionBy("collection").parquet(path)
    df = readers.read_collection(spark, path, "landsat8", ["B4"])
    return df.groupBy("collection", "row", "col").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("B4"), 2).alias("total"))


@query("write_layers", with_pixels(f"""SELECT 'Slope' AS layer, "row", "col", {s6('"Slope"')} AS value FROM px UNION ALL
    SELECT 'NDVI', "row", "col", {s6('"NDVI"')} FROM px WHERE "NDVI" IS NOT NULL"""))
def write_layers(spark, sf):
    path = scratch(spark, "layers")
    writers.write_layers(pixels(spark, sf), path, ["Slope", "NDVI"], {"pair": ["Slope", "NDVI"]})
    return rounded(spark.read.parquet(path).select("layer", "row", "col", "value"))


_DOC = "PixelID BIGINT, LST DOUBLE, flags STRUCT<hot: BOOLEAN, code: INT>"


@query("json_documents", with_pixels(f"""SELECT "PixelID", {s6('"LST"')} AS "LST", "LST" > 40 AS hot, "LULC_ESA" AS code FROM px"""))
def json_documents(spark, sf):
    """Nested documents written and looked up again; a path without a document gives no rows."""
    path = scratch(spark, "docs")
    doc = pixels(spark, sf).select("PixelID", "LST", F.struct((F.col("LST") > 40).alias("hot"), F.col("LULC_ESA").alias("code")).alias("flags"))
    writers.write_json_doc(doc, path)
    schema = T.StructType.fromDDL(_DOC)
    found = readers.result_lookup(spark, path, schema).unionByName(readers.result_lookup(spark, path + "-absent", schema))
    return rounded(found.select("PixelID", "LST", "flags.hot", "flags.code"))


_GEO = ("type STRING, geometry STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>, properties STRUCT<PixelID: BIGINT, NDVI: DOUBLE, LULC_ESA: INT>")


@query("geojson_polygons", with_pixels(f"""SELECT 'Feature' AS kind, 'Polygon' AS shape, "PixelID", {s6('"NDVI"')} AS "NDVI", "LULC_ESA", 5 AS n_vertices,
    {s6('"Longitude" - 5.25e-4 / cos(radians((SELECT avg("Latitude") FROM px)))')} AS west, {s6('"Latitude" + 5.25e-4')} AS north, "NDVI" IS NULL AS ndvi_null FROM px"""))
def geojson_polygons(spark, sf):
    df = writers.geojson_features(pixels(spark, sf), ["PixelID", "NDVI", "LULC_ESA", "absent"], cell_deg=0.00105)
    doc = df.select(F.from_json("feature", _GEO).alias("x"), F.col("feature").contains('"NDVI":null').alias("ndvi_null"))
    ring = F.col("x.geometry.coordinates")[0]
    return rounded(doc.select(F.col("x.type").alias("kind"), F.col("x.geometry.type").alias("shape"), "x.properties.*", F.size(ring).alias("n_vertices"),
                              ring[3][0].alias("west"), ring[3][1].alias("north"), "ndvi_null"))


@query("geojson_points", with_pixels(f"""SELECT "PixelID", {s6('"Longitude"')} AS lon, {s6('"Latitude"')} AS lat FROM px"""))
def geojson_points(spark, sf):
    df = writers.geojson_features(pixels(spark, sf), ["PixelID"])
    doc = df.select(F.from_json("feature", "geometry STRUCT<coordinates: ARRAY<DOUBLE>>, properties STRUCT<PixelID: BIGINT>").alias("x"))
    at = F.col("x.geometry.coordinates")
    return rounded(doc.select("x.properties.PixelID", at[0].alias("lon"), at[1].alias("lat")))


@query("grid_payload", with_pixels(f"""SELECT "PixelID", {s6('COALESCE("LST", 0e0)', 4)} AS "LST", {s6('COALESCE("NDVI", 0e0)', 4)} AS "NDVI", {s6('COALESCE("NDBI", 0e0)', 4)} AS "NDBI",
    {s6('COALESCE("NDWI", 0e0)', 4)} AS "NDWI", CAST(CASE WHEN "NDWI" > 0.1 THEN 2 WHEN "NDVI" > 0.25 THEN 0 WHEN "NDBI" > 0 OR "NDVI" < 0.05 THEN 1 ELSE 3 END AS DOUBLE) AS "LULC_Derived" FROM px"""))
def grid_payload(spark, sf):
    return rounded(writers.grid_payload(pixels(spark, sf), ["PixelID", "LST", "NDVI", "NDBI", "NDWI", "absent"]), 4)


@query("catalogue_document")
def catalogue_document(spark, sf):
    """The catalogue as JSON documents, each with the number of packages (one per part) that use it."""
    from workload.package_queries import packages

    used = iv.expand_package(packages(spark, sf), interventions_table(spark)).groupBy("id").agg(F.count(F.lit(1)).alias("n_packages"))
    return writers.json_doc(interventions_table(spark).join(used, "id", "left").orderBy("pos"))
