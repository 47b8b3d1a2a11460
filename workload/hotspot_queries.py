"""Queries on scoring, classes, hotspots, zones and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid import schema as S
from heatgrid.operators import explain, hotspots, ml, score
from heatgrid.operators.support import unnest
from workload.base import pixels, query, r6, rounded, s6, table, with_pixels
from workload.clean_queries import class_sql, clip_sql, label_sql, score_sql

SCORED = f"sc AS ({score_sql('px')}), kl AS ({class_sql('sc')})"


def scored(spark, sf):
    df = score.score_and_class(pixels(spark, sf))
    return df.withColumn("HeatScore_Predicted", F.col("HeatScore")).withColumn("HeatClass_Predicted", F.col("HeatClass"))


# --- scores ------------------------------------------------------------------------------------------------

@query("uhi_intensity", with_pixels(f"""SELECT "PixelID", {s6('"LST" - (SELECT avg("LST") FROM px WHERE "LULC_ESA" <> 50)')} AS uhi FROM px"""))
def uhi_intensity(spark, sf):
    return rounded(score.uhi_intensity(pixels(spark, sf), out="uhi").select("PixelID", "uhi"))


@query("utfvi", with_pixels(f"""SELECT "PixelID", {s6('("LST" - (SELECT avg("LST") FROM px)) / (SELECT avg("LST") FROM px)')} AS v FROM px"""))
def utfvi(spark, sf):
    return rounded(score.utfvi(pixels(spark, sf), out="v").select("PixelID", "v"))


@query("heat_score", with_pixels("""SELECT "PixelID", "HeatScore" FROM sc""", f"sc AS ({score_sql('px')})"))
def heat_score(spark, sf):
    return score.heat_score(pixels(spark, sf)).select("PixelID", "HeatScore")


@query("quartile_class", with_pixels(f"""SELECT "PixelID", "HeatClass", {label_sql('HeatClass')} AS "HeatClass_Label" FROM kl""", SCORED))
def quartile_class(spark, sf):
    return score.score_and_class(pixels(spark, sf)).select("PixelID", "HeatClass", "HeatClass_Label")


@query("quartile_thresholds", with_pixels(f"""SELECT {s6('quantile_cont("HeatScore", 0.25)')} AS q25, {s6('quantile_cont("HeatScore", 0.5)')} AS q50,
    {s6('quantile_cont("HeatScore", 0.75)')} AS q75, count("HeatScore") AS n FROM sc""", f"sc AS ({score_sql('px', digits=None)})"))
def quartile_thresholds(spark, sf):
    """Thresholds of the unrounded score, next to the number of scored pixels."""
    df = score.heat_score(pixels(spark, sf), digits=None)
    q25, q50, q75 = score.quartile_thresholds(df, rounded=False)
    return df.agg(F.count("HeatScore").alias("n")).select(r6(F.lit(q25)).alias("q25"), r6(F.lit(q50)).alias("q50"), r6(F.lit(q75)).alias("q75"), "n")


def _clip(c, lo, hi):
    return clip_sql(c, lo, hi)


@query("cooling_potential", with_pixels(f"""SELECT "PixelID", {s6('CASE WHEN v < 0 THEN 0 WHEN v > 50 THEN 50 ELSE v END')} AS v FROM (SELECT "PixelID",
    15e0 * ({_clip('NDBI', '0e0', '1e0')}) + 10e0 * (1e0 - ({_clip('NDVI', '0e0', '1e0')})) + 12e0 * "Impervious_Frac"
    + 10e0 * (0.7e0 - ({_clip('Albedo', '0e0', '0.7e0')})) + 8e0 * "Dist_Green" / (SELECT max("Dist_Green") FROM px) AS v FROM px)"""))
def cooling_potential(spark, sf):
    return rounded(score.cooling_potential(pixels(spark, sf), out="v").select("PixelID", "v"))


@query("intervention_priority", with_pixels(f"""SELECT "PixelID", {s6('CASE WHEN v < 0 THEN 0 WHEN v > 100 THEN 100 ELSE v END')} AS v FROM (SELECT "PixelID",
    0.4e0 * "HeatScore" """ + "".join(
        f""" + {w}e0 * "{c}" / (SELECT greatest(max("{c}"), 1e0) FROM px)""" for c, w in score.PRIORITY_WEIGHTS.items()) + " AS v FROM sc)",
    f"sc AS ({score_sql('px')})"))
def intervention_priority(spark, sf):
    df = score.heat_score(pixels(spark, sf))
    return rounded(score.intervention_priority(df, score="HeatScore", out="v").select("PixelID", "v"))


# --- hotspots -----------------------------------------------------------------------------------------------

@query("detect_hotspots", with_pixels("""SELECT "PixelID", "HeatScore", "HeatClass" FROM kl WHERE "HeatClass" >= 2""", SCORED))
def detect_hotspots(spark, sf):
    return hotspots.detect_hotspots(scored(spark, sf), sort=True).select("PixelID", "HeatScore", "HeatClass")


@query("detect_hotspots_percentile", with_pixels("""SELECT "PixelID", "HeatScore" FROM sc WHERE "HeatScore" >=
    (SELECT quantile_cont("HeatScore", 0.9) FROM sc)""", f"sc AS ({score_sql('px')})"))
def detect_hotspots_percentile(spark, sf):
    df = score.heat_score(pixels(spark, sf))
    return hotspots.detect_hotspots(df, percentile=90.0, score="HeatScore").select("PixelID", "HeatScore")


@query("quantile_zones", with_pixels("""SELECT "PixelID", """ + " + ".join(
    f"""CASE WHEN "HeatScore" > (SELECT quantile_cont("HeatScore", {p}) FROM sc) THEN 1 ELSE 0 END""" for p in (0.2, 0.4, 0.6, 0.8)) +
    """ AS "Zone_ID" FROM sc WHERE "HeatScore" IS NOT NULL""", f"sc AS ({score_sql('px')})"))
def quantile_zones(spark, sf):
    df = score.heat_score(pixels(spark, sf)).where(F.col("HeatScore").isNotNull())
    return hotspots.quantile_zones(df, score="HeatScore").select("PixelID", "Zone_ID")


_FEATURES = ["LST", "NDVI", "Impervious_Frac", "Building_Density", "Dist_Green", "Albedo", "WindSpeed", "Population_Density"]
_HZ = """hz AS (SELECT *, CAST(floor("row" / 10e0) AS INT) AS "Zone_ID" FROM kl WHERE "HeatClass" >= 2)"""


def _profile_sql(by: str | None) -> str:
    z, zk = ('"Zone_ID", ', '"Zone_ID", ') if by else ("", "")
    rows = []
    for f in _FEATURES:
        cm, cs = f'(SELECT avg("{f}") FROM kl)', f'(SELECT stddev_samp("{f}") FROM kl)'
        dev = f'(avg("{f}") - {cm}) / {cs}'
        rows.append(f"""SELECT {z}'{f}' AS feature, count("{f}") AS n, {s6(f'avg("{f}")', 4)} AS hotspot_mean, {s6(f'stddev_samp("{f}")', 4)} AS hotspot_std,
            {s6(cm, 4)} AS city_mean, {s6(cs, 4)} AS city_std, {s6(dev, 4)} AS deviation_zscore,
            CASE WHEN {dev} > 0 THEN 'higher' ELSE 'lower' END AS direction FROM hz {'GROUP BY "Zone_ID"' if by else ''}""")
    return " UNION ALL ".join(rows)


def _zoned(spark, sf):
    city = scored(spark, sf)
    return hotspots.detect_hotspots(city).withColumn("Zone_ID", F.floor(F.col("row") / 10.0).cast("int")), city


@query("hotspot_profile", with_pixels(_profile_sql(None), SCORED, _HZ))
def hotspot_profile(spark, sf):
    hot, city = _zoned(spark, sf)
    return rounded(hotspots.hotspot_profile(hot, city, _FEATURES))


_PF = f"pf AS ({_profile_sql('Zone_ID')})"
_FLAG = "CASE " + " ".join(
    f"WHEN feature = '{f}' AND deviation_zscore {'<' if side == 'below' else '>'} {limit} THEN '{name}'"
    for name, (f, side, limit) in S.VULNERABILITY_RULES.items()) + " END"


@query("zone_profile", with_pixels("SELECT * FROM pf", SCORED, _HZ, _PF))
def zone_profile(spark, sf):
    hot, city = _zoned(spark, sf)
    return rounded(hotspots.hotspot_profile(hot, city, _FEATURES, by="Zone_ID"))


_RF = """rf AS (SELECT *, row_number() OVER (PARTITION BY "Zone_ID" ORDER BY abs(deviation_zscore) DESC, feature) AS factor_rank FROM pf)"""


@query("rank_factors", with_pixels("""SELECT "Zone_ID", feature, factor_rank, deviation_zscore FROM rf WHERE factor_rank <= 5""", SCORED, _HZ, _PF, _RF))
def rank_factors(spark, sf):
    hot, city = _zoned(spark, sf)
    profile = hotspots.hotspot_profile(hot, city, _FEATURES, by="Zone_ID")
    return rounded(hotspots.rank_factors(profile, 5, by="Zone_ID").select("Zone_ID", "feature", "factor_rank", "deviation_zscore"))


_VF = f"""vf AS (SELECT "Zone_ID", COALESCE(string_agg(flag, ',' ORDER BY flag), '') AS vulnerabilities, count(flag) AS n_vulnerabilities
    FROM (SELECT "Zone_ID", {_FLAG} AS flag FROM pf) GROUP BY 1)"""


@query("vulnerability_flags", with_pixels("SELECT * FROM vf", SCORED, _HZ, _PF, _VF))
def vulnerability_flags(spark, sf):
    hot, city = _zoned(spark, sf)
    return hotspots.vulnerability_flags(hotspots.hotspot_profile(hot, city, _FEATURES, by="Zone_ID"), by="Zone_ID")


@query("zone_profiles", with_pixels(
    f"""SELECT z.*, t.top_factors, v.vulnerabilities, v.n_vulnerabilities FROM (SELECT "Zone_ID", count(*) AS n_hotspots,
        {s6('avg("HeatScore")', 2)} AS avg_heat_score, {s6('max("HeatScore")', 2)} AS max_heat_score, {s6('avg("Latitude")')} AS centroid_lat,
        {s6('avg("Longitude")')} AS centroid_lon, {s6('count(*) / CAST((SELECT count(*) FROM kl) AS DOUBLE)', 4)} AS hotspot_fraction FROM hz GROUP BY 1) z
    JOIN (SELECT "Zone_ID", string_agg(feature, ',' ORDER BY factor_rank) AS top_factors FROM rf WHERE factor_rank <= 5 GROUP BY 1) t USING ("Zone_ID")
    JOIN vf v USING ("Zone_ID")""", SCORED, _HZ, _PF, _RF, _VF))
def zone_profiles(spark, sf):
    hot, city = _zoned(spark, sf)
    return rounded(hotspots.zone_profiles(hot, city, _FEATURES))


@query("hotspot_summary", with_pixels(
    f"""SELECT count(*) AS total_pixels, count(CASE WHEN h THEN 1 END) AS hotspot_pixels, {s6('count(CASE WHEN h THEN 1 END) * 100e0 / count(*)', 1)} AS hotspot_pct,
        {s6('avg(CASE WHEN h THEN "HeatScore" END)', 2)} AS avg_heat_score, {s6('max(CASE WHEN h THEN "HeatScore" END)', 2)} AS max_heat_score,
        {s6('avg("HeatScore")', 2)} AS city_avg_heat_score, """ + ", ".join(
        f"""{s6(f'avg(CASE WHEN h THEN "{f}" END)', 4)} AS "{f}_hotspot_mean", {s6(f'avg("{f}")', 4)} AS "{f}_city_mean" """ for f in S.SUMMARY_FEATURES)
    + ", " + ", ".join(f"""count(CASE WHEN "HeatClass" = {k} THEN 1 END) AS "n_{v}" """ for k, v in S.HEAT_LABELS.items())
    + """ FROM (SELECT *, "HeatClass" >= 2 AS h FROM kl)""", SCORED))
def hotspot_summary(spark, sf):
    return rounded(hotspots.hotspot_summary(scored(spark, sf)))


@query("representatives", with_pixels(
    """SELECT kind, "PixelID", "HeatScore" FROM (SELECT 'class_' || "HeatClass" AS kind, "PixelID", "HeatScore", row_number() OVER (PARTITION BY "HeatClass"
       ORDER BY round(abs("HeatScore" - (SELECT median("HeatScore") FROM kl b WHERE b."HeatClass" = a."HeatClass")), 9), "PixelID") AS rn FROM kl a WHERE "HeatClass" IS NOT NULL) WHERE rn = 1
       UNION ALL (SELECT 'hottest', "PixelID", "HeatScore" FROM kl WHERE "HeatScore" IS NOT NULL ORDER BY "HeatScore" DESC, "PixelID" LIMIT 1)
       UNION ALL (SELECT 'coolest', "PixelID", "HeatScore" FROM kl WHERE "HeatScore" IS NOT NULL ORDER BY "HeatScore", "PixelID" LIMIT 1)""", SCORED))
def representatives(spark, sf):
    return hotspots.representatives(scored(spark, sf).where(F.col("HeatScore").isNotNull()))


@query("sorted_grid", with_pixels(
    """SELECT "PixelID", "HeatScore", CAST(floor(rk / side) AS BIGINT) AS grid_row, CAST(rk % side AS BIGINT) AS grid_col FROM (SELECT "PixelID", "HeatScore",
       row_number() OVER (ORDER BY "HeatScore" DESC, "PixelID") - 1 AS rk, (SELECT CAST(ceil(sqrt(count("HeatScore"))) AS BIGINT) FROM sc) AS side
       FROM sc WHERE "HeatScore" IS NOT NULL)""", f"sc AS ({score_sql('px')})"))
def sorted_grid(spark, sf):
    return hotspots.sorted_grid(score.heat_score(pixels(spark, sf)), "HeatScore")


@query("cluster_zones")
def cluster_zones(spark, sf):
    """KMeans zones of the hotspots: size, mean score and centroid per zone."""
    hot = hotspots.cluster_zones(hotspots.detect_hotspots(scored(spark, sf)), 5)
    return rounded(hot.groupBy("Zone_ID").agg(F.count(F.lit(1)).alias("n"), F.avg("HeatScore").alias("mean_score"),
                                              F.avg("Latitude").alias("lat"), F.avg("Longitude").alias("lon")))


# Five towns far from each other: whoever starts where, the best clustering is one zone for each, numbered from south to north.
_TOWN = '"Latitude" + ("PixelID" % 5) * 5e0'


@query("zones_of_towns", with_pixels(f"""SELECT CAST("PixelID" % 5 AS INT) AS "Zone_ID", count(*) AS n, {s6('avg("LST")')} AS mean_lst, {s6(f'avg({_TOWN})')} AS lat, {s6('avg("Longitude")')} AS lon
    FROM px GROUP BY 1"""))
def zones_of_towns(spark, sf):
    towns = pixels(spark, sf).withColumn("Latitude", F.expr(_TOWN.replace('"', "`")))
    zoned = hotspots.cluster_zones(towns, 5)
    return rounded(zoned.groupBy("Zone_ID").agg(F.count(F.lit(1)).alias("n"), F.avg("LST").alias("mean_lst"), F.avg("Latitude").alias("lat"), F.avg("Longitude").alias("lon")))


# --- explanations ---------------------------------------------------------------------------------------------

IMPORTANCES = {"UHI_Intensity": 0.31, "NDBI": 0.17, "Anthropogenic_Heat": 0.13, "Building_Density": 0.11, "NDVI": 0.09,
               "Albedo": 0.07, "WindSpeed": 0.05, "Population_Density": 0.04, "Dist_Green": 0.03}


def _long_contrib() -> str:
    parts = [f"""SELECT "PixelID", "HeatClass", '{f}' AS feature, round_even(COALESCE("{f}", (SELECT avg("{f}") FROM kl)), 4) AS value,
        {w}e0 * (COALESCE("{f}", (SELECT avg("{f}") FROM kl)) - (SELECT avg("{f}") FROM kl)) AS c FROM kl""" for f, w in IMPORTANCES.items()]
    return ("cb AS (SELECT *, round_even(c, 6) AS contribution, round_even(c / sum(abs(c)) OVER (PARTITION BY \"PixelID\") * 100, 1) AS pct FROM ("
            + " UNION ALL ".join(parts) + "))")


_CB = _long_contrib()
_DRIVE = """dr AS (SELECT *, row_number() OVER (PARTITION BY "PixelID" ORDER BY abs(pct) DESC, feature) AS place FROM cb)"""
_HEAT = """ht AS (SELECT *, row_number() OVER (PARTITION BY "PixelID" ORDER BY abs(contribution) DESC, feature) AS place FROM cb WHERE contribution > 0),
    al AS (SELECT *, row_number() OVER (PARTITION BY "PixelID" ORDER BY abs(contribution) DESC, feature) AS place FROM cb)"""


def with_contributions(spark, sf):
    return explain.contributions(scored(spark, sf), IMPORTANCES)


@query("contributions", with_pixels(f"""SELECT "PixelID", feature, {s6('value', 4)} AS value, {s6('contribution')} AS contribution, {s6('pct', 1)} AS pct FROM cb""", SCORED, _CB))
def contributions(spark, sf):
    return rounded(unnest(with_contributions(spark, sf), ["PixelID"], "contributions", "feature"))


@query("attribution_pct", with_pixels(f"""SELECT "PixelID", feature, {s6('abs(contribution) / sum(abs(contribution)) OVER (PARTITION BY "PixelID") * 100')} AS pct FROM cb""", SCORED, _CB))
def attribution_pct(spark, sf):
    items = F.transform("contributions", lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("value")))
    return rounded(unnest(with_contributions(spark, sf), ["PixelID"], explain.attribution_pct(items), "feature"))


@query("global_importance", with_pixels(f"""SELECT feature, {s6('avg(abs(contribution))')} AS importance FROM cb GROUP BY 1""", SCORED, _CB))
def global_importance(spark, sf):
    return rounded(explain.global_importance(with_contributions(spark, sf)))


@query("top_drivers", with_pixels(f"""SELECT "PixelID", feature, {s6('abs(pct)', 1)} AS contribution_pct, CASE WHEN contribution > 0 THEN 'heating' ELSE 'cooling' END AS direction,
    {s6('value', 4)} AS value FROM dr WHERE place <= 6 AND abs(pct) >= 1""", SCORED, _CB, _DRIVE))
def top_drivers(spark, sf):
    return rounded(unnest(explain.top_drivers(with_contributions(spark, sf)), ["PixelID"], "top_drivers", "feature"))


def _case(feature: str, mapping: dict) -> str:
    return f"CASE {feature} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


@query("recommendation_text", with_pixels(
    f"""SELECT k."PixelID", COALESCE(string_agg(a.line, ' | ' ORDER BY a.place), '{explain.NO_ADVICE}') AS recommendation FROM kl k LEFT JOIN
        (SELECT *, row_number() OVER (PARTITION BY "PixelID" ORDER BY place) AS nth FROM (SELECT "PixelID", line, min(place) AS place FROM (
          SELECT "PixelID", {_case('feature', explain.ADVICE)} AS line, place FROM ht WHERE place <= 3 UNION ALL
          SELECT "PixelID", CASE "HeatClass" WHEN 3 THEN '{explain.CLASS_PREFIX['Extreme']}' WHEN 2 THEN '{explain.CLASS_PREFIX['High']}' END, 0 FROM kl)
          WHERE line IS NOT NULL GROUP BY 1, 2)) a ON a."PixelID" = k."PixelID" AND a.nth <= 4 GROUP BY 1""", SCORED, _CB, _HEAT))
def recommendation_text(spark, sf):
    return explain.recommendation_text(with_contributions(spark, sf)).select("PixelID", "recommendation")


_LINES = " UNION ALL ".join(f"SELECT '{f}' AS feature, '{line}' AS line, {i} AS i" for f, lines in explain.ADVICE_LINES.items() for i, line in enumerate(lines))


@query("recommendation_lines", with_pixels(
    f"""SELECT k."PixelID", CASE WHEN k."HeatClass" >= 2 THEN concat('PRIORITY INTERVENTION AREA', chr(10), CASE WHEN a.txt IS NULL THEN '' ELSE chr(10) || a.txt END)
        ELSE COALESCE(a.txt, '{explain.NO_ADVICE_LINES}') END AS recommendation FROM kl k LEFT JOIN (SELECT "PixelID", string_agg(line, chr(10) ORDER BY place) AS txt FROM
        (SELECT "PixelID", line, min(al.place * 10 + ln.i) AS place FROM al JOIN ({_LINES}) ln USING (feature) WHERE al.place <= 5 AND contribution > 0 GROUP BY 1, 2) GROUP BY 1) a
        ON a."PixelID" = k."PixelID" """, SCORED, _CB, _HEAT))
def recommendation_lines(spark, sf):
    return explain.recommendation_text(with_contributions(spark, sf), long_form=True).select("PixelID", "recommendation")


@query("explanation_text", with_pixels(
    f"""SELECT k."PixelID", concat_ws(chr(10) || chr(10), printf('This location has a Heat Score of %.1f/100, classified as "%s" heat stress.', "HeatScore", {label_sql('HeatClass')}),
        'Assessment: ' || {_case(label_sql('HeatClass'), explain.CLASS_ASSESSMENT)}, 'Primary causes of heat stress at this location:' || chr(10) || a.txt, 'Key measurements: ' || concat_ws(' | ', """ + ", ".join(
        f"""CASE WHEN "{f}" IS NOT NULL THEN printf('{name}: %.2f', "{f}") || ' {unit}' END""" for f, (name, unit) in explain.KEY_MEASUREMENTS.items()) +
    f""")) AS explanation FROM kl k LEFT JOIN (SELECT "PixelID", string_agg('  ' || place || '. ' || {_case('feature', {f: d[0] for f, d in explain.DESCRIPTIONS.items()})}
        || printf(' (%.1f%%): ', abs(pct)) || CASE WHEN contribution > 0 THEN {_case('feature', {f: d[1] for f, d in explain.DESCRIPTIONS.items()})}
        ELSE {_case('feature', {f: d[2] for f, d in explain.DESCRIPTIONS.items()})} END, chr(10) ORDER BY place) AS txt FROM dr WHERE place <= 8 AND abs(pct) >= 2 GROUP BY 1) a
        ON a."PixelID" = k."PixelID" WHERE "HeatScore" IS NOT NULL""", SCORED, _CB, _DRIVE))
def explanation_text(spark, sf):
    df = with_contributions(spark, sf).where(F.col("HeatScore").isNotNull())
    return explain.explanation_text(df).select("PixelID", "explanation")


@query("importance_rank", with_pixels(f"""SELECT feature, {s6('r')} AS importance_regression, {s6('c')} AS importance_classification,
    {s6('0.5e0 * r + 0.5e0 * c')} AS importance_combined, CAST(row_number() OVER (ORDER BY 0.5e0 * r + 0.5e0 * c DESC, feature) AS INT) AS rank FROM (""" + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, abs(corr("LST", "{f}")) AS r, abs(corr("QualityScore", "{f}")) AS c FROM px""" for f in IMPORTANCES) + ")"))
def importance_rank(spark, sf):
    """Correlations stand in for a model's importances."""
    one = pixels(spark, sf).agg(*[F.abs(F.corr("LST", f)).alias(f"r_{f}") for f in IMPORTANCES],
                                *[F.abs(F.corr("QualityScore", f)).alias(f"c_{f}") for f in IMPORTANCES])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"r_{f}").alias("importance_regression"),
                                        F.col(f"c_{f}").alias("importance_classification")) for f in IMPORTANCES]))
    return rounded(explain.importance_rank(one.select(rows.alias("x")).select("x.*")))


@query("pixel_detail", with_pixels(
    f"""SELECT k."PixelID" AS pixel_id, {s6('"Latitude"')} AS latitude, {s6('"Longitude"')} AS longitude, {s6('"HeatScore"', 2)} AS heat_score,
        {label_sql('HeatClass').replace('"HeatClass"', 'k."HeatClass"')} AS heat_class, CASE k."HeatClass" WHEN 3 THEN 'Critical' WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS priority,
        0.95e0 AS confidence, d.feature AS first_driver, {s6('"NDVI"', 4)} AS ndvi, n_features FROM kl k JOIN (SELECT "PixelID", count(*) AS n_features FROM dr GROUP BY 1) c ON c."PixelID" = k."PixelID" JOIN dr d ON d."PixelID" = k."PixelID" AND d.place = 1 WHERE k."HeatClass" IS NOT NULL""", SCORED, _CB, _DRIVE))
def pixel_detail(spark, sf):
    full = scored(spark, sf)
    out = explain.pixel_detail(full, IMPORTANCES).where(F.col("heat_class") != "Unknown")
    return rounded(out.select("pixel_id", "latitude", "longitude", "heat_score", "heat_class", "priority", "confidence",
                              F.element_at("top_drivers", 1)["feature"].alias("first_driver"), F.col("features")["NDVI"].alias("ndvi"),
                              F.size("contributions").cast("bigint").alias("n_features")))
