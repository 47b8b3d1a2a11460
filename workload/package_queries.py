"""Queries on interventions, scenarios and packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid import schema as S
from heatgrid.functions.numeric import hash_uniform_sql
from heatgrid.catalog import STACKING_FACTORS, catalogue, effects_table, interventions_table
from heatgrid.operators import interventions as iv, packages as pk, scenarios as sc
from heatgrid.operators.score import LinearScore, quartile_thresholds, score_bounds
from heatgrid.operators.support import checkpointed, local_table, replace_columns
from workload.base import PIXEL_SQL, pixels, query, r6, rounded, s6, table, with_pixels
from workload.clean_queries import class_sql, score_sql

IDS = [i.id for i in catalogue()]
N_IDS = len(IDS)


def _lit(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value) + ("e0" if isinstance(value, float) and "e" not in repr(value) else "")


# The catalogue as SQL rows, for the twins.
CATALOG = ("it AS (SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {_lit(i.id)}, {_lit(i.name)}, {_lit(i.category)}, {_lit(i.cool_typical)}, {_lit(i.unit_cost)}, {_lit(i.feasibility)}, {len(i.co_benefits)})"
    for n, i in enumerate(catalogue())) + ") t(pos, id, name, category, typical, unit_cost, feasibility, n_cb)), "
    "ef AS (SELECT * FROM (VALUES " + ", ".join(
        f"({_lit(e.intervention_id)}, {e.seq}, {_lit(e.feature)}, {_lit(e.mode)}, {_lit(e.value)}, {_lit(e.lo)}, {_lit(e.hi)})" for i in catalogue() for e in i.effects)
    + ") t(intervention_id, eseq, feature, mode, value, e_lo, e_hi)), "
    "cbn AS (SELECT * FROM (VALUES " + ", ".join(f"({_lit(i.id)}, {_lit(b)})" for i in catalogue() for b in i.co_benefits) + ") t(id, benefit))")

# Packages: three different interventions per part, coverage from the part's key.
_SLOTS = [("p_partkey % 31", "(5 + (p_partkey * 13) % 83)"), ("(p_partkey % 31 + 1 + p_partkey % 10) % 31", "(5 + (p_partkey * 29) % 83)"),
          ("(p_partkey % 31 + 11 + p_partkey % 15) % 31", "(5 + (p_partkey * 41) % 83)")]
PACKAGES = CATALOG + ", pi AS (" + " UNION ALL ".join(
    f"SELECT p_partkey AS package_id, {i} AS seq, it.id, CAST({cov} AS DOUBLE) / 100e0 AS coverage FROM part JOIN it ON it.pos = {slot}"
    for i, (slot, cov) in enumerate(_SLOTS)) + ")"


def packages(spark, sf):
    ids = F.array(*[F.lit(i) for i in IDS])
    items = F.array(*[F.struct(F.element_at(ids, (F.expr(slot) + 1).cast("int")).alias("id"),
                               (F.expr(f"CAST({cov} AS DOUBLE)") / 100.0).alias("coverage")) for slot, cov in _SLOTS])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("package_id"), items.alias("items"))


# --- catalogue ---------------------------------------------------------------------------------------------

@query("interventions_by_category", f"""WITH {PACKAGES} SELECT p.id, count(*) AS n_packages, {s6('avg(coverage)')} AS mean_coverage FROM pi p JOIN it USING (id)
    WHERE category = 'blue' GROUP BY 1""")
def interventions_by_category(spark, sf):
    chosen = iv.interventions_by(interventions_table(spark), category="Blue")
    used = iv.expand_package(packages(spark, sf), chosen)
    return rounded(used.groupBy("id").agg(F.count(F.lit(1)).alias("n_packages"), F.avg("coverage").alias("mean_coverage")))


_MODEL = ["NDBI", "WindSpeed", "Dist_Water"]


@query("applicable_interventions", f"""WITH {PACKAGES} SELECT package_id, count(*) AS n FROM pi WHERE id IN (SELECT intervention_id FROM ef
    WHERE feature IN ('NDBI', 'WindSpeed', 'Dist_Water')) GROUP BY 1""")
def applicable_interventions(spark, sf):
    usable = iv.applicable_interventions(interventions_table(spark), _MODEL)
    return iv.expand_package(packages(spark, sf), usable).groupBy("package_id").agg(F.count(F.lit(1)).alias("n"))


@query("category_summary", f"""WITH {PACKAGES} SELECT category, n, names, avg_typical_cooling, n_used FROM (SELECT category, count(*) AS n,
    string_agg(name, '; ' ORDER BY name) AS names, round_even(avg(typical), 2) AS avg_typical_cooling FROM it GROUP BY 1) JOIN
    (SELECT category, count(*) AS n_used FROM pi JOIN it USING (id) GROUP BY 1) USING (category)""")
def category_summary(spark, sf):
    t = interventions_table(spark)
    used = iv.expand_package(packages(spark, sf), t).groupBy("category").agg(F.count(F.lit(1)).alias("n_used"))
    return iv.category_summary(t).join(used, "category")


@query("feature_to_interventions", f"""WITH {PACKAGES} SELECT feature, ids, n_changes FROM (SELECT feature, string_agg(DISTINCT intervention_id, ',' ORDER BY intervention_id) AS ids
    FROM ef GROUP BY 1) JOIN (SELECT feature, count(*) AS n_changes FROM pi JOIN ef ON intervention_id = id GROUP BY 1) USING (feature)""")
def feature_to_interventions(spark, sf):
    effects = effects_table(spark)
    changes = iv.stack_index(packages(spark, sf), effects).groupBy("feature").agg(F.count(F.lit(1)).alias("n_changes"))
    return iv.feature_to_interventions(effects).select("feature", F.array_join("ids", ",").alias("ids")).join(changes, "feature")


# --- packages as rows ------------------------------------------------------------------------------------------

@query("expand_package", f"""WITH {PACKAGES} SELECT package_id, seq, id, coverage, category, unit_cost, feasibility FROM pi JOIN it USING (id)""")
def expand_package(spark, sf):
    df = iv.expand_package(packages(spark, sf), interventions_table(spark))
    return df.select("package_id", "seq", "id", "coverage", "category", F.col("cost_per_unit.value").alias("unit_cost"), F.col("feasibility_score").alias("feasibility"))


_HITS = """hi AS (SELECT package_id, seq, eseq, feature, mode, value, e_lo, e_hi, coverage, row_number() OVER (PARTITION BY package_id, feature ORDER BY seq, eseq) AS hit
    FROM pi JOIN ef ON ef.intervention_id = pi.id)"""
_STACK = "CASE least(hit, 6) " + " ".join(f"WHEN {n} THEN {s}e0" for n, s in enumerate(STACKING_FACTORS, 1)) + " END"


@query("stack_index", f"""WITH {PACKAGES}, {_HITS} SELECT package_id, seq AS item_seq, eseq AS seq, feature, hit, {_STACK} AS stack FROM hi""")
def stack_index(spark, sf):
    return iv.stack_index(packages(spark, sf), effects_table(spark)).select("package_id", "item_seq", "seq", "feature", "hit", "stack")


@query("package_label", f"""WITH {PACKAGES} SELECT package_id, string_agg(name || ' (' || CAST(round_even(coverage * 100, 0) AS BIGINT) || '%)', ' + ' ORDER BY seq) AS label
    FROM pi JOIN it USING (id) GROUP BY 1""")
def package_label(spark, sf):
    return packages(spark, sf).select("package_id", iv.package_label(F.col("items")).alias("label"))


@query("coverage_columns", f"""WITH {PACKAGES} SELECT package_id, """ + ", ".join(
    f"""max(CASE WHEN id = '{i}' THEN coverage END) AS "Coverage_{i}" """ for i in IDS[:5]) + " FROM pi GROUP BY 1")
def coverage_columns(spark, sf):
    return iv.coverage_columns(packages(spark, sf), IDS[:5]).drop("items")


@query("decode_package", """SELECT p_partkey AS package_id, CAST((CASE WHEN a > 0.05 THEN 1 ELSE 0 END + CASE WHEN b > 0.05 THEN 1 ELSE 0 END) AS INT) AS n,
    CASE WHEN a > 0.05 THEN 'street_trees' WHEN b > 0.05 THEN 'urban_forests' END AS first_id,
    CASE WHEN a > 0.05 THEN round_even(a, 2) WHEN b > 0.05 THEN round_even(b, 2) END AS first_coverage FROM (SELECT p_partkey,
    CAST((p_partkey * 17) % 331 AS DOUBLE) / 331e0 - 0.3e0 AS a, CAST((p_partkey * 23) % 337 AS DOUBLE) / 337e0 - 0.3e0 AS b FROM part)""")
def decode_package(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("package_id"), F.expr(
        "array(CAST((p_partkey * 17) % 331 AS DOUBLE) / 331e0 - 0.3e0, CAST((p_partkey * 23) % 337 AS DOUBLE) / 337e0 - 0.3e0)").alias("genes"))
    out = iv.decode_package(df, "genes", IDS[:2])
    return out.select("package_id", F.size("items").alias("n"), F.get("items", F.lit(0))["id"].alias("first_id"), F.get("items", F.lit(0))["coverage"].alias("first_coverage"))


_SLIDERS = [("tree_cover_pct", "CAST(p_size * 3 AS DOUBLE)"), ("cool_roof_pct", "CAST(p_partkey % 120 AS DOUBLE)"), ("water_body_pct", "CAST(p_partkey % 7 * 20 AS DOUBLE)"),
            ("albedo_change", "CAST(p_partkey % 5 AS DOUBLE) / 10E0"), ("impervious_reduction_pct", "CAST(p_size AS DOUBLE)")]


@query("scenario_to_package", f"""SELECT package_id, id, {s6('coverage')} AS coverage FROM (""" + " UNION ALL ".join(
    f"SELECT p_partkey AS package_id, '{iid}' AS id, least({dict(_SLIDERS)[slider]} / {divisor}e0, {cap}e0) AS coverage FROM part"
    for slider, iid, divisor, cap in iv.SCENARIO_RULES if slider in dict(_SLIDERS)) + ") WHERE coverage > 0")
def scenario_to_package(spark, sf):
    requests = table(spark, sf, "part").selectExpr("p_partkey AS package_id", *[f"{e} AS {n}" for n, e in _SLIDERS])
    df = iv.scenario_to_package(requests).select("package_id", F.explode("items").alias("x"))
    return rounded(df.select("package_id", "x.id", "x.coverage"))


_METRICS = """pm AS (SELECT package_id, sum(unit_cost * coverage * 10) AS total_cost, sum(unit_cost * coverage * 10) / 1000e0 AS obj_cost, -avg(feasibility * coverage) AS obj_feasibility,
    -sum(n_cb) / 10e0 AS obj_cobenefits, avg(feasibility) AS avg_feasibility, sum(typical * coverage) AS estimated_cooling_celsius, count(*) AS n_interventions,
    round_even(least(0.95e0, 0.60e0 + 0.05e0 * count(*)), 2) AS confidence FROM pi JOIN it USING (id) GROUP BY 1),
    pb AS (SELECT package_id, count(DISTINCT benefit) AS n_cobenefits FROM pi JOIN cbn USING (id) GROUP BY 1)"""


@query("package_metrics", f"""WITH {PACKAGES}, {_METRICS} SELECT package_id, {', '.join(f'{s6(c)} AS {c}' for c in (
    'total_cost', 'obj_cost', 'obj_feasibility', 'obj_cobenefits', 'avg_feasibility', 'estimated_cooling_celsius', 'confidence'))}, n_interventions,
    CAST(n_cobenefits AS INT) AS n_cobenefits FROM pm JOIN pb USING (package_id)""")
def package_metrics(spark, sf):
    return rounded(pk.package_metrics(packages(spark, sf), interventions_table(spark)))


@query("solution_cobenefits", f"""WITH {PACKAGES} SELECT package_id, count(DISTINCT benefit) AS n, string_agg(DISTINCT benefit, '; ' ORDER BY benefit) AS co_benefits
    FROM pi JOIN cbn USING (id) GROUP BY 1""")
def solution_cobenefits(spark, sf):
    """What else a package is good for, over all its interventions."""
    out = iv.format_solution(packages(spark, sf), interventions_table(spark)).where("co_benefits IS NOT NULL")
    return out.select("package_id", F.size("co_benefits").cast("bigint").alias("n"), F.array_join("co_benefits", "; ").alias("co_benefits"))


@query("format_solution", f"""WITH {PACKAGES} SELECT package_id, seq, id, name, category, {s6('round_even(coverage * 100, 1)')} AS coverage_pct, {s6('feasibility')} AS feasibility_score
    FROM pi JOIN it USING (id)""")
def format_solution(spark, sf):
    df = iv.format_solution(packages(spark, sf), interventions_table(spark)).select("package_id", F.explode("interventions").alias("x"))
    return rounded(df.select("package_id", "x.seq", "x.id", "x.name", "x.category", "x.coverage_pct", "x.feasibility_score"))


# --- packages on pixels ------------------------------------------------------------------------------------------

DEMO = iv.scenario_items({"tree_cover_pct": 20, "cool_roof_pct": 40, "green_roof_pct": 10, "water_body_pct": 5, "albedo_change": 0.1,
                          "impervious_reduction_pct": 15, "building_density_reduction_pct": 10})
_CHANGED = ["NDVI", "NDBI", "MNDWI", "Albedo", "Impervious_Frac", "Tree_Cover_Pct", "Dist_Green", "Building_Density", "WindSpeed", "SolarRadiation", "Anthropogenic_Heat"]


def step_sql(x: str, mode: str, value: str, k: str, bounds: tuple) -> str:
    """One effect on a column, as a subquery-friendly expression on the name x."""
    moved = (f"CASE {mode} WHEN 'add' THEN {x} + {value} * {k} WHEN 'multiply' THEN {x} * (1e0 + ({value} - 1e0) * {k}) "
             f"WHEN 'set_max' THEN {x} + greatest(({value} - {x}) * {k}, 0e0) ELSE {x} END")
    lo, hi = bounds
    if hi is not None:
        moved = f"least({moved}, {hi}e0)"
    if lo is not None:
        moved = f"greatest({moved}, {lo}e0)"
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE {moved} END"


def apply_sql(source: str, items, features) -> str:
    """Nested SELECTs, one level per effect of the most-changed feature."""
    steps = iv.effect_steps(items, features)
    out = f'SELECT * REPLACE ({", ".join(f"""CAST("{f}" AS DOUBLE) AS "{f}" """ for f in features)}) FROM {source}'
    for level in range(max((len(s) for s in steps.values()), default=0)):
        changes = []
        for f, mine in steps.items():
            if level < len(mine):
                e, c, s = mine[level]
                expr = step_sql(f'"{f}"', f"'{e.mode}'", _lit(e.value), _lit(c * s), S.EFFECT_BOUNDS.get(f, (None, None)))
                changes.append(f'{expr} AS "{f}"')
        out = f"SELECT * REPLACE ({', '.join(changes)}) FROM ({out})"
    return out


@query("apply_package", with_pixels(f"""SELECT "PixelID", {', '.join(f'''{s6(f'"{c}"')} AS "{c}" ''' for c in _CHANGED)} FROM ap""", f"ap AS ({apply_sql('px', DEMO, _CHANGED)})"))
def apply_package(spark, sf):
    return rounded(iv.apply_package(pixels(spark, sf), DEMO).select("PixelID", *_CHANGED))


_DETAIL = ["NDVI", "Impervious_Frac", "Anthropogenic_Heat"]


@query("package_detail", with_pixels(" UNION ALL ".join(
    f"""SELECT b."PixelID", '{f}' AS feature, {s6(f'round_even(CAST(b."{f}" AS DOUBLE), 6)')} AS original, {s6(f'round_even(a."{f}", 6)')} AS final,
        {s6(f'round_even(round_even(a."{f}", 6) - round_even(CAST(b."{f}" AS DOUBLE), 6), 6)')} AS total_change,
        {len(iv.effect_steps(DEMO, _DETAIL)[f])} AS n_steps FROM px b JOIN ap a USING ("PixelID")""" for f in _DETAIL),
    f"ap AS ({apply_sql('px', DEMO, _DETAIL)})"))
def package_detail(spark, sf):
    return rounded(iv.package_detail(pixels(spark, sf), DEMO, _DETAIL).select("PixelID", "feature", "original", "final", "total_change", "n_steps"))


@query("feature_changes", with_pixels(" UNION ALL ".join(
    f"""SELECT '{f}' AS feature, {s6(f'round_even((SELECT avg("{f}") FROM px), 4)')} AS before, {s6(f'round_even((SELECT avg("{f}") FROM ap), 4)')} AS after,
        {s6(f'round_even((SELECT avg("{f}") FROM ap) - (SELECT avg("{f}") FROM px), 4)')} AS change,
        {s6(f'round_even(((SELECT avg("{f}") FROM ap) - (SELECT avg("{f}") FROM px)) / abs((SELECT avg("{f}") FROM px)) * 100, 1)')} AS change_pct"""
    for f in S.CHANGE_FEATURES), f"ap AS ({apply_sql('px', DEMO, S.CHANGE_FEATURES)})"))
def feature_changes(spark, sf):
    df = pixels(spark, sf)
    return rounded(sc.feature_changes(df, iv.apply_package(df, DEMO)))


# A linear surrogate of the heat score: its weights and the baseline's ranges are fixed before any change.
WEIGHTS = {"LST": 0.3, "NDBI": 0.2, "Impervious_Frac": 0.2, "Anthropogenic_Heat": 0.2, "Building_Density": 0.1}
FEATURES = list(WEIGHTS)


def predictor(baseline):
    return LinearScore(score_bounds(baseline, WEIGHTS), WEIGHTS)


def surrogate_sql(prefix: str = "", bounds: str = "bd") -> str:
    parts = [f'(CAST({prefix}"{f}" AS DOUBLE) - {bounds}."lo_{f}") / ({bounds}."hi_{f}" - {bounds}."lo_{f}") * {w}e0' for f, w in WEIGHTS.items()]
    return f"least(greatest(({' + '.join(parts)}) * 100e0, 0e0), 100e0)"


BOUNDS = 'bd AS (SELECT ' + ", ".join(f'CAST(min("{f}") AS DOUBLE) AS "lo_{f}", CAST(max("{f}") AS DOUBLE) AS "hi_{f}"' for f in FEATURES) + " FROM px)"
COMPLETE = "cp AS (SELECT * FROM px WHERE " + " AND ".join(f'"{f}" IS NOT NULL' for f in FEATURES) + ")"


@query("predict_complete", with_pixels(f"""SELECT "PixelID", {s6(f'CASE WHEN {" AND ".join(f"""px."{f}" IS NOT NULL""" for f in FEATURES)} THEN {surrogate_sql()} END')} AS score FROM px, bd""", BOUNDS))
def predict_complete(spark, sf):
    df = pixels(spark, sf)
    return rounded(sc.predict_complete(df, FEATURES, predictor(df)).select("PixelID", F.col("HeatScore_Predicted").alias("score")))


# Three requests, as a table: the scores of every complete pixel under each.
_REQUESTS = [(1, {"tree_cover_pct": 20.0, "cool_roof_pct": 40.0, "impervious_reduction_pct": 15.0}), (2, {"green_roof_pct": 60.0, "building_density_reduction_pct": 30.0}), (3, {})]


def requests(spark):
    names = [s for s in dict.fromkeys(r[0] for r in iv.SCENARIO_RULES)]
    rows = [(i, *[float(p.get(n, 0.0)) for n in names]) for i, p in _REQUESTS]
    return iv.scenario_to_package(local_table(spark, rows, "package_id BIGINT, " + ", ".join(f"{n} DOUBLE" for n in names))).select("package_id", "items")


_AFTER = ", ".join(f"a{i} AS ({apply_sql('cp', iv.scenario_items(p), FEATURES)})" for i, p in _REQUESTS)
_SCORED = "ss AS (" + " UNION ALL ".join(
    f"""SELECT CAST({i} AS BIGINT) AS package_id, a."PixelID", {surrogate_sql('b.')} AS before, {surrogate_sql('a.')} AS after FROM a{i} a JOIN cp b USING ("PixelID"), bd"""
    for i, _ in _REQUESTS) + ")"


def scored_requests(spark, sf):
    df = pixels(spark, sf)
    return sc.score_scenarios(df, requests(spark), effects_table(spark), FEATURES, predictor(df))


@query("score_scenarios", with_pixels(f"""SELECT package_id, "PixelID", {s6('before')} AS before, {s6('after')} AS after, {s6('after - before')} AS diff FROM ss""",
                                      BOUNDS, COMPLETE, _AFTER, _SCORED))
def score_scenarios(spark, sf):
    return rounded(scored_requests(spark, sf))


_EDGES = ", ".join(f"quantile_cont(before, {p}) AS q{n}" for n, p in ((1, 0.25), (2, 0.5), (3, 0.75)))


@query("scenario_summary", with_pixels(
    f"""SELECT package_id, count(*) AS n_pixels, {s6('avg(before)')} AS before_mean, {s6('avg(after)')} AS after_mean, {s6('max(before)')} AS before_max, {s6('max(after)')} AS after_max,
        {s6('min(before)')} AS before_min, {s6('min(after)')} AS after_min, {s6('avg(before) - avg(after)')} AS reduction, {s6('(avg(before) - avg(after)) / avg(before) * 100')} AS reduction_pct, """
    + ", ".join(f"count(CASE WHEN {side} {'> ' + 'q' + str(code) if code else '> -1'} AND {side} {'<= q' + str(code + 1) if code < 3 else '< 1e9'} THEN 1 END) AS \"{side}_{name}\""
                for side in ("before", "after") for code, name in S.HEAT_LABELS.items())
    + " FROM ss, (SELECT " + _EDGES + " FROM ss WHERE package_id = 3) GROUP BY 1", BOUNDS, COMPLETE, _AFTER, _SCORED))
def scenario_summary(spark, sf):
    df = pixels(spark, sf)
    predict = predictor(df)
    edges = quartile_thresholds(predict(sc.complete_pixels(df, FEATURES)), "HeatScore_Predicted", rounded=False)
    return rounded(sc.scenario_summary(scored_requests(spark, sf), thresholds=edges))


@query("overlay_scenario", with_pixels(f"""SELECT x."PixelID", {s6('COALESCE(s.after, x."LST")')} AS after_view, {s6('COALESCE(s.after - s.before, 0e0)')} AS diff_view FROM px x LEFT JOIN
    (SELECT * FROM ss WHERE package_id = 1) s ON s."PixelID" = x."PixelID" """, BOUNDS, COMPLETE, _AFTER, _SCORED))
def overlay_scenario(spark, sf):
    grid = pixels(spark, sf).select("PixelID", "LST")
    result = scored_requests(spark, sf).where("package_id = 1")
    after = sc.overlay_scenario(grid, result, "after", score="LST", out="after_view").drop("LST")
    diff = sc.overlay_scenario(grid, result, "diff", score="LST", out="diff_view").drop("LST")
    return rounded(after.join(diff, "PixelID"))


@query("before_after", with_pixels(
    f"""SELECT b."PixelID", {s6('b."Latitude"')} AS "Latitude", {s6('b."Longitude"')} AS "Longitude", {s6('round_even(b.s, 2)')} AS "HeatScore_Before", {s6('round_even(a.s, 2)')} AS "HeatScore_After",
        {s6('round_even(round_even(b.s, 2) - round_even(a.s, 2), 2)')} AS "HeatScore_Reduction", CASE WHEN b.s > 50 THEN 'High' ELSE 'Low' END AS "HeatClass_Before",
        CASE WHEN a.s > 50 THEN 'High' ELSE 'Low' END AS "HeatClass_After", """ + ", ".join(
        f"""{s6(f'round_even(b."{f}", 4)')} AS "{f}_Before", {s6(f'round_even(a."{f}", 4)')} AS "{f}_After", {s6(f'round_even(a."{f}" - b."{f}", 4)')} AS "{f}_Change" """ for f in ("NDBI", "Anthropogenic_Heat"))
    + """ FROM bs b JOIN afs a USING ("PixelID")""", BOUNDS, COMPLETE, f"bs AS (SELECT cp.*, {surrogate_sql('cp.')} AS s FROM cp, bd)",
    f"ap AS ({apply_sql('cp', DEMO, FEATURES)})", f"afs AS (SELECT ap.*, {surrogate_sql('ap.')} AS s FROM ap, bd)"))
def before_after(spark, sf):
    df = pixels(spark, sf)
    predict = predictor(df)
    label = F.when(F.col("HeatScore_Predicted") > 50, "High").otherwise("Low")
    ready = sc.complete_pixels(df, FEATURES)
    before = predict(ready).withColumn("HeatClass_Label", label)
    after = predict(iv.apply_package(ready, DEMO)).withColumn("HeatClass_Label", label)
    return rounded(sc.before_after(before, after, ["NDBI", "Anthropogenic_Heat"]))


# --- evaluation, dominance, ranking ----------------------------------------------------------------------------------

# Hotspots here: built-up pixels in the hottest tenth.
_HOT = """hs AS (SELECT * FROM cp WHERE "LULC_ESA" = 50 AND "LST" >= (SELECT quantile_cont("LST", 0.9) FROM px))"""


def hotspots(spark, sf):
    """The hottest tenth of all land covers, and all pixels."""
    df = pixels(spark, sf)
    from heatgrid.operators.hotspots import detect_hotspots

    return detect_hotspots(df, percentile=90.0, score="LST"), df


def hot_pixels(spark, sf):
    """The built-up hotspots, which the SQL twin is limited to."""
    hot, df = hotspots(spark, sf)
    return hot.where(F.col("LULC_ESA") == 50), df


def _chain(feature: str) -> str:
    """Three nested effect slots of a package on one feature."""
    x = f'h."{feature}"'
    bounds = S.EFFECT_BOUNDS.get(feature, (None, None))
    inner = f"CAST({x} AS DOUBLE)"
    for n in (1, 2, 3):
        lo, hi = bounds
        moved = (f"CASE c.m_{feature}_{n} WHEN 'add' THEN ({inner}) + c.v_{feature}_{n} * c.k_{feature}_{n} "
                 f"WHEN 'multiply' THEN ({inner}) * (1e0 + (c.v_{feature}_{n} - 1e0) * c.k_{feature}_{n}) ELSE ({inner}) END")
        if hi is not None:
            moved = f"least({moved}, {hi}e0)"
        if lo is not None:
            moved = f"greatest({moved}, {lo}e0)"
        inner = f"CASE WHEN c.m_{feature}_{n} IS NULL THEN ({inner}) ELSE {moved} END"
    return inner


_TOUCHED = ["NDBI", "Impervious_Frac", "Anthropogenic_Heat", "Building_Density"]
_SLOTTED = "ch AS (SELECT package_id, " + ", ".join(
    f"max(CASE WHEN feature = '{f}' AND hit = {n} THEN mode END) AS m_{f}_{n}, max(CASE WHEN feature = '{f}' AND hit = {n} THEN value END) AS v_{f}_{n}, "
    f"max(CASE WHEN feature = '{f}' AND hit = {n} THEN coverage * {_STACK} END) AS k_{f}_{n}" for f in _TOUCHED for n in (1, 2, 3)) + " FROM hi GROUP BY 1)"
_EVAL = (f"""ev AS (SELECT package_id, avg(after) - (SELECT avg({surrogate_sql('hs.')}) FROM hs, bd) AS obj_reduction FROM
    (SELECT c.package_id, {surrogate_sql('n.')} AS after FROM ch c, hs h, bd, LATERAL (SELECT h."LST" AS "LST", {', '.join(f'{_chain(f)} AS "{f}"' for f in _TOUCHED)}) n) GROUP BY 1)""")
_EVALUATION = (BOUNDS, COMPLETE, _HOT, PACKAGES, _HITS, _SLOTTED, _EVAL, _METRICS)


def evaluated(spark, sf):
    hot, city = hot_pixels(spark, sf)
    return pk.evaluate_packages(packages(spark, sf), hot, FEATURES, predictor(city))


@query("evaluate_packages", with_pixels(f"""SELECT package_id, {s6('obj_reduction')} AS obj_reduction, {s6('obj_cost')} AS obj_cost, {s6('obj_feasibility')} AS obj_feasibility,
    {s6('obj_cobenefits')} AS obj_cobenefits FROM ev JOIN pm USING (package_id)""", *_EVALUATION))
def evaluate_packages(spark, sf):
    return rounded(evaluated(spark, sf).select("package_id", *pk.OBJECTIVES))


_HOT_ALL = """hs AS (SELECT * FROM cp WHERE "LST" >= (SELECT quantile_cont("LST", 0.9) FROM px))"""
_EVALUATION_ALL = (BOUNDS, COMPLETE, _HOT_ALL, PACKAGES, _HITS, _SLOTTED, _EVAL, _METRICS)


@query("evaluate_packages_all", with_pixels(f"""SELECT package_id, {s6('obj_reduction')} AS obj_reduction, {s6('obj_cost')} AS obj_cost, {s6('obj_feasibility')} AS obj_feasibility,
    {s6('obj_cobenefits')} AS obj_cobenefits FROM ev JOIN pm USING (package_id)""", *_EVALUATION_ALL))
def evaluate_packages_all(spark, sf):
    """The same over the hotspots of all land covers."""
    hot, city = hotspots(spark, sf)
    return rounded(pk.evaluate_packages(packages(spark, sf), hot, FEATURES, predictor(city)).select("package_id", *pk.OBJECTIVES))


_AIMS = ["r", "c", "f", "b"]
_BEATS = " AND ".join(f"z.{o} <= a.{o}" for o in _AIMS) + " AND (" + " OR ".join(f"z.{o} < a.{o}" for o in _AIMS) + ")"


@query("optimize_given_packages", with_pixels("""SELECT package_id, predicted_reduction, total_cost, priority_score, row_number() OVER (ORDER BY priority_score DESC, predicted_reduction DESC, package_id) AS priority_rank
    FROM (SELECT *, round_even(predicted_reduction * 0.4e0 + feasibility * 10e0 * 0.3e0 + predicted_reduction / greatest(total_cost / 1000e0, 0.1e0) * 0.2e0 + n_cobenefits * 0.1e0, 2) AS priority_score FROM fr)""",
    *_EVALUATION_ALL, f"""ob AS (SELECT package_id, round_even(obj_reduction, 9) AS r, round_even(obj_cost, 9) AS c, round_even(obj_feasibility, 9) AS f, round_even(obj_cobenefits, 9) AS b,
        total_cost, avg_feasibility, n_cobenefits FROM ev JOIN pm USING (package_id) JOIN pb USING (package_id)),
    fr AS (SELECT package_id, round_even(-r, 2) + 0e0 AS predicted_reduction, round_even(total_cost, 0) AS total_cost, round_even(avg_feasibility, 3) AS feasibility, n_cobenefits
        FROM ob a WHERE NOT EXISTS (SELECT 1 FROM ob z WHERE {_BEATS}))"""))
def optimize_given_packages(spark, sf):
    """The optimisation plan over one package per part: all hotspots, the front, and its ranking."""
    from heatgrid.plans import cooling

    hot, city = hotspots(spark, sf)
    out = cooling.optimize_packages(hot, FEATURES, predictor(city), candidates=packages(spark, sf))
    return out.select("package_id", "predicted_reduction", "total_cost", "priority_score", "priority_rank")


# Dominance runs on the catalogue objectives, rounded so that both engines see the same numbers.
_OBJ = ["obj_cooling", "obj_cost", "obj_feasibility"]
_OB = f"""ob AS (SELECT package_id, {s6('-estimated_cooling_celsius', 4)} AS obj_cooling, {s6('obj_cost', 4)} AS obj_cost, {s6('obj_feasibility', 4)} AS obj_feasibility FROM pm)"""
_DOM = " AND ".join(f"b.{o} <= a.{o}" for o in _OBJ) + " AND (" + " OR ".join(f"b.{o} < a.{o}" for o in _OBJ) + ")"


def objectives(spark, sf):
    m = pk.package_metrics(packages(spark, sf), interventions_table(spark))
    return m.select("package_id", r6(-F.col("estimated_cooling_celsius"), 4).alias("obj_cooling"), r6("obj_cost", 4).alias("obj_cost"),
                    r6("obj_feasibility", 4).alias("obj_feasibility"))


@query("pareto_front", f"""WITH {PACKAGES}, {_METRICS}, {_OB} SELECT * FROM ob a WHERE NOT EXISTS (SELECT 1 FROM ob b WHERE {_DOM})""")
def pareto_front(spark, sf):
    return pk.pareto_front(objectives(spark, sf), _OBJ)


# A row's front is the length of the longest chain of rows that dominate one another above it.
@query("nondominated_rank", f"""WITH RECURSIVE {PACKAGES}, {_METRICS}, {_OB}, dm AS (SELECT a.package_id AS low, b.package_id AS high FROM ob a JOIN ob b ON {_DOM}),
    ch AS (SELECT package_id, 0 AS depth FROM ob UNION SELECT dm.low, ch.depth + 1 FROM ch JOIN dm ON dm.high = ch.package_id)
    SELECT package_id, CAST(max(depth) AS INT) AS front FROM ch GROUP BY 1""")
def nondominated_rank(spark, sf):
    return pk.nondominated_rank(objectives(spark, sf), _OBJ).select("package_id", "front")


_CROWD = " + ".join(f"""CASE WHEN n <= 2 OR p_{o} IS NULL OR x_{o} IS NULL THEN 1e9 WHEN hi_{o} = lo_{o} THEN 0 ELSE (x_{o} - p_{o}) / (hi_{o} - lo_{o}) END""" for o in _OBJ)


@query("crowding_distance", f"""WITH {PACKAGES}, {_METRICS}, {_OB}, gf AS (SELECT *, CAST(package_id % 4 AS INT) AS front FROM ob)
    SELECT package_id, {s6(f'CASE WHEN d >= 1e9 THEN 1e9 ELSE d END')} AS crowding FROM (SELECT package_id, {_CROWD} AS d FROM (SELECT *, count(*) OVER (PARTITION BY front) AS n, """ + ", ".join(
    f"""lag({o}) OVER (PARTITION BY front ORDER BY {o}, package_id) AS p_{o}, lead({o}) OVER (PARTITION BY front ORDER BY {o}, package_id) AS x_{o},
        min({o}) OVER (PARTITION BY front) AS lo_{o}, max({o}) OVER (PARTITION BY front) AS hi_{o}""" for o in _OBJ) + " FROM gf))")
def crowding_distance(spark, sf):
    df = objectives(spark, sf).withColumn("front", (F.col("package_id") % 4).cast("int"))
    out = pk.crowding_distance(df, _OBJ)
    return out.select("package_id", r6(F.when(F.col("crowding") >= 1e9, 1e9).otherwise(F.col("crowding"))).alias("crowding"))


# Six decimals in the inputs: the score's own rounding to two then meets no ties, on which engines differ.
_SOL = f"""sl AS (SELECT package_id, {s6('estimated_cooling_celsius * 0.913731e0')} AS predicted_reduction, {s6('total_cost')} AS total_cost,
    {s6('avg_feasibility')} AS avg_feasibility, n_cobenefits
    FROM pm JOIN pb USING (package_id)),
    pr AS (SELECT *, round_even(0.4e0 * predicted_reduction + 0.3e0 * avg_feasibility * 10 + 0.2e0 * (predicted_reduction / greatest(total_cost / 1000e0, 0.1e0)) + 0.1e0 * n_cobenefits, 2)
      AS priority_score FROM sl)"""


def solutions(spark, sf):
    """Catalogue cooling stands in for the predicted reduction."""
    m = pk.package_metrics(packages(spark, sf), interventions_table(spark))
    return rounded(m.select("package_id", (F.col("estimated_cooling_celsius") * 0.913731).alias("predicted_reduction"), "total_cost", "avg_feasibility",
                            "n_cobenefits"))


@query("solution_table", f"""WITH {PACKAGES}, {_METRICS} SELECT package_id, {s6('round_even(estimated_cooling_celsius * 0.913731e0, 2)')} AS predicted_reduction,
    {s6('round_even(avg_feasibility, 3)')} AS avg_feasibility FROM pm""")
def solution_table(spark, sf):
    m = pk.package_metrics(packages(spark, sf), interventions_table(spark))
    m = m.withColumn("obj_reduction", -F.col("estimated_cooling_celsius") * 0.913731)
    return rounded(pk.solution_table(m).select("package_id", "predicted_reduction", "avg_feasibility"))


@query("priority_rank", f"""WITH {PACKAGES}, {_METRICS}, {_SOL} SELECT package_id, priority_score, row_number() OVER (ORDER BY priority_score DESC, predicted_reduction DESC, package_id) AS priority_rank FROM pr""")
def priority_rank(spark, sf):
    return pk.priority_rank(solutions(spark, sf)).select("package_id", "priority_score", "priority_rank")


_ORDERS = {"balanced": "priority_score DESC, predicted_reduction DESC, package_id", "max_cooling": "predicted_reduction DESC, priority_score DESC, package_id",
           "min_cost": "total_cost, priority_score DESC, package_id", "max_feasibility": "avg_feasibility DESC, priority_score DESC, package_id"}


@query("select_best", f"""WITH {PACKAGES}, {_METRICS}, {_SOL} """ + " UNION ALL ".join(
    f"(SELECT '{n}' AS strategy, package_id FROM pr ORDER BY {o} LIMIT 1)" for n, o in _ORDERS.items()))
def select_best(spark, sf):
    df = pk.priority_score(solutions(spark, sf))
    out = None
    for name in pk.STRATEGIES:
        best = pk.select_best(df, name).select(F.lit(name).alias("strategy"), "package_id")
        out = best if out is None else out.unionByName(best)
    return out


@query("top_n", f"""WITH {PACKAGES}, {_METRICS}, {_SOL} SELECT package_id, priority_score FROM pr ORDER BY priority_score DESC, package_id LIMIT 10""")
def top_n(spark, sf):
    df = pk.priority_score(solutions(spark, sf))
    return pk.top_n(df, [F.col("priority_score").desc(), F.col("package_id")], 10).select("package_id", "priority_score")


# --- hashed draws ------------------------------------------------------------------------------------------------------

def _draw(salt: int) -> str:
    return hash_uniform_sql(f"package_id * {N_IDS} + pos", 420 + salt)


_CANDIDATES = f"""gn AS (SELECT package_id, pos, id, CASE WHEN {_draw(0)} < 0.7 THEN 0e0 ELSE {_draw(1)} * 0.8e0 END AS c, {_draw(2)} AS d, {_draw(3)} * 0.5e0 + 0.1e0 AS r
    FROM (SELECT row_number() OVER () - 1 AS package_id FROM part), it),
    gs AS (SELECT *, count(CASE WHEN c > 0 THEN 1 END) OVER (PARTITION BY package_id) AS active, row_number() OVER (PARTITION BY package_id ORDER BY d, id) AS nth FROM gn),
    gk AS (SELECT package_id, pos, id, round_even(CASE WHEN active < 2 THEN CASE WHEN nth <= 3 THEN r ELSE 0e0 END ELSE c END, 2) AS coverage FROM gs),
    gt AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY coverage DESC, pos) AS strength FROM gk WHERE coverage > 0.05)"""


@query("candidate_packages", f"""WITH {CATALOG}, {_CANDIDATES} SELECT package_id, id, coverage FROM gt WHERE strength <= 6""")
def candidate_packages(spark, sf):
    """As many random packages as there are parts."""
    n = table(spark, sf, "part").count()
    df = pk.candidate_packages(spark, n, IDS)
    return df.select("package_id", F.inline("items"))


_MC = sorted({e.feature for i in catalogue() for e in i.effects})
_MC_U = hash_uniform_sql("((package_id * 50 + draw) * 64 + seq) * 16 + eseq", 42)


def _mc(feature: str) -> str:
    out = f"""SELECT package_id, draw, (SELECT avg("{feature}") FROM px) AS x0, * EXCLUDE (package_id, draw) FROM ms WHERE feature = '{feature}'"""
    for i in (1, 2, 3):
        step = step_sql(f"x{i - 1}", f"m{i}", f"v{i}", f"k{i}", S.EFFECT_BOUNDS[feature])
        out = f"SELECT *, CASE WHEN m{i} IS NULL THEN x{i - 1} ELSE {step} END AS x{i} FROM ({out})"
    return (f"SELECT package_id, '{feature}' AS feature, {s6('round_even(avg(x3), 4)')} AS mean, {s6('round_even(stddev_pop(x3), 4)')} AS std, "
            f"{s6('round_even(quantile_cont(x3, 0.05), 4)')} AS p5, {s6('round_even(quantile_cont(x3, 0.95), 4)')} AS p95, {s6('round_even(min(x0), 4)')} AS original "
            f"FROM ({out}) GROUP BY 1")


@query("effect_uncertainty", with_pixels(" UNION ALL ".join(_mc(f) for f in _MC), PACKAGES, _HITS,
    f"un AS (SELECT package_id, feature, draw, hit, mode, e_lo + {_MC_U} * (e_hi - e_lo) AS v, coverage * {_STACK} AS k FROM hi, (SELECT unnest(range(0, 50)) AS draw))",
    "ms AS (SELECT package_id, feature, draw, " + ", ".join(f"max(CASE WHEN hit = {i} THEN {c} END) AS {c[0]}{i}" for i in (1, 2, 3) for c in ("mode", "v", "k")) + " FROM un GROUP BY 1, 2, 3)"))
def effect_uncertainty(spark, sf):
    """Monte-Carlo of every package on the mean pixel, in all features that any effect changes."""
    means = pixels(spark, sf).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in _MC]).first().asDict()
    return rounded(iv.effect_uncertainty(spark, packages(spark, sf), means))
