"""The catalogue as tables, and packages of interventions applied to pixels.

A package is an ordered array of (id, coverage). Each effect changes one feature; the n-th change of a
feature is damped by the stacking factor, and the feature is clamped to its bounds after every change.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from heatgrid import schema as S
from heatgrid.catalog import STACKING_FACTORS, Effect, Intervention, catalogue, effects_table, interventions_table
from heatgrid.functions.numeric import clamp_nested, hash_uniform_numpy, round_even
from heatgrid.operators.support import checkpointed, replace_columns, unnest

PACKAGE_TYPE = "array<struct<id:string,coverage:double>>"


# --- catalogue queries -------------------------------------------------------------------------------

def interventions_by(table: DataFrame, *, category: str | None = None, id: str | None = None) -> DataFrame:
    if category is not None:
        table = table.where(F.col("category") == category.lower())
    if id is not None:
        table = table.where(F.col("id") == id)
    return table


def applicable_interventions(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """Interventions with at least one effect on a model feature."""
    return table.where(F.arrays_overlap("effect_features", F.array(*[F.lit(f) for f in features])))


def category_summary(table: DataFrame) -> DataFrame:
    return table.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("names"),
        round_even(F.avg("cooling_potential_celsius.typical"), 2).alias("avg_typical_cooling"),
    )


def feature_to_interventions(effects: DataFrame) -> DataFrame:
    """Reverse map: (feature, ids)."""
    return effects.groupBy("feature").agg(F.array_sort(F.collect_set("intervention_id")).alias("ids"))


# --- one known package: plain columns ------------------------------------------------------------------

def stack_factor(hit: int) -> float:
    return STACKING_FACTORS[min(hit, len(STACKING_FACTORS) - 1)]


def effect_steps(
    items: Sequence[tuple[str, float]], features: Sequence[str],
    interventions: Sequence[Intervention] | None = None,
) -> dict[str, list[tuple[Effect, float, float]]]:
    """feature -> ordered (effect, coverage, stack factor). Unknown ids and absent features are skipped."""
    known = {i.id: i for i in (interventions or catalogue())}
    wanted = set(features)
    steps: dict[str, list[tuple[Effect, float, float]]] = {}
    for iid, coverage in items:
        if iid not in known:
            continue
        for effect in known[iid].effects:
            if effect.feature in wanted:
                mine = steps.setdefault(effect.feature, [])
                mine.append((effect, float(coverage), stack_factor(len(mine))))
    return steps


def package_columns(items: Sequence[tuple[str, float]], features: Sequence[str],
                    bounds: Mapping[str, tuple] = S.EFFECT_BOUNDS, **options) -> dict[str, Column]:
    """Changed features as plain expressions: the package is folded while the plan is built, so each
    feature is one code-generated column."""
    out = {}
    for feature, steps in effect_steps(items, features, **options).items():
        source = F.col(feature).cast("double")
        x = source
        for effect, coverage, stack in steps:
            if effect.mode == "add":
                x = x + effect.value * coverage * stack
            elif effect.mode == "multiply":
                x = x * (1.0 + (effect.value - 1.0) * coverage * stack)
            elif effect.mode == "set_max":
                x = x + F.greatest((F.lit(effect.value) - x) * coverage * stack, F.lit(0.0))
            x = clamp_nested(x, *bounds.get(feature, (None, None)))
        out[feature] = F.when(source.isNotNull(), x)
    return out


def apply_package(df: DataFrame, items: Sequence[tuple[str, float]], **options) -> DataFrame:
    """All rows changed by one package."""
    return replace_columns(df, package_columns(items, df.columns, **options))


# --- packages as data --------------------------------------------------------------------------------

def expand_package(packages: DataFrame, table: DataFrame, *, package_id: str = "package_id",
                   items: str = "items") -> DataFrame:
    """One row per package item with its catalogue fields; unknown ids drop out. The catalogue is a
    dimension of fixed size and is broadcast."""
    exploded = packages.select(package_id, F.posexplode(items).alias("seq", "_item")).select(
        package_id, "seq", F.col("_item.id").alias("id"), F.col("_item.coverage").alias("coverage")
    )
    return exploded.join(F.broadcast(table), "id")


def stack_index(packages: DataFrame, effects: DataFrame, *, package_id: str = "package_id",
                items: str = "items") -> DataFrame:
    """Every effect of every package in order, with its place among the changes of the same feature.

    The window groups hold one package's effects on one feature, a handful of rows.
    """
    exploded = packages.select(package_id, F.posexplode(items).alias("item_seq", "_item")).select(
        package_id, "item_seq", F.col("_item.id").alias("intervention_id"), F.col("_item.coverage").alias("coverage")
    )
    joined = exploded.join(F.broadcast(effects), "intervention_id")
    order = Window.partitionBy(package_id, "feature").orderBy("item_seq", "seq")
    factors = F.array(*[F.lit(x) for x in STACKING_FACTORS])
    hit = F.row_number().over(order)
    return joined.withColumn("hit", hit).withColumn(
        "stack", F.element_at(factors, F.least(F.col("hit"), F.lit(len(STACKING_FACTORS))))
    )


def affine_step(mode: Column, value: Column, k: Column) -> list[Column]:
    """An effect as x -> x * scale + shift, kept from falling below x where `raise_only` holds."""
    scale = F.when(mode == "multiply", (value - 1.0) * k + 1.0).when(mode == "set_max", F.lit(1.0) - k).otherwise(1.0)
    shift = F.when(mode == "multiply", 0.0).otherwise(value * k)
    return [scale.alias("scale"), shift.alias("shift"), (mode == "set_max").alias("raise_only")]


def compile_packages(packages: DataFrame, effects: DataFrame, features: Sequence[str], *,
                     package_id: str = "package_id", items: str = "items") -> DataFrame:
    """(package_id, one `steps_<feature>` array of ordered affine steps per feature).

    Packages without a known intervention keep empty arrays.
    """
    indexed = stack_index(packages, effects, package_id=package_id, items=items)
    step = F.struct("item_seq", "seq", *affine_step(F.col("mode"), F.col("value"), F.col("coverage") * F.col("stack")))
    arrays = indexed.where(F.col("feature").isin(list(features))).groupBy(package_id).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("feature") == f, step))).alias(f"steps_{f}") for f in features
    ])
    empty = F.array().cast("array<struct<item_seq:int,seq:int,scale:double,shift:double,raise_only:boolean>>")
    joined = packages.select(package_id).join(arrays, package_id, "left")
    return joined.select(package_id, *[F.coalesce(f"steps_{f}", empty).alias(f"steps_{f}") for f in features])


def fold_steps(x: Column, steps: Column, bounds: tuple = (None, None)) -> Column:
    """Apply affine steps in order to one value, clamping after each. Kept short: lambdas are interpreted."""

    def change(acc: Column, s: Column) -> Column:
        new = acc * s["scale"] + s["shift"]
        return clamp_nested(F.when(s["raise_only"], F.greatest(acc, new)).otherwise(new), *bounds)

    return F.when(x.isNotNull(), F.aggregate(steps, x.cast("double"), change))


def merged_steps(steps: Column, bounds: tuple = (None, None)) -> Column:
    """Ordered affine steps, clamped after each, as one: x -> clamp(x * scale + shift, low, high). A clamped affine step keeps that
    form, with the bounds before it mapped by the step. Not for steps that only raise."""
    low, high = [F.lit(float(b)) if b is not None else F.lit(sign * float("inf")) for b, sign in zip(bounds, (-1, 1))]

    def inside(c: Column) -> Column:
        return F.greatest(F.least(c, high), low)

    def change(m: Column, s: Column) -> Column:
        ends = [F.when(s["scale"] == 0, s["shift"]).otherwise(m[e] * s["scale"] + s["shift"]) for e in ("low", "high")]
        return F.struct((m["scale"] * s["scale"]).alias("scale"), (m["shift"] * s["scale"] + s["shift"]).alias("shift"),
                        inside(F.least(*ends)).alias("low"), inside(F.greatest(*ends)).alias("high"))

    start = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    return F.aggregate(steps, start, change)


def slot_packages(packages: DataFrame, effects: DataFrame, features: Sequence[str], *, package_id: str = "package_id",
                  items: str = "items") -> tuple[DataFrame, dict[str, int]]:
    """Packages as plain columns, as arrays of steps would be folded by interpreted lambdas for every pixel; and per feature the
    number of slots, 0 where its steps are merged.

    Merged features have `_scale`, `_shift`, `_low` and `_high`. A feature with steps that only raise keeps them: `_n` and for each
    slot `_scale`, `_shift` and `_raise`; a slot beyond a package's own steps changes nothing. Writes the (small) compiled table.
    """
    compiled = checkpointed(compile_packages(packages, effects, features, package_id=package_id, items=items))
    raising = [F.max(F.when(F.exists(f"steps_{f}", lambda s: s["raise_only"]), F.lit(True))).alias(f"r_{f}") for f in features]
    most = compiled.agg(*[F.max(F.size(f"steps_{f}")).alias(f) for f in features], *raising).first()
    slots = {f: (most[f] or 0) if most[f"r_{f}"] else 0 for f in features}
    merged = compiled.select("*", *[merged_steps(F.col(f"steps_{f}"), S.EFFECT_BOUNDS.get(f, (None, None))).alias(f"_m_{f}") for f in features if not slots[f]])
    columns = []
    for f in features:
        if not slots[f]:
            columns += [F.col(f"_m_{f}")[c].alias(f"_{c}_{f}") for c in ("scale", "shift", "low", "high")]
            continue
        columns.append(F.size(f"steps_{f}").alias(f"_n_{f}"))
        for j in range(slots[f]):
            step = F.get(f"steps_{f}", F.lit(j))
            columns += [F.coalesce(step["scale"], F.lit(1.0)).alias(f"_scale_{f}_{j}"), F.coalesce(step["shift"], F.lit(0.0)).alias(f"_shift_{f}_{j}"),
                        F.coalesce(step["raise_only"], F.lit(False)).alias(f"_raise_{f}_{j}")]
    return checkpointed(merged.select(package_id, *columns)), slots


def apply_slots(pairs: DataFrame, features: Sequence[str], slots: Mapping[str, int], keep: Sequence[str]) -> DataFrame:
    """(keep..., features) with the steps of `slot_packages` applied; features must not be NULL.

    Slots take one projection each, since a step may mention its input twice."""
    number = {f: F.col(f).cast("double") for f in features}
    one = {f: F.greatest(F.least(number[f] * F.col(f"_scale_{f}") + F.col(f"_shift_{f}"), F.col(f"_high_{f}")), F.col(f"_low_{f}")) for f in features if not slots[f]}
    pairs = replace_columns(pairs, number | one)
    for j in range(max(slots.values(), default=0)):
        moved = {}
        for f in features:
            if j < slots[f]:
                x = F.col(f)
                new = x * F.col(f"_scale_{f}_{j}") + F.col(f"_shift_{f}_{j}")
                new = F.when(F.col(f"_raise_{f}_{j}"), F.greatest(x, new)).otherwise(new)
                moved[f] = F.when(F.col(f"_n_{f}") > j, clamp_nested(new, *S.EFFECT_BOUNDS.get(f, (None, None)))).otherwise(x)
        pairs = replace_columns(pairs, moved)
    return pairs.select(*keep, *features)


def trace_steps(x: Column, steps: Column, bounds: tuple = (None, None)) -> Column:
    """Like `fold_steps`, keeping every step as (old, new, change, change_pct, mode)."""
    row_type = "array<struct<mode:string,old:double,new:double>>"

    def change(acc: Column, s: Column) -> Column:
        new = fold_steps(acc["value"], F.array(s), bounds)
        return F.struct(
            new.alias("value"),
            F.concat(acc["log"], F.array(F.struct(s["mode"].alias("mode"), acc["value"].alias("old"),
                                                  new.alias("new")))).alias("log"),
        )

    start = F.struct(x.cast("double").alias("value"), F.array().cast(row_type).alias("log"))
    log = F.aggregate(steps, start, change, lambda acc: acc["log"])
    return F.transform(log, lambda s: F.struct(
        s["mode"].alias("mode"), round_even(s["old"], 6).alias("old"), round_even(s["new"], 6).alias("new"),
        round_even(s["new"] - s["old"], 6).alias("change"),
        round_even(F.coalesce((s["new"] - s["old"]) / F.nullif(F.abs(s["old"]), F.lit(0.0)) * 100.0, F.lit(0.0)), 2)
        .alias("change_pct"),
    ))


def package_detail(df: DataFrame, items: Sequence[tuple[str, float]], features: Sequence[str], *,
                   key: str = "PixelID") -> DataFrame:
    """Per pixel and feature: original, final, total change and the steps in between."""
    per_feature = []
    for feature, steps in effect_steps(items, features).items():
        literal = F.array(*[
            F.struct(F.lit(e.mode).alias("mode"), *affine_step(F.lit(e.mode), F.lit(e.value), F.lit(c * s)))
            for e, c, s in steps
        ])
        traced = trace_steps(F.col(feature), literal, S.EFFECT_BOUNDS.get(feature, (None, None)))
        stacks = F.array(*[F.lit(s) for _, _, s in steps])
        ids = F.array(*[F.lit(e.intervention_id) for e, _, _ in steps])
        rows = F.transform(F.arrays_zip(ids.alias("i"), stacks.alias("k"), traced.alias("t")), lambda z: F.struct(
            z["i"].alias("intervention_id"), z["k"].alias("stack_factor"), z["t"]["mode"].alias("mode"),
            z["t"]["old"].alias("old"), z["t"]["new"].alias("new"), z["t"]["change"].alias("change"),
            z["t"]["change_pct"].alias("change_pct"),
        ))
        per_feature.append(F.struct(F.lit(feature).alias("feature"), rows.alias("steps")))
    out = unnest(df, [key], F.array(*per_feature), "feature")
    first, last = F.element_at("steps", 1)["old"], F.element_at("steps", -1)["new"]
    return out.withColumn("original", first).withColumn("final", last).withColumn(
        "total_change", round_even(last - first, 6)
    ).withColumn("n_steps", F.size("steps"))


# --- requests to packages -----------------------------------------------------------------------------

# Scenario slider -> (intervention, divisor, cap), in the order they are applied.
SCENARIO_RULES = [
    ("tree_cover_pct", "street_trees", 100.0, 1.0),
    ("cool_roof_pct", "cool_roofs", 100.0, 1.0),
    ("green_roof_pct", "green_roofs", 100.0, 1.0),
    ("water_body_pct", "ponds", 200.0, 0.5),
    ("water_body_pct", "rain_gardens", 200.0, 0.5),
    ("albedo_change", "high_albedo_materials", 0.3, 1.0),
    ("impervious_reduction_pct", "impervious_surface_reduction", 100.0, 1.0),
    ("building_density_reduction_pct", "building_spacing", 100.0, 1.0),
]


def scenario_items(params: Mapping[str, float]) -> list[tuple[str, float]]:
    """Package of one request."""
    return [
        (iid, min(params[slider] / divisor, cap))
        for slider, iid, divisor, cap in SCENARIO_RULES if params.get(slider, 0) > 0
    ]


def scenario_to_package(scenarios: DataFrame, out: str = "items") -> DataFrame:
    """Packages of a table of requests, one slider per column; absent sliders count as 0."""
    rows = [
        F.struct(F.lit(iid).alias("id"), F.least(F.col(slider).cast("double") / divisor, F.lit(cap)).alias("coverage"))
        for slider, iid, divisor, cap in SCENARIO_RULES if slider in scenarios.columns
    ]
    return scenarios.withColumn(out, F.filter(F.array(*rows), lambda s: s["coverage"] > 0))


def decode_package(df: DataFrame, vector: str, ids: Sequence[str], out: str = "items", threshold: float = 0.05) -> DataFrame:
    """Coverage vector to items: genes above the threshold, two decimals."""
    names = F.array(*[F.lit(i) for i in ids])
    genes = F.zip_with(names, F.col(vector), lambda i, c: F.struct(i.alias("id"), c.alias("coverage")))
    kept = F.filter(genes, lambda g: g["coverage"] > threshold)
    return df.withColumn(out, F.transform(kept, lambda g: F.struct(
        g["id"].alias("id"), round_even(g["coverage"], 2).alias("coverage"))))


def name_map(interventions: Sequence[Intervention] | None = None) -> Column:
    return F.create_map(*[F.lit(x) for i in (interventions or catalogue()) for x in (i.id, i.name)])


def package_label(items: Column) -> Column:
    """'Street Trees (42%) + ...'; an unknown id stands for itself."""
    names = name_map()
    return F.array_join(F.transform(items, lambda s: F.concat(
        F.coalesce(F.try_element_at(names, s["id"]), s["id"]), F.lit(" ("),
        round_even(s["coverage"] * 100.0, 0).cast("bigint").cast("string"), F.lit("%)"),
    )), " + ")


def coverage_columns(df: DataFrame, ids: Sequence[str], items: str = "items") -> DataFrame:
    """One `Coverage_<id>` column per intervention; NULL where the package does not use it."""
    lookup = F.map_from_entries(F.col(items))
    return df.select("*", *[F.try_element_at(lookup, F.lit(i)).alias(f"Coverage_{i}") for i in ids])


def format_solution(solutions: DataFrame, table: DataFrame, *, package_id: str = "package_id") -> DataFrame:
    """Solution rows with an `interventions` array of catalogue fields in package order, and the sorted `co_benefits` of all of them."""
    entries = expand_package(solutions, table, package_id=package_id).groupBy(package_id).agg(
        F.array_sort(F.collect_list(F.struct(
            "seq", "id", "name", "category", round_even(F.col("coverage") * 100.0, 1).alias("coverage_pct"),
            F.col("cooling_potential_celsius").alias("cooling_potential"), "cost_per_unit", "feasibility_score",
            "indian_suitability",
        ))).alias("interventions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("co_benefits")))).alias("co_benefits"),
    )
    return solutions.join(entries, package_id, "left")


# --- uncertainty -----------------------------------------------------------------------------------------

DRAWN_VALUES = 1 << 20


def _draw_effects(baseline: Mapping[str, float], n: int, seed: int):
    """(package id, feature, mean, std, p5, p95) from arrays of steps, all draws of many packages at once."""

    def drawn(steps: dict[str, np.ndarray], at: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scale, shift, NULL scale, NULL shift and whether it only raises, of the steps `at`, by (row, step, draw)."""
        code, k, lo, hi = (steps[c][at][..., None] for c in ("code", "k", "lo", "hi"))
        u = hash_uniform_numpy(steps["first"][at][..., None] + np.arange(n) * 1024, seed)
        value = lo + u * (hi - lo)
        whole, flat = np.zeros(u.shape, bool), np.ones(u.shape)
        lost = whole | (steps["null_value"][at] + steps["null_k"][at] > 0)[..., None]
        scale = np.where(code == 0, (value - 1.0) * k + 1.0, np.where(code == 1, 1.0 - k, flat))
        shift = np.where(code == 0, 0.0, value * k)
        no_scale = np.where(code == 0, lost, (code == 1) & (steps["null_k"][at] > 0)[..., None])
        parts = [scale, shift, no_scale, (code != 0) & lost, (code == 1) | whole]
        seqs = [steps[c][at] for c in ("item_seq", "seq")]
        tied = (real[:, 1:] & (seqs[0][:, 1:] == seqs[0][:, :-1]) & (seqs[1][:, 1:] == seqs[1][:, :-1])).any(axis=1)
        if tied.any():  # equal places, as of packages with one id: by their values, NULL first
            keys = [p[tied] for p in parts]
            keys = [keys[4], np.where(keys[3], -np.inf, keys[1]), ~keys[3], np.where(keys[2], -np.inf, keys[0]), ~keys[2]]
            keys += [whole[tied] + (q[tied])[..., None] for q in (seqs[1], seqs[0], ~real)]
            order = np.lexsort(keys, axis=1)
            for part in parts:
                part[tied] = np.take_along_axis(part[tied], order, axis=1)
        return tuple(parts)

    def fold(start: np.ndarray, parts: tuple[np.ndarray, ...], real: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `fold_steps`: NULL takes a bound where there is one."""
        x = np.repeat(start[:, None], n, axis=1)
        null = np.zeros(x.shape, bool)
        low, high = [np.where(np.isnan(b), sign * np.inf, b)[:, None] for b, sign in ((lo, -1), (hi, 1))]
        bounded = ~(np.isnan(lo) & np.isnan(hi))[:, None]
        bound = np.where(np.isnan(hi), lo, np.maximum(hi, np.where(np.isnan(lo), -np.inf, lo)))[:, None]
        for j in range(real.shape[1]):
            scale, shift, no_scale, no_shift, raises = (p[:, j] for p in parts)
            new, lost = x * scale + shift, null | no_scale | no_shift
            new = np.where(raises, np.where(lost, x, np.maximum(x, new)), new)
            lost = np.where(raises, null, lost)
            new = np.where(np.isnan(hi)[:, None], new, np.fmin(new, high))
            new = np.where(lost & bounded, bound, np.maximum(new, low))
            on = real[:, j][:, None]
            x, null = np.where(on, new, x), np.where(on, lost & ~bounded, null)
        return x, null.any(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            begin, fields = lists.offsets.to_numpy(), lists.flatten()
            begin, sizes = begin[:-1] - begin[0], np.diff(begin)
            steps = {f.name: pc.fill_null(fields.field(i), 0).to_numpy(zero_copy_only=False) for i, f in enumerate(fields.type)}
            features = batch.column(1).to_pylist()
            start = np.array([float(baseline[f]) for f in features])
            lo, hi = (np.array([np.nan if (b := S.EFFECT_BOUNDS.get(f, (None, None))[i]) is None else float(b) for f in features]) for i in (0, 1))
            by_size, done = np.argsort(sizes, kind="stable"), 0
            while done < len(by_size):
                widths = np.maximum(sizes[by_size[done:]], 1) * (np.arange(len(by_size) - done) + 1) * n
                rows = by_size[done: done + max(1, int(np.searchsorted(widths, DRAWN_VALUES, side="right")))]
                done += len(rows)
                place = np.arange(int(sizes[rows[-1]]))
                real = place[None, :] < sizes[rows][:, None]
                at = np.where(real, begin[rows][:, None] + place[None, :], begin[rows][:, None])
                x, null = fold(start[rows], drawn(steps, at, real), real, lo[rows], hi[rows])
                out = [x.mean(axis=1), x.std(axis=1)]
                ranked = np.sort(x, axis=1)
                for p in (0.05, 0.95):
                    spot = (n - 1) * p
                    low, high = int(np.floor(spot)), int(np.ceil(spot))
                    out.append(ranked[:, low] if low == high else (high - spot) * ranked[:, low] + (spot - low) * ranked[:, high])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), *[pa.array(v, mask=null) for v in out]],
                    [*batch.schema.names[:2], "mean", "std", "p5", "p95"],
                )

    return run


def effect_uncertainty(
    spark: SparkSession, packages: DataFrame, baseline: Mapping[str, float], *, n: int = 50, seed: int = 42,
    package_id: str = "package_id",
) -> DataFrame:
    """Monte-Carlo over the effects' sampling ranges: (package_id, feature, mean, std, p5, p95, original).

    Each draw is a hashed uniform of (package number, draw, item, effect): the catalogue stays as it is. A package's steps on a
    feature meet once, in one small array; the draws are columns of a matrix over many packages, so no row is multiplied by them.
    """
    features = list(baseline)
    indexed = stack_index(packages, effects_table(spark), package_id=package_id).where(F.col("feature").isin(features))
    first = ((F.col(package_id) * n * 64 + F.col("item_seq")) * 16 + F.col("seq")).cast("bigint")
    k = F.col("coverage") * F.col("stack")
    code = F.when(F.col("mode") == "multiply", 0).when(F.col("mode") == "set_max", 1).otherwise(2)
    lost = first.isNull() | F.col("lo").isNull() | F.col("hi").isNull()
    step = F.struct("item_seq", "seq", code.alias("code"), k.alias("k"), "lo", "hi", first.alias("first"), k.isNull().cast("int").alias("null_k"), lost.cast("int").alias("null_value"))
    steps = indexed.groupBy(package_id, "feature").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    found = T.StructType([steps.schema[package_id], steps.schema["feature"], *[T.StructField(c, T.DoubleType()) for c in ("mean", "std", "p5", "p95")]])
    drawn = steps.mapInArrow(_draw_effects(baseline, n, seed), found)
    return drawn.select(package_id, "feature", *[round_even(F.col(c), 4).alias(c) for c in ("mean", "std", "p5", "p95")]).withColumn("original", round_even(
        F.create_map(*[F.lit(x) for f in features for x in (f, float(baseline[f]))])[F.col("feature")], 4))
