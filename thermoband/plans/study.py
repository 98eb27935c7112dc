"""The whole analysis over a user's own logger files.

    inputs = Raw(body_logs(spark, "logs/"), env_logs(spark, "env.csv"), lab_logs(spark, "lab.csv"))
    tables = tidy(inputs, season)          # body, env, lab, run metadata
    save_tables(tables, root)              # Parquet
    results = summaries(load_tables(...))  # day-part, contrast and smoothed tables
    models = fit_models(tables)            # the two mixed models, with tests and predictions
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from thermoband.functions.categories import LOCATIONS, TREATMENTS, TYPE_LABELS, recode
from thermoband.mixed import predict, tables as model_tables
from thermoband.mixed.fit import FittedModel, fit
from thermoband.mixed.spec import BODY_MODEL, ENV_MODEL
from thermoband.operators import cleaning, grids, series, smooth, summary
from thermoband.operators.band import attach_band, lab_summary, reference_band
from thermoband.operators.deviation import with_deviation
from thermoband.operators.keys import code_series
from thermoband.plans import fixed
from thermoband.sources.tables import write_csv

ENV_KEYS = ("location", "treatment")


@dataclass(frozen=True)
class Raw:
    """Readings as the log readers return them."""

    body: DataFrame
    env: DataFrame
    lab: DataFrame


@dataclass(frozen=True)
class Season:
    """First and last day of year, and the series left out.

    `years` is optional and only helps file scans skip other times.
    """

    first_day: int = 182
    last_day: int = 237
    exclude: tuple[str, ...] = ("NG2",)
    years: tuple[int, ...] | None = None


def tidy(raw: Raw, season: Season = Season()) -> dict[str, DataFrame]:
    """Tidy tables. Body and environment rows keep `obs_id` as the order of ties."""
    codes = code_series(raw.body, "original_id")
    body = cleaning.season_rows(
        raw.body, season.first_day, season.last_day, season.exclude, season.years
    )
    body = body.join(codes, ["original_id"]).select(
        "id", "type", "datetime", "day", "hour", "temp", "read_at", "obs_id"
    )
    return {
        "tb": body,
        "te": cleaning.clean_env(raw.env),
        "gradient": lab_summary(raw.lab),
        "gradient_metadata": series.run_metadata(raw.lab),
        "env_models": cleaning.env_dimension(raw.env),
        "env_completeness": cleaning.completeness(raw.env),
    }


def deviations(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The reference band and the two deviation tables."""
    band = reference_band(tables["gradient"])
    return {
        "band": band,
        "db": with_deviation(tables["tb"], band, "type", "temp", "db"),
        "de": with_deviation(tables["te"], band, "location", "temp", "de"),
    }


def summaries(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every observed series, summary and contrast table, each under its own name.

    Deviations are taken from `tables` if they were saved there, so that the many
    tables made of them do not each derive them again.
    """
    dev = {k: tables[k] for k in ("band", "db", "de")} if "db" in tables else deviations(tables)
    band, db, de = dev["band"], dev["db"], dev["de"]
    tb, te = tables["tb"], tables["te"]
    te_in, de_in = (cleaning.within_dates_of(df, tb) for df in (te, de))

    def labelled(df: DataFrame) -> DataFrame:
        return df.withColumn("type", recode("type", TYPE_LABELS))

    carry = ["tb_q1", "tb_q3"]
    out = dict(dev)
    out["hourly_tb"] = summary.hourly_mean(
        labelled(attach_band(tb, band, "type")), ["type", "day"], "temp", carry
    )
    out["hourly_te"] = summary.hourly_mean(attach_band(te, band, "location"), ENV_KEYS, "temp", carry)
    out["hourly_db"] = summary.hourly_mean(labelled(db), ["type", "day"], "db")
    out["hourly_de"] = summary.hourly_mean(de, ENV_KEYS, "de")

    smoothed = {"tb": (["type"], "temp"), "te": (ENV_KEYS, "temp"), "db": (["type"], "db"), "de": (ENV_KEYS, "de")}
    for name, (keys, value) in smoothed.items():
        kept = smooth.censor(out[f"hourly_{name}"], value, *fixed.LIMITS[name])
        out[f"smooth_{name}"] = smooth.loess_by_hour(kept, keys, value, surface="interpolate")
    parts = {
        "tb": (labelled(tb), ["type"], "temp"), "te": (te_in, ENV_KEYS, "temp"),
        "db": (labelled(db), ["type"], "db"), "de": (de_in, ENV_KEYS, "de"),
    }
    for name, (df, keys, value) in parts.items():
        out[f"part_series_{name}"] = summary.daily_parts(df, keys, value)
        out[f"part_summary_{name}"] = summary.part_summary(df, keys, value, fixed.PART_WIDTH[name])

    places, cover, groups = LOCATIONS, TREATMENTS, tuple(TYPE_LABELS.values())
    out["env_deviation_cells"] = summary.cell_mean(de_in, ENV_KEYS, "de")
    out["env_deviation_by_daytime"] = summary.contrast(de_in, ENV_KEYS, "location", places, "de", ["treatment"])
    out["env_deviation_by_location"] = summary.contrast(de_in, ENV_KEYS, "location", places, "de")
    out["env_deviation_by_treatment"] = summary.contrast(de_in, ENV_KEYS, "treatment", cover, "de")
    out["body_deviation_by_group"] = summary.contrast(labelled(db), ["type"], "type", groups, "db")
    return out


def fit_models(tables: dict[str, DataFrame]) -> dict[str, FittedModel]:
    return {
        "tb": fit(tables["tb"], BODY_MODEL, "id", ts="read_at", order=["read_at", "obs_id"]),
        "te": fit(tables["te"], ENV_MODEL, "id", order=["datetime", "obs_id"]),
    }


def model_results(
    spark: SparkSession, tables: dict[str, DataFrame], models: dict[str, FittedModel], rule: str = "containment"
) -> dict[str, DataFrame]:
    """Marginal means, tests, and predictions for groups and for single series."""
    tb, te, fit_tb, fit_te = tables["tb"], tables["te"], models["tb"], models["te"]
    band = reference_band(tables["gradient"])
    means = model_tables.means_and_contrasts
    out = {
        "means_te": model_tables.means_table(spark, means(fit_te, te, list(ENV_KEYS), list(ENV_KEYS), rule)),
        "means_tb": model_tables.means_table(spark, means(fit_tb, tb, ["type"], ["type"], rule)),
        "anova_te": model_tables.tests_table(
            spark, model_tables.sequential_tests(fit_te, model_tables.ENV_TERMS)
        ),
        "anova_tb": model_tables.tests_table(
            spark, model_tables.sequential_tests(fit_tb, model_tables.BODY_TERMS)
        ),
    }
    grid_tb = grids.group_grid(tb, {"type": tuple(TYPE_LABELS)}, hours=fixed.GRID_HOURS, days=fixed.GROUP_DAYS["tb"])
    grid_te = grids.group_grid(te, {"location": LOCATIONS, "treatment": TREATMENTS}, hours=fixed.GRID_HOURS, days=fixed.GROUP_DAYS["te"])
    out["pred_tb"] = predict.predict_population(grid_tb, fit_tb, m=fixed.JOINT_LIMITS["tb"])
    out["pred_te"] = predict.predict_population(grid_te, fit_te, m=fixed.JOINT_LIMITS["te"])
    out["pred_db"] = with_deviation(out["pred_tb"], band, "type", "pred", "pred_db")
    out["pred_de"] = with_deviation(out["pred_te"], band, "location", "pred", "pred_de")
    dims = {
        "tb": (tb, tb.select("id", "type").distinct(), fit_tb),
        "te": (te, te.select("id", "location", "site", "treatment").distinct(), fit_te),
    }
    for name, (df, rows, fitted) in dims.items():
        effects = predict.with_effects(rows, fitted)
        out[f"pred_series_{name}"] = predict.predict_on_grid(df, effects, fitted, hours=fixed.GRID_HOURS, days=fixed.SERIES_DAYS[name])
    return out


def write_results(results: dict[str, DataFrame], root: str, names: Sequence[str] | None = None) -> None:
    """One CSV folder per table."""
    for name in names or results:
        write_csv(results[name], f"{root}/{name}")
