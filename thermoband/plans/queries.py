"""Every registered query: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoband.functions import categories as cat
from thermoband.functions import clock, strict
from thermoband.functions.fourier import fourier_terms
from thermoband.mixed import plain, predict, tables
from thermoband.mixed.fit import FittedModel, at_parameters, fit
from thermoband.mixed.spec import BODY_MODEL, ENV_MODEL, PeriodicModel
from thermoband.mixed.stats import long_statistics, series_statistics
from thermoband.operators import band as bands
from thermoband.operators import cleaning, grids, series, smooth, summary
from thermoband.operators.deviation import deviation, with_deviation
from thermoband.plans.fixed import GRID_HOURS, GROUP_DAYS, JOINT_LIMITS, LIMITS, PART_WIDTH, SERIES_DAYS, STATED
from thermoband.plans.inputs import Inputs
from thermoband.session import durable, remove_folder, shared_dir
from thermoband.sources import logs, types
from thermoband.sources import tables as stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Digits kept in compared reals; sums in another order differ far below that.
# Means of readings are short fractions, which sit on rounding ties at 6 digits but not at 8.
DIGITS = 6
MEAN_DIGITS = 8
ENV_KEYS = ("location", "treatment")


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Inputs(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def rounded(df: DataFrame, cols: Sequence[str], digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in cols})


# --- scans and sources -------------------------------------------------------


@query
def q_scan_lower_rename(t: Inputs) -> DataFrame:
    shouting = t.events.toDF(*[c.upper() for c in t.events.columns])
    return (
        logs.lower_names(shouting)
        .withColumnsRenamed({"user_id": "series", "value": "temp"})
        .drop("props")
        .select("event_id", "ts", "series", "event_type", "temp")
    )


FORMS = 7


def _written_time(form: Column, seconds: bool) -> tuple[Column, Column]:
    """Date and time of `ts` as text, in one of seven forms; the last one is no date."""
    ts = F.col("ts")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    month, day, year = F.month(ts), F.dayofmonth(ts), F.year(ts)
    date = (
        F.when(form == 0, F.concat_ws("/", month, day, year))
        .when(form == 1, F.concat_ws("-", two(month), two(day), year))
        .when(form == 2, F.concat_ws(".", month, two(day), two(year % 100)))
        .when(form == 3, F.concat_ws(" ", two(month), day, year))
        .when(form == 4, F.concat(F.date_format(ts, "MMMM"), F.lit(" "), day, F.lit(", "), year))
        .when(form == 5, F.concat_ws("-", F.upper(F.date_format(ts, "MMM")), day, year))
        .otherwise(F.concat_ws("/", F.lit(13), day, year))
    )
    rest = F.concat_ws(":", two(F.minute(ts)), *([two(F.floor(F.date_part(F.lit("SECOND"), ts)))] if seconds else []))
    half = F.concat((F.hour(ts) + 11) % 12 + 1, F.lit(":"), rest, F.when(F.hour(ts) < 12, " AM").otherwise(" PM"))
    return date, F.when(form.isin(1, 4), half).otherwise(F.concat(F.hour(ts), F.lit(":"), rest))


@query
def q_unite_parse(t: Inputs) -> DataFrame:
    date, time = _written_time(F.col("event_id") % FORMS, seconds=True)
    parts = t.events.select("event_id", date.alias("date"), time.alias("time"))
    return parts.select("event_id", cat.unite(" ", "date", "time").alias("text")).withColumn(
        "datetime", clock.parse_mdy_hms("text")
    )


@query
def q_parse_mdy_hm(t: Inputs) -> DataFrame:
    date, time = _written_time(F.col("event_id") % FORMS, seconds=False)
    read = t.events.select("event_id", clock.parse_mdy_hm(F.concat_ws(" ", date, time)).alias("datetime"))
    return read.withColumn("unreadable", F.col("datetime").isNull())


@query
def q_csv_roundtrip(t: Inputs) -> DataFrame:
    root = f"{shared_dir(t.spark)}/roundtrip-{uuid.uuid4().hex}"
    ev = t.events.select("event_id", "ts", "value")
    stored.write_csv(ev, f"{root}/csv")
    stored.save_tables({"events": ev}, root)
    csv = logs.read_log_dir(t.spark, f"{root}/csv", ev.schema).select(ev.columns)
    parquet = stored.load_tables(t.spark, root, ["events"])["events"]
    both = durable(
        csv.withColumn("format", F.lit("csv")).unionByName(parquet.withColumn("format", F.lit("parquet")))
    )
    remove_folder(t.spark, root)
    return both


# Bytes of the blocks that the small test files are cut into, so that records lie across their borders.
BLOCK = 65_536
# A larger folder is cut into about so many blocks, for as long as they are smaller than the session's own.
BLOCKS = 256


def block_bytes(folder: int, own: int) -> int:
    """Bytes of a block of a folder of so many bytes, where the session's own blocks have `own`."""
    return min(max(BLOCK, -(-folder // BLOCKS)), max(BLOCK, own))


def _in_blocks(spark: SparkSession, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What `build` gives, with `folder` read in small blocks and written."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[0])
    for n, value in zip(names, (str(block_bytes(stored.folder_bytes(spark, folder), own)), "1"), strict=True):
        spark.conf.set(n, value)
    try:
        return durable(build())
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)


@query
def q_csv_dirs(t: Inputs) -> DataFrame:
    """One folder of files with columns in another order, missing columns, other endings and names that start with an
    underscore, quoted line breaks (in blocks that cut records), an empty file, and a folder that is no part of it."""
    root = f"{shared_dir(t.spark)}/logs-{uuid.uuid4().hex}"
    ev = t.events
    kind = F.col("event_id") % 3
    said = F.concat(F.lit('said "'), "event_type", F.lit('",\n\nthen,\n"'), "event_id", F.lit('"\n'))
    first = ev.filter(kind == 0).select("event_id", "ts", said.alias("note"), "value", "event_type")
    stored.write_csv(first, root)
    stored.write_csv(ev.filter(kind == 2).select("ts", "event_id", F.col("user_id").alias("Extra")), root, "txt", append=True)
    stored.write_csv(ev.filter("false").select("event_id"), root, "nil", append=True)
    stored.write_csv(first, f"{root}/sub")
    stored.write_csv(ev.filter(kind == 1).select("event_type", F.col("value").alias("VALUE"), "event_id"), f"{root}/other", "CSV")
    stored.move_files(t.spark, f"{root}/other", root, prefix="_")
    wanted = ev.select("event_id", "ts", "value", "event_type").schema
    kept = _in_blocks(t.spark, root, lambda: logs.read_log_dir(t.spark, root, wanted).select(*wanted.names, "extra", "note"))
    remove_folder(t.spark, root)
    return kept


@query
def q_infer_types(t: Inputs) -> DataFrame:
    """Types of the columns of a folder, whose files don't have the same columns and don't agree on all of them."""
    root = f"{shared_dir(t.spark)}/types-{uuid.uuid4().hex}"
    ev = t.events.filter("ts IS NOT NULL AND value IS NOT NULL")
    kind, even = F.col("event_id") % 3, F.when(F.col("event_id") % 2 == 0, "TRUE").otherwise("FALSE")
    none = F.lit(None).cast("string").alias("none")
    stored.write_csv(
        ev.filter(kind == 0).select("event_id", F.col("value").alias("amount"), F.to_date("ts").alias("day"), even.alias("flag"), "ts", none), root
    )
    stored.write_csv(
        ev.filter(kind == 1).select(F.col("ts").alias("day"), F.col("user_id").alias("AMOUNT"), "event_id", F.concat("event_type", F.lit("\n")).alias("note")),
        root, append=True,
    )
    stored.write_csv(ev.filter(kind == 2).select("ts", even.substr(1, 1).alias("flag"), none, F.col("user_id").alias("note")), root, append=True)
    found = durable(types.folder_types(t.spark, root).select("name", "kind", (F.col("n_apart") > 0).alias("apart")))
    remove_folder(t.spark, root)
    return found


@query
def q_bundle(t: Inputs) -> DataFrame:
    """Tables saved as one bundle twice, and the second one loaded."""
    root = f"{shared_dir(t.spark)}/bundle-{uuid.uuid4().hex}"
    ev = t.events.select("event_id", "event_type", "value")
    clicks = F.col("event_type") == "click"
    stored.save_bundle({"clicks": ev.filter(clicks), "rest": ev.filter("false")}, root)
    stored.save_bundle({"clicks": ev.filter(clicks), "rest": ev.filter(~clicks)}, root, by={"rest": ["event_type"]})
    loaded = stored.load_bundle(t.spark, root)
    named = [df.select(F.lit(name).alias("name"), "event_id", "event_type", "value") for name, df in sorted(loaded.items())]
    both = durable(logs.union_by_name(*named))
    remove_folder(t.spark, root)
    return both


@query
def q_union_by_name(t: Inputs) -> DataFrame:
    ev = t.events.select("event_id", "event_type", "value", "props")
    known = F.col("event_type").isin("click", "view", "purchase", "signup")
    described = ev.filter(known).select("props", "value", "event_type", "event_id")
    rest = ev.filter(~F.coalesce(known, F.lit(False))).drop("props")
    return logs.union_by_name(described, rest).select("event_id", "event_type", "value", "props")


# --- clock -------------------------------------------------------------------


@query
def q_round_hour(t: Inputs) -> DataFrame:
    return t.events.select("event_id", clock.round_hour("ts").alias("datetime"))


@query
def q_calendar_parts(t: Inputs) -> DataFrame:
    return t.events.select(
        "event_id",
        clock.day_of_year("ts").alias("day"),
        clock.hour_of_day("ts").alias("hour"),
        clock.calendar_date("ts").alias("date"),
    )


@query
def q_eco_date(t: Inputs) -> DataFrame:
    return t.events.select("event_id", clock.ecological_date("ts").alias("date_adj"))


@query
def q_day_to_date(t: Inputs) -> DataFrame:
    grid = grids.group_grid(t.tb_rows, {}, hours=100, days=None)
    whole, minute = clock.hour_minute("hour")
    return grid.select(
        F.col("day").cast("int").alias("day"),
        whole.alias("hour"),
        minute.alias("minute"),
        clock.timestamp_of("day", "hour").alias("datetime"),
    )


# --- cleaning ----------------------------------------------------------------


@query
def q_dictionary_id(t: Inputs) -> DataFrame:
    return t.codes


@query
def q_tb_clean(t: Inputs) -> DataFrame:
    return t.tb


@query
def q_season_bounds(t: Inputs) -> DataFrame:
    field = t.body_raw.filter(F.col("location") == "field")
    return cleaning.season_bounds(field).orderBy(F.desc("last_datetime"))


@query
def q_te_clean(t: Inputs) -> DataFrame:
    return t.te


@query
def q_env_dimension(t: Inputs) -> DataFrame:
    return cleaning.env_dimension(t.env_raw)


@query
def q_completeness(t: Inputs) -> DataFrame:
    return cleaning.completeness(t.env_raw)


@query
def q_date_range_filter(t: Inputs) -> DataFrame:
    return t.in_season(t.te)


@query
def q_run_metadata(t: Inputs) -> DataFrame:
    out = series.run_metadata(t.lab_raw).orderBy("run", "snakeid", "repro")
    return rounded(out, ["gap_max_s", "gap_min_s", "duration_s", "s"])


@query
def q_panel_index(t: Inputs) -> DataFrame:
    # One row per animal carries the counts, so the codes join to animals, not to readings.
    counted = t.tb_rows.groupBy("original_id", "type").agg(F.count(F.lit(1)).alias("n_rows"))
    coded = counted.join(t.codes, ["original_id"])
    return series.panel_index(coded, rows="n_rows")


@query
def q_display_order(t: Inputs) -> DataFrame:
    labelled = t.tb_rows.select("type").distinct().withColumn("label", cat.recode("type", cat.TYPE_LABELS))
    return labelled.withColumn(
        "ord", cat.display_order("label", list(reversed(cat.TYPE_LABELS.values())))
    ).orderBy("ord")


# --- bands and deviations ----------------------------------------------------


@query
def q_gradient(t: Inputs) -> DataFrame:
    return rounded(bands.lab_summary(t.lab_raw), ["tb_med", "tb_q1", "tb_q3"], MEAN_DIGITS)


@query
def q_reference_band(t: Inputs) -> DataFrame:
    return rounded(t.band, ["tb_med", "tb_q1", "tb_q3"], MEAN_DIGITS)


@query
def q_dev_body(t: Inputs) -> DataFrame:
    db = with_deviation(t.tb, t.band, "type", "temp", "db")
    return rounded(db.select("id", "type", "datetime", "day", "hour", "db"), ["db"], MEAN_DIGITS)


@query
def q_dev_env(t: Inputs) -> DataFrame:
    cols = ["id", "site", "location", "treatment", "datetime", "day", "hour", "de"]
    return rounded(t.de.select(cols), ["de"], MEAN_DIGITS)


# --- day-parts and summaries -------------------------------------------------


@query
def q_daypart3(t: Inputs) -> DataFrame:
    return t.te.select("hour", cat.daypart3("hour").alias("daytime")).distinct()


@query
def q_daypart2(t: Inputs) -> DataFrame:
    return t.te.select("hour", cat.daypart2("hour").alias("daytime")).distinct()


def _labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("type", cat.recode("type", cat.TYPE_LABELS))


def _hourly_with_band(t: Inputs, df: DataFrame, key: str, keys: Sequence[str]) -> DataFrame:
    joined = bands.attach_band(df, t.band, key)
    out = summary.hourly_mean(joined, keys, "temp", carry=["tb_q1", "tb_q3"])
    return rounded(out, ["temp", "tb_q1", "tb_q3"], MEAN_DIGITS)


@query
def q_hourly_tb(t: Inputs) -> DataFrame:
    return _labelled(_hourly_with_band(t, t.tb_rows, "type", ["type", "day"]))


@query
def q_hourly_te(t: Inputs) -> DataFrame:
    return _hourly_with_band(t, t.te, "location", ENV_KEYS)


@query
def q_hourly_db(t: Inputs) -> DataFrame:
    return rounded(_labelled(summary.hourly_mean(t.db_rows, ["type", "day"], "db")), ["db"], MEAN_DIGITS)


@query
def q_hourly_de(t: Inputs) -> DataFrame:
    return rounded(summary.hourly_mean(t.de, ENV_KEYS, "de"), ["de"], MEAN_DIGITS)


def _parts(t: Inputs, what: str) -> tuple[DataFrame, Sequence[str], str]:
    """Rows, group keys and value column of the four day-part views."""
    return {
        "tb": lambda: (_labelled(t.tb_rows), ("type",), "temp"),
        "te": lambda: (t.in_season(t.te), ENV_KEYS, "temp"),
        "db": lambda: (_labelled(t.db_rows), ("type",), "db"),
        "de": lambda: (t.in_season(t.de), ENV_KEYS, "de"),
    }[what]()


def _register_parts(what: str) -> None:
    def part_series(t: Inputs) -> DataFrame:
        df, keys, value = _parts(t, what)
        out = summary.daily_parts(df, keys, value).withColumnRenamed(value, what)
        return rounded(out, [what], MEAN_DIGITS)

    def part_summary(t: Inputs) -> DataFrame:
        df, keys, value = _parts(t, what)
        return rounded(
            summary.part_summary(df, keys, value, PART_WIDTH[what]), ["avg", "se", "lo", "hi"], MEAN_DIGITS
        )

    part_series.__name__ = f"q_part_series_{what}"
    part_summary.__name__ = f"q_part_summary_{what}"
    query(part_series)
    query(part_summary)


for _what in PART_WIDTH:
    _register_parts(_what)


@query
def q_cell_mean_de(t: Inputs) -> DataFrame:
    return rounded(summary.cell_mean(t.in_season(t.de), ENV_KEYS, "de"), ["de"], MEAN_DIGITS)


@query
def q_contrast_de_daytime(t: Inputs) -> DataFrame:
    out = summary.contrast(
        t.in_season(t.de), ENV_KEYS, "location", ("Prairie", "Rookery"), "de", within=["treatment"]
    )
    return rounded(out, ["Prairie", "Rookery", "diff"], MEAN_DIGITS)


@query
def q_contrast_de_location(t: Inputs) -> DataFrame:
    out = summary.contrast(t.in_season(t.de), ENV_KEYS, "location", ("Prairie", "Rookery"), "de")
    return rounded(out, ["Prairie", "Rookery", "diff"], MEAN_DIGITS)


@query
def q_contrast_de_exposure(t: Inputs) -> DataFrame:
    out = summary.contrast(t.in_season(t.de), ENV_KEYS, "treatment", ("Exposed", "Shaded"), "de")
    return rounded(out, ["Exposed", "Shaded", "diff"], MEAN_DIGITS)


@query
def q_contrast_db_group(t: Inputs) -> DataFrame:
    levels = tuple(cat.TYPE_LABELS.values())
    out = summary.contrast(_labelled(t.db_rows), ["type"], "type", levels, "db")
    return rounded(out, [*levels, "diff"], MEAN_DIGITS)


@query
def q_interval_text(t: Inputs) -> DataFrame:
    cells = (
        t.tb_rows.withColumn("daytime", cat.daypart3("hour"))
        .groupBy(cat.composite("type", "daytime").alias("group"))
        .agg(strict.mean("temp").alias("m"), strict.se("temp").alias("e"))
    )
    lo, hi = F.col("m") - 2 * F.col("e"), F.col("m") + 2 * F.col("e")
    return cells.select("group", cat.interval_text(lo, hi).alias("ci"))


# --- grids and bases ---------------------------------------------------------


def _body_grid0(t: Inputs) -> DataFrame:
    return grids.group_grid(t.tb_rows, {"type": tuple(cat.TYPE_LABELS)}, hours=GRID_HOURS, days=GROUP_DAYS["tb"])


def _env_grid0(t: Inputs) -> DataFrame:
    levels = {"location": cat.LOCATIONS, "treatment": cat.TREATMENTS}
    return grids.group_grid(t.te, levels, hours=GRID_HOURS, days=GROUP_DAYS["te"])


def _body_dims(t: Inputs) -> DataFrame:
    animals = t.tb_rows.select("original_id", "type").distinct()
    return animals.join(t.codes, ["original_id"])


def _env_dims(t: Inputs) -> DataFrame:
    return t.te.select("id", "location", "site", "treatment").distinct()


@query
def q_grid_level0_tb(t: Inputs) -> DataFrame:
    return _body_grid0(t)


@query
def q_grid_level0_te(t: Inputs) -> DataFrame:
    return _env_grid0(t)


@query
def q_grid_level1_tb(t: Inputs) -> DataFrame:
    dims = _body_dims(t).drop("original_id")
    return grids.series_grid(t.tb_rows, dims, hours=GRID_HOURS, days=SERIES_DAYS["tb"])


@query
def q_grid_level1_te(t: Inputs) -> DataFrame:
    return grids.series_grid(t.te, _env_dims(t), hours=GRID_HOURS, days=SERIES_DAYS["te"])


def _basis(df: DataFrame, column: str, harmonics: int, period: float) -> DataFrame:
    names = [f"{f}{k}" for k in range(1, harmonics + 1) for f in ("sin", "cos")]
    terms = dict(zip(names, fourier_terms("x", harmonics, period)))
    return rounded(df.select(F.col(column).alias("x")).distinct().withColumns(terms), names)


@query
def q_fourier_hour(t: Inputs) -> DataFrame:
    return _basis(t.tb_rows, "hour", 3, 23.0)


@query
def q_fourier_day(t: Inputs) -> DataFrame:
    return _basis(t.tb_rows, "day", 1, 365.0)


# Design columns shown by the query, under short names.
DESIGN_SHOWN = {
    "x_location": "location1",
    "x_location_treatment": "location1:treatment1",
    "x_hour": "hour_sin1",
    "x_treatment_hour": "treatment1:hour_cos2",
    "x_hour_day": "hour_sin2:day_cos1",
    "x_all": "location1:treatment1:hour_cos1:day_sin1",
}


@query
def q_design_row(t: Inputs) -> DataFrame:
    names = ENV_MODEL.column_names()
    rows = t.te_ordered.select("obs_id", "id", "datetime", ENV_MODEL.design_row().alias("x"))
    shown = {short: F.get("x", F.lit(names.index(full))) for short, full in DESIGN_SHOWN.items()}
    shown["x_sum"] = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return rounded(rows.withColumns(shown).drop("x"), list(shown))


# --- smoothing ---------------------------------------------------------------



def _smooth_input(t: Inputs, what: str) -> tuple[DataFrame, Sequence[str], str]:
    df, keys, value = {
        "tb": lambda: (t.tb_rows, ("type",), "temp"),
        "te": lambda: (t.te, ENV_KEYS, "temp"),
        "db": lambda: (t.db_rows, ("type",), "db"),
        "de": lambda: (t.de, ENV_KEYS, "de"),
    }[what]()
    return summary.hourly_mean(df, keys, value), keys, value


@query
def q_band_censor(t: Inputs) -> DataFrame:
    parts = []
    for what in ("tb", "te"):
        df, keys, value = _smooth_input(t, what)
        kept = smooth.censor(df, value, *LIMITS[what])
        parts.append(
            kept.groupBy(cat.composite(*keys).alias("panel")).agg(F.count(F.lit(1)).alias("n_kept"))
        )
    return logs.union_by_name(*parts)


def _register_loess(what: str) -> None:
    def loess(t: Inputs) -> DataFrame:
        df, keys, value = _smooth_input(t, what)
        kept = smooth.censor(df, value, *LIMITS[what])
        return rounded(smooth.loess_by_hour(kept, keys, value), ["x0", "fit"])

    def between_vertices(t: Inputs) -> DataFrame:
        df, keys, value = _smooth_input(t, what)
        kept = smooth.censor(df, value, *LIMITS[what])
        return rounded(smooth.loess_by_hour(kept, keys, value, surface="interpolate"), ["x0", "fit"])

    for name, build in (("loess", loess), ("loess_vertices", between_vertices)):
        build.__name__ = f"q_{name}_{what}"
        query(build)


for _what in LIMITS:
    _register_loess(_what)


# --- mixed models ------------------------------------------------------------


@query
def q_ar1_stats(t: Inputs) -> DataFrame:
    stats = series_statistics(t.tb_rows, BODY_MODEL, "original_id", "temp", "read_at", ["read_at", "obs_id"])
    coded = stats.join(t.codes, ["original_id"])
    return rounded(long_statistics(coded, BODY_MODEL, "id"), ["s0", "s1", "s2"])


def fit_body(t: Inputs) -> FittedModel:
    return fit(t.tb_rows, BODY_MODEL, "original_id", ts="read_at", order=["read_at", "obs_id"])


def fit_env(t: Inputs) -> FittedModel:
    return fit(t.te_ordered, ENV_MODEL, "id", order=["datetime", "obs_id"])


FITS = {"tb": fit_body, "te": fit_env}


def coefficient_rows(fitted: FittedModel) -> list[tuple[int, str, float, float]]:
    se = fitted.cov.diagonal() ** 0.5
    return [
        (i, name, float(b), float(s))
        for i, (name, b, s) in enumerate(zip(fitted.model.column_names(), fitted.beta, se), start=1)
    ]


def variance_rows(fitted: FittedModel) -> list[tuple[str, float]]:
    rows = [(f"sd:{n}", float(s)) for n, s in zip(fitted.model.slope_names(), fitted.slope_sd)]
    return [*rows, ("phi", fitted.phi), ("sigma", fitted.sigma), ("reml", fitted.criterion)]


def _register_model(what: str) -> None:
    def coef(t: Inputs) -> DataFrame:
        return t.spark.createDataFrame(
            coefficient_rows(FITS[what](t)), "ord int, term string, estimate double, se double"
        )

    def var(t: Inputs) -> DataFrame:
        return t.spark.createDataFrame(variance_rows(FITS[what](t)), "parameter string, value double")

    def blup(t: Inputs) -> DataFrame:
        long = predict.long_effects(FITS[what](t))
        if what == "te":
            return long
        return long.join(t.codes, ["original_id"]).select("id", "term", "value")

    for name, build in (("coef", coef), ("var", var), ("blup", blup)):
        build.__name__ = f"q_lmm_{name}_{what}"
        query(build)


for _what in FITS:
    _register_model(_what)



@query
def q_predict_level0_tb(t: Inputs) -> DataFrame:
    out = predict.predict_population(_body_grid0(t), fit_body(t), JOINT_LIMITS["tb"])
    return out.withColumn("datetime", clock.timestamp_of("day", "hour"))


@query
def q_predict_level0_te(t: Inputs) -> DataFrame:
    return predict.predict_population(_env_grid0(t), fit_env(t), JOINT_LIMITS["te"])


@query
def q_predict_level1_tb(t: Inputs) -> DataFrame:
    fitted = fit_body(t)
    dims = predict.with_effects(_body_dims(t), fitted).drop("original_id")
    return predict.predict_on_grid(t.tb_rows, dims, fitted, hours=GRID_HOURS, days=SERIES_DAYS["tb"])


@query
def q_predict_level1_te(t: Inputs) -> DataFrame:
    fitted = fit_env(t)
    dims = predict.with_effects(_env_dims(t), fitted)
    return predict.predict_on_grid(t.te, dims, fitted, hours=GRID_HOURS, days=SERIES_DAYS["te"])


def _predicted_deviation(t: Inputs, pred: DataFrame, key: str, name: str, keep: Sequence[str]) -> DataFrame:
    return with_deviation(pred, t.band, key, "pred", name).select(*keep, "day", "hour", name)


@query
def q_pred_deviation_db(t: Inputs) -> DataFrame:
    return _predicted_deviation(t, q_predict_level0_tb(t), "type", "pred_db", ["type", "datetime", "se"])


@query
def q_pred_deviation_de(t: Inputs) -> DataFrame:
    return _predicted_deviation(t, q_predict_level0_te(t), "location", "pred_de", ENV_KEYS)


@query
def q_emm_tb(t: Inputs) -> DataFrame:
    rows = tables.means_and_contrasts(fit_body(t), t.tb_rows, ["type"], ["type"])
    return tables.means_table(t.spark, rows)


@query
def q_emm_te(t: Inputs) -> DataFrame:
    rows = tables.means_and_contrasts(fit_env(t), t.te, list(ENV_KEYS), list(ENV_KEYS))
    return tables.means_table(t.spark, rows)


@query
def q_anova_tb(t: Inputs) -> DataFrame:
    return tables.tests_table(t.spark, tables.sequential_tests(fit_body(t), tables.BODY_TERMS))


@query
def q_anova_te(t: Inputs) -> DataFrame:
    return tables.tests_table(t.spark, tables.sequential_tests(fit_env(t), tables.ENV_TERMS))


# --- models at stated parameters ---------------------------------------------

# Correlation of neighbouring readings that the search starts from; no slopes, one hour wave and no day terms,
# so that SQL can solve the same equations from single rows.
PHI = 0.8
SMALL = {
    "tb": PeriodicModel(factors=BODY_MODEL.factors, hour_harmonics=1, day_harmonics=0),
    "te": PeriodicModel(factors=ENV_MODEL.factors, hour_harmonics=1, day_harmonics=0),
}


def gls(t: Inputs, what: str) -> FittedModel:
    model = SMALL[what]
    sd = [0.0] * (model.slopes_per_series * len(model.slope_levels))
    if what == "tb":
        return at_parameters(t.tb_rows, model, "original_id", PHI, sd, ts="read_at", order=["read_at", "obs_id"])
    return at_parameters(t.te_ordered, model, "id", PHI, sd, order=["datetime", "obs_id"])


def _register_at(what: str) -> None:
    def coef(t: Inputs) -> DataFrame:
        rows = t.spark.createDataFrame(coefficient_rows(gls(t, what)), "ord int, term string, estimate double, se double")
        return rounded(rows.drop("ord"), ["estimate", "se"])

    def scale(t: Inputs) -> DataFrame:
        fitted = gls(t, what)
        rows = [(fitted.n_rows, fitted.n_series, float(fitted.sigma))]
        return rounded(t.spark.createDataFrame(rows, "n_rows bigint, n_series bigint, sigma double"), ["sigma"])

    def means(t: Inputs) -> DataFrame:
        keys = ["type"] if what == "tb" else list(ENV_KEYS)
        found = tables.means_and_contrasts(gls(t, what), t.tb_rows if what == "tb" else t.te, keys, keys)
        return rounded(tables.means_table(t.spark, found).drop("ord"), ["estimate", "se", "lower", "upper"])

    def population(t: Inputs) -> DataFrame:
        grid = _body_grid0(t) if what == "tb" else _env_grid0(t)
        out = predict.predict_population(grid, gls(t, what), JOINT_LIMITS[what])
        return rounded(out, ["pred", "se", "lo", "hi"])

    def deviated(t: Inputs) -> DataFrame:
        grid, key, name, keep = (
            (_body_grid0(t), "type", "pred_db", ["type"]) if what == "tb" else (_env_grid0(t), "location", "pred_de", ENV_KEYS)
        )
        pred = predict.predict_population(grid, gls(t, what), JOINT_LIMITS[what])
        return rounded(_predicted_deviation(t, pred, key, name, keep), [name])

    for name, build in (
        ("gls_coef", coef), ("gls_scale", scale), ("emm_at", means), ("predict_at_level0", population), ("pred_deviation_at", deviated),
    ):
        build.__name__ = f"q_{name}_{what}"
        query(build)


for _what in SMALL:
    _register_at(_what)


# --- models at stated parameters, with slopes, in columns ----------------------

SLOPED = {"tb": SMALL["tb"], "te": replace(SMALL["te"], slopes_by="treatment")}
TERMS = {
    "tb": [x for x in tables.BODY_TERMS if "Day" not in x.split(":")],
    "te": [x for x in tables.ENV_TERMS if "Day" not in x.split(":")],
}
SERIES = {"tb": "original_id", "te": "id"}
# Digits of series predictions: there are so many that some lie close to a rounding at six.
SERIES_DIGITS = 4


def _statistics(t: Inputs, what: str) -> DataFrame:
    rows, ts, order = (t.tb_rows, "read_at", ["read_at", "obs_id"]) if what == "tb" else (t.te_ordered, "datetime", ["datetime", "obs_id"])
    return durable(series_statistics(rows, SLOPED[what], SERIES[what], "temp", ts, order))


def _stated(stats: DataFrame, what: str, which: int) -> tuple[DataFrame, DataFrame, Sequence[float]]:
    """Matrices of the series, fits of the classes, and the deviations of the slopes."""
    phi, sd = STATED[what][which]
    marginal = plain.marginal_matrices(stats, SLOPED[what], phi, sd)
    return marginal, plain.class_fits(marginal, SLOPED[what]), sd


def _register_stated(what: str) -> None:
    model = SLOPED[what]

    def reml(t: Inputs) -> DataFrame:
        stats = _statistics(t, what)
        rows = [
            plain.criterion(_stated(stats, what, i)[1], model).withColumn("at", F.lit(i + 1)) for i in range(len(STATED[what]))
        ]
        return rounded(logs.union_by_name(*rows), ["sigma", "reml"])

    def anova(t: Inputs) -> DataFrame:
        found = plain.sequential_tests(_stated(_statistics(t, what), what, 0)[1], model, TERMS[what])
        return rounded(found, ["f", "p"])

    def blup(t: Inputs) -> DataFrame:
        marginal, fits, sd = _stated(_statistics(t, what), what, 0)
        slopes = plain.series_slopes(marginal, fits, model, sd, SERIES[what])
        if what == "tb":
            slopes = slopes.join(t.codes, ["original_id"]).select("id", "term", "value")
        return rounded(slopes, ["value"])

    def level1(t: Inputs) -> DataFrame:
        marginal, fits, sd = _stated(_statistics(t, what), what, 0)
        coefs = plain.series_coefficients(marginal, fits, model, sd, SERIES[what])
        dims = (_body_dims(t) if what == "tb" else _env_dims(t)).join(coefs, SERIES[what], "left")
        rows = t.tb_rows if what == "tb" else t.te
        grid = predict.predict_on_grid(rows, dims.drop("original_id"), model, hours=GRID_HOURS, days=SERIES_DAYS[what])
        return rounded(grid, ["pred"], SERIES_DIGITS)

    for name, build in (("reml", reml), ("anova_at", anova), ("blup_at", blup), ("predict_at_level1", level1)):
        build.__name__ = f"q_{name}_{what}"
        query(build)


for _what in SLOPED:
    _register_stated(_what)
