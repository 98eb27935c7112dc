"""The whole study from CSV files to tables, on the readings of the small test data."""

from __future__ import annotations

import pandas as pd
import pytest

from thermoband.plans import study
from thermoband.sources import logs, tables


@pytest.fixture(scope="module")
def files(sf_dir, tmp_path_factory):
    """Logger files as a user has them: text dates, mixed headers, one folder per source."""
    root = tmp_path_factory.mktemp("logs")
    ev = pd.read_parquet(f"{sf_dir}/events.parquet").sort_values("ts")
    even = ev.user_id % 2 == 0
    animal = even.map({True: "G", False: "NG"}) + ev.user_id.astype(str)
    date, time = ev.ts.dt.strftime("%-m/%-d/%Y"), ev.ts.dt.strftime("%H:%M:%S")
    body = pd.DataFrame({"date": date, "time": time, "snakeid": animal, "location": "field", "temp": ev.value})
    (root / "body").mkdir()
    for name, part in body.groupby("snakeid"):
        cols = list(part.columns) if name.startswith("G") else ["temp", "snakeid", "location", "date", "time"]
        part[cols].to_csv(root / "body" / f"{name}.csv", index=False)
    pd.DataFrame(
        {
            "DateTime": ev.ts.dt.strftime("%-m/%-d/%Y %H:%M"), "Date": date, "Time": time, "Time_int": 0,
            "ID": ev.user_id, "Site": (ev.user_id % 10).map(lambda s: "Entrance" if s == 9 else f"S{s}"),
            "Location": even.map({True: "Rookery", False: "Prairie"}),
            "Treatment": (ev.user_id % 4 < 2).map({True: "Exposed", False: "Shaded"}), "Temp": ev.value,
        }
    ).to_csv(root / "env.csv", index=False)
    lab = pd.DataFrame(
        {"Date": date, "Time": time, "SnakeID": animal, "Repro": even.map({True: "Pregnant", False: "Non-Pregnant"}),
         "Run": 1, "Tb": ev.value}
    )
    lab[ev.event_type == "view"].to_csv(root / "lab.csv", index=False)
    return root, body


def test_study(spark, files, tmp_path):
    root, body = files
    raw = study.Raw(
        logs.body_logs(spark, f"{root}/body"), logs.env_logs(spark, f"{root}/env.csv"), logs.lab_logs(spark, f"{root}/lab.csv")
    )
    assert raw.body.count() == len(body)
    season = study.Season(first_day=5, last_day=25, exclude=("NG7",))
    tables.save_tables(study.tidy(raw, season), f"{tmp_path}/tidy", by={"tb": ["day"], "te": ["day"]})
    names = ["tb", "te", "gradient", "gradient_metadata", "env_models", "env_completeness"]
    tidy = tables.load_tables(spark, f"{tmp_path}/tidy", names)
    assert tidy["tb"].agg({"day": "min"}).first()[0] == 5
    assert tidy["tb"].filter("id IS NULL OR temp IS NULL").count() == 0

    tables.save_tables(study.deviations(tidy), f"{tmp_path}/tidy")
    tidy = tables.load_tables(spark, f"{tmp_path}/tidy", [*names, "band", "db", "de"])
    results = study.summaries(tidy)
    study.write_results(results, f"{tmp_path}/csv", ["env_deviation_by_daytime", "body_deviation_by_group", "part_summary_te", "smooth_de"])
    de = spark.read.option("header", True).csv(f"{tmp_path}/csv/env_deviation_by_daytime")
    assert de.columns == ["treatment", "daytime", "Prairie", "Rookery", "diff"] and de.count() == 4

    models = study.fit_models(tidy)
    out = study.model_results(spark, tidy, models)
    assert out["means_te"].count() == 6 and out["anova_te"].count() == 15
    assert out["means_tb"].count() == 3 and out["anova_tb"].count() == 7
    n_series = tidy["tb"].select("id").distinct().count()
    days = tidy["tb"].select("day").distinct().count()
    assert out["pred_series_tb"].filter("pred IS NOT NULL").count() == n_series * days * 100
    assert out["pred_de"].filter("pred_de IS NOT NULL AND se > 0").count() == 12_000


def bundle(spark, k):
    return {"a": spark.range(k).toDF("x"), "b": spark.range(k).selectExpr("id AS y", "id % 2 AS part")}


def sizes(spark, root):
    return {name: df.count() for name, df in tables.load_bundle(spark, root).items()}


def test_bundle_is_saved_as_one(spark, tmp_path):
    """A save that stops after the first table leaves the old bundle whole."""
    root = f"file://{tmp_path}/bundle"
    with pytest.raises(FileNotFoundError):
        tables.load_bundle(spark, root)
    tables.save_bundle(bundle(spark, 5), root)
    fails = spark.range(3).selectExpr("CAST(raise_error('stop') AS string) AS y")
    with pytest.raises(Exception, match="stop"):
        tables.save_bundle({"a": spark.range(9).toDF("x"), "b": fails}, root)
    assert sizes(spark, root) == {"a": 5, "b": 5}
    old = tables.load_bundle(spark, root)
    tables.save_bundle(bundle(spark, 7), root, by={"b": ["part"]})
    assert sizes(spark, root) == {"a": 7, "b": 7}
    assert old["a"].count() == 5  # who has loaded the version before can read on
    tables.save_bundle({"c": spark.range(2).toDF("x")}, root)
    assert sizes(spark, root) == {"c": 2}
    left = sorted(p.name for p in (tmp_path / "bundle").iterdir() if p.is_dir())
    assert len(left) == 2 and [n.split("-")[0] for n in left] == ["00000002", "00000003"]
    with pytest.raises(ValueError, match="needs tables"):
        tables.save_bundle({}, root)
