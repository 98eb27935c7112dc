"""Domain tables of the test data, built once per query."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from thermoband.operators import band as bands
from thermoband.operators import cleaning
from thermoband.operators.deviation import with_deviation
from thermoband.operators.keys import code_series
from thermoband.sources import events as ev

# Season and excluded series of the test data.
FIRST_DAY, LAST_DAY = 5, 25
EXCLUDED = ("NG7",)
#: More years than this are not named one by one.
MOST_YEARS = cleaning.MOST_RANGES


@dataclass
class Inputs:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def events(self) -> DataFrame:
        return ev.events(self.spark, self.sf_dir)

    @cached_property
    def known(self) -> tuple[datetime, datetime] | None:
        """First and last time of the events, None if there are none: one aggregate over a single column."""
        first, last = self.events.selectExpr("min(ts)", "max(ts)").first()
        return None if first is None else (first, last)

    @cached_property
    def years(self) -> tuple[int, ...] | None:
        """All years that rounded times of the events lie in; None if there are none or more than MOST_YEARS."""
        if self.known is None:
            return None
        first, last = self.known[0].year, (self.known[1] + timedelta(minutes=30)).year
        return None if last - first >= MOST_YEARS else tuple(range(first, last + 1))

    @cached_property
    def body_raw(self) -> DataFrame:
        return ev.body_raw(self.events)

    @cached_property
    def env_raw(self) -> DataFrame:
        return ev.env_raw(self.events)

    @cached_property
    def lab_raw(self) -> DataFrame:
        return ev.lab_raw(self.events)

    @cached_property
    def codes(self) -> DataFrame:
        """Numeric code of each animal; all animals take part, excluded ones too."""
        return code_series(self.body_raw, "original_id")

    @cached_property
    def tb(self) -> DataFrame:
        return cleaning.clean_body(self.body_raw, FIRST_DAY, LAST_DAY, EXCLUDED, codes=self.codes, years=self.years, known=self.known)

    @cached_property
    def tb_rows(self) -> DataFrame:
        """The body table under the animals' own names, for summaries that need no code."""
        return cleaning.season_rows(self.body_raw, FIRST_DAY, LAST_DAY, EXCLUDED, self.years, self.known)

    @cached_property
    def te(self) -> DataFrame:
        return cleaning.clean_env(self.env_raw).drop("obs_id")

    @cached_property
    def te_ordered(self) -> DataFrame:
        return cleaning.clean_env(self.env_raw)

    @cached_property
    def band(self) -> DataFrame:
        return bands.reference_band(bands.lab_summary(self.lab_raw))

    @cached_property
    def db_rows(self) -> DataFrame:
        return with_deviation(self.tb_rows, self.band, "type", "temp", "db")

    @cached_property
    def de(self) -> DataFrame:
        return with_deviation(self.te, self.band, "location", "temp", "de")

    def in_season(self, df: DataFrame) -> DataFrame:
        """Environment rows within the date range of the body table."""
        return cleaning.within_dates_of(df, self.tb_rows)
