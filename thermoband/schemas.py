"""Schemas of the input files."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


_text, _real, _whole = T.StringType(), T.DoubleType(), T.IntegerType()

BODY_RAW = _struct(date=_text, time=_text, snakeid=_text, location=_text, temp=_real)
ENV_RAW = _struct(
    datetime=_text, date=_text, time=_text, time_int=_text, id=_text,
    site=_text, location=_text, treatment=_text, temp=_real,
)
LAB_RAW = _struct(date=_text, time=_text, snakeid=_text, repro=_text, run=_whole, tb=_real)
