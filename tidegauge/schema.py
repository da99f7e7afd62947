"""Schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType, TimestampNTZType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S, _L, _D, _T = StringType(), LongType(), DoubleType(), TimestampNTZType()

OBSERVATIONS = _struct(site_id=_S, stream_id=_S, ts=_T, value=_D)
INVENTORY = _struct(site_id=_S, stream_id=_S, point_class=_S, point_label=_S, equipment_type=_S, equipment_label=_S, location_type=_S, location_label=_S)
WINDOW_AGGREGATE = _struct(site_id=_S, stream_id=_S, period=_S, window_start=_T, window_end=_T, count=_L, mean_value=_D, std_value=_D, min_value=_D, max_value=_D)
CALENDAR_PROFILE = _struct(site_id=_S, stream_id=_S, day_of_week=_L, hour_of_day=_L, count=_L, mean_value=_D, std_value=_D, min_value=_D, max_value=_D)
QUALITY = _struct(
    site_id=_S, stream_id=_S, n_points=_L, first_ts=_T, last_ts=_T, median_step_seconds=_D, longest_gap_seconds=_D, observed_fraction=_D,
    nan_fraction=_D, zero_fraction=_D, constant_fraction=_D, duplicate_timestamp_fraction=_D,
)
PREVIEW = _struct(site_id=_S, stream_id=_S, points=ArrayType(_struct(ts=_T, value=_D)))
CALL = _struct(call_id=_S, tool_name=_S, arguments=MapType(_S, _S), output=MapType(_S, _S))
TASK = _struct(task_id=_S, split=_S, task_family=_S, site_id=_S, query=_S, call_variants=ArrayType(ArrayType(CALL)), gold=MapType(_S, _S), evidence=ArrayType(_S), has_raw=BooleanType())


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of the schema in its order and types; a column that is missing is null, one that is too many goes."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
