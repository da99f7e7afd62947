"""Archives of pickled streams: (token, timestamps, values) in each member of a ZIP file, read with a decoder that makes no objects but plain ones.

A ZIP file is one row of Spark's binaryFile source, which holds up to 2 GB; `sources.zips` reads larger ones, by members. Land the result as Parquet once and query that.
"""

from __future__ import annotations

import io
import pickle
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.columns import archive_stream_id

SCHEMA = "zip_path string, member_name string, token string, ts timestamp_ntz, value double, error_type string, error string"
_ALLOWED = {("datetime", "datetime"), ("datetime", "timezone"), ("datetime", "timedelta"), ("builtins", "list"), ("builtins", "tuple")}


class _Plain(pickle.Unpickler):
    """Plain values and datetimes only: any other name in a pickle is an error, and nothing of it runs."""

    def find_class(self, module: str, name: str):
        if (module, name) not in _ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} is not allowed")
        return super().find_class(module, name)


def load_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per observation; a member that can't be read gives one row with its error."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in SCHEMA.split(", ")]
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                archive = zipfile.ZipFile(io.BytesIO(content))
                for member in sorted(archive.namelist()):
                    if not member.endswith((".pickle", ".pkl")):
                        continue
                    try:
                        token, stamps, values = _Plain(archive.open(member)).load()
                        ts = pd.to_datetime(pd.Series(list(stamps)), utc=True, errors="coerce").dt.tz_localize(None).astype("datetime64[us]")
                        out = pd.DataFrame({"zip_path": name, "member_name": member, "token": str(token), "ts": ts, "value": pd.to_numeric(pd.Series(list(values)), errors="coerce").astype("float64")})
                        out["error_type"] = out["error"] = None
                    except Exception as e:  # noqa: BLE001  one bad member must not end the job; it is a row of the result
                        out = pd.DataFrame([(name, member, None, None, None, type(e).__name__, str(e)[:300])], columns=columns)
                        out["ts"] = pd.to_datetime(out["ts"]).astype("datetime64[us]")
                        out["value"] = out["value"].astype("float64")
                    yield out[columns]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def observations(archive: DataFrame, site: str) -> DataFrame:
    return archive.where("error_type is null").select(F.lit(site).alias("site_id"), F.coalesce(archive_stream_id("token"), archive_stream_id("member_name")).alias("stream_id"), "ts", "value")


def errors(archive: DataFrame) -> DataFrame:
    return archive.where("error_type is not null").select("zip_path", "member_name", "error_type", "error")


def raw_index(archive: DataFrame) -> DataFrame:
    """One row per member: stream, number of points, first and last instant."""
    good = archive.where("error_type is null")
    return good.groupBy("zip_path", "member_name").agg(F.first(archive_stream_id("token")).alias("stream_id"), F.count("*").alias("n_points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
