"""ZIP archives as partitioned sources: members are found by the central directory, dealt into partitions by size, and read by offset, however large the archive.

`zip_streams` reads members that are pickled (token, timestamps, values) with a decoder that makes no objects but plain ones, `zip_rows` reads CSV members in chunks. A
filter on stream_id or member_name leaves other members unread: a member whose name carries a stream id holds that stream, others are read and filtered by Spark. Filters are
pushed down where spark.sql.python.filterPushdown.enabled is set. Archives lie where pyarrow's file systems reach; a member that can't be read is a row with its error.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tidegauge.functions.columns import UUID
from tidegauge.sources.archive import _Plain

STREAMS = "zip_path string, member_name string, stream_id string, ts timestamp_ntz, value double, error_type string, error string"
ROWS = "zip_path string, member_name string, line long, fields map<string,string>"
_CHUNK = 50_000


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    """The archive, or all archives of a folder in order."""
    fs, at = located(path)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return [path]
    return sorted(path.rstrip("/") + "/" + f.base_name for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.endswith(".zip"))


def id_in(name: str) -> str | None:
    """The stream id that a text carries."""
    import re

    found = re.search(UUID, name)
    return found[0].lower().replace("-", "_") if found else None


def stream_of(member: str, token: str | None) -> str:
    """The stream of a member: the id in its name, else that in its token, else its name without folder, site prefix and ending."""
    import re

    bare = re.sub(r"\.(pickle|pkl)$", "", member.rsplit("/", 1)[-1])
    return id_in(bare) or id_in(token or "") or re.sub(r"^site_[a-z]_", "", bare.lower())


@dataclass
class Members(InputPartition):
    archive: str
    names: list[str]


class _Reader(DataSourceReader):
    """Members of archives by the options path, suffixes (comma between) and partition_bytes."""

    def __init__(self, options: dict[str, str], suffixes: str) -> None:
        self.path, self.suffixes = options["path"], tuple(options.get("suffixes", suffixes).split(","))
        self.most = int(options.get("partition_bytes", 64 << 20))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("stream_id",), ("member_name",)):
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            # Spark filters the rows again: not every name tells its stream.
            yield f

    def asked(self, member: str) -> bool:
        own = id_in(member.rsplit("/", 1)[-1])
        return (own is None or own in self.wanted.get("stream_id", {own})) and member in self.wanted.get("member_name", {member})

    def open(self, path: str):
        fs, at = located(path)
        return fs.open_input_file(at)

    def partitions(self) -> list[Members]:
        out = []
        for archive in archives(self.path):
            with self.open(archive) as file, zipfile.ZipFile(file) as z:
                members = [m for m in z.infolist() if m.filename.endswith(self.suffixes) and self.asked(m.filename)]
            size, names = 0, []
            for m in sorted(members, key=lambda m: m.header_offset):
                if names and size + m.compress_size > self.most:
                    out.append(Members(archive, names))
                    size, names = 0, []
                size += m.compress_size
                names.append(m.filename)
            if names:
                out.append(Members(archive, names))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.names:
            return
        with self.open(partition.archive) as file, zipfile.ZipFile(file) as z:
            for name in partition.names:
                yield from self.member(z, partition.archive, name)

    def member(self, z: zipfile.ZipFile, archive: str, name: str) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class _StreamReader(_Reader):
    FIELDS = [("zip_path", pa.string()), ("member_name", pa.string()), ("stream_id", pa.string()), ("ts", pa.timestamp("us")), ("value", pa.float64()), ("error_type", pa.string()), ("error", pa.string())]

    def member(self, z: zipfile.ZipFile, archive: str, name: str) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(self.FIELDS)
        try:
            with z.open(name) as handle:
                token, stamps, values = _Plain(handle).load()
            ts = pd.to_datetime(pd.Series(list(stamps)), utc=True, errors="coerce").dt.tz_localize(None).astype("datetime64[us]")
            value = pd.to_numeric(pd.Series(list(values)), errors="coerce").astype("float64")
            if len(ts) != len(value):
                raise ValueError(f"{len(ts)} timestamps and {len(value)} values")
        except Exception as e:  # noqa: BLE001  one bad member must not end the job; it is a row of the result
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip([archive, name, stream_of(name, None), None, None, type(e).__name__, str(e)[:300]], self.FIELDS, strict=True)], schema=schema)
            return
        stream = stream_of(name, str(token))
        for at in range(0, len(ts), _CHUNK):
            some, n = slice(at, at + _CHUNK), len(ts[at : at + _CHUNK])
            cells = [[archive] * n, [name] * n, [stream] * n, pa.Array.from_pandas(ts[some], type=pa.timestamp("us")), pa.Array.from_pandas(value[some]), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c for c, (_, t) in zip(cells, self.FIELDS, strict=True)], schema=schema)


class _RowReader(_Reader):
    SCHEMA = pa.schema([("zip_path", pa.string()), ("member_name", pa.string()), ("line", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))])

    def __init__(self, options: dict[str, str], suffixes: str) -> None:
        super().__init__(options, suffixes)
        self.sep, self.encoding = options.get("sep", ","), options.get("encoding", "utf-8")

    def member(self, z: zipfile.ZipFile, archive: str, name: str) -> Iterator[pa.RecordBatch]:
        with z.open(name) as handle, io.TextIOWrapper(handle, self.encoding, errors="replace", newline="") as text:
            lines = csv.reader(text, delimiter=self.sep)
            header, line = next(lines, []), 0
            while some := list(islice(lines, _CHUNK)):
                maps = [list(zip(header, r, strict=False)) for r in some]
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(some)), pa.array([name] * len(some)), pa.array(range(line, line + len(some)), pa.int64()), pa.array(maps, pa.map_(pa.string(), pa.string()))], schema=self.SCHEMA)
                line += len(some)


class ZipStreams(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_streams"

    def schema(self) -> str:
        return STREAMS

    def reader(self, schema) -> DataSourceReader:
        return _StreamReader(self.options, ".pickle,.pkl")


class ZipRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_rows"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _RowReader(self.options, ".csv")


def register(spark: SparkSession) -> None:
    """Make both formats known, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ZipStreams, ZipRows):
        spark.dataSource.register(source)


def load_streams(spark: SparkSession, path: str, stream_id: str | None = None, **options: str) -> DataFrame:
    """STREAMS of an archive or of all archives of a folder; of one stream, if it is named, without reading what the names tell apart."""
    register(spark)
    rows = spark.read.format("zip_streams").options(path=path, **options).load()
    return rows if stream_id is None else rows.where(F.col("stream_id") == stream_id)


def load_rows(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """ROWS of the CSV members: a map from the header's names for each line."""
    register(spark)
    return spark.read.format("zip_rows").options(path=path, **options).load()


def stream_index(streams: DataFrame) -> DataFrame:
    """One row for each readable member: archive, member, stream, points, first and last instant."""
    good = streams.where("error_type is null")
    return good.groupBy("zip_path", "member_name", "stream_id").agg(F.count("*").alias("n_points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def write_archives(obs: DataFrame, folder: str, parts: int) -> list[str]:
    """Write (stream_id, ts, value) as `parts` archives with a pickled member for each stream, by the tasks that hold them; the archives' paths. The folder must be shared."""
    import pickle

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            part = int(frame["part"].iloc[0])
            fs, at = located(folder)
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/part-{part:05d}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for stream, own in frame.sort_values(["stream_id", "ts", "value"]).groupby("stream_id", sort=True):
                    z.writestr(f"{stream}.pickle", pickle.dumps((stream, [t.to_pydatetime() for t in own["ts"]], own["value"].tolist())))
            yield pd.DataFrame({"path": [f"{folder}/part-{part:05d}.zip"]})

    dealt = obs.select(F.pmod(F.xxhash64("stream_id"), F.lit(parts)).alias("part"), "stream_id", "ts", "value")
    return sorted(r["path"] for r in dealt.groupBy("part").applyInPandas(lambda f: next(run([f])), "path string").collect())
