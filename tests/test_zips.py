"""Archives read by members: one stream without the rest, archives of a folder, broken members, CSV in chunks."""

from __future__ import annotations

import pickle
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from tidegauge.sources import zips

IDS = [f"0a1b2c3d-0000-0000-0000-{k:012d}" for k in range(6)]


@pytest.fixture
def folder(tmp_path):
    def pickled(token, n):
        return pickle.dumps((token, [datetime(2024, 1, 1) + timedelta(hours=k) for k in range(n)], [float(k) for k in range(n)]))

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k, i in enumerate(IDS[:3]):
            z.writestr(f"Site_A/Site_A_{i}.pickle", pickled(f"Site_A_{i}", 2000 + k))
        z.writestr("Site_A/room.pickle", pickled(IDS[5].upper(), 7))
        z.writestr("Site_A/Site_A_hall.pickle", pickled("hall", 3))
        z.writestr("Site_A/bad.pickle", b"rubbish")
        z.writestr("Site_A/odd.pickle", pickle.dumps(("odd", ["2024-01-01"], [1.0, 2.0])))
        z.writestr("notes.txt", "x")
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{IDS[3]}.pkl", pickled(IDS[3], 120_001))
    return tmp_path


def test_streams_of_a_folder(spark, folder):
    rows = zips.load_streams(spark, str(folder)).cache()
    index = {r["stream_id"]: r for r in zips.stream_index(rows).collect()}
    name = lambda k: IDS[k].replace("-", "_")
    assert {k: r["n_points"] for k, r in index.items()} == {name(0): 2000, name(1): 2001, name(2): 2002, name(3): 120_001, name(5): 7, "hall": 3}
    assert index[name(3)]["first_ts"] == datetime(2024, 1, 1) and index[name(3)]["last_ts"] == datetime(2024, 1, 1) + timedelta(hours=120_000)
    assert {(r["member_name"], r["error_type"]) for r in rows.where("error_type is not null").collect()} == {("Site_A/bad.pickle", "UnpicklingError"), ("Site_A/odd.pickle", "ValueError")}
    assert rows.where(F.col("stream_id") == name(3)).agg(F.sum("value")).first()[0] == sum(range(120_001))


def test_one_stream_is_read_without_the_rest(spark, folder):
    wanted = IDS[1].replace("-", "_")
    assert zips.load_streams(spark, str(folder), wanted).count() == 2001
    # The id of room.pickle is in its token only.
    assert zips.load_streams(spark, str(folder), IDS[5].replace("-", "_")).count() == 7

    class Counting(zips._StreamReader):
        read_bytes = 0

        def open(self, path):
            own, file = self, super().open(path)

            class File:
                def __getattr__(self, name):
                    return getattr(file, name)

                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    file.close()

                def read(self, n=-1):
                    data = file.read(None if n is None or n < 0 else n)
                    own.read_bytes += len(data)
                    return data

            return File()

    def read(*filters):
        reader = Counting({"path": str(folder)}, ".pickle,.pkl")
        assert list(reader.pushFilters(list(filters))) == list(filters)
        parts = reader.partitions()
        listing = reader.read_bytes
        rows = sum(b.num_rows for p in parts for b in reader.read(p))
        return rows, reader.read_bytes - listing, {n for p in parts for n in p.names}

    everything = read()
    rows, size, members = read(EqualTo(("stream_id",), wanted))
    assert {m for m in members if "0a1b" in m} == {f"Site_A/Site_A_{IDS[1]}.pickle"} and rows >= 2001 and size < everything[1] / 5
    rows, size, members = read(In(("member_name",), ("Site_A/room.pickle", "nothing")))
    assert members == {"Site_A/room.pickle"} and rows == 7
    assert read(EqualTo(("member_name",), "nothing"))[0] == 0


def test_partitions_by_size(folder):
    reader = zips._StreamReader({"path": str(folder / "a.zip"), "partition_bytes": "40000"}, ".pickle,.pkl")
    parts = reader.partitions()
    assert len(parts) > 2 and sorted(n for p in parts for n in p.names) == sorted(n for p in zips._StreamReader({"path": str(folder / "a.zip")}, ".pickle,.pkl").partitions() for n in p.names)


def test_csv_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("d/x.csv", "id;v\n" + "".join(f"{k};{k / 2}\n" for k in range(60_000)))
        z.writestr("d/empty.csv", "")
        z.writestr("d/y.csv", 'id;v;w\n1;"a;b"\n')
    rows = zips.load_rows(spark, str(tmp_path / "c.zip"), sep=";")
    assert rows.where("member_name = 'd/x.csv'").agg(F.count("*"), F.sum(F.col("fields")["v"].cast("double")), F.max("line")).first() == (60_000, sum(range(60_000)) / 2, 59_999)
    assert [r["fields"] for r in rows.where("member_name = 'd/y.csv'").collect()] == [{"id": "1", "v": "a;b"}]


def test_written_archives_come_back(spark, tmp_path):
    obs = spark.createDataFrame([(f"s{k % 5}", datetime(2024, 1, 1) + timedelta(minutes=k), k / 4) for k in range(200)], "stream_id string, ts timestamp_ntz, value double")
    paths = zips.write_archives(obs, str(tmp_path / "out"), 3)
    assert paths == zips.archives(str(tmp_path / "out"))
    back = zips.load_streams(spark, str(tmp_path / "out")).select("stream_id", "ts", "value")
    assert back.exceptAll(obs).isEmpty() and back.count() == 200
