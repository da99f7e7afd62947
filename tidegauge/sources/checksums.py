"""Checksums of files, each read in pieces by one task, however large."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.sources.zips import located

_PIECE = 1 << 20


def digests(files: DataFrame) -> DataFrame:
    """path, bytes, sha256 (null where there is no such file) of every path of files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                try:
                    fs, at = located(path)
                    h, n = hashlib.sha256(), 0
                    with fs.open_input_stream(at, compression=None) as stream:
                        while piece := stream.read(_PIECE):
                            h.update(piece)
                            n += len(piece)
                    out.append((path, n, h.hexdigest()))
                except OSError:
                    out.append((path, None, None))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "bytes", "sha256"])

    # A file a task: their sizes differ.
    n = max(1, files.count())
    return files.select("path").repartition(min(n, 10_000)).mapInArrow(run, "path string, bytes long, sha256 string")


def verified(files: DataFrame) -> DataFrame:
    """path, bytes, sha256, problem (missing, differs or null) of files (path, expected)."""
    found = digests(files).join(files.select("path", "expected"), "path")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.lower("expected") != F.col("sha256"), "differs")
    return found.select("path", "bytes", "sha256", problem.alias("problem"))
