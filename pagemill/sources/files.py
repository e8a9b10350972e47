"""Files written by executors, one for each row."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def put(files: DataFrame, path: str) -> DataFrame:
    """Writes ``data`` of each row as ``file`` under ``path`` (a folder all executors share, any scheme
    pyarrow knows) and returns the rows without the data, as kept in ``path/_files``. A file is written
    under a name of its own and then moved, so that tasks that are tried again, or twice at a time,
    leave whole files."""
    keep = [c for c in files.columns if c != "data"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _opened(path)
        system.create_dir(root, recursive=True)
        for rows in batches:
            for file, data in zip(rows.file, rows.data, strict=True):
                aside = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as out:
                    out.write(data)
                system.move(aside, f"{root}/{file}")
            yield rows[keep]

    files.mapInPandas(run, files.select(*keep).schema).write.mode("overwrite").parquet(f"{path}/_files")
    return files.sparkSession.read.parquet(f"{path}/_files")
