"""Plain files by name: what recipes, shapes and catalogues are kept in."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(files: DataFrame, folder: str) -> int:
    """(name, content) rows as files of a folder that all executors share, written in tasks; gives their number.

    A file is written aside and renamed, so it is there whole or not at all, and a task that runs again replaces it. Of rows that share a
    name one stays. Names with a slash, empty ones and ones that begin with a dot are an error; a null content is an empty file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("name").to_pylist()
            for name, content in zip(names, batch.column("content"), strict=True):
                if not name or name.startswith(".") or "/" in name:
                    raise ValueError(f"not a file's name: {name!r}")
                aside = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(aside, "wb") as f:
                    f.write(content.as_py() or b"")
                os.replace(aside, os.path.join(folder, name))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    os.makedirs(folder, exist_ok=True)
    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string").distinct().count()
