"""SNK-11: a sink of small files, one JSON or CSV object a key, as a Python data source with a commit step.

df.write.format("sidecar").option("path", folder).option("name", column).mode("append").save(): each row becomes the file that
the column names, its other columns the object; `.csv` names give a header and one line, others JSON. Tasks write to a
staging folder under names of their own; the commit renames what successful attempts report, so a repeated or
abandoned attempt leaves nothing, and the same write again replaces the same files. The folder is a mounted one.
"""

from __future__ import annotations

import csv
import datetime
import decimal
import io
import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Staged(WriterCommitMessage):
    """(staged path, file name) of what one attempt wrote."""

    files: list[tuple[str, str]]


def _plain(value):
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    if isinstance(value, datetime.date | datetime.datetime):
        return value.isoformat()
    return float(value) if isinstance(value, decimal.Decimal) else value


def rendered(name: str, fields: dict) -> str:
    """The file's text by its suffix."""
    if not name.endswith(".csv"):
        return json.dumps({k: _plain(v) for k, v in fields.items()}, ensure_ascii=False, indent=2, sort_keys=True)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(fields)
    writer.writerow([json.dumps(x, ensure_ascii=False) if isinstance(x, dict | list) else x for x in (_plain(v) for v in fields.values())])
    return out.getvalue()


class SidecarWriter(DataSourceWriter):
    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name
        self.staging = os.path.join(folder, f".staging-{uuid.uuid4().hex}")

    def write(self, iterator) -> Staged:
        own, files = os.path.join(self.staging, uuid.uuid4().hex), []
        os.makedirs(own, exist_ok=True)
        for row in iterator:
            fields = row.asDict()
            name = fields.pop(self.name)
            if not name or os.path.basename(name) != name or name.startswith("."):
                raise ValueError(f"not a file name: {name!r}")
            staged = os.path.join(own, f"{len(files)}")
            with open(staged, "w", encoding="utf-8") as out:
                out.write(rendered(name, fields))
            files.append((staged, name))
        return Staged(files)

    def commit(self, messages) -> None:
        done = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in done]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same file name")
        for staged, name in done:
            os.replace(staged, os.path.join(self.folder, name))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class SidecarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sidecar"

    def writer(self, schema: StructType, overwrite: bool) -> SidecarWriter:
        folder, name = self.options["path"], self.options.get("name", "name")
        if name not in schema.fieldNames():
            raise ValueError(f"no column {name}")
        os.makedirs(folder, exist_ok=True)
        return SidecarWriter(folder, name)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(SidecarSource)
