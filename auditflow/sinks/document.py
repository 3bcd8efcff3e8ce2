"""Whole reports, written by tasks: every row in its place, whatever their number.

Findings are sorted by ranges in canonical order; each task writes its range as one fragment, and the
commit writes a manifest that names the fragments in order, with their rows, between a head and
a foot.  A report exists once its manifest does: until then readers see the one before, and a job
that fails leaves nothing but fragments that the next commit removes.  assemble() joins head,
fragments and foot into one file, piece by piece.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.findings import canonical_order
from . import reports

MANIFEST = "manifest.json"
#: By format: what stands before all rows and after them (with the number of rows and the rules' ids), between two, and a row itself.
_FRAMES = {
    "json": ('{"schema_version": 1, "truncated": 0, "total": <rows>, "findings": [\n', "\n]}\n", ",\n", lambda r: json.dumps(r, default=str)),
    "sarif": ('{"$schema": "' + reports.SCHEMA + '", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "auditflow", "rules": <rules>}}, "properties": {"truncated": 0}, "results": [\n', "\n]}]}\n", ",\n", lambda r: json.dumps(reports.sarif_result(r))),
    "markdown": ("# Audit\n\n" + "\n".join(reports.MARKDOWN_HEAD) + "\n", "\n", "\n", reports.markdown_row),
    "console": ("", "\n", "\n", reports.console_row),
    "html": ('<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>Audit</title></head>\n<body><h1>Audit</h1>\n<table>' + reports.HTML_HEAD + "\n<tbody>\n", "\n</tbody></table></body></html>\n", "\n", reports.html_row),
}


@dataclass
class Fragment(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    rules: dict[str, str]


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, path: str, fmt: str):
        self.path, self.fmt, self.run = path, fmt, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Fragment:
        head, foot, between, row = _FRAMES[self.fmt]
        task = TaskContext.get()
        name = f"{self.run}-{task.partitionId():06d}-{task.taskAttemptId()}"
        os.makedirs(self.path, exist_ok=True)
        rows, rules = 0, {}
        with open(os.path.join(self.path, name), "w", encoding="utf-8") as f:
            for batch in iterator:
                for r in batch.to_pylist():
                    f.write((between if rows else "") + row(r))
                    rules.setdefault(r["rule_id"], r.get("title") or r["rule_id"])
                    rows += 1
        return Fragment(task.partitionId(), name, rows, rules)

    def commit(self, messages: list[Fragment | None]) -> None:
        head, foot, between, _ = _FRAMES[self.fmt]
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        rules: dict[str, str] = {}
        for m in parts:
            for k, v in m.rules.items():
                rules.setdefault(k, v)
        total = sum(m.rows for m in parts)
        listed = json.dumps([{"id": k, "name": k, "shortDescription": {"text": v}} for k, v in sorted(rules.items())])
        manifest = {"schema_version": 1, "format": self.fmt, "rows": total, "head": head.replace("<rows>", str(total), 1).replace("<rules>", listed, 1), "foot": foot, "between": between, "fragments": [{"name": m.name, "rows": m.rows} for m in parts]}
        os.makedirs(self.path, exist_ok=True)
        part = os.path.join(self.path, f".{self.run}.part")
        with open(part, "w", encoding="utf-8") as f:
            json.dump(manifest, f, indent=1)
        os.replace(part, os.path.join(self.path, MANIFEST))
        keep = {m.name for m in parts} | {MANIFEST}
        for old in os.listdir(self.path):
            if old not in keep:
                os.remove(os.path.join(self.path, old))

    def abort(self, messages: list[Fragment | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(os.path.join(self.path, m.name)):
                os.remove(os.path.join(self.path, m.name))


class ReportDocument(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report_document"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ReportWriter(self.options["path"], self.options["report"])


def save(findings: DataFrame, path: str, fmt: str = "json") -> dict:
    """Write a report of all findings below a folder that all workers see; gives its manifest."""
    if fmt not in _FRAMES:
        raise ValueError(f"{fmt} is not one of {', '.join(_FRAMES)}")
    spark = findings.sparkSession
    spark.dataSource.register(ReportDocument)
    rows = reports.keyed(findings) if fmt == "sarif" else findings
    rows.orderBy(*canonical_order()).write.format("report_document").option("report", fmt).mode("append").save(path)
    with open(os.path.join(path, MANIFEST), encoding="utf-8") as f:
        return json.load(f)


def pieces(path: str, size: int = 1 << 20) -> Iterator[str]:
    """The text of a saved report, piece by piece."""
    with open(os.path.join(path, MANIFEST), encoding="utf-8") as f:
        manifest = json.load(f)
    yield manifest["head"]
    for i, part in enumerate(manifest["fragments"]):
        yield manifest["between"] if i else ""
        with open(os.path.join(path, part["name"]), encoding="utf-8") as f:
            while text := f.read(size):
                yield text
    yield manifest["foot"]


def assemble(path: str, target: str) -> None:
    """A saved report as one file, replaced as a whole."""
    part = f"{target}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.writelines(pieces(path))
    os.replace(part, target)
