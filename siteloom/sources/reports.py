"""Reports as a data source to write to: ``df.write.format("site_reports").option("path", ...)``, a line of (site, report) for each.

Tasks write files of their own into a folder beside the reports; the driver moves the files of the tasks that ended well
into place when all have, and removes them all if any failed. So a folder never holds half of a job's reports. The path
may be in any store that Arrow opens (``file:``, ``hdfs:``, ``s3:``, ``gs:``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: How often a set of sites is halved at most to find those that fail.
HALVINGS = 40


def fallback(error: str) -> str:
    """The report of a site that has none: valid, empty, and says why."""
    return json.dumps({"summary": {"total_findings": 0, "critical": 0, "high": 0, "medium": 0, "low": 0}, "findings": [], "proactive_recommendations": [], "error": error}, ensure_ascii=False)


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, path = _store(self.path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{self.job}.json"
        store.create_dir(f"{path}/_staged-{self.job}")
        n = 0
        with store.open_output_stream(f"{path}/_staged-{self.job}/{name}") as out:
            for row in iterator:
                report = row["report"]
                try:
                    json.loads(report)
                except (TypeError, ValueError) as e:  # no report, or none that can be read
                    report = fallback(f"no valid report: {e}")
                out.write((json.dumps({"site": row["site"], "report": report}, ensure_ascii=False) + "\n").encode())
                n += 1
        return _Written(name, n)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, path = _store(self.path)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if old.is_file:
                    store.delete_file(old.path)
        for m in messages:
            if m is not None and m.rows:
                store.move(f"{path}/_staged-{self.job}/{m.file}", f"{path}/{m.file}")
        self._clear(store, path)

    def abort(self, messages: list) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, path: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{path}/_staged-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_staged-{self.job}")


class SiteReports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "site_reports"

    def schema(self) -> str:
        return "site string, report string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if "path" not in self.options:
            raise ValueError("site_reports: no path is given")
        return _Writer(self.options["path"], overwrite)


def write(reports: DataFrame, path: str, mode: str = "append") -> None:
    """Reports (site, report) to a folder: all of them, or none if this raises."""
    reports.sparkSession.dataSource.register(SiteReports)
    reports.select("site", "report").write.format("site_reports").mode(mode).option("path", path).save()


def write_isolated(sites: DataFrame, make: Callable[[DataFrame], DataFrame], path: str) -> dict[str, int]:
    """The reports that ``make`` gives for ``sites``, where a site that fails costs its own report only.

    A job that fails leaves nothing; its sites are halved by a hash and tried again, down to those that fail alone, which
    get a fallback report. Returns the numbers of jobs that ended well and of fallback reports.
    """
    pending, done = [(0, 0, "")], {"jobs": 0, "fallbacks": 0}
    while pending:
        rest, bits, why = pending.pop()
        part = sites.where(F.pmod(F.xxhash64("site"), F.lit(1 << bits)) == rest)
        try:
            write(make(part), path)
            done["jobs"] += 1
        except Exception as e:  # whatever it is, other sites go on
            why = str(e).splitlines()[0][:300]
            n = part.count()
            if n > 1 and bits < HALVINGS:
                pending += [(rest, bits + 1, why), (rest + (1 << bits), bits + 1, why)]
            elif n:
                write(part.select("site", F.lit(fallback(why)).alias("report")), path)
                done["fallbacks"] += n
    return done
