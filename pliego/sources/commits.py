"""A table as numbered versions, each committed at most once: pinned, guarded, checked, then claimed.

A version is a folder of Parquet files and a claim, a small file in the log named by the
version's number. A commit writes its folder, reads it back and checks it, and then makes the
claim of the number after the one it was pinned to. The claim is made only if no such file
exists, so of two writers that started from one version the second is refused, and a run
that dies leaves at most a folder that no claim names. Earlier versions stay as they are.

The log needs a file system that creates a file exclusively: HDFS, a POSIX folder, or an object
store with conditional writes.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..functions.contract import digest


class Version(NamedTuple):
    """number -1 is the table before its first commit."""

    number: int
    folder: str
    records: int
    digest: str


NOTHING = Version(-1, "", 0, "")


class Refused(RuntimeError):
    """A commit that did not happen: ``why`` is guards, pin, checks or claim; ``rules`` has the names that failed."""

    def __init__(self, why: str, rules: list[str]):
        super().__init__(f"{why}: {', '.join(rules)}")
        self.why, self.rules = why, rules


class Commits:
    """The versions of a table below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._log = f"{self.path}/log"

    def _file(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def history(self) -> list[Version]:
        """All versions by number. A claim without content is an error: its writer died while making it."""
        target, files = self._file(self._log)
        if not files.exists(target):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(target))
        claims = [n for n in names if n.isdigit()]
        if not claims:
            return []
        texts = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in self.spark.read.format("binaryFile").load([f"{self._log}/{n}" for n in claims]).select("path", "content").collect()}
        if empty := [n for n in claims if not texts.get(n)]:
            raise ValueError(f"{self._log}/{empty[0]} has no content; remove it if no commit is running")
        return [Version(int(n), **json.loads(texts[n])) for n in claims]

    def current(self) -> Version:
        return (self.history() or [NOTHING])[-1]

    def read(self, number: int | None = None) -> DataFrame | None:
        """The table in a version, the last by default; None if there is none."""
        found = [v for v in self.history() if number is None or v.number == number]
        return self.spark.read.parquet(f"{self.path}/{found[-1].folder}") if found else None

    def commit(self, df: DataFrame, pinned: Version, guards: DataFrame | None = None, checks: Callable[[DataFrame], list[str]] = lambda df: []) -> Version:
        """The version after ``pinned``, made of df; Refused, and nothing changed, if any step does not hold.

        Steps: no row of guards (rule, status) fails; the last version is the pinned one, by
        number and digest; df is written to a folder of its own; what is read back has as many
        rows and the digest of df, and ``checks`` names no fault in it; the number is free.
        """
        if guards is not None and (failed := [r["rule"] for r in guards.where("status <> 'PASS'").select("rule").collect()]):  # rules are few
            raise Refused("guards", failed)
        if (last := self.current()) != pinned:
            raise Refused("pin", [f"version {last.number}"])
        folder = f"v{pinned.number + 1}-{uuid.uuid4().hex}"
        told = digest(df).first()
        df.write.parquet(f"{self.path}/{folder}")
        kept = self.spark.read.parquet(f"{self.path}/{folder}")
        seen = digest(kept).first()
        faults = [n for n in ("records", "digest") if seen[n] != told[n]] + checks(kept)
        if faults:
            self._drop(folder)
            raise Refused("checks", faults)
        version = Version(pinned.number + 1, folder, seen["records"], seen["digest"])
        if not self._claim(version):
            self._drop(folder)
            raise Refused("claim", [f"version {version.number}"])
        return version

    def restore(self, number: int, pinned: Version) -> Version:
        """A new version with the content of an earlier one, which must still have its digest."""
        old = next(v for v in self.history() if v.number == number)
        if digest(self.read(number)).first()["digest"] != old.digest:
            raise Refused("checks", ["digest"])
        if self.current() != pinned:
            raise Refused("pin", [f"version {self.current().number}"])
        version = old._replace(number=pinned.number + 1)
        if not self._claim(version):
            raise Refused("claim", [f"version {version.number}"])
        return version

    def _claim(self, version: Version) -> bool:
        text = json.dumps({"folder": version.folder, "records": version.records, "digest": version.digest}).encode()
        path = f"{self._log}/{version.number:012d}"
        target, files = self._file(path)
        files.mkdirs(target.getParent())
        where = urlsplit(path)
        if where.scheme in ("", "file"):  # Hadoop's local file system looks first and creates later
            try:
                with open(os.open(where.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644), "wb") as out:
                    out.write(text)
            except FileExistsError:
                return False
            return True
        try:
            out = files.create(target, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        out.write(bytearray(text))
        out.close()
        return True

    def _drop(self, folder: str) -> None:
        target, files = self._file(f"{self.path}/{folder}")
        files.delete(target, True)


def planned_append(table: Commits, pinned: Version, plan: DataFrame, guards: DataFrame, document: list[str], documents: str = "documents") -> tuple[Version, DataFrame]:
    """The version with a plan's documents appended, and the summary of what changed.

    Besides the commit's own checks: no record comes or goes, as many documents are added as
    the plan has, and the digest changes if it has any.
    """
    from ..operators.persistence import appended, apply_summary

    before = table.read(pinned.number)
    planned = plan.count()

    def checks(after: DataFrame) -> list[str]:
        s = apply_summary(before, after, plan, documents).first()
        rules = {"record_count": s["records_before"] == s["records_after"], "all_documents_added": s["documents_appended"] == planned, "no_duplicate_pairs": s["duplicate_append_pairs"] == 0}
        rules["digest_changes"] = not planned or digest(after).first()["digest"] != pinned.digest
        return [name for name, holds in rules.items() if not holds]

    version = table.commit(appended(before, plan, document, documents), pinned, guards, checks)
    return version, apply_summary(before, table.read(version.number), plan, documents)


def swept(table: Commits, keep: int) -> list[str]:
    """Delete folders that none of the last ``keep`` versions uses; returns their names. No commit may be running."""
    used = {v.folder for v in table.history()[-keep:]}
    target, files = table._file(table.path)
    gone = [s.getPath().getName() for s in files.listStatus(target) if s.getPath().getName().startswith("v") and s.getPath().getName() not in used]
    for folder in gone:
        table._drop(folder)
    return sorted(gone)


