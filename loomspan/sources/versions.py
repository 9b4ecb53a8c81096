"""A log of versions of many tables: a commit is whole or absent, and of two that began alike only one is made (inventory
J18, K17, K27).

A version is a manifest ``_log/<number>.json`` that names the folder of each table.  A writer puts the tables it changes into
new folders, then makes the manifest of the number after the one it has read.  That number can be taken once: the
manifest is written aside and renamed in a way that fails if it is there.  A writer whose base is no longer the
latest therefore fails whatever it has computed, and a crash before the rename leaves folders that no manifest names.
Tables that a commit does not change keep their folders.
"""

from __future__ import annotations

import json
import os
from urllib.parse import urlparse
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class VersionLog:
    """Versions below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.Path(name)

    def latest(self) -> int:
        """The newest version; 0 before the first."""
        folder = self._path(f"{self.root}/_log")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int) -> dict[str, str]:
        """Folder of each table, relative to the root."""
        if not version:
            return {}
        try:
            row = self.spark.read.text(f"{self.root}/_log/{version:020d}.json", wholetext=True).first()
        except AnalysisException as e:
            raise ValueError(f"there is no version {version}") from e
        return json.loads(row["value"])["tables"]

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of a version, the latest by default; later commits do not touch them."""
        return {n: self.spark.read.parquet(f"{self.root}/{f}") for n, f in self.manifest(self.latest() if version is None else version).items()}

    def commit(self, changes: dict[str, DataFrame], base: int, drop: tuple[str, ...] = ()) -> int:
        """Make version ``base`` + 1 with ``changes`` in place of those tables and without ``drop``; all others stay as they were.

        Raises Conflict if that version is there; nothing of this commit can be seen then.
        """
        if self.latest() != base:
            raise Conflict(f"version {base} is not the latest")
        tables = {n: f for n, f in self.manifest(base).items() if n not in drop}
        folder = f"data/{uuid4().hex}"
        for name, df in changes.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
            tables[name] = f"{folder}/{name}"
        if not self._publish(base + 1, json.dumps({"version": base + 1, "tables": dict(sorted(tables.items()))})):
            raise Conflict(f"version {base + 1} was made by another writer")
        return base + 1

    def _publish(self, version: int, text: str) -> bool:
        """Make a manifest unless it is there; atomic on local disks by a hard link, elsewhere by the store's own rename."""
        aside, final = (f"{self.root}/_log/{n}" for n in (f".{uuid4().hex}", f"{version:020d}.json"))
        out = self._fs.create(self._path(aside), False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                local = lambda p: urlparse(p).path if "://" in p or p.startswith("file:") else p
                os.link(local(aside), local(final))
            else:
                context = self._jvm.FileContext.getFileContext(self._path(final).toUri(), self.spark._jsc.hadoopConfiguration())
                none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                array = self.spark.sparkContext._gateway.new_array(none.getClass(), 1)
                array[0] = none
                context.rename(self._path(aside), self._path(final), array)
        except FileExistsError:
            return False
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(self._path(aside), False)
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that none of the ``keep`` newest versions names, and older manifests; returns how many folders went.

        Not to be run while a writer is at work: its folders are not named yet.
        """
        last = self.latest()
        kept = range(max(1, last - keep + 1), last + 1)
        named = {f.split("/")[1] for v in kept for f in self.manifest(v).values()}
        for v in range(1, last):
            if v not in kept:
                self._fs.delete(self._path(f"{self.root}/_log/{v:020d}.json"), False)
        data, gone = self._path(f"{self.root}/data"), 0
        for s in self._fs.listStatus(data) if self._fs.exists(data) else ():
            if s.getPath().getName() not in named:
                gone += self._fs.delete(s.getPath(), True)
        return gone


def restore(log: VersionLog, snapshot: dict[str, DataFrame], base: int, key: str = "key", trash: str = "trash", settings: str = "settings") -> int:
    """One version that holds the snapshot's tables in place of the current ones, merged settings (the snapshot's value wins, keys
    it lacks stay) and an empty trash (K17)."""
    now = log.read(base)
    changes = {n: df for n, df in snapshot.items() if n != trash}
    if settings in snapshot and settings in now:
        changes[settings] = snapshot[settings].unionByName(now[settings].join(snapshot[settings].select(key), key, "left_anti"))
    if trash in now:
        changes[trash] = now[trash].where("false")
    return log.commit(changes, base)


def sync_documents(log: VersionLog, base: int, incoming: DataFrame, carry) -> int:
    """Take edited documents in, with the reading state of every linked project carried over, in one version.

    Tables of the log: ``documents`` (doc, text), ``witnesses`` (doc, seen: the hash of the text that was taken last), ``states`` (doc,
    project_id and more).  ``incoming`` has doc, text and safe: whether its merge loses nothing.  A document whose hash is that
    of its witness, or of the stored text, is not parsed again; one that is not safe is left as it is.  ``carry(states, before,
    after)`` gives the states of the projects of changed documents; other rows are kept.  Witnesses are written in the same
    version, so a crash cannot take an edit for seen.  Returns the version, ``base`` itself if nothing changed.
    """
    now = log.read(base)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    seen = incoming.withColumn("hash", digest).join(now["witnesses"], "doc", "left")
    fresh = seen.where("seen IS NULL OR seen <> hash")
    stored = now["documents"].select("doc", digest.alias("stored"))
    fresh = fresh.join(stored, "doc", "left")
    edited = fresh.where("safe AND (stored IS NULL OR stored <> hash)").select("doc", "text")
    taken = fresh.where("safe OR stored = hash").select("doc", F.col("hash").alias("seen"))
    if taken.isEmpty():
        return base
    before = now["documents"].join(edited.select("doc"), "doc", "left_semi")
    touched = now["states"].join(edited.select("doc"), "doc", "left_semi")
    changes = {
        "documents": now["documents"].join(edited.select("doc"), "doc", "left_anti").unionByName(edited, allowMissingColumns=True),
        "states": now["states"].join(edited.select("doc"), "doc", "left_anti").unionByName(carry(touched, before, edited)),
        "witnesses": now["witnesses"].join(taken.select("doc"), "doc", "left_anti").unionByName(taken),
    }
    return log.commit(changes, base)
