"""A catalog of several tables that changes as one.

Each version is a folder with all tables, written whole before an entry of the commit log
makes it current; a writer that dies between tables leaves the version before.  Readers
are pinned to the version that they opened.  Of two writers that start from the same
version one commits.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tallyshelf.sources.commitlog import CommitLog


class CatalogStore:
    """Versions at ``path``, numbered by the log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/log")

    def _versions(self) -> tuple[int, dict[int, dict]]:
        n, entries = self.log.read()
        kept = {v["n"]: v for e in entries for v in (e["kept"] if e.get("restart") else [e])}
        return n, kept

    def versions(self) -> list[int]:
        return sorted(self._versions()[1])

    def commit(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """Write ``tables`` as a new version and make it current; returns its number.  With
        ``base``, the version that they were worked out from, a version that came
        meanwhile raises ``RuntimeError`` and nothing changes."""
        at = f"{self.path}/data/{uuid4().hex}"
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{at}/{name}")
        while True:
            n, kept = self._versions()
            if base is not None and kept and max(kept) != base:
                raise RuntimeError(f"version {max(kept)} came after {base}")
            if self.log.append(n, {"at": at, "tables": sorted(tables)}):
                return n

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of a version, the current one by default."""
        kept = self._versions()[1]
        if not kept:
            raise FileNotFoundError(f"no version at {self.path}")
        one = kept[max(kept) if version is None else version]
        return {name: self.spark.read.parquet(f"{one['at']}/{name}") for name in one["tables"]}

    def collect(self, keep: int = 2) -> list[int]:
        """Forget and delete all but the last ``keep`` versions, and shorten the log; the
        numbers that went.  Folders that no entry has named yet belong to writers at
        work and stay."""
        while True:
            n, kept = self._versions()
            gone = sorted(kept)[:-keep] if keep else sorted(kept)
            if not gone:
                return []
            if self.log.append(n, {"restart": True, "kept": [kept[v] for v in sorted(kept)[-keep:]]}):
                break
        for v in gone:
            fs, path = self.log._fs(kept[v]["at"])
            fs.delete(path, True)
        return gone


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, parts: int = 16, **options: str) -> DataFrame:
    """A database table in ``parts`` ranges of a numeric ``key`` between its least and
    greatest value, which the database is asked for; null keys come with the first."""
    reader = lambda: spark.read.format("jdbc").options(url=url, **options)
    ends = reader().option("query", f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}").load().first()
    whole = reader().option("dbtable", table)
    if ends[0] is None:
        return whole.load()
    return whole.options(partitionColumn=key, lowerBound=str(ends[0]), upperBound=str(int(ends[1]) + 1), numPartitions=str(parts)).load()
