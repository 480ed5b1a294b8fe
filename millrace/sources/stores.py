"""Vector collections: where the rows are kept, and filtered search over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.hybrid import dense_top_k
from millrace.operators.records import upsert
from millrace.sources.index_files import current_version, publish_version, reset


class FileStore:
    """A collection as versions of a Parquet table, partitioned by the columns that searches filter by.

    A filter on those columns prunes folders, one on others uses the files' statistics: they are the payload
    indexes. A write gives a whole new version, so that readers never see half of one.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", version: str = "upserted_at", by: tuple[str, ...] = ("language", "strategy")):
        self.spark, self.path, self.key, self.version, self.by = spark, path, key, version, by

    def rows(self) -> DataFrame | None:
        current = current_version(self.spark, self.path)
        return self.spark.read.parquet(current) if current else None

    def upsert(self, rows: DataFrame) -> None:
        old = current_version(self.spark, self.path)
        target = f"{self.path}/v{int(old.rsplit('/v', 1)[1]) + 1 if old else 0}"
        before = self.spark.read.parquet(old).select(*rows.columns) if old else rows.limit(0)
        upsert(before, rows, self.key, self.version).write.mode("overwrite").partitionBy(*self.by).parquet(target)
        publish_version(self.spark, self.path, target)

    def reset(self) -> None:
        reset(self.spark, self.path)

    def count(self) -> int:
        rows = self.rows()
        return 0 if rows is None else rows.count()

    def search(self, queries: DataFrame, k: int, wanted: Column | None = None) -> DataFrame:
        """The k nearest rows of each query (query_id, query_vector) among those for which ``wanted`` holds."""
        rows = self.rows()
        if rows is None:
            raise ValueError(f"no collection at {self.path}")
        return dense_top_k(queries, rows if wanted is None else rows.filter(wanted), k, key=self.key)


class MemoryStore(FileStore):
    """The same over a DataFrame of the session: for small collections, and for tests. Rows are those given, the latest of a key."""

    def __init__(self, spark: SparkSession, rows: DataFrame | None = None, key: str = "id", version: str = "upserted_at"):
        super().__init__(spark, "memory", key, version)
        self._rows = rows

    def rows(self) -> DataFrame | None:
        return self._rows

    def upsert(self, rows: DataFrame) -> None:
        self._rows = rows if self._rows is None else upsert(self._rows, rows, self.key, self.version)

    def reset(self) -> None:
        self._rows = None


def open_store(spark: SparkSession, kind: str, path: str | None = None, **options) -> FileStore:
    """The store of that kind: files (at ``path``) or memory; auto is files if a path is given."""
    if kind == "auto":
        kind = "files" if path else "memory"
    if kind == "files" and path:
        return FileStore(spark, path, **options)
    if kind == "memory":
        return MemoryStore(spark, **options)
    raise ValueError(f"no store of kind {kind!r} at {path!r}")


def known_languages(rows: DataFrame, wanted: list[str], language: str = "language") -> DataFrame:
    """``rows`` of the wanted languages (all without any). Raises if that leaves none."""
    kept = rows.filter(F.col(language).isin(*wanted)) if wanted else rows
    if kept.isEmpty():
        raise ValueError(f"no rows of {', '.join(wanted) or 'any language'}")
    return kept
