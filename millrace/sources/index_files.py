"""Index files: JSON lines, statistics snapshots, dataset bundles with their staleness, versions of a table."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_SCHEMA = (
    "id string, chunkKey string, text string, isParent boolean, vector array<double>, sparse struct<indices:array<int>,values:array<double>>, "
    "metadata struct<documentId:string,passageId:string,language:string,source:string,topic:string,strategy:string,chunkIndex:int,parentChunk:string,tokenCount:int,charStart:int,charEnd:int,isSelected:boolean,queryId:string,queryText:string,indexedAt:string>"
)
SNAPSHOT_VERSION = 1


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines index; malformed and torn lines, and lines without an id, are left out."""
    return spark.read.schema(INDEX_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter(F.col("id").isNotNull())


def write_index(df: DataFrame, path: str, digits: int = 4) -> None:
    """JSON lines with vectors rounded to ``digits``; the committer moves the files in place once all are written."""
    df.withColumn("vector", F.transform("vector", lambda x: F.round(x, digits))).write.mode("overwrite").json(path)


def write_snapshot(terms: DataFrame, stats: DataFrame, path: str) -> None:
    """BM25 statistics: term rows (term, term_id, frequency) and one corpus row with the format's version."""
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    stats.withColumn("version", F.lit(SNAPSHOT_VERSION)).write.mode("overwrite").parquet(f"{path}/stats")


def load_snapshot(spark: SparkSession, path: str, rebuild: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """terms and stats of a snapshot; rebuilt if it is missing, broken or of another version."""
    try:
        stats = spark.read.parquet(f"{path}/stats")
        if stats.first()["version"] == SNAPSHOT_VERSION:  # one row
            return spark.read.parquet(f"{path}/terms"), stats.drop("version")
    except Exception:  # noqa: BLE001
        pass
    return rebuild()


def stale_reason(bundle: Column, wanted: Column) -> Column:
    """Why a cached bundle does not serve: repository, split, english, languages, rows; null if it does.

    Both are structs of repository, split, english, languages (array) and rows; a bundle with more rows than wanted serves.
    """
    same = lambda f: bundle[f].eqNullSafe(wanted[f])
    languages = F.array_sort(bundle["languages"]).eqNullSafe(F.array_sort(wanted["languages"]))
    reasons = (("repository", ~same("repository")), ("split", ~same("split")), ("english", ~same("english")), ("languages", ~languages), ("rows", F.coalesce(bundle["rows"], F.lit(0)) < wanted["rows"]))
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in reasons))


def read_languages(spark: SparkSession, paths: dict[str, str], limit: int | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """The Parquet files of several languages as one table with language, and the errors of those that cannot be read.

    One bad file does not lose the others. ``limit``: rows of each language.
    """
    read, failed = [], {}
    for language, path in paths.items():
        try:
            df = spark.read.parquet(path)
            read.append((df.limit(limit) if limit else df).withColumn("language", F.lit(language)))
        except Exception as error:  # noqa: BLE001
            failed[language] = str(error).splitlines()[0]
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read) if read else None), failed


def language_of_file(path: Column) -> Column:
    """The language prefix of a file's name, as in hin_Deva-train.parquet."""
    return F.nullif(F.regexp_extract(path, r"([a-z]{3}_[A-Z][a-z]{3})[^/]*$", 1), F.lit(""))


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder that the table's pointer names; null without one."""
    _, pointer, fs = _hadoop(spark, f"{path}/CURRENT")
    return spark.read.text(f"{path}/CURRENT").first()["value"] if fs.exists(pointer) else None


def publish_version(spark: SparkSession, path: str, target: str) -> None:
    """Points the table at ``target``: written beside the pointer, then moved over it."""
    jvm, pointer, fs = _hadoop(spark, f"{path}/CURRENT")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/.CURRENT.new")
    out = fs.create(fresh, True)
    out.write(bytearray(target.encode()))
    out.close()
    if not fs.rename(fresh, pointer):
        fs.delete(pointer, False)
        fs.rename(fresh, pointer)


def reset(spark: SparkSession, path: str) -> None:
    """Drops the table and all its versions."""
    _, p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table, from its footers; 0 if it cannot be read."""
    try:
        return spark.read.parquet(path).count()
    except Exception:  # noqa: BLE001
        return 0


def write_report(df: DataFrame, path: str, stamp: str) -> str:
    """A report as JSON in a folder of its own, named by its time; returns the folder."""
    target = f"{path}/report-{stamp.replace(':', '-')}"
    df.coalesce(1).write.mode("errorifexists").json(target)  # a few rows
    return target


class TimedOut(Exception):
    pass


def with_timeout(call: Callable[[], object], seconds: float):
    """What ``call`` gives; TimedOut if it takes longer. The call itself is not stopped, only no longer waited for."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(seconds)
    except FutureTimeout:
        raise TimedOut(f"no answer in {seconds} s") from None
    finally:
        pool.shutdown(wait=False)


def with_retries(call: Callable[[int], object], retries: int = 3, base: float = 0.4, most: float = 8.0, again: Callable[[Exception, int], bool] = lambda error, attempt: True, sleep: Callable[[float], None] = time.sleep):
    """What ``call`` (given the attempt, from 0) gives, tried again after a random wait below a ceiling that doubles each time up to ``most`` seconds.

    An error of which ``again`` says no is raised at once.
    """
    for attempt in range(retries + 1):
        try:
            return call(attempt)
        except Exception as error:
            if attempt == retries or not again(error, attempt):
                raise
            sleep(random.uniform(0, min(most, base * 2**attempt)))


def read_json_rows(spark: SparkSession, path: str, schema: str, limit: int | None = None, retries: int = 3) -> DataFrame:
    """Rows of JSON lines; listing and opening are tried again when the store fails. ``limit``: a sample of so many."""
    rows = with_retries(lambda _: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path), retries)
    return rows.limit(limit) if limit else rows


def send_batches(df: DataFrame, send: Callable[[], Callable[[list[dict]], None]], size: int = 128, retries: int = 2, seconds: float = 30.0) -> int:
    """Sends all rows to an outside store in batches from every partition; a batch that fails or takes longer than ``seconds`` is tried again, after a wait. Returns the rows sent.

    ``send`` is called once a task. A task that is run again sends its rows again: the store must take a row twice.
    """
    import pandas as pd

    def run(frames):
        put, sent = send(), 0
        for frame in frames:
            rows = frame.to_dict("records")
            for i in range(0, len(rows), size):
                batch = rows[i : i + size]
                with_retries(lambda _, batch=batch: with_timeout(lambda: put(batch), seconds), retries)
            sent += len(rows)
        yield pd.DataFrame({"sent": [sent]})

    return df.mapInPandas(run, "sent long").agg(F.coalesce(F.sum("sent"), F.lit(0)).alias("n")).first()["n"]
