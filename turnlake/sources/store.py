"""A keyed table that changes as a whole or not at all: upserts, deletes and imports on Parquet, one version after the other.

Rows lie in BUCKETS by their key. A change writes anew only the buckets that it touches, under names of their own, and then
puts one small file in place that lists the buckets of the new version. Readers take the newest such file, so they see all of
a change or nothing of it, and a version that is being read stays as it is. Two changes that began from one version cannot
both be put in place: the second is refused and may be tried again.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
BUCKET, VERSION = "_bucket", "version-"


class Conflict(RuntimeError):
    """Another change was put in place first."""


class Refused(ValueError):
    """A change that holds rows which the table must not have."""


def _context(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return folder, folder.getFileSystem(conf), spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.getFileSystem(conf).getUri(), conf)


def versions(spark: SparkSession, path: str) -> list[int]:
    folder, system, _ = _context(spark, path)
    if not system.exists(folder):
        return []
    names = [x.getPath().getName() for x in system.listStatus(folder)]
    return sorted(int(x.removeprefix(VERSION)) for x in names if x.startswith(VERSION))


def _manifest(spark: SparkSession, path: str, version: int | None) -> dict | None:
    held = versions(spark, path)
    if not held or version is not None and version not in held:
        return None
    (told,) = spark.read.text(f"{path}/{VERSION}{held[-1] if version is None else version:012d}", wholetext=True).collect()
    return json.loads(told[0])


def _commit(spark: SparkSession, path: str, manifest: dict) -> int:
    """Put a version's list in place, which fails if there is one: it is written under another name and renamed, never over another."""
    _, system, context = _context(spark, path)
    waiting = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.{uuid.uuid4().hex}")
    out = system.create(waiting, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    try:
        context.rename(waiting, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{VERSION}{manifest['version']:012d}"), spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        system.delete(waiting, False)
        raise Conflict(f"version {manifest['version']} of {path} is there already") from error
    return manifest["version"]


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))


def read(spark: SparkSession, path: str, version: int | None = None, keys: list | None = None) -> DataFrame:
    """The table at a version (default: the newest); with keys only their rows, from their buckets alone."""
    manifest = _manifest(spark, path, version)
    if manifest is None:
        raise FileNotFoundError(f"{path} has no {'version' if version is None else f'version {version}'}")
    held = manifest["folders"]
    if keys is not None:
        asked = spark.createDataFrame([(str(x),) for x in keys], f"{manifest['key']} string")
        held = {str(r[0]): held[str(r[0])] for r in _bucketed(asked, manifest["key"], manifest["buckets"]).select(BUCKET).distinct().collect() if str(r[0]) in held}
    folders = [f"{path}/{x}/{BUCKET}={b}" for b, x in held.items()]
    rows = spark.read.schema(manifest["schema"]).parquet(*folders) if folders else spark.createDataFrame([], manifest["schema"])
    return rows if keys is None else rows.where(F.col(manifest["key"]).cast("string").isin([str(x) for x in keys]))


def change(spark: SparkSession, path: str, rows: DataFrame, key: str, valid: Column | None = None, removed: DataFrame | None = None, since: int | None = None, buckets: int = BUCKETS) -> int:
    """Upsert rows and delete the keys of removed (key) in one version, and give its number; a new table begins with version 1.

    A null or repeated key, or a row for which valid does not hold, refuses the whole change, and so does a version other
    than since, if that is given, being the newest. Columns stay those of the first version; further ones are not taken.
    """
    before = _manifest(spark, path, None)
    if since is not None and since != (before or {"version": 0})["version"]:
        raise Conflict(f"{path} is at version {(before or {'version': 0})['version']}")
    if before is not None:
        rows, buckets = rows.select(*spark.createDataFrame([], before["schema"]).columns), before["buckets"]
    schema = before["schema"] if before else ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    bad = F.col(key).isNull() | (F.lit(False) if valid is None else ~F.coalesce(valid, F.lit(False)))
    if rows.where(bad).limit(1).count():
        raise Refused("a row has no key or is not valid")
    if rows.groupBy(key).count().where("count > 1").limit(1).count():
        raise Refused("a key comes twice")
    new = _bucketed(rows, key, buckets)
    gone = None if removed is None else _bucketed(removed.select(key).where(F.col(key).isNotNull()).distinct(), key, buckets)
    touched = {r[0] for r in (new.select(BUCKET) if gone is None else new.select(BUCKET).unionByName(gone.select(BUCKET))).distinct().collect()}
    folders = dict(before["folders"]) if before else {}
    kept = [f"{path}/{folders[str(b)]}/{BUCKET}={b}" for b in touched if str(b) in folders]
    whole = new if gone is None else new.join(gone.select(key), key, "left_anti")
    if kept:
        old = _bucketed(spark.read.schema(schema).parquet(*kept), key, buckets).join(rows.select(key), key, "left_anti")
        whole = (old if gone is None else old.join(gone.select(key), key, "left_anti")).unionByName(whole)
    name = f"data-{uuid.uuid4().hex}"
    whole.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{name}")
    _, system, _ = _context(spark, path)
    for b in touched:
        there = system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/{BUCKET}={b}"))
        folders = {k: v for k, v in folders.items() if k != str(b)} | ({str(b): name} if there else {})
    return _commit(spark, path, {"version": (before["version"] if before else 0) + 1, "key": key, "schema": schema, "buckets": buckets, "folders": folders})
