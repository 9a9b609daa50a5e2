"""Releases of tables: staged, listed file by file with their hashes, marked, renamed; and table hashes that don't depend on order.

Everything goes through the Hadoop file system of the path, so a release can be wherever Spark writes. Hashes of files are made by the tasks that read them.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MARKER, MANIFEST, FILES, AUDITS, LATEST = "_SUCCESS", "manifest.json", "_files", "_audits", "latest.json"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's spark.checkpoint.dir. Where that is unset, in a folder of our own, but only on one machine: executors elsewhere wouldn't see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="scratch-")
    return f"{at}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _at(spark, new)
    fs.mkdirs(p.getParent())
    if fs.exists(p) or not fs.rename(_at(spark, old)[1], p):
        raise OSError(f"can't rename {old} to {new}")


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """A small file; with `replace`, written beside the old one and moved over it."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent())
    to = _at(spark, f"{path}.{uuid.uuid4().hex}")[1] if replace else p
    out = fs.create(to, False)
    out.write(bytearray(text.encode()))
    out.close()
    if replace:
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(to, p)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, hash): the same for equal rows in any order and any partitions, other for a row more, less or changed. Columns count by name.

    hash is the sum of the first 15 digits of each row's MD5, rows as text by columns in order of their names; null is unlike any text. So other engines can have it too.
    """
    cells = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(df.columns)]
    row = F.conv(F.substring(F.md5(F.concat_ws("\u001f", *cells)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string").alias("hash"))


def files(spark: SparkSession, at: str) -> DataFrame:
    """(path, bytes, sha256) of the data files below a folder. A file is read whole by one task, so tables should be written in files of bounded size."""
    name = at.rstrip("/").rsplit("/", 1)[-1]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(at)
    return read.select(F.regexp_extract("path", f"/{name}/(.*)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def publish(spark: SparkSession, root: str, release: str, tables: dict[str, DataFrame], meta: dict | None = None, audits: dict[str, DataFrame] | None = None, keep: int | None = None, rows_a_file: int = 10_000_000) -> str:
    """Writes tables as root/runs/release and returns that path. A release that is there already is an error: nothing is overwritten.

    Tables go to a staging folder, rows are counted while they are written, files are listed with bytes and SHA-256 as a table of their own (however many there are), the manifest has a line a table, the
    marker comes last, and one rename makes all of it visible; then latest.json points to it. `keep`: so many of the newest releases stay. If anything fails, the audits that were written are kept in
    root/failed/release with the reason, and the staging folder goes.
    """
    final, staging = f"{root}/runs/{release}", f"{root}/.staging-{release}-{uuid.uuid4().hex}"
    if exists(spark, final):
        raise FileExistsError(f"release {release} is there already: {final}")
    try:
        for name, df in (audits or {}).items():
            df.write.option("header", True).csv(f"{staging}/{AUDITS}/{name}")
        counts = {}
        for name, df in tables.items():
            seen = Observation(f"{name}-{uuid.uuid4().hex}")
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("maxRecordsPerFile", rows_a_file).parquet(f"{staging}/{name}")
            counts[name] = seen.get["rows"]
        listed = None
        for name in tables:
            one = files(spark, f"{staging}/{name}").withColumn("path", F.concat(F.lit(f"{name}/"), F.col("path")))
            listed = one if listed is None else listed.unionByName(one)
        listed.write.parquet(f"{staging}/{FILES}")
        sizes = spark.read.parquet(f"{staging}/{FILES}").groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("name")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        of = {r.name: r for r in sizes.collect()}
        manifest = {"release": release, "meta": meta or {}, "tables": {n: {"rows": counts[n], "files": of[n].n, "bytes": of[n].bytes, "columns": dict(tables[n].dtypes)} for n in tables}}
        write_text(spark, f"{staging}/{MANIFEST}", json.dumps(manifest, indent=2))
        write_text(spark, f"{staging}/{MARKER}", release)
        rename(spark, staging, final)
    except Exception as e:
        if exists(spark, f"{staging}/{AUDITS}"):
            failed = f"{root}/failed/{release}-{uuid.uuid4().hex[:8]}"
            rename(spark, f"{staging}/{AUDITS}", failed)
            write_text(spark, f"{failed}/failure.json", json.dumps({"release": release, "type": type(e).__name__, "message": str(e)[:2_000], "audits": sorted(audits or {})}))
        remove(spark, staging)
        raise
    write_text(spark, f"{root}/{LATEST}", json.dumps({"release": release, "path": final}), replace=True)
    if keep is not None:
        fs, p = _at(spark, f"{root}/runs")
        for old in sorted((s.getPath().getName() for s in fs.listStatus(p)), reverse=True)[max(keep, 1) :]:
            remove(spark, f"{root}/runs/{old}")
    return final


def released(spark: SparkSession, root: str, release: str | None = None) -> tuple[str, dict]:
    """(path, manifest) of a release, the latest by default. One without its marker isn't a release."""
    if release is None:
        release = json.loads(read_text(spark, f"{root}/{LATEST}"))["release"]
    at = f"{root}/runs/{release}"
    if not exists(spark, f"{at}/{MARKER}"):
        raise FileNotFoundError(f"{release} wasn't published: no {MARKER} in {at}")
    return at, json.loads(read_text(spark, f"{at}/{MANIFEST}"))


def damage(spark: SparkSession, at: str) -> DataFrame:
    """(path, reason) of files of a release that are missing, extra, or of other bytes than its list says."""
    manifest = json.loads(read_text(spark, f"{at}/{MANIFEST}"))
    now = None
    for name in manifest["tables"]:
        one = files(spark, f"{at}/{name}").withColumn("path", F.concat(F.lit(f"{name}/"), F.col("path")))
        now = one if now is None else now.unionByName(one)
    then = spark.read.parquet(f"{at}/{FILES}").select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    reason = F.when(F.col("sha256").isNull(), "missing").when(F.col("_sha256").isNull(), "extra").when(F.col("bytes") != F.col("_bytes"), "bytes").when(F.col("sha256") != F.col("_sha256"), "sha256")
    return now.join(then, "path", "full").select("path", reason.alias("reason")).where("reason is not null")


def load(spark: SparkSession, root: str, table: str, release: str | None = None) -> DataFrame:
    """A table of a release whose files are as they were published; an error that names some that aren't."""
    at, manifest = released(spark, root, release)
    if table not in manifest["tables"]:
        raise ValueError(f"no table {table} in {manifest['release']}")
    wrong = damage(spark, at).limit(5).collect()
    if wrong:
        raise ValueError(f"release {manifest['release']} isn't as it was published: {[tuple(r) for r in wrong]}")
    return spark.read.parquet(f"{at}/{table}")


def differences(spark: SparkSession, first: str, second: str) -> dict[str, tuple]:
    """Tables of two releases whose contents differ, with both hashes; files and order don't count."""
    a, b = (json.loads(read_text(spark, f"{at}/{MANIFEST}"))["tables"] for at in (first, second))
    out: dict[str, tuple] = {n: (n in a, n in b) for n in set(a) ^ set(b)}
    for n in set(a) & set(b):
        x, y = (tuple(content_hash(spark.read.parquet(f"{at}/{n}")).first()) for at in (first, second))
        if x != y:
            out[n] = (x, y)
    return out
