"""What the training-data operators share: table access, scratch tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a small table is broadcast; beyond either joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space, as in the contracts: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application: their Python may not have it on its path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="mnemospark-ship-")  # the driver's own; Spark serves it from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    file = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(file)
    _shipped.add(app)


def rows_of(spark: SparkSession, schema: str, rows) -> DataFrame:
    """A constant table from literals: no Python worker takes part."""
    kinds = spark.createDataFrame([], schema).schema.fields
    cells = [F.struct(*(F.lit(v).cast(k.dataType).alias(k.name) for v, k in zip(r, kinds, strict=True))) for r in rows]
    return spark.range(1).select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one of the cluster; where none is set a temporary one, in local mode only.

    The folder goes when the driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir is not set: executors share no other folder")
            shared = tempfile.mkdtemp(prefix="mnemospark-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        _scratch[app] = f"{shared.rstrip('/')}/mnemospark-{app}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch[app])
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _scratch[app]


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that materialize wrote and nothing reads any more, and let go of shuffles that nothing refers to."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if it has at most `limit` rows (counted unless given) and BROADCAST_BYTES bytes."""
    wide = [F.coalesce(F.length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "struct", "map")]
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(sum(wide, F.lit(0))), F.lit(0))).first()
    size = held + 8 * n * len(df.columns)
    return F.broadcast(df) if (n if rows is None else rows) <= limit and size <= BROADCAST_BYTES else df


def ascii_lower(col):
    """Lower-case A-Z only. Texts without other letters take the fast built-in way."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def row_key(*cols):
    """A key that tells rows apart even if their id is null or repeated; equal rows share it."""
    return F.xxhash64(*cols)


def free_name(df: DataFrame, name: str) -> str:
    """name, or with as many underscores as it takes for df to have no such column."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, with all their columns, but for the rows of gone(doc_id, key); null ids match by their text."""
    row = free_name(docs, "__row__")
    keyed = docs.withColumn(row, row_key("doc_id", "text"))
    g = materialize(gone.select(F.col("doc_id").alias("__gone_id__"), F.col("key").alias("__gone_row__")).distinct(), "gone")
    return keyed.join(small(g), keyed["doc_id"].eqNullSafe(g["__gone_id__"]) & (keyed[row] == g["__gone_row__"]), "left_anti").drop(row)


def hot_join(big: DataFrame, unique: DataFrame, on: dict[str, str], share: int = 1000) -> DataFrame:
    """big left-joined with unique on columns {big's: unique's}, those of unique dropped; unique has a row per key.

    Keys that hold more than 1 / share of big's rows, so fewer than `share` of them, are looked up by broadcast; the
    rest is shuffled, so that no key fills a task. big is read twice and should be a written table.
    """
    mine, theirs = [*on], [*on.values()]
    same = lambda a, b: F.expr(" and ".join(f"`{x}` = `{y}`" for x, y in zip(a, b, strict=True)))
    n = big.count()
    hot = big.groupBy(*mine).agg(F.count("*").alias("__n__")).where(F.col("__n__") * share > n)
    hot = materialize(hot.select(*(F.col(c).alias(f"__h{i}__") for i, c in enumerate(mine))), "hot-keys")
    keys = F.broadcast(hot)
    few, rest = (unique.join(keys, same(theirs, hot.columns), how) for how in ("left_semi", "left_anti"))
    there, else_ = (big.join(keys, same(mine, hot.columns), how) for how in ("left_semi", "left_anti"))
    return there.join(F.broadcast(few), same(mine, theirs), "left").union(else_.join(rest, same(mine, theirs), "left")).drop(*theirs)
