"""Helpers shared by the training-data operators.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, which every
executor and the driver can reach; a private folder is used only where that
setting is absent and Spark runs on one machine. They go when the driver ends,
those of finished rounds as soon as the next round stands.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and the ASCII controls 9 to 13.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables. A cluster must name one: a
    machine-local folder would lose the tables of other machines."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="textscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(df written as a table in the shared folder and read back, its path): cuts
    lineage, so that a lost executor only costs the tasks that read that table.
    The table is deleted when the driver's JVM ends, or by ``discard``."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds, as texts can be long: the setting is
    lowered, never raised. It is read when a plan is run, thus it can't be put
    back before the caller has run it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def hub_join(rows: DataFrame, values: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to values (one row a key; ``weight`` is how many rows have it).

    A key that holds more than a thousandth of ``total`` rows, and ``HUB_ROWS`` of
    them, is one of at most 1,000; those values are broadcast, so that no task has
    to take a hub's rows. The others meet by a shuffled join. inner or left, null keys match nothing."""
    hot = max(HUB_ROWS, total // 1000)
    if total <= hot:
        return rows.join(values.drop(weight), key, how)
    hubs = F.broadcast(values.where(F.col(weight) > hot).drop(weight))
    rest = values.where(F.col(weight) <= hot).drop(weight)
    spread = rows.join(F.broadcast(values.where(F.col(weight) > hot).select(key)), key, "left_anti")
    return rows.join(hubs, key).unionByName(spread.join(rest, key, how))


#: Rows of one key that a task takes without trouble.
HUB_ROWS = 100_000


def as_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def as_bytes(name: str) -> Column:
    """UTF-8 bytes, null as empty: spares Python the decoding."""
    return as_text(name).cast("binary")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is a binding,
    while a plain column expression would be repeated wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Lower-case words of letters and digits; other ASCII signs separate."""
    if not raw.isascii():
        raw = raw.decode("utf-8", "replace").lower().encode()
    return raw.lower().translate(_PLAIN).split()


def sampled(ids: DataFrame, name: str, limit: int) -> DataFrame:
    """About ``limit`` rows at most, chosen by a hash of their id; all, where there
    are no more."""
    n = ids.count()
    if n <= limit:
        return ids
    return ids.where(F.pmod(F.xxhash64(F.col(name), F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * limit / n))


def bucket_of_id(name: str, n: int) -> Column:
    """crc32 of an id's decimal text modulo n (null id: bucket of '')."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n
