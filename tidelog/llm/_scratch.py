"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that is unset and the session is
    local (tests).  On a cluster without that setting, executors would write to their own disks: an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tidelog-"))
            atexit.register(shutil.rmtree, _local[0], True)
        base = "file://" + _local[0]
    _made.append(f"{base.rstrip('/')}/tidelog-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the list of folders made, for ``clear``."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Removes all folders made (since a mark), but for those that keep reads, once no other result that
    reads them is needed any more."""
    read = keep.inputFiles() if keep is not None else []
    held = [f for f in _made[since:] if any(f.rsplit("/", 1)[1] in x for x in read)]
    for folder_ in _made[since:]:
        if folder_ not in held:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder_)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made[since:] = held


def frequent(counted: DataFrame, most: int, *key: str, n: str = "n"):
    """Column: the row of counted (key, n) is one of the most frequent, about ``most`` of them.  Counts fall
    into bins about 9 % wide, which are few, whatever the corpus; of the bin that ``most`` cuts, a share is
    taken by a hash of the key."""
    from pyspark.sql import functions as F

    bin_of = F.floor(F.log2(n) * 8).cast("long")
    bins = sorted(((r.b, r.k) for r in counted.groupBy(bin_of.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)
    room, unit, on_top = most, 1 << 20, F.lit(False)
    for b, k in bins:
        if k > room:
            return on_top | ((bin_of == b) & (F.pmod(F.xxhash64(*key), F.lit(unit)) < room * unit // k))
        on_top, room = bin_of >= b, room - k
    return on_top


def learning_rows(df: DataFrame, id_col: str, modulus: int, held: int):
    """Column: the row's id has a crc32 remainder other than the held-out one. Null ids never teach."""
    from pyspark.sql import functions as F

    part = F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
    return F.coalesce(part != held, F.lit(False))


def held_out(id_col: str, modulus: int, held: int):
    """Column: the row's id has the held-out remainder; false for a null id."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == held, F.lit(False))
