"""Helpers of the genotyping operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of a reference table that may be sent to every worker
BROADCAST_ROWS = 2_000_000
#: bases of a panel that the kernels may hold in every worker process, three times those of the genomic one
PANEL_BASES = 1 << 28
#: keys that `matched` treats as hot, at most
HOT_KEYS = 10_000

#: path: (Hadoop file system, Hadoop path) of every table that stored() wrote and nobody has dropped yet
_made: dict[str, tuple] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it through sys.path alone."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it was counted to have at most `rows` rows; otherwise the optimiser chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def matched(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, how: str = "inner", most: int = 10_000, hot: int = HOT_KEYS) -> DataFrame:
    """rows joined with groups (one row per key; column `n`: how many rows have the key, dropped), no key meeting in one task.

    groups must be stored. Up to `most` of them are broadcast. Beyond, keys with more than a `hot`-th of all rows, which
    can't be more than `hot` keys, are broadcast and the other keys are joined by a shuffle.
    """
    size = groups.agg(F.count("*").alias("k"), F.sum(n).alias("rows"), F.max(n).alias("top")).first()
    own = groups.drop(n)
    if size.k <= most:
        return rows.join(F.broadcast(own), keys, how)
    least = max(1_000, size.rows // hot)
    if size.top <= least:
        return rows.join(own, keys, how)
    large = groups.where(F.col(n) > least).drop(n)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(large), keys).unionByName(rest.join(groups.where(F.col(n) <= least).drop(n), keys, how))


def collected(df: DataFrame, rows: int = BROADCAST_ROWS):
    """df as a pandas table on the driver; more than `rows` rows are refused before any but the first `rows` + 1 are read."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"a reference table of more than {rows} rows can't be sent to the workers")
    return df.toPandas()


def shared_panel(alleles: DataFrame, most: int = PANEL_BASES):
    """A broadcast of (ids, sequences) of alleles (seq_idx, seq) in order, counted before any row reaches the driver.

    A panel of more than `most` bases or rows is refused: which strand and which alleles a read keeps depends on all of
    them at once, so a panel can't be split, and reads are not dropped instead.
    """
    size = alleles.agg(F.count("*").alias("n"), F.sum(F.length("seq").cast("long")).alias("bases")).first()
    if size.n + (size.bases or 0) > most:
        raise ValueError(f"a panel of {size.n} sequences and {size.bases} bases is above the {most} that a worker may hold; genotype groups of genes apart")
    rows = alleles.orderBy("seq_idx").select("seq_idx", "seq").collect()
    return alleles.sparkSession.sparkContext.broadcast(([r.seq_idx for r in rows], [r.seq for r in rows]))


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows over all cores where it has fewer splits than these; a scan of many files stays as it is."""
    n = 2 * scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(n) if scan.rdd.getNumPartitions() < n else scan


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where that is unset, a local session (one machine) uses a temporary folder; any other is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="lociframe-")
        sc.setCheckpointDir(folder)
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a cut of the lineage that outlives executors.

    The table is deleted by dropped(), at the end of a temporary() block, by release(), or when the driver ends.
    """
    path = shared_path(df.sparkSession, name)
    owned(df.sparkSession, path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lociframe_path = path
    return out


def owned(spark: SparkSession, path: str) -> None:
    """Have `path` deleted like a stored table."""
    sc = spark.sparkContext
    if not _made:
        atexit.unregister(release)
        atexit.register(release)
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    _made[path] = (place.getFileSystem(sc._jsc.hadoopConfiguration()), place)


def _delete(path: str) -> None:
    if path in _made:
        from py4j.protocol import Py4JError

        fs, place = _made.pop(path)
        try:
            fs.delete(place, True)
        except (Py4JError, OSError):
            pass  # the JVM has ended: nothing is left that could delete it


def dropped(df: DataFrame) -> None:
    """Delete a table made by stored(); nothing may read it afterwards."""
    _delete(df._lociframe_path)


def release() -> None:
    """Delete every table that is still stored. Call it when no result that reads them is needed any more."""
    for path in list(_made):
        _delete(path)


@contextmanager
def temporary():
    """Deletes the tables stored inside the block when it ends, but those that were given to the function it yields."""
    before, kept = set(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._lociframe_path)
        return df

    try:
        yield keep
    finally:
        for path in [x for x in _made if x not in before and x not in kept]:
            _delete(path)
