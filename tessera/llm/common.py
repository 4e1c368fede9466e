"""Shared plumbing: the shared folder, written tables, Arrow-batch mapping."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: dict[int, str] = {}
HOT_SHARE = 1000  # a key is hot if it holds more than one in so many rows, so there are fewer hot keys than that
BATCH_BYTES = 2 << 20  # of texts that are held as Python objects, and of Arrow batches in the pipeline


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, one of our own on a local master (tests)."""
    sc = spark.sparkContext
    set_by_cluster = sc.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
    return _own[sc.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table in ``folder`` or the shared folder and reread it: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = folder or fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = path
    weakref.finalize(out, _written.pop, id(out), None)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for t in tables:
        path = _written.pop(id(t), None)
        if path:
            jvm = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(jvm, True)


def join_skewed(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small``, which has a row per key at most; keys that hold many rows of ``big`` are not shuffled.

    Their rows of ``small``, fewer than ``HOT_SHARE``, are broadcast; the rest is joined by key.  ``how``: inner or left.
    """
    n = big.count()
    hot = [r[0] for r in big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n ")).where(F.col("n ") > max(10_000, n // HOT_SHARE)).select(key).collect()]
    if not hot:
        return big.join(small, key, how)
    is_hot = F.col(key).isin(hot)
    rest = F.coalesce(~is_hot, F.lit(True))
    return big.where(is_hot).join(F.broadcast(small.where(is_hot)), key, how).unionByName(big.where(rest).join(small.where(rest), key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker; functions come with each task anew, and so do their globals."""
    return sys.modules.setdefault("tessera worker state", ModuleType("tessera worker state")).__dict__


def bound_batches(spark: SparkSession, most_bytes: int = BATCH_BYTES) -> None:
    """From now on the session's Arrow batches hold about ``most_bytes``, a row at least, unless it asks for less already.

    Spark deals 10,000 rows or 64 MB at a time; while a batch is sent it lies several times in the executor's native memory and in
    the worker's, and what was held once is kept.
    """
    now = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if now <= 0 or now > most_bytes:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def give_back() -> None:
    """Hand memory that this process has freed back to the system: a worker lives on, and its allocators would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)``; at the end of a task its worker gives back what the task has freed."""

    def lean(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return df.mapInArrow(lean, schema)


def slices(batch, most_bytes: int = BATCH_BYTES) -> Iterator:
    """The batch in slices of about ``most_bytes``, a row at least."""
    step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
    return (batch.slice(a, step) for a in range(0, batch.num_rows, step))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Apply ``make()(columns) -> columns`` to every Arrow batch of ``df``; ``make`` runs once per task."""

    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        f = make()
        for batch in (part for whole in batches for part in slices(whole)):
            if batch.num_rows:
                out = f({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_pydict({k: out[k] for k in arrow.names}, schema=arrow)

    return map_arrow(df, run, schema)
