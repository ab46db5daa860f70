"""Helpers shared by the operators: tables, durable intermediates, small SQL idioms."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of five are a shingle; texts at this similarity or above are near duplicates.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables written by the operator that runs, if it tidies up.
_WRITTEN: ContextVar[list | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it."""
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # One process on one machine: the warehouse is as durable as anything there.
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/.strataforge"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and iterative plans stay short.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if (written := _WRITTEN.get()) is not None:
        written.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again, so that loops don't fill the disk."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is materialized: all other tables that it wrote are deleted when it returns."""

    @wraps(operator)
    def run(*args, **options) -> DataFrame:
        outer = _WRITTEN.set([])
        out = None
        try:
            out = operator(*args, **options)
            return out
        finally:
            discard(*[t for t in _WRITTEN.get() if t is not out])
            _WRITTEN.reset(outer)
            if out is not None and (written := _WRITTEN.get()) is not None:
                written.append(out)

    return run


def let(value: Column, body) -> Column:
    """``body`` of ``value`` with ``value`` evaluated once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def with_clash_free(df: DataFrame, *names: str) -> DataFrame:
    """Fail early, and clearly, if ``df`` lacks a column that an operator needs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def sent(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast that workers open without a copy of this subpackage; open it once a task."""
    box = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(box.value)


def ship_by_value() -> None:
    """Send this subpackage's functions to Python workers whole, so that executors need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__])


ship_by_value()
