"""Options, local to the context that sets them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: block: positions per alignment block; flush_sources: distinct sources above which an expression is checkpointed.
DEFAULTS: dict[str, Any] = {"block": 1 << 16, "flush_sources": 32}
_OPTIONS: ContextVar[dict[str, Any]] = ContextVar("runloom_options", default=DEFAULTS)


def get_value(key: str) -> Any:
    return _OPTIONS.get()[key]


def get_all_values() -> dict[str, Any]:
    return dict(_OPTIONS.get())


def set_value(key: str, value: Any) -> None:
    if key not in DEFAULTS:
        raise KeyError(key)
    _OPTIONS.set({**_OPTIONS.get(), key: value})


@contextlib.contextmanager
def config_scope(**values: Any) -> Iterator[None]:
    """The options of ``values`` hold inside."""
    if unknown := set(values) - set(DEFAULTS):
        raise KeyError(*unknown)
    token = _OPTIONS.set({**_OPTIONS.get(), **values})
    try:
        yield
    finally:
        _OPTIONS.reset(token)


def flush_threshold_scope(sources: int):
    return config_scope(flush_sources=sources)


def lazy_evaluation_scope():
    """Nothing is checkpointed inside, however large expressions grow."""
    return config_scope(flush_sources=1 << 30)


def greedy_evaluation_scope():
    """Every operation on tensors is checkpointed inside."""
    return config_scope(flush_sources=0)


@contextlib.contextmanager
def num_threads_scope(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Shuffles inside have so many partitions."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(partitions))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="runloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
