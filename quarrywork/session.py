"""Session helpers: the package on executors, and settings that plans here rely on."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


#: Rows that are sent to a Python worker at once: whole texts, so fewer than Spark's 10,000.
BATCH_ROWS = 2000


def ship_package(spark: SparkSession) -> None:
    """Make ``quarrywork`` importable in Python workers, once for each application.

    Workers do not see the driver's ``sys.path``; the package goes to them as a zip file through
    Spark's file server.  Where the session does not say how many rows go to a worker at once, it is
    told ``BATCH_ROWS``, as the texts of a batch are in memory together.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quarrywork-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "quarrywork.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local, as in tests, a private folder is made; on any other
    master that is an error, as executors would not see each other's files.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _OWN:
        path = tempfile.mkdtemp(prefix="quarrywork-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[context.applicationId] = f"file://{path}"
    return _OWN[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A new path for a table or file in the shared folder."""
    return f"{shared_dir(spark)}/quarrywork/{name}-{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` with its lineage cut by a checkpoint in the shared folder."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.checkpoint()


#: Names under which builds of the library export the call.
_NAMES = ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads")


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Tells the OpenBLAS that numpy brings along; other libraries keep their own setting."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in _NAMES:
            if hasattr(library, name):
                getattr(library, name)(ctypes.c_int(1))
                break
