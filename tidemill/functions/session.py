"""The package on executors: shipped once per application, where workers can't import it already."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from concurrent.futures import Executor, Future, ThreadPoolExecutor

from pyspark.sql import SparkSession

_checked: set[str] = set()


def ensure_package(spark: SparkSession) -> None:
    """Adds this package as a zip if a worker can't import it (it can where it is installed, or on PYTHONPATH)."""
    app = spark.sparkContext.applicationId
    if app in _checked:
        return
    _checked.add(app)

    def found(batches):
        import importlib.util

        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"ok": [importlib.util.find_spec("tidemill") is not None] * len(batch)})

    if spark.range(0, 1, 1, 1).mapInPandas(found, "ok boolean").first()["ok"]:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "tidemill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)


_background: list[ThreadPoolExecutor] = []


def in_background(operation: Callable, *args, executors: tuple[Executor | None, ...] = (), **options) -> Future:
    """The asynchronous form of an operation with its action, such as a send that is written: submitted to the first executor given (of the call, of the sender, ..), else to one of the application. Its jobs run beside those of other threads."""
    chosen = next((e for e in executors if e is not None), None)
    if chosen is None:
        if not _background:
            _background.append(ThreadPoolExecutor(4, thread_name_prefix="tidemill"))
        chosen = _background[0]
    return chosen.submit(operation, *args, **options)
