"""What a failed read was about, whether it failed on the driver or in a task."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

FAILURES = (PySparkException, Py4JJavaError)
MISSING = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}
CORRUPT = {"CANNOT_READ_FILE_FOOTER", "CANNOT_READ_FILE"}
MALFORMED = {"MALFORMED_RECORD_IN_PARSING"}


def conditions(e: BaseException) -> set[str]:
    """Names of the error conditions in an error and its causes, as Spark prints them in brackets."""
    names = {w for found in re.findall(r"\[([A-Z][A-Z_0-9.]+)\]", str(e)) for w in found.split(".")}
    if isinstance(e, PySparkException):
        names |= set((e.getCondition() or "").split("."))
    return names - {""}
