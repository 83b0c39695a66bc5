"""Reading paths that may not exist yet, and the time formats of text files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

# Text files keep microseconds; Spark's default formats stop at milliseconds.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
LOCAL_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def if_exists(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The result of ``read``, or ``None`` if its path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
