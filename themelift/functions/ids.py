"""Identifiers of jobs, theme tasks and validation batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def job_id(*parts: Column) -> Column:
    """Eight hex digits derived from the inputs, so that a rerun gives the same id."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8)


def theme_id(job: Column, position: Column) -> Column:
    return F.concat(job, F.lit("-t"), position.cast("string"))


def batch_id(theme: Column, index: Column) -> Column:
    return F.concat(theme, F.lit("-b"), index.cast("string"))
