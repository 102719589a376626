"""Arithmetic of runs (durations, backoff, warm-up) and the driver's logger."""

from __future__ import annotations

import logging

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds; hours may exceed 99."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def time_left(elapsed: Column, steps: Column, total: Column) -> Column:
    """Seconds to the end at the pace so far; null before the first step."""
    return F.try_divide(elapsed, steps) * (total - steps)


def warmup_steps(total: Column, ratio: float) -> Column:
    return F.floor(total * ratio)


def backoff(attempt: Column) -> Column:
    """Seconds before the next try of a service that is overloaded."""
    return F.least(15 * attempt, F.lit(120))


def failure_wait(failures: Column) -> Column:
    """Seconds before the next try after replies that could not be read."""
    return 5 * failures


class _Context(logging.LoggerAdapter):
    def process(self, msg, kwargs):
        fields = {**self.extra, **kwargs.pop("fields", {})}
        return " ".join([msg, *(f"{k}={v}" for k, v in fields.items())]), kwargs


def logger(name: str, **fields) -> logging.LoggerAdapter:
    """A console logger whose lines carry these fields and those of a call (fields={...})."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
        log.propagate = False
    return _Context(log, fields)
