"""Loggers, timing and the engine's exceptions."""

from __future__ import annotations

import functools
import logging
import time


class PipelineError(Exception):
    """Any failure of a stage."""


class IngestionError(PipelineError):
    pass


class EmbeddingError(PipelineError):
    pass


class ClusteringError(PipelineError):
    pass


def logger(name: str = "tidemark", level: int | str = logging.INFO, file: str | None = None) -> logging.Logger:
    out = logging.getLogger(name)
    out.setLevel(level)
    if not out.handlers:
        for handler in [logging.StreamHandler(), *([logging.FileHandler(file)] if file else [])]:
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
            out.addHandler(handler)
    return out


def timed(func):
    """Log how long each call takes, failed ones too."""

    @functools.wraps(func)
    def run(*args, **kwargs):
        began, log = time.perf_counter(), logging.getLogger(func.__module__)
        try:
            result = func(*args, **kwargs)
        except Exception:
            log.exception("%s failed after %.2f s", func.__name__, time.perf_counter() - began)
            raise
        log.info("%s took %.2f s", func.__name__, time.perf_counter() - began)
        return result

    return run
