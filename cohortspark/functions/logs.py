"""Logging: silent unless asked for."""

from __future__ import annotations

import logging


def logger(console: bool = False, file: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The library's logger with the wanted outputs and no others."""
    log = logging.getLogger("cohortspark")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    style = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    wanted = ([logging.StreamHandler()] if console else []) + ([logging.FileHandler(file)] if file else [])
    for h in wanted or [logging.NullHandler()]:
        h.setFormatter(style)
        log.addHandler(h)
    log.setLevel(level if wanted else logging.CRITICAL + 1)
    log.propagate = False
    return log
