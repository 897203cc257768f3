"""A logger to the console and a file; importing this changes nothing."""

from __future__ import annotations

import logging
from pathlib import Path


def setup_logger(name: str = "equisift", file: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The logger of that name, writing to the console and, if given, to a file on the driver. Called again, it adds only what isn't there yet."""
    log = logging.getLogger(name)
    log.setLevel(level)
    log.propagate = False
    form = logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s")
    if not any(type(h) is logging.StreamHandler for h in log.handlers):
        log.addHandler(logging.StreamHandler())
    if file and not any(isinstance(h, logging.FileHandler) and h.baseFilename == str(Path(file).absolute()) for h in log.handlers):
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        log.addHandler(logging.FileHandler(file, encoding="utf-8"))
    for h in log.handlers:
        h.setFormatter(form)
    return log


def get_logger(name: str = "equisift") -> logging.Logger:
    return logging.getLogger(name)
