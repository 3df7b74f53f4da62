"""A logger with a console and perhaps a file."""

from __future__ import annotations

import logging


def get_logger(name: str, level: int = logging.INFO, log_file: str | None = None, file_level: int = logging.DEBUG) -> logging.Logger:
    """Handlers are added once for each name; messages aren't passed on."""
    logger = logging.getLogger(name)
    logger.propagate = False
    logger.setLevel(min(level, file_level) if log_file else level)
    shape = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    wanted = [("console", level, logging.StreamHandler)] + ([(log_file, file_level, lambda: logging.FileHandler(log_file))] if log_file else [])
    for key, own, make in wanted:
        if not any(h.get_name() == key for h in logger.handlers):
            handler = make()
            handler.set_name(key)
            handler.setLevel(own)
            handler.setFormatter(shape)
            logger.addHandler(handler)
    return logger
