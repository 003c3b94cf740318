"""Log output of the jobs: short lines on the console, everything with its time in a file."""

from __future__ import annotations

import logging
import sys

NAME = "cueloom"


def utf8_console() -> None:
    """Texts of any language can be printed, whatever the console's own encoding is."""
    for stream in (sys.stdout, sys.stderr):
        if hasattr(stream, "reconfigure"):
            stream.reconfigure(encoding="utf-8", errors="replace")


def start(verbose: bool = False, log_file: str | None = None) -> logging.Logger:
    """The engine's logger, with handlers of its own; those of an earlier start are closed."""
    stop()
    log = logging.getLogger(NAME)
    log.setLevel(logging.DEBUG)
    log.propagate = False
    console = logging.StreamHandler(sys.stderr)
    console.setLevel(logging.DEBUG if verbose else logging.INFO)
    console.setFormatter(logging.Formatter("%(levelname)s %(message)s"))
    log.addHandler(console)
    if log_file:
        file = logging.FileHandler(log_file, encoding="utf-8")
        file.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(file)
    return log


def stop() -> None:
    log = logging.getLogger(NAME)
    for handler in list(log.handlers):
        log.removeHandler(handler)
        handler.close()
    log.propagate = True
