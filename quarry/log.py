"""Messages of the library, with level and time, for drivers that want to keep them."""

from __future__ import annotations

import logging
from pathlib import Path

LINE = "%(asctime)s %(name)s %(levelname)s %(message)s"


def logger(name: str, folder: str | None = None) -> logging.Logger:
    """The logger of a part of the library. Messages go to the console; with ``folder`` they are also
    appended to ``<folder>/<name>.log``. Each message is written once however often this is called."""
    found = logging.getLogger(name)
    if not found.handlers:
        found.addHandler(logging.StreamHandler())
        found.setLevel(logging.INFO)
    target = folder and str(Path(folder, f"{name}.log").absolute())
    if target and target not in (getattr(h, "baseFilename", None) for h in found.handlers):
        Path(folder).mkdir(parents=True, exist_ok=True)
        file = logging.FileHandler(target, delay=True)
        file.setFormatter(logging.Formatter(LINE))
        found.addHandler(file)
    return found
