"""Small files of catalogs: atomic writes and locks.  Data itself goes through Spark."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path


def write_json(path: Path, value: object) -> None:
    """Replace a small file as a whole; canonical JSON."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fresh = path.parent / f".new-{uuid.uuid4().hex}-{path.name}"
    with fresh.open("w") as f:
        f.write(canonical(value))
        f.flush()
        os.fsync(f.fileno())
    os.replace(fresh, path)


def canonical(value: object) -> str:
    return json.dumps(value, allow_nan=False, separators=(",", ":"), sort_keys=True)


@contextmanager
def lock(path: Path, wait_s: float = 600, stale_s: float = 3600) -> Iterator[None]:
    """One writer at a time, also across processes; a lock whose owner is gone for ``stale_s`` is broken."""
    path.parent.mkdir(parents=True, exist_ok=True)
    until = time.monotonic() + wait_s
    while True:
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            try:
                if time.time() - path.stat().st_mtime > stale_s:
                    path.unlink(missing_ok=True)
                    continue
            except FileNotFoundError:
                continue
            if time.monotonic() > until:
                raise TimeoutError(f"{path} is locked") from None
            time.sleep(0.1)
    try:
        yield
    finally:
        path.unlink(missing_ok=True)
