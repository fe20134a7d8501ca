"""Files in folders that driver and executors share, through Arrow's file systems."""

from __future__ import annotations

from kindred.storage import open_fs

__all__ = ["open_fs"]
