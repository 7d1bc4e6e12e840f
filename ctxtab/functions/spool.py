"""Rows of numbers that a task reads again and again: in memory while they are few, else in a scratch file."""

from __future__ import annotations

import tempfile

import numpy as np

IN_MEMORY = 32 << 20  # bytes of a spool beyond which its rows wait in a file


class Spool:
    """Rows added in parts.  The file has no name, is the task's alone and goes with it."""

    def __init__(self):
        self.parts, self.file, self.shape, self.bytes, self.dtype = [], None, None, 0, None
        self.n = 0

    def add(self, x: np.ndarray) -> None:
        if not len(x):
            return
        self.dtype, self.shape = self.dtype or x.dtype, self.shape or x.shape[1:]
        x = np.ascontiguousarray(x, dtype=self.dtype)
        self.n, self.bytes = self.n + len(x), self.bytes + x.nbytes
        self.parts.append(x)
        if self.file is None and self.bytes > IN_MEMORY:
            self.file = tempfile.TemporaryFile()
        if self.file is not None:
            for p in self.parts:
                p.tofile(self.file)
            self.parts = []

    def rows(self) -> np.ndarray:
        """All rows; those of a file are read as they are used."""
        if self.file is not None:
            self.file.flush()
            return np.asarray(np.memmap(self.file, self.dtype, "r", shape=(self.n, *self.shape)))
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        return self.parts[0] if self.parts else np.zeros((0, *(self.shape or ())), self.dtype or np.float64)
