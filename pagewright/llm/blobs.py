"""Byte files in the shared folder, from Python workers, by whatever file system its URI names."""

from __future__ import annotations

import pyarrow.fs as pafs


def open_fs(uri: str):
    """The file system of ``uri`` and its path there."""
    return pafs.FileSystem.from_uri(uri)


class RollingWriter:
    """Appends chunks to files ``{folder}/{stem}-{k}{suffix}`` of about ``limit`` bytes.

    The stem names the task attempt: an attempt that is repeated writes files of its own, and an index whose
    rows were committed always points to files that the same attempt has closed.
    """

    def __init__(self, folder: str, stem: str, suffix: str, limit: int):
        self.fs, self.folder = open_fs(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.stem, self.suffix, self.limit = stem, suffix, limit
        self.k, self.out, self.at, self.name = 0, None, 0, ""

    def append(self, chunk: bytes) -> tuple[str, int]:
        """Writes the chunk and returns its file's name and offset."""
        if self.out is None:
            self.name, self.at = f"{self.stem}-{self.k:04d}{self.suffix}", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        name, at = self.name, self.at
        self.out.write(chunk)
        self.at += len(chunk)
        if self.at >= self.limit:
            self.close()
        return name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out, self.k = None, self.k + 1
