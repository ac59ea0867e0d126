"""Files as Python workers reach them: local and shared mounts, HDFS, S3, GCS."""

from __future__ import annotations

import fnmatch

import pyarrow.fs as pafs


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return fs, inner.rstrip("/")


def listed(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """A file, or the files below a folder in order, or those whose name fits a pattern; names that begin with . or _ are no data."""
    fs, inner = opened(path)
    folder, _, name = inner.rpartition("/")
    if any(c in name for c in "*?["):
        found = [f for f in fs.get_file_info(pafs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, name)]
    elif (one := fs.get_file_info(inner)).type == pafs.FileType.File:
        return fs, [one]
    elif one.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    else:
        found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    return fs, sorted((f for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path)
