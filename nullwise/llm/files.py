"""Binary files in the shared folder, for tasks that write or read them."""

from __future__ import annotations

from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a local path or a URI that pyarrow knows."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def open_output(path: str):
    system, inner = filesystem(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)  # the bytes as given, whatever the name says


def open_input(path: str):
    system, inner = filesystem(path)
    return system.open_input_stream(inner, compression=None)
