"""Binary files in the shared folder, by whatever scheme its address has."""

from __future__ import annotations

import os
from typing import BinaryIO
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path) if parts.scheme else uri
    return None


def _system(uri: str):
    """pyarrow's file system for an address. Hadoop's names of object stores are those of pyarrow with another scheme."""
    from pyarrow import fs

    scheme, rest = uri.split("://", 1) if "://" in uri else ("", uri)
    known = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfs"}
    return fs.FileSystem.from_uri(f"{known.get(scheme, scheme)}://{rest}" if scheme else uri)


def open_write(uri: str) -> BinaryIO:
    """Create a file (and, on file systems with folders, its folder)."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    system, path = _system(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path)


def open_read(uri: str) -> BinaryIO:
    """A seekable file."""
    path = _local(uri)
    if path is not None:
        return open(path, "rb")
    system, path = _system(uri)
    return system.open_input_file(path)
