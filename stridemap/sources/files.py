"""Single files by any address that the file-system layer of pyarrow knows."""

from __future__ import annotations

import os
from typing import BinaryIO


def writer(uri: str) -> BinaryIO:
    if "://" not in uri:
        path = uri.removeprefix("file:")
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path)
