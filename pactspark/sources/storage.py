"""Files that tasks open by themselves, through Arrow's file systems."""

from __future__ import annotations

import re


def file_system(uri: str):
    """(file system, path in it) of a folder's URI or absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri) if ":/" in uri else f"file://{uri}")


def listed(system, folder: str, recursive: bool = False) -> list:
    """File infos below a folder, by path; none where there is no folder."""
    from pyarrow import fs

    return sorted(system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=recursive)), key=lambda i: i.path)
