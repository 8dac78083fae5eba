"""Binary files in the shared folder, written and read by tasks.

pyarrow's file systems serve the same URIs as Spark's (file, hdfs, s3, gs).  A
task writes under a name of its own attempt and returns that name with its rows;
only names in the rows of finished tasks are ever read, so a lost executor
leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import uuid
from functools import cache
from urllib.parse import urlsplit

from pyarrow import fs


@cache
def _filesystem(root: str):
    return fs.FileSystem.from_uri(root)[0]


def _at(uri: str):
    parts = urlsplit(uri)
    if not parts.scheme:
        return _filesystem("file:///"), uri
    path = parts.path if parts.scheme in ("file", "hdfs", "viewfs") else parts.netloc + parts.path
    return _filesystem(f"{parts.scheme}://{parts.netloc}/"), path


def new_name(folder: str, suffix: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    """An output stream; its folder is made if need be."""
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_random(uri: str):
    """A file that is read by ranges."""
    system, path = _at(uri)
    return system.open_input_file(path)
