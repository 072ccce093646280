"""Files that tasks write to and read from the shared folder, of any file system that pyarrow opens."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


@contextmanager
def written(uri: str):
    """A stream to a file that appears under its name whole or not at all, so a task may run twice."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part) as out:
            yield out
        if system.get_file_info(path).type != fs.FileType.NotFound:  # an earlier attempt's, with the same bytes
            system.delete_file(path)
        system.move(part, path)
    except BaseException:
        if system.get_file_info(part).type != fs.FileType.NotFound:
            system.delete_file(part)
        raise


def opened(uri: str):
    """A seekable stream."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
