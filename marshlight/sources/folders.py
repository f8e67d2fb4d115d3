"""Files of a folder as Python workers see them, by pyarrow's file systems: local and mounted folders, HDFS, object stores."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyarrow import fs


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path).rstrip("/"))


def write_bytes(system: fs.FileSystem, path: str, data: bytes) -> None:
    with system.open_output_stream(path) as out:
        out.write(data)


def read_bytes(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path) as stream:
        return stream.read()


def newest(system: fs.FileSystem, folder: str) -> int:
    """The newest version published below a folder (see ``versions``); 0 without one."""
    found = system.get_file_info(fs.FileSelector(f"{folder}/_versions", allow_not_found=True))
    return max([0, *(int(m[1]) for f in found if (m := re.fullmatch(r"v(\d+)\.json", f.base_name)))])


def publish(system: fs.FileSystem, folder: str, version: int, content: dict) -> bool:
    """Make a version, at once and once only; False if it is taken. Exclusive by a link on local file systems, elsewhere as far as
    a rename doesn't overwrite."""
    system.create_dir(f"{folder}/_versions")
    draft, final = f"{folder}/_versions/draft-{uuid.uuid4().hex}", f"{folder}/_versions/v{version}.json"
    write_bytes(system, draft, json.dumps(content).encode())
    taken = system.get_file_info(final).type != fs.FileType.NotFound
    if not taken and isinstance(system, fs.LocalFileSystem):
        try:
            os.link(draft, final)
        except FileExistsError:
            taken = True
        system.delete_file(draft)
    elif not taken:
        system.move(draft, final)
    else:
        system.delete_file(draft)
    return not taken
