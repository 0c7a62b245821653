"""File stores as tasks see them."""

from __future__ import annotations

import re

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or of a path of this machine."""
    if re.match(r"file:|/", path):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", path).strip("/")
    found, place = fs.FileSystem.from_uri(path)
    return found, place.rstrip("/")


def files(path: str, under: str = "") -> list[fs.FileInfo]:
    """The files below a folder, by name, without hidden ones; none where it is not there."""
    found, top = store(path)
    listed = found.get_file_info(fs.FileSelector(f"{top}/{under}".rstrip("/"), allow_not_found=True, recursive=True))
    return sorted((f for f in listed if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path)


def put(path: str, name: str, content: bytes) -> None:
    """Writes a file that is there whole or not at all."""
    import uuid

    found, top = store(path)
    found.create_dir(f"{top}/{name}".rsplit("/", 1)[0], recursive=True)
    own = f"{top}/._{uuid.uuid4().hex}"
    with found.open_output_stream(own) as out:
        out.write(content)
    found.move(own, f"{top}/{name}")
