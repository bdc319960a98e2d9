"""Opening a file inside a task, for what Spark's readers and writers do not offer."""

from __future__ import annotations


def _system(uri: str):
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def open_stream(uri: str):
    """A byte stream over a file of any file system Arrow knows; gzip by ending."""
    system, path = _system(uri)
    codec = "gzip" if uri.lower().endswith(".gz") else None
    return system.open_input_stream(path, compression=codec)


def open_bytes(uri: str):
    """A file's own bytes, with ``seek`` and ``size``."""
    system, path = _system(uri)
    return system.open_input_file(path)


def create(uri: str):
    """A byte stream into a new file; its folder is made."""
    system, path = _system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def move(uri: str, to: str) -> None:
    """A file under its new name; done once already is done."""
    from pyarrow import fs

    system, old = _system(uri)
    new = _system(to)[1]
    if system.get_file_info(new).type == fs.FileType.NotFound:
        system.move(old, new)
