"""Plain files in the shared folder, opened from any task.

``pyarrow.fs`` resolves the address (``file:``, ``hdfs:``, ``s3:``, ``gs:`` or a
plain path), so that the same code runs on a mounted folder and an object store.
"""

from __future__ import annotations

from pyarrow import fs


def locate(address: str):
    """(file system, path in it) of an address."""
    if "://" not in address and not address.startswith("file:"):
        return fs.LocalFileSystem(), address
    if address.startswith("file:"):
        rest = address[len("file:"):]
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(address)


def list_files(address: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(address, bytes) of the files directly below a folder, by name.

    A file that holds the given address itself is listed alone. Names that
    begin with ``_`` or ``.`` are skipped, as Spark's readers do.
    """
    store, path = locate(address)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(address, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(address)
    base = address.rstrip("/")
    found = [x for x in store.get_file_info(fs.FileSelector(path))
             if x.type == fs.FileType.File and x.base_name.endswith(suffixes)
             and not x.base_name.startswith(("_", "."))]
    return sorted((f"{base}/{x.base_name}", x.size) for x in found)


def make_folder(address: str) -> None:
    store, path = locate(address)
    store.create_dir(path, recursive=True)


def open_for_writing(address: str):
    store, path = locate(address)
    return store.open_output_stream(path, compression=None)


def open_for_reading(address: str):
    store, path = locate(address)
    return store.open_input_file(path)


def remove(address: str) -> None:
    store, path = locate(address)
    if store.get_file_info(path).type == fs.FileType.File:
        store.delete_file(path)
