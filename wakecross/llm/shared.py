"""Arrays in the cluster's shared folder: written by tasks, memory-mapped by workers."""

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs


def release_memory() -> None:
    """Gives back to the system what earlier tasks of a reused worker have freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task for mapInArrow, which leaves no freed memory with its worker for later stages."""

    def run(batches: Iterator) -> Iterator:
        release_memory()
        yield from task(batches)
        release_memory()

    return run


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = _system(uri)
    system.create_dir(path, recursive=True)


def files(uri: str, suffix: str = "") -> list[tuple[str, int]]:
    """The files of a folder, as paths that can be opened and sizes, in order."""
    system, path = _system(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    root = uri.rstrip("/")
    return sorted((f"{root}/{f.base_name}", f.size) for f in found if f.is_file and f.path.endswith(suffix))


def write_bytes(uri: str, data) -> None:
    """Writes one file under its final name at once, so a task that is run again replaces it whole."""
    system, path = _system(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(memoryview(data).cast("B") if len(data) else b"")
    system.move(part, path)


def mapped(uri: str, dtype) -> np.ndarray:
    """The file as a read-only array.

    A mounted folder is mapped in place. Any other store is copied to a file
    that has no name any more once it is mapped, so nothing stays behind.
    """
    system, path = _system(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.asarray(np.memmap(path, dtype, "r")) if os.path.getsize(path) else np.zeros(0, dtype)
    with tempfile.TemporaryFile() as local, system.open_input_stream(path) as source:
        while block := source.read(8 << 20):
            local.write(block)
        local.flush()
        return np.asarray(np.memmap(local, dtype, "r")) if local.tell() else np.zeros(0, dtype)


def open_file(uri: str):
    system, path = _system(uri)
    return system.open_input_file(path)


def exists(uri: str) -> bool:
    system, path = _system(uri)
    return system.get_file_info(path).type == fs.FileType.File
