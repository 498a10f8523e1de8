"""Files of a store as Python workers reach them: a local or mounted folder, or any store that pyarrow knows by its address."""

from __future__ import annotations

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it; an address without a scheme is a path of the machine's own."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listing(path: str) -> list[fs.FileInfo]:
    """What is in a folder, by name; nothing if it is not there."""
    store, at = store_of(path)
    return sorted(store.get_file_info(fs.FileSelector(at, allow_not_found=True)), key=lambda f: f.base_name)


def read_bytes(path: str) -> bytes:
    store, at = store_of(path)
    with store.open_input_stream(at) as f:
        return f.read()


def write_bytes(path: str, content: bytes) -> None:
    """Under another name first, then renamed, so that no reader meets half a file."""
    store, at = store_of(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(f"{at}.part") as f:
        f.write(content)
    store.move(f"{at}.part", at)


def exists(path: str) -> bool:
    store, at = store_of(path)
    return store.get_file_info(at).type != fs.FileType.NotFound
