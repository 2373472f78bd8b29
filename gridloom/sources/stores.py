"""Opening and listing files by scheme, on the driver and in tasks alike."""

from __future__ import annotations

import glob
import json
import os
import time
from collections.abc import Iterator
from contextlib import ExitStack, closing, contextmanager
from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import BinaryIO
from urllib.parse import urlparse

#: Schemes of stores that can be listed and written, and those that can only be read.
STORES, WEB = ("", "file", "s3", "s3a", "gs", "hdfs", "viewfs"), ("http", "https")


def store(url: str):
    """(file system, path) of a location; a scheme without a store is an error."""
    from pyarrow import fs

    scheme = urlparse(str(url)).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(str(url)).path if scheme else os.path.abspath(os.path.expanduser(str(url)))
    if scheme not in STORES:
        raise ValueError(f"no store for the scheme {scheme!r}")
    return fs.FileSystem.from_uri(str(url).replace("s3a://", "s3://", 1))


@dataclass(frozen=True)
class Access:
    """How patient reads over the web are: seconds without an answer, and further tries when a server is busy or does not answer."""

    timeout: float = 60.0
    tries: int = 3
    wait: float = 0.5


def _from_web(url: str, access: Access) -> BinaryIO:
    from urllib.error import HTTPError, URLError
    from urllib.request import urlopen

    for left in reversed(range(max(1, access.tries))):
        try:
            return urlopen(url, timeout=access.timeout)
        except HTTPError as answer:
            # What a server refuses for good stays refused.
            if answer.code < 500 or not left:
                raise
        except URLError:
            if not left:
                raise
        time.sleep(access.wait)
    raise AssertionError("not reached")


def _from_store(url: str, access: Access) -> BinaryIO:
    system, path = store(url)
    return system.open_input_stream(path)


@contextmanager
def opened(url: str, access: Access = Access()) -> Iterator[BinaryIO]:
    """A file's bytes as a stream that ends with the block; what fails inside the block names the file."""
    find = _from_web if urlparse(str(url)).scheme in WEB else _from_store
    with ExitStack() as held:
        try:
            yield held.enter_context(closing(find(str(url), access)))
        except Exception as error:
            error.add_note(f"in the file {url}")
            raise


def listed(source: str) -> list[str]:
    """The files of a folder, those that a pattern matches (in any store; ** for folders of any depth), or the source itself if it is a file."""
    from pyarrow import fs

    scheme = urlparse(source).scheme
    if scheme in WEB:
        return [source]
    prefix = f"{scheme}://" if scheme else ""
    if glob.has_magic(source):
        # Everything below the last folder without a sign of a pattern, matched by whole names.
        parts = (os.path.abspath(os.path.expanduser(source)) if not scheme else source.removeprefix(prefix)).split("/")
        fixed = next(k for k, part in enumerate(parts) if glob.has_magic(part))
        system, top = store(prefix + ("/".join(parts[:fixed]) or "/"))
        deep = "**" in parts or len(parts) > fixed + 1
        entries = system.get_file_info(fs.FileSelector(top, recursive=deep, allow_not_found=True))
        pattern = "/".join([top.rstrip("/"), *parts[fixed:]])
        return sorted(prefix + f.path for f in entries if f.type == fs.FileType.File and PurePosixPath(f.path).full_match(pattern))
    system, path = store(source)
    info = system.get_file_info(path)
    if info.type == fs.FileType.Directory:
        return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File)
    return [source] if info.type == fs.FileType.File else []


def write_bytes(url: str, data: bytes) -> None:
    """The whole file or nothing under its name: written beside it first, then renamed."""
    system, path = store(url)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path + ".part") as out:
        out.write(data)
    system.move(path + ".part", path)


def save_state(url: str, state: dict) -> None:
    """A JSON state, replaced as a whole."""
    write_bytes(url, (json.dumps(state, indent=2) + "\n").encode())


def load_state(url: str) -> dict | None:
    """The state of that name; None where there is none."""
    from pyarrow import fs

    system, path = store(url)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(path) as stream:
        return json.loads(stream.read())


def exists(url: str) -> bool:
    """Whether a file or folder of that name is there."""
    from pyarrow import fs

    system, path = store(url)
    return system.get_file_info(path).type != fs.FileType.NotFound


def move(file: str, name: str) -> None:
    """Give a file another name in its store, in place of what has that name."""
    system, path = store(file)
    system.move(path, store(name)[1])


def remove(url: str) -> None:
    """Delete a file, or a folder with all it holds; one that is not there is no error."""
    from pyarrow import fs

    system, path = store(url)
    kind = system.get_file_info(path).type
    if kind == fs.FileType.Directory:
        system.delete_dir(path)
    elif kind != fs.FileType.NotFound:
        system.delete_file(path)
