"""Markdown files as a Spark data source: listed folder by folder, read in groups by many tasks.

Works on every file system that Arrow opens by address (local, HDFS, object stores). Names that begin with "_" or "."
are listed like any other; what the scope leaves out is neither opened nor, where it is a folder, entered.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GROUP_BYTES, GROUP_FILES = 32 << 20, 500
LISTING_THREADS = 16


def glob_regex(pattern: str) -> str:
    """Path glob as a regular expression: ** crosses folders, * and ? do not, {a,b} alternates."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


class Scope:
    """Which relative paths belong to a scan: Markdown files, matching any include and no exclude pattern.

    Without an exclude list, entries whose name begins with a dot and ``node_modules`` folders are left out.
    """

    def __init__(self, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None):
        self.plain = exclude is None
        self.include = None if include is None else [re.compile(glob_regex(p)) for p in include]
        self.exclude = [re.compile(glob_regex(p)) for p in exclude or ()]

    def enters(self, name: str) -> bool:
        return not self.plain or not (name.startswith(".") or name == "node_modules")

    def holds(self, relative: str) -> bool:
        name = relative.rpartition("/")[2]
        if not name.lower().endswith(".md") or (self.plain and name.startswith(".")):
            return False
        chosen = self.include is None or any(p.match(relative) for p in self.include)
        return chosen and not any(p.match(relative) for p in self.exclude)


@dataclass
class FileGroup(InputPartition):
    """Files of one task: name in the file system, path below the root, size."""

    files: list[tuple[str, str, int]]


def open_system(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if re.match(r"^[a-z][a-z0-9+.-]*:", address) else (fs.LocalFileSystem(), os.path.abspath(address))


def list_tree(address: str, scope: Scope) -> list[tuple[str, str, int]]:
    """Files of ``scope`` below ``address``, sorted by relative path; links to files or folders are skipped."""
    from pyarrow import fs

    system, root = open_system(address)
    root = root.rstrip("/") or "/"
    local = system.type_name == "local"
    if (local and os.path.islink(root)) or system.get_file_info(root).type != fs.FileType.Directory:
        raise ValueError(f"The root of a scan must be a folder: {address}")

    def entries(folder: str) -> tuple[list[str], list[tuple[str, str, int]]]:
        folders, files = [], []
        for info in system.get_file_info(fs.FileSelector(folder)):
            if local and os.path.islink(info.path):
                continue
            if info.type == fs.FileType.Directory and scope.enters(info.base_name):
                folders.append(info.path)
            elif info.type == fs.FileType.File:
                relative = info.path[len(root) :].lstrip("/")
                if scope.holds(relative):
                    files.append((info.path, relative, info.size))
        return folders, files

    found = []
    with ThreadPoolExecutor(LISTING_THREADS) as pool:
        waiting = {pool.submit(entries, root)}
        while waiting:
            done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
            for future in done:
                folders, files = future.result()
                found += files
                waiting |= {pool.submit(entries, f) for f in folders}
    return sorted(found, key=lambda f: f[1])


def grouped(files: list[tuple[str, str, int]], most_bytes: int = GROUP_BYTES, most_files: int = GROUP_FILES) -> list[FileGroup]:
    """Neighbouring files in groups of bounded size and number."""
    groups: list[FileGroup] = []
    held = 0
    for file in files:
        if not groups or held + file[2] > most_bytes or len(groups[-1].files) >= most_files:
            groups.append(FileGroup([]))
            held = 0
        groups[-1].files.append(file)
        held += file[2]
    return groups


class MarkdownFiles(DataSource):
    """Options: root (address), scope (JSON with include and exclude), maxFileBytes (content of larger files is not read)."""

    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def schema(self) -> str:
        return "path string, relative_path string, modified timestamp, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return MarkdownReader(self.options)


class MarkdownReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.scope = json.loads(options.get("scope", "{}"))
        self.limit = int(options.get("maxfilebytes") or options.get("maxFileBytes") or 1 << 62)

    def partitions(self) -> list[FileGroup]:
        return grouped(list_tree(self.root, Scope(**self.scope))) or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        system, _ = open_system(self.root)
        for path, relative, _ in partition.files:
            info = system.get_file_info(path)
            content = None
            if info.size <= self.limit:
                with system.open_input_file(path) as file:
                    content = file.read()
            size = info.size if content is None else len(content)
            yield path, relative, info.mtime or datetime.fromtimestamp(0, timezone.utc), size, content
