"""Source trees as a data source: folders are dealt to tasks, which list and read them.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("root", root).load()

The driver lists folders down to a depth and no file. Hidden files and names
with an underscore in front, which Spark's own readers skip, are read. Filters
on the path are pushed down, so that folders which can't hold a wanted path are
never listed and files that aren't wanted never opened; Spark filters again.
The root has to be a folder that all executors see.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .lines import FILE_KINDS

# Folders that are left out, and what is read.
# The tool's own folder, which comes first to mind beside .git, has this library's name.
IGNORED = (".git", ".graphloom", "node_modules", "dist", "build", "out", ".venv", "venv", "__pycache__", "vendor", "generated", ".next", "coverage", ".turbo", ".cache")
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "java", "go", "rb", "rs", "php", "cs", "kt", "scala", "swift", "c", "cc", "cpp", "h", "hpp")
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml")
MAX_BYTES = 512 * 1024
#: Files that a task hands on at once, and their bytes.
BATCH_FILES, BATCH_BYTES = 512, 8 << 20
#: Tasks that folders are dealt to, if there are more.
TASKS = 64

COLUMNS = "repo string, path string, content string, size long, sha256 string"


def wanted(name: str) -> bool:
    """Manifests, code, and the files that kind_of_file names."""
    low = name.lower()
    return name in MANIFESTS or ("." in low and low.rpartition(".")[2] in EXTENSIONS) or any(re.search(p, low) for p in FILE_KINDS.values())


@dataclass
class Folder(InputPartition):
    """A folder below the root, with all that is below it or with its own files only."""

    path: str
    below: bool


@dataclass
class Folders(InputPartition):
    """Folders that one task reads, where there are more than tasks."""

    folders: list[Folder]


@dataclass(frozen=True)
class Paths:
    """The paths that filters leave: of these, if any are named, and with all these beginnings."""

    names: tuple[str, ...] | None = None
    begins: tuple[str, ...] = ()

    def take(self, path: str) -> bool:
        return (self.names is None or path in self.names) and all(path.startswith(b) for b in self.begins)

    def under(self, folder: str) -> bool:
        """Whether a wanted path can lie in or below a folder."""
        front = f"{folder}/" if folder else ""
        return (self.names is None or any(n.startswith(front) for n in self.names)) and all(b.startswith(front) or front.startswith(b) for b in self.begins)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, repo: str | None, depth: int) -> None:
        self.root, self.repo, self.depth, self.paths = root, repo, depth, Paths()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, membership and beginnings of path narrow the listing; all filters are handed back."""
        for f in filters:
            of_path = getattr(f, "attribute", None) == ("path",)
            if of_path and isinstance(f, EqualTo | In):
                named = tuple(f.value) if isinstance(f, In) else (f.value,)
                kept = named if self.paths.names is None else tuple(n for n in named if n in self.paths.names)
                self.paths = Paths(kept, self.paths.begins)
            elif of_path and isinstance(f, StringStartsWith):
                self.paths = Paths(self.paths.names, (*self.paths.begins, f.value))
            yield f

    def _folders(self, folder: str) -> list[str]:
        try:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                names = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False) and e.name not in IGNORED)
        except OSError:
            return []
        return [x for n in names if self.paths.under(x := f"{folder}/{n}" if folder else n)]

    def partitions(self) -> Sequence[InputPartition]:
        out, level = [], [""]
        for _ in range(self.depth):
            out += [Folder(f, False) for f in level]
            level = [x for f in level for x in self._folders(f)]
        out += [Folder(f, True) for f in level]
        return out if len(out) <= TASKS else [Folders(out[k::TASKS]) for k in range(TASKS)]

    def _files(self, partition: Folder | Folders) -> Iterator[str]:
        for f in partition.folders if isinstance(partition, Folders) else [partition]:
            yield from self._in(f.path, f.below)

    def _in(self, top: str, below: bool) -> Iterator[str]:
        stack = [top]
        while stack:
            folder = stack.pop()
            try:
                with os.scandir(os.path.join(self.root, folder)) as entries:
                    names = sorted(e.name for e in entries if e.is_file() and wanted(e.name))
            except OSError:
                continue
            yield from (x for n in names if self.paths.take(x := f"{folder}/{n}" if folder else n))
            if below:
                stack += reversed(self._folders(folder))

    def read(self, partition: Folder | Folders) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 5
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["repo", "path", "content", "size", "sha256"])

        for path in self._files(partition):
            try:
                full = os.path.join(self.root, path)
                if os.path.getsize(full) > MAX_BYTES:
                    continue
                with open(full, "rb") as f:
                    text = f.read().decode("utf-8", "replace")
            except OSError:
                continue
            raw = text.encode()
            rows.append((self.repo, path, text, len(raw), hashlib.sha256(raw).hexdigest()))
            held += len(raw)
            if len(rows) >= BATCH_FILES or held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        yield batch()


class SourceTree(DataSource):
    """Options: root, repo (none by default), and depth, down to which the driver lists folders to deal them to tasks (2)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: object) -> DataSourceReader:
        return TreeReader(self.options["root"], self.options.get("repo"), max(1, int(self.options.get("depth", 2))))


def source_files(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """(repo, path, content, size, sha256) of a tree's files up to 512 KiB."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    named = spark.read.format("source_tree").option("root", root)
    return (named if repo is None else named.option("repo", repo)).load()
