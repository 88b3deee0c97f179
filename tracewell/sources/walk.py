"""A walk over directory trees that sees every name: level by level, each level listed by the executors.

Spark's own listing leaves out names that begin with '.' or '_'; this one does not. Directories that hold copies and build output
are not entered; ignore files are read where they lie and hold for what is below them; files whose names look like secrets
come out although an ignore file names them. Paths of any file system that Arrow knows; links to directories are not followed,
links to files only where they stay under the root.

Defined results: a root that is missing or empty gives no rows; a file that vanishes between listing and reading has a null content;
contents over the cap are null; paths have '/' for separators and no leading './'.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import glob_regex
from tracewell.session import cut
from tracewell.sources.readers import PRUNED, SECRETISH, SIZE_CAP, is_binary, printable

VCS = (".hg", ".svn")
IGNORE_FILES = (".gitignore", ".ignore")


def ignore_rules(text: str, base: str) -> list[tuple[str, str, bool, bool]]:
    """(base, pattern, negated, directories only) of an ignore file that lies in ``base``."""
    out = []
    for raw in text.splitlines():
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.lstrip("!")
        only_dirs, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line.lstrip("/") or line.startswith("/")
        pattern = line.lstrip("/") if anchored else "**/" + line
        out.append((base, glob_regex(pattern).replace(r"\z", r"\Z"), negated, only_dirs))
    return out


def ignored(path: str, is_dir: bool, rules: list) -> bool:
    """The last rule that fits decides."""
    off = False
    for base, pattern, negated, only_dirs in rules:
        inside = path[len(base) + 1 :] if base and path.startswith(base + "/") else path if not base else None
        if inside is not None and (is_dir or not only_dirs) and re.search(pattern, inside):
            off = not negated
    return off


def walk(spark: SparkSession, root: str, git: bool = False, prune: bool = True, ignore_files: bool = True, deepest: int = 64) -> DataFrame:
    """(path, size, mtime) of the files under ``root``; one job for each level of directories."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        base = base.rstrip("/")
        top = os.path.realpath(base)
        for b in batches:
            rows = []
            for where, held in zip(b["path"], b["rules"], strict=True):
                rules = [tuple(r) for r in json.loads(held)]
                try:
                    found = system.get_file_info(fs.FileSelector(f"{base}/{where}".rstrip("/")))
                except OSError:
                    continue
                if ignore_files:
                    for x in found:
                        if x.base_name in IGNORE_FILES and x.type == fs.FileType.File:
                            with system.open_input_stream(x.path) as f:
                                rules += ignore_rules(f.read(1 << 20).decode("utf-8", "replace"), where)
                packed = json.dumps(rules)
                for x in found:
                    path = f"{where}/{x.base_name}".lstrip("/")
                    local = isinstance(system, fs.LocalFileSystem) and os.path.islink(x.path)
                    if x.type == fs.FileType.Directory:
                        out = x.base_name in VCS or (x.base_name == ".git" and not git) or (prune and x.base_name in PRUNED)
                        if not local and not out:
                            # An ignored directory is entered for the secrets it may hold; what else it has stays out.
                            below = [*rules, (path, ".", False, False)] if ignored(path, True, rules) else None
                            rows.append((path, True, 0, None, json.dumps(below) if below else packed))
                    elif x.type == fs.FileType.File:
                        if local and not (os.path.realpath(x.path) + "/").startswith(top + "/"):
                            continue
                        if not ignored(path, False, rules) or re.search(SECRETISH, x.base_name):
                            rows.append((path, False, x.size, x.mtime, ""))
            yield pd.DataFrame(rows, columns=["path", "dir", "size", "mtime", "rules"]).astype({"size": "int64", "dir": "bool"}).assign(mtime=lambda d: pd.to_datetime(d["mtime"], utc=True))

    level, files = spark.createDataFrame([("", "[]")], "path string, rules string"), None
    for _ in range(deepest):
        here = cut(level.repartition("path").mapInPandas(each, "path string, dir boolean, size long, mtime timestamp, rules string"), "walk")
        part = here.where("NOT dir").select("path", "size", "mtime")
        files = part if files is None else files.unionByName(part)
        level = here.where("dir").select("path", "rules")
        if level.isEmpty():
            break
    return files


def read_files(spark: SparkSession, root: str, files: DataFrame, size_cap: int = SIZE_CAP) -> DataFrame:
    """``files`` (path, size, ...) with target, key, content (up to the cap), is_binary and text: read by the executors."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for b in batches:
            for path, size in zip(b["path"], b["size"], strict=True):
                content = None
                if size <= size_cap:
                    try:
                        with system.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                            content = f.read()
                    except OSError:
                        pass
                yield pd.DataFrame({"path": [path], "size": [size], "content": [content]})

    got = files.select("path", "size").repartition("path").mapInPandas(each, "path string, size long, content binary")
    binary = F.coalesce(is_binary(F.col("content")), F.lit(False))
    text = F.when(binary, printable(F.col("content"))).otherwise(F.col("content").cast("string"))
    return got.withColumns({"key": F.sha2("path", 256), "target": F.lit(root), "is_binary": binary, "text": text})


def scan_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """Every file under a root, hidden ones too, ready for the scan."""
    return read_files(spark, root, walk(spark, root, **options))
