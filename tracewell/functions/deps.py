"""Dependencies from manifests and lock files: one parser per format, as rows (ecosystem, name, version)."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import plain_path

Dep = tuple[str, str, str]
LOCAL = re.compile(r"^(?:file|link|portal|workspace|patch):|^git|^https?://|^\.{0,2}/")
DEPTH = 32


def _npm_tree(node: dict, depth: int = 0) -> Iterator[Dep]:
    for name, x in (node.get("dependencies") or {}).items():
        if isinstance(x, dict):
            if isinstance(x.get("version"), str):
                yield "npm", name, x["version"]
            if depth < DEPTH:
                yield from _npm_tree(x, depth + 1)


def npm_lock(text: str) -> Iterator[Dep]:
    d = json.loads(text)
    for path, x in (d.get("packages") or {}).items():
        if path and isinstance(x, dict) and x.get("version"):
            yield "npm", x.get("name") or path.rpartition("node_modules/")[2], x["version"]
    if "packages" not in d:
        yield from _npm_tree(d)


def package_json(text: str) -> Iterator[Dep]:
    d = json.loads(text)
    for k in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies"):
        for name, spec in (d.get(k) or {}).items():
            if isinstance(spec, str) and not LOCAL.search(spec):
                yield "npm", name, spec.lstrip("^~>=< ")


def toml_packages(ecosystem: str) -> Callable[[str], Iterator[Dep]]:
    def parse(text: str) -> Iterator[Dep]:
        for x in tomllib.loads(text).get("package", []):
            if x.get("name") and x.get("version"):
                yield ecosystem, x["name"], x["version"]

    return parse


def lines(ecosystem: str, pattern: str) -> Callable[[str], Iterator[Dep]]:
    rx = re.compile(pattern, re.M)

    def parse(text: str) -> Iterator[Dep]:
        for m in rx.finditer(text):
            if not LOCAL.search(m.group(2)):
                yield ecosystem, m.group(1), m.group(2)

    return parse


def composer_lock(text: str) -> Iterator[Dep]:
    d = json.loads(text)
    for k in ("packages", "packages-dev"):
        for x in d.get(k) or []:
            yield "Packagist", x["name"], x["version"].lstrip("v")


def cargo_toml(text: str) -> Iterator[Dep]:
    d = tomllib.loads(text)
    for k in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, x in (d.get(k) or {}).items():
            v = x if isinstance(x, str) else x.get("version") if isinstance(x, dict) and not x.get("path") else None
            if v:
                yield "crates.io", name, v.lstrip("^~>=< ")


def pyproject(text: str) -> Iterator[Dep]:
    d = tomllib.loads(text)
    for spec in (d.get("project") or {}).get("dependencies") or []:
        if m := re.match(r"\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*[=~>]=\s*([0-9][^\s,;]*)", spec):
            yield "PyPI", m.group(1), m.group(2)
    for name, x in (((d.get("tool") or {}).get("poetry") or {}).get("dependencies") or {}).items():
        v = x if isinstance(x, str) else x.get("version") if isinstance(x, dict) else None
        if v and name.lower() != "python":
            yield "PyPI", name, v.lstrip("^~>=< ")


def generic_lock(text: str) -> Iterator[Dep]:
    """A JSON object from name to {version}, as some indexes hold lock files."""
    for name, x in json.loads(text).items():
        if isinstance(x, dict) and isinstance(x.get("version"), str):
            yield "generic", name, x["version"]


def pom(text: str) -> Iterator[Dep]:
    for m in re.finditer(r"<dependency>(.*?)</dependency>", text, re.S):
        g, a, v = (re.search(rf"<{t}>\s*([^<\s]+)\s*</{t}>", m.group(1)) for t in ("groupId", "artifactId", "version"))
        if g and a and v and not v.group(1).startswith("${"):
            yield "Maven", f"{g.group(1)}:{a.group(1)}", v.group(1)


def pipfile_lock(text: str) -> Iterator[Dep]:
    d = json.loads(text)
    for k in ("default", "develop"):
        for name, x in (d.get(k) or {}).items():
            if isinstance(x, dict) and isinstance(x.get("version"), str):
                yield "PyPI", name, x["version"].lstrip("=")


def nuget_lock(text: str) -> Iterator[Dep]:
    for group in (json.loads(text).get("dependencies") or {}).values():
        for name, x in group.items():
            if isinstance(x, dict) and isinstance(x.get("resolved"), str):
                yield "NuGet", name, x["resolved"]


def swift_resolved(text: str) -> Iterator[Dep]:
    d = json.loads(text)
    for x in d.get("pins") or (d.get("object") or {}).get("pins") or []:
        version = (x.get("state") or {}).get("version")
        if isinstance(version, str):
            yield "SwiftURL", x.get("location") or x.get("repositoryURL") or x["identity"], version


PARSERS: list[tuple[str, Callable[[str], Iterator[Dep]]]] = [
    (r"(?:^|/)(?:package-lock|npm-shrinkwrap)\.json$", npm_lock), (r"(?:^|/)package\.json$", package_json),
    (r"(?:^|/)yarn\.lock$", lines("npm", r'^"?(@?[^@\s"]+)@[^\n]*:\n\s+version:? "?([^"\s]+)"?')),
    (r"(?:^|/)pnpm-lock\.yaml$", lines("npm", r"^\s+/?'?(@?[^@\s']+)@([0-9][^:'()\s]*)")),
    (r"(?:^|/)requirements[^/]*\.txt$", lines("PyPI", r"^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*==\s*([^\s;#]+)")),
    (r"(?:^|/)(?:poetry|uv|pdm)\.lock$", toml_packages("PyPI")), (r"(?:^|/)pyproject\.toml$", pyproject),
    (r"(?:^|/)Cargo\.lock$", toml_packages("crates.io")), (r"(?:^|/)Cargo\.toml$", cargo_toml),
    (r"(?:^|/)go\.sum$", lines("Go", r"^(\S+) v?([^\s/]+)(?:/go\.mod)? h1:")), (r"(?:^|/)go\.mod$", lines("Go", r"^(?:require\s+|\t)([^\s]+/[^\s]+) v?([0-9][^\s]*)")),
    (r"(?:^|/)Gemfile\.lock$", lines("RubyGems", r"^    ([A-Za-z0-9._-]+) \(([0-9][^)]*)\)$")), (r"(?:^|/)composer\.lock$", composer_lock),
    (r"(?:^|/)Pipfile\.lock$", pipfile_lock), (r"(?:^|/)packages\.lock\.json$", nuget_lock), (r"(?:^|/)Package\.resolved$", swift_resolved),
    (r"(?:^|/)pubspec\.lock$", lines("Pub", r'^  (\w+):\n(?:    .*\n)*?    version: "([^"]+)"')), (r"(?:^|/)mix\.lock$", lines("Hex", r'^\s*"(\w+)": \{:hex, :\w+, "([^"]+)"')),
    (r"(?:^|/)gradle\.lockfile$", lines("Maven", r"^([\w.-]+:[\w.-]+):([^=\s]+)=")), (r"(?:^|/)Podfile\.lock$", lines("CocoaPods", r"^  - \"?([\w./+-]+) \(([0-9][^)]*)\)")),
    (r"(?:^|/)pom\.xml$", pom), (r"(?:^|/)build\.gradle(?:\.kts)?$", lines("Maven", r"""["']([\w.-]+:[\w.-]+):([0-9][\w.-]*)["']""")),
]


def parse(path: str, text: str | None) -> list[Dep]:
    """Dependencies of one file; nothing for other files. A file that does not parse falls back to the generic form, then to nothing."""
    if not text:
        return []
    for rx, f in PARSERS:
        if re.search(rx, path):
            for g in (f, generic_lock):
                try:
                    got = sorted(set(g(text)))
                except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
                    continue
                if got:
                    return got
            return []
    return []


def extract(files: DataFrame) -> DataFrame:
    """(key, path, ecosystem, name, version), distinct, of every manifest in ``files`` (key, path, text)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, p, *d) for k, p, t in zip(b["key"], b["path"], b["text"], strict=True) for d in parse(p, t)]
            yield pd.DataFrame(rows, columns=["key", "path", "ecosystem", "name", "version"])

    kept = files.select("key", plain_path(F.col("path")).alias("path"), "text").where(F.col("path").rlike("|".join(rx for rx, _ in PARSERS)) & F.col("text").isNotNull())
    return kept.dropDuplicates(["key"]).mapInPandas(each, f"key {dict(files.dtypes)['key']}, path string, ecosystem string, name string, version string")


def name_candidates(files: DataFrame) -> DataFrame:
    """(key, ecosystem, name, start): names of dependencies in manifests with their first place in the text (0-based), as rules on names need it."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, p, t in zip(b["key"], b["path"], b["text"], strict=True):
                for eco, name in dict.fromkeys((e, n) for e, n, _ in parse(p, t)):
                    m = re.search(rf"(?<![\w@/.-]){re.escape(name)}(?![\w-])", t)
                    rows.append((k, eco, name, m.start() if m else max(t.find(name), 0)))
            yield pd.DataFrame(rows, columns=["key", "ecosystem", "name", "start"])

    kept = files.select("key", plain_path(F.col("path")).alias("path"), "text").where(F.col("path").rlike("|".join(rx for rx, _ in PARSERS)) & F.col("text").isNotNull())
    return kept.mapInPandas(each, f"key {dict(files.dtypes)['key']}, ecosystem string, name string, start int").distinct()


def inventory(files: DataFrame, deepest: int = 12) -> DataFrame:
    """(ecosystem, packages, names, files) of the lock files and manifests at most ``deepest`` directories down, and of all ecosystems ('*')."""
    near = files.where(F.size(F.split(plain_path(F.col("path")), "/")) <= deepest + 1)
    d = extract(near).select("key", F.explode(F.array("ecosystem", F.lit("*"))).alias("ecosystem"), "name", "version")
    return d.groupBy("ecosystem").agg(F.countDistinct("name", "version").alias("packages"), F.countDistinct("name").alias("names"), F.countDistinct("key").alias("files"))
