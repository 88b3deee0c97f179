"""Sources: file trees, delimited text, JSON, package databases, hash signatures, socket tables, indicator lists.

Readers return DataFrames and leave the listing, splitting and pushdown to Spark. Defined results: lines over the cap are skipped but
keep their number; a JSON line that does not parse stands for itself; missing fields are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as X

# Directories that a walk leaves out; names that are read although ignore rules leave them out.
PRUNED = "node_modules target dist vendor .venv venv __pycache__ .next .nuxt .turbo .cache .gradle .idea .vscode".split()
SECRETISH = r"(?i)^(?:\.env(?:\..*)?|\.netrc|\.npmrc|\.pypirc|\.htpasswd|\.pgpass|id_(?:rsa|dsa|ecdsa|ed25519)|.*\.(?:pem|key|p12|pfx|keystore|jks)|.*(?:credential|secret).*)$"
LINE_CAP = 1 << 20
SIZE_CAP = 8 << 20


def pruned(path: Column, git: bool = False) -> Column:
    dirs = [*PRUNED, *([] if git else [".git"])]
    return path.rlike("(?:^|/)(?:" + "|".join(d.replace(".", r"\.") for d in dirs) + ")/")


def tree(spark: SparkSession, root: str, git: bool = False, size_cap: int = SIZE_CAP) -> DataFrame:
    """(key, target, path, size, mtime, content, text, is_binary) of all files under a root; contents only up to the cap.

    Pruned directories are left out, except for files whose names look like secrets. Spark's own listing leaves out
    names that begin with '.' or '_': ``walk.scan_tree`` sees them, and reads ignore files.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # A walk gives absolute addresses; what follows the root is the path.
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + base.replace(".", r"\.") + "/?", "")
    name = F.element_at(F.split(rel, "/"), -1)
    kept = raw.where(~pruned(rel, git) | (name.rlike(SECRETISH) & ~rel.rlike(r"(?:^|/)\.git/")))
    content = F.when(F.col("length") <= size_cap, F.col("content"))
    binary = is_binary(F.col("content"))
    out = kept.select(rel.alias("path"), F.lit(root).alias("target"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), content.alias("content"))
    text = F.when(binary, printable(F.col("content"))).otherwise(F.try_to_binary(F.lit("")).cast("string"))
    return out.withColumns({"key": F.sha2("path", 256), "is_binary": binary, "text": F.when(binary, text).otherwise(F.col("content").cast("string"))})


def is_binary(content: Column) -> Column:
    """A zero byte in the first eight KiB."""
    return F.contains(F.substring(content, 1, 8192), F.lit(b"\x00"))


def printable(content: Column, least: int = 6) -> Column:
    """Runs of printable characters of a binary, one a line."""
    return F.array_join(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(rf"[\x20-\x7e\t]{{{least},}}"), F.lit(0)), "\n")


def selected(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files on a list of paths."""
    return files.join(paths.select("path").distinct(), "path", "left_semi")


def lines(files: DataFrame) -> DataFrame:
    """(key, line, text) of texts (key, text); lines over the cap are skipped."""
    return files.select("key", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.octet_length("text") <= LINE_CAP).select("key", (F.col("pos") + 1).alias("line"), "text")


def delimited(spark: SparkSession, path: str, column: str | None = None, sep: str = ",") -> DataFrame:
    """A table with a header row, quotes doubled inside quotes; one column of it as ``value`` if named."""
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True)
    return df if column is None else df.select(F.col(f"`{column}`").alias("value"))


def json_lines(spark: SparkSession, path: str, pick: str | None = None) -> DataFrame:
    """(value) of each line: the field a or a.b, or the line itself if it has none."""
    df = spark.read.text(path)
    return df if pick is None else df.select(F.coalesce(F.get_json_object("value", "$." + pick), "value").alias("value"))


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """(value) of each element of JSON arrays, one a file; other files by lines."""
    whole = spark.read.text(path, wholetext=True)
    arrays = whole.where(F.ltrim("value").startswith("[")).select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    return arrays.unionByName(whole.where(~F.ltrim("value").startswith("[")).select(F.explode(F.split("value", "\n")).alias("value")).where("value <> ''"))


def kind_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("csv", "tsv", "json"), ext).when(ext.isin("jsonl", "ndjson"), "jsonl").when(ext.isin("sqlite", "sqlite3", "db"), "sqlite").otherwise("text")


def grep(rows: DataFrame, value: str, pattern: str | None = None, equals: str | None = None, most: int = 100, order: list[str] | None = None) -> DataFrame:
    """Rows whose value matches, is equal, or both; clipped to 240 characters. ``most`` is the report's length, 0 for all."""
    out = rows
    if pattern is not None:
        out = out.where(F.col(value).rlike(pattern))
    if equals is not None:
        out = out.where(F.col(value) == equals)
    out = out.withColumn("shown", X.collapse(F.col(value)))
    return out.orderBy(*(order or [value])).limit(most) if most else out


def stanzas(text: DataFrame) -> DataFrame:
    """(key, package, version) of package databases of 'Package: x' stanzas or of 'P:' and 'V:' lines (key, text)."""
    parts = text.select("key", F.explode(F.split("text", r"\n\s*\n")).alias("s"))
    pick = lambda a, b: F.nullif(F.coalesce(F.nullif(F.regexp_extract("s", rf"(?m)^{a}:\s*(.+)$", 1), F.lit("")), F.regexp_extract("s", rf"(?m)^{b}:(.+)$", 1)), F.lit(""))
    return parts.select("key", pick("Package", "P").alias("package"), pick("Version", "V").alias("version")).where("package IS NOT NULL")


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """(hash, size, name) of a signature list hash:size:name; '*' is any size."""
    s = F.split("value", ":")
    return spark.read.text(path).where(F.col("value").rlike(r"^[0-9a-fA-F]{32,64}:")).select(F.lower(s[0]).alias("hash"), F.expr("try_cast(split(value, ':')[1] as bigint)").alias("size"), s[2].alias("name"))


def match_signatures(files: DataFrame, sigs: DataFrame) -> DataFrame:
    """Files (key, size, content) with a known digest: an equi-join from the few files' digests to the large list."""
    h = files.select("key", "size", F.explode(F.array(F.md5("content"), F.sha1("content"), F.sha2("content", 256))).alias("hash"))
    return h.join(sigs.withColumnRenamed("size", "sig_size"), "hash").where("sig_size IS NULL OR sig_size = size").select("key", "hash", "name")


def sockets(text: DataFrame) -> DataFrame:
    """(key, local_ip, local_port, remote_ip, remote_port, state, inode) of /proc/net tables of TCP and UDP, IPv4 and IPv6 (key, text).

    IPv6 addresses come in eight groups of four digits; those that hold an IPv4 address are given as that.
    """
    f = F.split(F.trim("l"), r"\s+")
    rows = text.select("key", F.explode(F.split("text", "\n")).alias("l")).where(F.trim("l").rlike(r"^\d+:\s+(?:[0-9A-F]{8}|[0-9A-F]{32}):[0-9A-F]{4}\s"))
    octets = lambda a, at: F.concat_ws(".", *[F.conv(F.substring(a, at + i, 2), 16, 10) for i in (6, 4, 2, 0)])  # noqa: E731  a word has its lowest byte first
    group = lambda a, w, half: F.lower(F.concat(F.substring(a, 8 * w + (7 if half == 0 else 3), 2), F.substring(a, 8 * w + (5 if half == 0 else 1), 2)))
    six = lambda a: F.concat_ws(":", *[group(a, w, half) for w in range(4) for half in (0, 1)])
    ip = lambda c: F.when(F.length(F.split(c, ":")[0]) == 8, octets(F.split(c, ":")[0], 1)).when(F.substring(c, 1, 24) == "0000000000000000FFFF0000", octets(c, 25)).otherwise(six(F.split(c, ":")[0]))
    port = lambda c: F.conv(F.split(c, ":")[1], 16, 10).cast("int")
    return rows.select("key", ip(f[1]).alias("local_ip"), port(f[1]).alias("local_port"), ip(f[2]).alias("remote_ip"), port(f[2]).alias("remote_port"), F.conv(f[3], 16, 10).cast("int").alias("state"), f[9].cast("bigint").alias("inode"))


def signature_archives(files: DataFrame) -> DataFrame:
    """(key, hash, size, name) of signature archives (key, content): a header of 512 bytes, then a compressed archive of lists hash:size:name."""
    import gzip
    import io
    import tarfile
    from collections.abc import Iterator

    import pandas as pd

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, content in zip(b["key"], b["content"], strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(gzip.decompress(bytes(content)[512:]))) as t:
                        for m in t:
                            if m.isfile() and m.name.rsplit(".", 1)[-1] in ("hdb", "hsb", "hdu", "hsu"):
                                for line in t.extractfile(m).read().decode("latin-1").splitlines():
                                    p = line.split(":")
                                    if len(p) >= 3:
                                        rows.append((key, p[0].lower(), int(p[1]) if p[1].isdigit() else None, p[2]))
                except (OSError, EOFError, tarfile.TarError, TypeError, ValueError):
                    pass
                yield pd.DataFrame(rows, columns=["key", "hash", "size", "name"]).astype({"size": "Int64"})

    return files.select("key", "content").mapInPandas(each, f"key {dict(files.dtypes)['key']}, hash string, size long, name string")


def with_processes(socks: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Sockets with the process (pid, comm) that holds their inode, if one does."""
    return socks.join(descriptors.groupBy("inode").agg(F.min(F.struct("pid", "comm")).alias("p")), "inode", "left").select(*socks.columns, "p.pid", "p.comm")


def indicators(values: DataFrame) -> DataFrame:
    """(value, kind) of an indicator list, one a line; defanged forms are mended, the first kind that fits counts."""
    v = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", r"\[\.\]|\(\.\)", "."), r"(?i)^hxxp", "http"), r"#.*$", ""))
    kind = (
        F.when(v.rlike("^[0-9a-fA-F]{64}$"), "sha256").when(X.valid_ipv4(v), "ip").when(v.rlike("^https?://"), "url").when(v.rlike(r"^(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"), "domain")
        .when(v.rlike("^[0-9a-fA-F]{32}$|^[0-9a-fA-F]{40}$"), "hash").when(v.contains("/"), "path").otherwise("string")
    )
    return values.select(v.alias("value"), kind.alias("kind")).where("value <> ''").distinct()


def override(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Later rows replace earlier ones with the same key and take the first one's place."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r"), F.min(order).alias("_place"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) if c != order else F.col("_place").alias(order) for c in rows.columns if c != key])
