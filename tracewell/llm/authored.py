"""Generated, minified, bundled and vendored files, lock files and data stored as code.

Three kinds of evidence, each over all rows:
- the path: directories and names that build tools, package managers and generators use,
- the text: headers that say so, and the layout (line lengths, share of literals),
- Merkle hashes, bottom-up over each root's directory tree: a directory is hashed from the names and
  hashes of what it holds, a file from its name and text (line ends and trailing blanks mean nothing). A subtree that
  unrelated roots share is a third-party copy, whatever its directories are called; this evidence comes first.

A finding is judged by the file with its target and path, or, when there is none, by its path alone.

Everything is built-in expressions; the tree is folded level by level, as many steps as the deepest
path has directories. Shared subtrees are counted by hash with partial aggregation.

Defined results: null and empty texts are judged by their path; a null path by the text; rows delivered twice count
once; file and directory names are compared with '/' for separators and without a leading './'; a directory that merely
has a similar name (``vendors``, ``generator``) is no evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut

# Directories that hold third-party copies, generated code or build output.
VENDOR_DIRS = (
    "node_modules bower_components vendor third_party third-party thirdparty external extern externals deps Pods Carthage "
    "site-packages dist-packages .venv venv virtualenv .tox .yarn .pnpm jspm_packages .bundle .cargo Godeps _vendor"
).split()
OUTPUT_DIRS = "generated __generated__ gen Gen autogen _build dist .next .nuxt .output .gradle __pycache__ .parcel-cache .svelte-kit .angular coverage .dart_tool".split()
# Output directories only in this company.
OUTPUT_PAIRS = ("target/classes", "target/generated-sources", "target/debug", "target/release", "build/lib", "build/generated", "out/production", "static/chunks", "bin/Debug", "bin/Release", "obj/Debug", "obj/Release")
LOCK_FILES = (
    "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml bun.lockb bun.lock composer.lock Gemfile.lock Cargo.lock poetry.lock uv.lock pdm.lock "
    "Pipfile.lock go.sum go.work.sum mix.lock pubspec.lock Podfile.lock packages.lock.json flake.lock Package.resolved gradle.lockfile conan.lock deno.lock"
).split()

_esc = lambda xs: "|".join(x.replace(".", r"\.") for x in xs)
DIRS_RE = rf"(?:^|/)(?:{_esc(VENDOR_DIRS)}|{_esc(OUTPUT_DIRS)}|(?i:vendor|third[_-]party|node_modules))/"
PAIRS_RE = rf"(?:^|/)(?:{_esc(OUTPUT_PAIRS)})/"
LOCK_RE = rf"(?:^|/)(?:{_esc(LOCK_FILES)})$"
NAME_RE = (
    r"(?:^|/)(?:"
    r"[^/]+[.\-]min\.(?:js|css|mjs|cjs|html|svg|json)|[^/]+[.\-](?:bundle|chunk|packed|prod)\.(?:js|css|mjs|cjs)|[^/]+\.(?:js|css|mjs)\.map"
    r"|[^/]+\.(?:pb|pb2|pbobjc|grpc)\.(?:go|cc|h|c|py|rb|m|swift|dart|js|ts)|[^/]+_pb2(?:_grpc)?\.pyi?|[^/]+_pb(?:\.d)?\.(?:js|ts|rb)|[^/]+Pb\.java|[^/]+(?:OuterClass|Grpc)\.java"
    r"|[^/]+\.(?:generated|gen|g|designer|Designer|g\.i)\.[A-Za-z]+|[^/]+\.g\.dart|[^/]+\.freezed\.dart|[^/]+_generated\.[A-Za-z]+|zz_generated[^/]*\.[A-Za-z]+|[^/]+_(?:bindata|string|easyjson)\.go|bindata\.go|[^/]+_gen\.go"
    r"|moc_[^/]+\.(?:cpp|cc|h)|ui_[^/]+\.h|qrc_[^/]+\.cpp|[^/]+\.tab\.(?:c|h|cc|cpp|hpp)|lex\.yy\.c|[^/]+\.yy\.(?:c|cc)"
    r"|[A-Za-z][^/]*-\d+\.\d+\.\d+(?:[.\-][^/]*)?\.(?:js|mjs|cjs|css)|[^/]+[.\-][0-9a-f]{8,20}\.(?:js|mjs|cjs|css)|[0-9a-f]{8,40}\.(?:js|mjs|css)"
    r")$"
)
_S = r"(?:[^\n]*\n){0,12}?"
#: A header line: at the head of the file, within a comment (or before any code).
_C = r"(?m)^[ \t]*(?://|#|/?\*+!?|/\*!?|--|;+|<!--|%+|\"\"\"|'''|rem\b)[ \t]*"
HEADERS = [
    _C + r"[^\n]*(?i:\bcode generated by\b[^\n]*do not edit)",
    _C + r"(?i:@generated\b|<auto-?generated\b)",
    _C + r"(?i:auto-?generated\b[^\n]*(?:file|by|with|from|edit|modify))",
    _C + r"(?i:(?:this (?:file|code|class|module) (?:was|is|has been) )?(?:automatically |auto-?|machine[- ])generated (?:by|from|with|file|code))",
    _C + r"(?i:generated (?:by|from|with|using) [^\n]*\b(?:compiler|generator|tool|schema|protoc|edit)\b)",
    _C + r"(?i:generated from [^\n]+\.(?:proto|thrift|avdl|graphql|xsd|idl|fbs|y|l|g4|tmpl|json|yaml)\b)",
    _C + r"(?i:do not (?:edit|modify)(?: by hand| manually)?\s*[:.;-]?[^\n]*(?:output of|generated|produced|emitted|by hand))",
    _C + r"(?i:machine-readable table, regenerate with|regenerate (?:this file )?with\b)",
    _C + r"[^\n]*(?i:(?:wurde|wird) von [^\n]* (?:erzeugt|generiert)|automatisch (?:erzeugt|generiert)|nicht von hand (?:geändert|bearbeite))",
    _C + r"[^\n]*(?i:(?:fichier|code) (?:produit|généré)|ne pas (?:modifier|éditer))",
    _C + r"[^\n]*(?i:(?:archivo|código) generado|no editar a mano)",
    _C + r"(?i:third-party code\b|vendored (?:from|copy)|bundled copy of|bundled from|origin: upstream|copied (?:verbatim|unchanged) from)",
    _C + r"[^\n]*(?i:imported unchanged from|kept verbatim|local changes are not accepted|unmodified copy of)",
    _C + r"[^\n|]+\d+\.\d+\.\d+ \| \(c\) [^\n|]+ \| https?://",
    r"(?m)^/\*{3,}/ \(\(\) =>|__webpack_require__|webpackBootstrap|^/\*{3,}/ (?:function|export|return|const|if|for|await)|System\.register\(\[|parcelRequire",
    r"(?m)^[ \t]*(?://|/\*)[#@] sourceMappingURL=",
]
#: Any header rule: one pass tells the same as one after the other.
ANY_HEADER = _C + "(?:" + "|".join(h[len(_C) :] for h in HEADERS[:-2]) + ")"
#: Text that a shared subtree must have at least: less is a marker or a stub that many write alike.
LEAST_CHARS = 200
#: A header stands in the first lines or, however long that is, among the remarks before any code.
HEAD_LINES = 12
#: Remarks, open ones too, and what may stand before or among them without being code.
_REMARKS = (
    r"(?sm)/\*.*?(?:\*/|\z)|<!--.*?(?:-->|\z)|\"\"\".*?(?:\"\"\"|\z)|'''.*?(?:'''|\z)|^[ \t]*(?://|#|--|;|%|(?i:rem\b))[^\n]*"
    r"|<\?(?i:php\b|xml\b[^>]*>)|<!(?i:doctype\b)[^>]*>|^[ \t]*[\"']use strict[\"'];?|\uFEFF"
)


def plain_path(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./+)+", "")


def path_evidence(path: Column) -> Column:
    """'lock', 'vendored or output directory' or 'name', else null."""
    return (
        F.when(path.rlike(LOCK_RE), F.lit("lock file"))
        .when(path.rlike(DIRS_RE) | path.rlike(PAIRS_RE), F.lit("directory"))
        .when(path.rlike(NAME_RE), F.lit("name"))
    )


def text_evidence(text: Column) -> Column:
    """Evidence of the text itself: header, bundle, minified layout or data; null for hand-written code."""
    head = F.substring_index(text, "\n", HEAD_LINES)
    tail = F.substring_index(text, "\n", -3)
    only_remarks = lambda c: F.regexp_replace(F.regexp_replace(c, _REMARKS, ""), r"\s+", "") == ""
    header = head.rlike(ANY_HEADER) | F.when(text.rlike(ANY_HEADER), only_remarks(F.element_at(F.split(text, ANY_HEADER, 2), 1))).otherwise(False)
    # A source map is named in the last lines, or with nothing but remarks behind it.
    after_map = F.split(text, HEADERS[-1] + r"[^\n]*")
    mapped = tail.rlike(HEADERS[-1]) | F.when(text.contains("sourceMappingURL="), (F.size(after_map) > 1) & only_remarks(F.element_at(after_map, -1))).otherwise(False)
    bundle = text.rlike(HEADERS[-2]) | mapped
    n = F.length(text)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    longest = F.array_max(F.transform(lines, lambda x: F.length(x)))
    # Minified: most of the text lies in very long lines that are dense in punctuation and poor in blanks.
    long_chars = F.aggregate(lines, F.lit(0), lambda a, x: a + F.when(F.length(x) >= 400, F.length(x)).otherwise(0))
    blanks = n - F.length(F.regexp_replace(text, r"[ \t]", ""))
    punct = n - F.length(F.regexp_replace(text, r"[(){}\[\];,=:.&|?!<>+\-*/]", ""))
    minified = (longest >= 400) & (long_chars >= 0.5 * n) & (blanks <= 0.10 * n) & (punct >= 0.12 * n)
    # Data: most of the text is literals: long runs of an encoding alphabet, or numbers.
    encoded = n - F.length(F.regexp_replace(text, r"[A-Za-z0-9+/=_\-]{40,}", ""))
    numbers = n - F.length(F.regexp_replace(text, r"(?<![\w.])(?:0[xX][0-9A-Fa-f]+|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)[LlUuFf]*\s*[,;\]\s]\s*|(?:\\x[0-9A-Fa-f]{2})+", ""))
    data = (n >= 200) & ((encoded >= 0.6 * n) | (numbers >= 0.6 * n))
    return F.when(header, F.lit("header")).when(bundle, F.lit("bundle")).when(minified, F.lit("minified")).when(data, F.lit("data"))


def judged_rows(files: DataFrame) -> DataFrame:
    """(file_id, root, path, own, hash, chars) of each file, the row indexed last: what its own path and text tell, and its text's hash.

    Every delivered text is read where it lies; only these few columns are shuffled to settle what was delivered twice.
    """
    path = plain_path(F.col("path"))
    plain = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), r"[ \t]+(?=\n)|\s+\z", "")
    own = F.coalesce(path_evidence(path), text_evidence(F.col("text")))
    at = F.col("indexed_at") if "indexed_at" in files.columns else F.lit(0)
    rows = files.where(F.col("file_id").isNotNull()).select("file_id", at.alias("at"), F.struct("root", path.alias("path"), own.alias("own"), F.md5(plain).alias("hash"), F.length("text").cast("bigint").alias("chars")).alias("v"))
    return rows.groupBy("file_id").agg(F.max_by("v", F.struct("at", "v")).alias("v")).select("file_id", "v.*")


def subtree_hashes(rows: DataFrame) -> DataFrame:
    """(root, owner, path, hash, chars, n): the Merkle hash of every file and directory of each root, from the bottom up.

    A file hashes its text, a directory the names and hashes of what it holds. A file without a text makes its directories unlike any
    other. A directory's hash folds its children's with two exclusive ors, a sum and a count, so a directory of any size is
    aggregated before the shuffle and never collected.
    """
    owner = F.lower(F.element_at(F.split(F.coalesce("root", F.lit("")), "/"), 1))
    leaves = cut(
        rows.where(F.col("path").isNotNull()).groupBy(F.coalesce("root", F.lit("")).alias("root"), owner.alias("owner"), F.split("path", "/").alias("seg"))
        .agg(F.min(F.coalesce("hash", F.concat(F.lit("?"), F.col("file_id").cast("string")))).alias("hash"), F.max("chars").alias("chars")).select("*", F.lit(1).cast("bigint").alias("n")),
        "leaves",
    )
    depth = leaves.agg(F.max(F.size("seg"))).first()[0] or 1
    name, child = F.element_at("seg", -1), F.col("hash")
    named = lambda df: df.select("root", "owner", F.array_join("seg", "/").alias("path"), F.md5(F.concat_ws("/", name, child)).alias("hash"), "chars", "n")  # noqa: E731  a file's node has its name
    made, nodes = None, named(leaves)
    for level in range(depth, 1, -1):
        here = leaves.where(F.size("seg") == level)
        here = here if made is None else here.unionByName(made)
        folded = here.groupBy("root", "owner", F.slice("seg", 1, level - 1).alias("seg")).agg(
            F.bit_xor(F.xxhash64(name, child)).alias("x"), F.bit_xor(F.xxhash64(child, F.lit(1), name)).alias("y"),
            F.sum(F.shiftright(F.xxhash64(child, F.lit(2), name), 20)).alias("z"), F.count(F.lit(1)).alias("k"), F.sum("chars").alias("chars"), F.sum("n").alias("n"),
        )
        made = cut(folded.select("root", "owner", "seg", F.md5(F.concat_ws(",", "x", "y", "z", "k")).alias("hash"), "chars", "n"), "subtrees")
        nodes = nodes.unionByName(made.select("root", "owner", F.array_join("seg", "/").alias("path"), "hash", "chars", "n"))
    return nodes


def shared_subtrees(rows: DataFrame, least_files: int = 1, least_roots: int = 2, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(root, path, files, owners): files and directories whose Merkle hash also stands in unrelated roots.

    A subtree of one file has its name as well as its text in common with the other. Related roots (the same owner before the
    first '/') count as one. Subtrees of less text than ``least_chars`` (markers, empty files) say nothing.
    """
    big = subtree_hashes(rows).where((F.col("n") >= least_files) & (F.col("chars") >= least_chars))
    spread = big.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners")).where(F.col("owners") >= least_roots)
    return big.join(spread, "hash").groupBy("root", "path").agg(F.max("n").alias("files"), F.max("owners").alias("owners"))


def judged_files(files: DataFrame) -> DataFrame:
    """(file_id, root, path, evidence, own) of every file; evidence is null for hand-written ones.

    Evidence is a subtree shared by unrelated roots first, else what the file's own path and text tell, which ``own`` keeps.
    """
    rows = cut(judged_rows(files), "judged")
    shared = shared_subtrees(rows).select("root", F.col("path").alias("up"))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size("seg"), F.lit(1))), lambda i: F.array_join(F.slice("seg", F.lit(1), i), "/"))
    up = rows.where("path IS NOT NULL").select("file_id", F.coalesce("root", F.lit("")).alias("root"), F.split("path", "/").alias("seg")).select("file_id", "root", F.explode(above).alias("up"))
    copied = up.join(shared, ["root", "up"], "left_semi").select("file_id").distinct().withColumn("copied", F.lit("shared subtree"))
    return rows.join(copied, "file_id", "left").select("file_id", "root", "path", F.coalesce("copied", "own").alias("evidence"), "own")


def find_not_authored(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(tab, rec_id, evidence) of the files and findings that are not hand-written source."""
    judged = cut(judged_files(files).drop("own"), "evidence")
    f = judged.where(F.col("evidence").isNotNull()).select(F.lit("files").alias("tab"), F.col("file_id").alias("rec_id"), "evidence")
    # Several files may name one (root, path): one that counts decides.
    by_name = judged.where(F.col("root").isNotNull() & F.col("path").isNotNull()).groupBy("root", "path").agg(F.max("evidence").alias("by_file"), F.lit(1).alias("known"))
    rows = findings.where(F.col("finding_id").isNotNull()).select("finding_id", F.col("target").alias("root"), plain_path(F.col("path")).alias("path")).dropDuplicates(["finding_id"])
    g = (
        rows.join(by_name, ["root", "path"], "left")
        .select("finding_id", F.when(F.col("known").isNotNull(), F.col("by_file")).otherwise(path_evidence(F.col("path"))).alias("evidence"))
        .where(F.col("evidence").isNotNull()).select(F.lit("findings").alias("tab"), F.col("finding_id").alias("rec_id"), "evidence")
    )
    return f.unionByName(g)
