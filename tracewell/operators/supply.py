"""Versions and advisories, dependency deltas and hygiene, look-alike names, inventories.

Version ranges join on the product with the range as a residual condition; names meet by deletion keys or trigram-free
blocking, never all with all. Defined results: a version that does not parse is in no range; an empty range affects nothing; null
names are dropped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.codecs import osa_distance
from tracewell.functions.text import version_key

_LOWEST, _HIGHEST = "0", "999999999999"


def ranges(advisories: DataFrame) -> DataFrame:
    """(advisory, product, lo, lo_open, hi, hi_open): one row for each alternative of an advisory's ``affected`` list.

    A range is constraints joined by blanks or commas ('>=1.2 <1.4', '=2.0'). One that does not parse makes its range void.
    """
    each = advisories.select("id", "product", F.explode("affected").alias("r"))
    parts = F.filter(F.split(F.regexp_replace(F.trim("r"), r"(>=|<=|==|=|>|<)\s+", "$1"), r"[\s,]+"), lambda x: x != "")
    ok = (F.size(parts) > 0) & F.forall(parts, lambda x: x.rlike(r"^(?:>=|<=|==|=|>|<)?[vV]?[0-9]+(?:\.[0-9]+)*$"))
    bound = lambda ops, agg: agg(F.transform(F.filter(parts, lambda x: x.rlike(rf"^(?:{ops})")), lambda x: F.struct(version_key(F.regexp_replace(x, r"^[><=]+", "")).alias("v"), x.rlike(r"^[><](?!=)").alias("open"))))
    lo = bound(r">=|>|==|=|[vV0-9]", F.array_max)
    hi = bound(r"<=|<|==|=|[vV0-9]", F.array_min)
    return each.where(ok).select(
        F.col("id").alias("advisory"), F.lower("product").alias("product"),
        F.coalesce(lo["v"], version_key(F.lit(_LOWEST))).alias("lo"), F.coalesce(lo["open"], F.lit(False)).alias("lo_open"),
        F.coalesce(hi["v"], version_key(F.lit(_HIGHEST))).alias("hi"), F.coalesce(hi["open"], F.lit(False)).alias("hi_open"),
    )


def affected(installs: DataFrame, advisories: DataFrame) -> DataFrame:
    """(key, product, version, advisory): installs (key, product, version) in some range of an advisory."""
    v = installs.where(F.col("product").isNotNull()).select("key", F.lower("product").alias("product"), "version", version_key(F.col("version")).alias("v")).where("v IS NOT NULL")
    inside = F.when(F.col("lo_open"), F.col("v") > F.col("lo")).otherwise(F.col("v") >= F.col("lo")) & F.when(F.col("hi_open"), F.col("v") < F.col("hi")).otherwise(F.col("v") <= F.col("hi"))
    return v.join(ranges(advisories), "product").where(inside).select("key", "product", "version", "advisory").distinct()


def dep_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old, new, change) of two dependency sets (keys, version): a full outer join on the whole name."""
    one = lambda df, c: df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("version")), ",").alias(c))  # noqa: E731  versions of one name in one tree
    both = one(before, "old").join(one(after, "new"), keys, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL")


def deletion_keys(name: Column, most: int = 1) -> Column:
    """The name and the name less up to ``most`` characters: names within so many edits or swaps share a key."""
    less = lambda x: F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))).otherwise(F.array().cast("array<string>"))
    keys = F.array(name)
    for _ in range(most):
        keys = F.array_distinct(F.concat(keys, F.flatten(F.transform(keys, less))))
    return keys


def typosquats(names: DataFrame, popular: DataFrame, most: int = 1) -> DataFrame:
    """(name, nearest, distance): names within ``most`` edits or swaps of a popular one that are not popular themselves.

    ``popular`` (name, pos): the nearest wins, ties by position. Candidates share a deletion key, so no name meets all.
    """
    own = names.select(F.lower("name").alias("name")).where("name IS NOT NULL").distinct().join(popular.select(F.lower("name").alias("name")), "name", "left_anti")
    a = own.select("name", F.explode(deletion_keys(F.col("name"), most)).alias("k"))
    b = popular.select(F.lower("name").alias("nearest"), "pos").select("nearest", "pos", F.explode(deletion_keys(F.col("nearest"), most)).alias("k"))
    pairs = a.join(b, "k").select("name", "nearest", "pos").distinct().withColumn("distance", osa_distance(F.col("name"), F.col("nearest"), most)).where(F.col("distance").between(1, most))
    best = pairs.groupBy("name").agg(F.min_by(F.struct("nearest", "distance"), F.struct("distance", "pos")).alias("v"))
    return best.select("name", "v.nearest", "v.distance")


# Characters that look alike, for the generator of look-alike names.
CONFUSABLE = {"l": "1i", "i": "1l", "o": "0", "0": "o", "1": "l", "e": "3", "a": "4", "s": "5", "m": "rn", "w": "vv"}
SUFFIXES = ("com", "net", "org", "io", "co", "app", "dev")


def lookalikes(names: DataFrame, most: int = 400) -> DataFrame:
    """(name, candidate, how): omissions, repetitions, swaps, hyphens and other suffixes of domain names, at most ``most`` a name."""
    n = names.select(F.lower("name").alias("name")).distinct().select("name", F.substring_index("name", ".", 1).alias("s"), F.expr("substring(name, length(substring_index(name, '.', 1)) + 1)").alias("rest"))
    i = F.sequence(F.lit(1), F.length("s"))
    cut = lambda a, b: F.substring(F.col("s"), a, b)

    def swapped(old: str, new: str) -> Column:
        at = F.filter(i, lambda k: cut(k, F.lit(1)) == old)
        return F.transform(at, lambda k: F.concat(cut(F.lit(1), k - 1), F.lit(new), cut(k + 1, F.length("s"))))

    made = {
        "omission": F.transform(i, lambda k: F.concat(cut(F.lit(1), k - 1), cut(k + 1, F.length("s")))),
        "repetition": F.transform(i, lambda k: F.concat(cut(F.lit(1), k), cut(k, F.length("s")))),
        "transposition": F.when(F.length("s") > 1, F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda k: F.concat(cut(F.lit(1), k - 1), cut(k + 1, F.lit(1)), cut(k, F.lit(1)), cut(k + 2, F.length("s"))))),
        "hyphen": F.when(F.length("s") > 1, F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda k: F.concat(cut(F.lit(1), k), F.lit("-"), cut(k + 1, F.length("s"))))),
        "confusable": F.flatten(F.array(*[swapped(c, r) for c, rs in CONFUSABLE.items() for r in ([rs] if c in "mw" else rs)])),
    }
    rows = None
    for how, xs in made.items():
        part = n.select("name", "s", "rest", F.explode(F.filter(F.array_distinct(xs), lambda x: (x != F.col("s")) & (x != ""))).alias("x")).select("name", F.concat("x", "rest").alias("candidate"), F.lit(how).alias("how"))
        rows = part if rows is None else rows.unionByName(part)
    tld = n.select("name", F.explode(F.array(*[F.concat(F.col("s"), F.lit("." + t)) for t in SUFFIXES])).alias("candidate"), F.lit("suffix").alias("how")).where("candidate <> name")
    once = rows.unionByName(tld).groupBy("name", "candidate").agg(F.min("how").alias("how"))
    w = Window.partitionBy("name").orderBy("how", "candidate")
    return once.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select("name", "candidate", "how")


def enrich(findings: DataFrame, aliases: DataFrame, kev: DataFrame, epss: DataFrame) -> DataFrame:
    """Findings with whether some alias of their advisory is known to be exploited, and the best exploit score of its aliases."""
    al = aliases.select("advisory", F.explode("aliases").alias("cve")).unionByName(aliases.select("advisory", F.col("advisory").alias("cve"))).distinct()
    scored = al.join(kev.select("cve").distinct().withColumn("k", F.lit(True)), "cve", "left").join(epss, "cve", "left")
    best = scored.groupBy("advisory").agg(F.coalesce(F.max("k"), F.lit(False)).alias("exploited"), F.max_by(F.struct("score", "percentile"), "score").alias("e"))
    return findings.join(best.select("advisory", "exploited", "e.score", "e.percentile"), "advisory", "left")


# The ladder of licence texts; the first that stands in the head of a text wins.
LICENSES = (
    ("AGPL-3.0", "affero general public license"), ("LGPL", "lesser general public license"), ("GPL-3.0", "general public license version 3"), ("GPL-2.0", "general public license version 2"),
    ("MPL-2.0", "mozilla public license"), ("MPL-2.0", "mpl-2.0"), ("Apache-2.0", "apache license"), ("Apache-2.0", "apache-2.0"), ("BSD", "redistribution and use in source and binary forms"),
    ("MIT", "permission is hereby granted, free of charge"), ("MIT", "identifier: mit"), ("ISC", "isc license"), ("Unlicense", "unlicense"), ("CC0-1.0", "cc0"),
)


def license_of(text: Column) -> Column:
    head = F.lower(F.left(text, F.lit(8192)))
    out = F.lit(None).cast("string")
    for name, words in reversed(LICENSES):
        out = F.when(F.contains(head, F.lit(words)), name).otherwise(out)
    return out


def copyleft(license: Column) -> Column:
    return license.rlike("(?i)agpl|lgpl|gpl|mpl|epl|eupl|cddl|osl|cc-by-sa")


def sbom(deps: DataFrame) -> DataFrame:
    """Distinct packages per ecosystem and in all ('*')."""
    d = deps.select("ecosystem", "name", "version").distinct()
    both = d.select(F.explode(F.array("ecosystem", F.lit("*"))).alias("ecosystem"), "name", "version")
    return both.groupBy("ecosystem").agg(F.count(F.lit(1)).alias("packages"), F.countDistinct("name").alias("names"))


IMPORTS = {
    "py": r"(?m)^\s*(?:from\s+([A-Za-z_][\w]*)|import\s+([A-Za-z_][\w]*))", "js": r"""(?:require\(\s*|from\s+)["'](@?[A-Za-z0-9_][\w./-]*)["']""",
    "go": r"""(?m)^\s*(?:import\s+)?"([\w.-]+\.[\w./-]+)\"""", "rb": r"""(?m)^\s*require\s+["']([\w/-]+)["']""", "rs": r"(?m)^\s*use\s+([a-z_][\w]*)::", "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+);",
}


def imports(files: DataFrame) -> DataFrame:
    """(key, module): modules that a source file imports, by the language of its extension."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    lang = F.when(ext.isin("js", "ts", "jsx", "tsx", "mjs", "cjs"), "js").otherwise(ext)
    pick = F.lit(None).cast("array<string>")
    for k, rx in IMPORTS.items():
        groups = re.compile(rx).groups
        got = F.regexp_extract_all("text", F.lit(rx), F.lit(1))
        if groups > 1:
            got = F.concat(got, F.regexp_extract_all("text", F.lit(rx), F.lit(2)))
        pick = F.when(lang == k, got).otherwise(pick)
    return files.select("key", F.explode(F.array_distinct(F.filter(pick, lambda x: x != ""))).alias("module"))
