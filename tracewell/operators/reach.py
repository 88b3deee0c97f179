"""Dependencies beyond their names: advisories, reachability by imports and symbols, hygiene, release gaps, products known to be exploited.

Joins are on keys derived from both sides (candidate names of a module, first characters of a contained name), never all with
all. Defined results: null names and modules meet nothing; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.text import normal_name
from tracewell.operators.supply import typosquats

# Limits of the hygiene checks, in days, downloads and dependents.
DORMANT, GAP, YOUNG, FEW_DOWNLOADS, FEW_REPOS, VERY_FEW_DOWNLOADS, VERY_FEW_REPOS = 730, 365, 180, 15_000, 500, 1_000, 50
LEVELS = ("absent", "tests only", "imported")


def advisories_of(deps: DataFrame, hits: DataFrame) -> DataFrame:
    """(key, ecosystem, name, version, advisory): dependencies (key, ecosystem, name, version) in an answer table (ecosystem, name, version, advisory)."""
    named = lambda df: df.withColumn("_n", normal_name(F.col("ecosystem"), F.col("name")))
    right = named(hits).select(F.col("ecosystem").alias("_e"), "_n", F.col("version").alias("_v"), "advisory").distinct()
    left = named(deps)
    met = left.join(right, (left["ecosystem"] == right["_e"]) & (left["_n"] == right["_n"]) & (left["version"] == right["_v"]))
    return met.select("key", "ecosystem", "name", "version", "advisory").distinct()


def package_candidates(ecosystem: Column, module: Column) -> Column:
    """Names of packages that an imported module may belong to."""
    parts = lambda sep: F.split(module, sep)
    prefixes = lambda ps, sep: F.transform(F.sequence(F.lit(1), F.size(ps)), lambda i: F.array_join(F.slice(ps, F.lit(1), i), sep))
    npm = F.array(F.when(module.startswith("@"), F.concat_ws("/", F.get(parts("/"), F.lit(0)), F.get(parts("/"), F.lit(1)))).otherwise(F.get(parts("/"), F.lit(0))))
    top = F.lower(F.get(parts(r"\."), F.lit(0)))
    return (
        F.when(ecosystem == "npm", npm).when(ecosystem == "PyPI", F.array(F.regexp_replace(top, "[-_.]+", "-")))
        .when(ecosystem == "Go", prefixes(parts("/"), "/")).when(ecosystem == "crates.io", F.array(F.replace(module, F.lit("_"), F.lit("-")), module))
        .when(ecosystem == "RubyGems", F.array(module, F.get(parts("/"), F.lit(0)), F.replace(module, F.lit("/"), F.lit("-")))).when(ecosystem == "Maven", prefixes(parts(r"\."), "."))
        .otherwise(F.array(module))
    )


def reachability(deps: DataFrame, imports: DataFrame) -> DataFrame:
    """(ecosystem, name, level, files): how far each dependency is reached by imports (path, module): the greatest level over the files.

    A module names candidate packages per ecosystem, so the join is on names. Packages of Maven are known by their group.
    """
    ecos = deps.select("ecosystem").where("ecosystem IS NOT NULL").distinct()
    mods = imports.where("module IS NOT NULL").select("path", "module").distinct()
    tests = F.col("path").rlike(r"(?i)(?:^|/)(?:tests?|specs?|__tests__|testdata)/|(?:_test|\.spec|\.test)\.\w+$|(?:^|/)test_")
    # As many copies of a module as there are ecosystems in use: at most a dozen.
    each = mods.join(F.broadcast(ecos)).select("ecosystem", "path", F.when(tests, 1).otherwise(2).alias("level"), F.explode(package_candidates(F.col("ecosystem"), F.col("module"))).alias("_c"))
    reached = each.groupBy("ecosystem", "_c").agg(F.max("level").alias("level"), F.countDistinct("path").alias("files"))
    name = F.when(F.col("ecosystem") == "Maven", F.substring_index("name", ":", 1)).when(F.col("ecosystem") == "PyPI", normal_name(F.col("ecosystem"), F.col("name"))).otherwise(F.col("name"))
    own = deps.select("ecosystem", "name", name.alias("_c")).where("name IS NOT NULL").distinct()
    met = own.join(reached, ["ecosystem", "_c"], "left")
    return met.select("ecosystem", "name", F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce("level", F.lit(0)) + 1).alias("level"), F.coalesce("files", F.lit(0)).alias("files"))


def symbols_used(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(advisory, symbol, files): symbols (advisory, symbol) that stand as identifiers in texts (path, text); an equi-join on the last part of the symbol."""
    words = files.where("text IS NOT NULL").select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("_w"))
    wanted = symbols.where("symbol IS NOT NULL").select("advisory", "symbol", F.regexp_extract("symbol", r"([A-Za-z_$][\w$]*)\W*$", 1).alias("_w")).distinct()
    return wanted.join(words, "_w").groupBy("advisory", "symbol").agg(F.countDistinct("path").alias("files"))


def vulnerability_severity(advisory: Column, level: Column, has_symbols: Column, symbol_hit: Column) -> Column:
    """critical for malicious packages and used symbols, medium for what is not imported or whose symbols are not used, else high."""
    return F.when(advisory.startswith("MAL-") | F.coalesce(symbol_hit, F.lit(False)), "critical").when((level == "absent") | F.coalesce(has_symbols, F.lit(False)), "medium").otherwise("high")


def internal_name(name: Column) -> Column:
    """A package name that looks like a company's own: a word for it in its parts, or a scope that says so."""
    return F.lower(name).rlike(r"(?:^|[-_.@/])(?:internal|private|corp|intranet|inhouse|proprietary)(?:$|[-_./])")


def dependency_hygiene(deps: DataFrame, registry: DataFrame, day: Column, popular: DataFrame | None = None) -> DataFrame:
    """(ecosystem, name, id, severity) of dependencies against what registries told (ecosystem, name, found, created, released, archived, downloads, repos)."""
    d = deps.select("ecosystem", F.col("name")).where("name IS NOT NULL").distinct()
    r = registry.groupBy("ecosystem", "name").agg(*[F.max(c).alias(c) for c in ("found", "created", "released", "archived", "downloads", "repos")])
    j = d.join(r, ["ecosystem", "name"], "left")
    age = lambda c: F.datediff(day, F.col(c).cast("date"))
    unknown = F.col("found") == F.lit(False)
    checks = [
        ("DEP-001", "medium", unknown & ~internal_name(F.col("name"))), ("DEP-002", "high", internal_name(F.col("name")) & (F.col("found") == F.lit(True))),
        ("DEP-010", "low", age("released") > DORMANT), ("DEP-011", "medium", F.col("archived") == F.lit(True)),
        ("DEP-031", "medium", (age("created") < YOUNG) & (F.col("downloads") < VERY_FEW_DOWNLOADS) & (F.col("repos") < VERY_FEW_REPOS)),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"))) for i, s, c in checks]), lambda x: x.isNotNull())
    out = j.select("ecosystem", "name", F.explode(found).alias("_x")).select("ecosystem", "name", "_x.id", "_x.severity")
    if popular is not None:
        near = typosquats(d.select("name"), popular).select(F.col("name").alias("_n"))
        close = j.join(near, F.lower("name") == F.col("_n"))
        few = (F.col("downloads") < FEW_DOWNLOADS) | (F.col("repos") < FEW_REPOS)
        out = out.unionByName(close.select("ecosystem", "name", F.when(few, "DEP-030").otherwise("DEP-020").alias("id"), F.when(few, "high").otherwise("medium").alias("severity")))
    return out.distinct()


def release_gaps(releases: DataFrame) -> DataFrame:
    """(ecosystem, name, version, gap_days): days between the two latest releases (ecosystem, name, version, published) of a package that has two."""
    w = Window.partitionBy("ecosystem", "name").orderBy(F.desc("published"), F.desc("version"))
    steps = releases.where("published IS NOT NULL").select("ecosystem", "name", "version", "published").distinct().withColumns({"_r": F.row_number().over(w), "_p": F.lead("published").over(w)})
    return steps.where("_r = 1 AND _p IS NOT NULL").select("ecosystem", "name", "version", F.datediff(F.col("published").cast("date"), F.col("_p").cast("date")).alias("gap_days"))


def exploited_products(deps: DataFrame, kev: DataFrame, least: int = 4) -> DataFrame:
    """(name, cve): dependencies whose name, letters and digits in lower case, equals, holds or lies in a product's (cve, product), of at least ``least`` characters.

    What is contained begins with ``least`` characters that stand in the other: the join is on those.
    """
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    a = deps.where("name IS NOT NULL").select("name", flat(F.col("name")).alias("x")).where(F.length("x") >= least).distinct()
    b = kev.where("product IS NOT NULL").select("cve", flat(F.col("product")).alias("y")).where(F.length("y") >= least).distinct()
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substring(F.col(c), i, F.lit(least)))))
    inside = a.withColumn("_g", F.left("x", F.lit(least))).join(b.withColumn("_g", grams("y")), "_g").where(F.contains("y", "x"))
    around = a.withColumn("_g", grams("x")).join(b.withColumn("_g", F.left("y", F.lit(least))), "_g").where(F.contains("x", "y"))
    return inside.select("name", "cve").union(around.select("name", "cve")).distinct()


def advisory_listing(advisories: DataFrame) -> DataFrame:
    """Advisories by product and id."""
    return advisories.orderBy(F.lower("product"), "id")


def cve_findings(installs: DataFrame, hits: DataFrame, probes: DataFrame, changelogs: DataFrame) -> DataFrame:
    """(key, advisory, status, severity): one row for each install (key, product, version, scope) and advisory that its version hits.

    ``hits`` (key, advisory, severity, aliases, scope, needs ARRAY). A changelog (key, text) of the package that names the id or an alias
    as a whole token tells a backport. ``probes`` (key, need, answer 'yes', 'no' or 'unknown'): all no is not configured, any yes
    reached, else unknown; an advisory for the web does not touch an install for the command line.
    """
    tokens = changelogs.where("text IS NOT NULL").select("key", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(r"[A-Z0-9][A-Z0-9\-]*[A-Z0-9]"), F.lit(0)))).alias("_t"))
    names = hits.select("key", "advisory", F.explode(F.array_distinct(F.concat(F.array("advisory"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("_a")).withColumn("_t", F.upper("_a"))
    mended = names.join(tokens, ["key", "_t"]).select("key", "advisory").distinct().withColumn("_m", F.lit(True))
    asked = hits.select("key", "advisory", F.explode("needs").alias("need")).join(probes, ["key", "need"], "left")
    told = asked.groupBy("key", "advisory").agg(F.max(F.col("answer") == "yes").alias("_y"), F.min(F.coalesce(F.col("answer") == "no", F.lit(False))).alias("_n"))
    j = hits.alias("h").join(installs.select("key", F.col("scope").alias("_own")), "key").join(mended, ["key", "advisory"], "left").join(told, ["key", "advisory"], "left")
    status = (
        F.when(F.coalesce("_m", F.lit(False)), "backported").when((F.col("scope") == "web") & (F.col("_own") == "cli"), "not for this use").when(F.coalesce("_y", F.lit(False)), "reached")
        .when(F.coalesce("_n", F.lit(False)), "not configured").when(F.size("needs") > 0, "unknown").otherwise("affected")
    )
    return j.select("key", "advisory", status.alias("status"), F.when(status.isin("backported", "not for this use", "not configured"), "info").otherwise(F.col("severity")).alias("severity"))


def in_cve_order(findings: DataFrame) -> DataFrame:
    """Severity downwards, then install and advisory."""
    rank = F.array_position(F.array(*map(F.lit, ("info", "low", "medium", "high", "critical"))), F.col("severity"))
    return findings.orderBy(rank.desc(), "key", "advisory")


def runs_in_window(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Workflow runs (repo, run_id, ts) within the days of a finding's window (repo, rule_id, start, end): RUNCHECK-001, keyed by repository and day."""
    days = findings.select("repo", "rule_id", "start", "end", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("_d"))
    return runs.withColumn("_d", F.to_date("ts")).join(days, ["repo", "_d"]).where(F.col("ts").between(F.col("start"), F.col("end"))).select("repo", "run_id", "rule_id", F.lit("RUNCHECK-001").alias("id"))
