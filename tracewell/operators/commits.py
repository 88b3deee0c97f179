"""Commits: their records and changed lines, authors, secrets in history, sequences that tell how a repository was made.

Thresholds are fixed values under their names. Windows are per repository and ordered by time; lists of a repository are never
collected. Defined results: records that do not parse are left out; empty tables give no rows; ties are broken by sha.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.operators.events import burst, rotation

US = "\x1f"
# Verbs that bare subjects of a self-review loop begin with.
LOOP_VERBS = "fix address apply update refine improve clean tidy adjust correct polish simplify handle remove".split()


def commit_records(log: DataFrame) -> DataFrame:
    """(repo, sha, name, email, ts, committer, subject, body) from rows (repo, value) of fields separated by U+001F: sha, name, email, seconds, committer, message."""
    f = F.split("value", US)
    rows = log.where(F.size(f) >= 6).select("repo", f[0].alias("sha"), f[1].alias("name"), F.lower(f[2]).alias("email"), F.expr(f"try_cast(split(value, '{US}')[3] as bigint)").alias("ts"), f[4].alias("committer"), F.element_at(f, 6).alias("_m"))
    subject = F.trim(F.substring_index("_m", "\n", 1))
    return rows.where("sha <> '' AND ts IS NOT NULL").select("repo", "sha", "name", "email", "ts", "committer", subject.alias("subject"), F.regexp_replace(F.expr("substring(_m, length(substring_index(_m, '\n', 1)) + 2)"), r"^\s+|\s+$", "").alias("body"))


def history_lines(patches: DataFrame) -> DataFrame:
    """(repo, sha, ts, file, sign, line) of the added and removed lines of patches (repo, sha, ts, patch)."""
    files = patches.select("repo", "sha", "ts", F.explode(F.split("patch", r"(?m)^diff --git ")).alias("_p"))
    name = F.regexp_extract("_p", r"(?m)^\+\+\+ (?:b/)?(.+?)\s*$", 1)
    old = F.regexp_extract("_p", r"(?m)^--- (?:a/)?(.+?)\s*$", 1)
    each = files.select("repo", "sha", "ts", F.when((name == "") | (name == "/dev/null"), old).otherwise(name).alias("file"), F.explode(F.split(F.regexp_extract("_p", r"(?s)(?:^|\n)(@@ .*)", 1), "\n")).alias("_l"))
    kept = each.where(F.col("_l").rlike(r"^[+-]") & (F.col("file") != ""))
    return kept.select("repo", "sha", "ts", "file", F.left("_l", F.lit(1)).alias("sign"), F.substring("_l", 2, 2_000_000_000).alias("line"))


def history_tokens(lines: DataFrame, pattern: str, at_head: DataFrame | None = None) -> DataFrame:
    """(fp, state, ts, sha, file, token): tokens that a pattern (its first group) finds in added and removed lines, with what became of them.

    A token is known by its own hash from the start, so no finding has to be led back to it.
    """
    found = lines.select("repo", "sha", "ts", "file", "sign", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias("token"))
    named = found.withColumn("fp", F.sha2(F.concat_ws(US, "repo", "token"), 256))
    states = rotation(named.select("fp", "ts", "sha", "sign"), at_head)
    first = named.where("sign = '+'").groupBy("fp").agg(F.min_by(F.struct("file", "token"), F.struct("ts", "sha", "file")).alias("f"))
    return states.join(first, "fp", "left").select("fp", "state", "ts", "sha", "f.file", "f.token")


def authors(commits: DataFrame) -> DataFrame:
    """(name, email, commits) most first."""
    return commits.groupBy("name", F.lower("email").alias("email")).agg(F.count(F.lit(1)).alias("commits")).orderBy(F.desc("commits"), "name", "email")


def self_review(commits: DataFrame, least: int = 20, hits: int = 8, share: float = 0.4) -> DataFrame:
    """(repo, commits, loops): repositories where bare subjects with a verb of repair follow a commit of the same author."""
    w = Window.partitionBy("repo").orderBy("ts", "sha")
    bare = F.lower("subject").rlike(r"^(?:" + "|".join(LOOP_VERBS) + r")\b") & ~F.contains("subject", F.lit("("))
    steps = commits.withColumn("_l", bare & (F.lag("email").over(w) == F.col("email")))
    out = steps.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.count_if("_l").alias("loops"))
    return out.where((F.col("commits") >= least) & (F.col("loops") >= hits) & (F.col("loops") >= share * F.col("commits")))


def ghosts(commits: DataFrame, least: int = 50, authors_least: int = 3, share: float = 0.6, days: int = 30) -> DataFrame:
    """(repo, commits, authors, ghosts): repositories most of whose authors are single words in lower case that were there for a few days only."""
    per = commits.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"), (F.max("ts") - F.min("ts")).alias("span"))
    ghost = F.col("name").rlike(r"^[a-z0-9_-]+$") & (F.col("span") <= days * 86_400)
    out = per.groupBy("repo").agg(F.sum("n").alias("commits"), F.count(F.lit(1)).alias("authors"), F.count_if(ghost).alias("ghosts"))
    return out.where((F.col("commits") >= least) & (F.col("authors") >= authors_least) & (F.col("ghosts") >= share * F.col("authors")))


def evidence(commits: DataFrame) -> DataFrame:
    """(subject, id, tier): what a repository's commits (with changed, files counts) tell about how it was made; counts only, one pass per kind.

    trailer (a tool named as author), uniform subjects, bulleted bodies, long bodies, bursts, quick sequences, huge changes, huge first
    commit; and against it reverts and slips.
    """
    n = F.count(F.lit(1))
    upper_median = lambda c: F.coalesce(F.element_at(F.array_sort(F.collect_list(c)), (F.floor(F.count(c) / 2) + 1).cast("int")), F.lit(0))  # noqa: E731  one repository's commits
    words = F.size(F.filter(F.split("body", r"\s+"), lambda x: x != ""))
    bullets = F.size(F.regexp_extract_all("body", F.lit(r"(?m)^\s*[-*] "), F.lit(0)))
    per = commits.groupBy("repo").agg(
        n.alias("n"), F.count_if(F.col("body").rlike(r"(?im)^(?:co-authored-by|generated-by|assisted-by):.*(?:bot|assistant|copilot|gpt|\bai\b)")).alias("trailers"),
        F.count_if(F.col("subject").rlike(r"^(?:feat|fix|docs|chore|refactor|test|style|perf|build|ci)(?:\([^)]*\))?!?: ")).alias("uniform"), F.count_if(bullets >= 3).alias("bulleted"), upper_median(words).alias("body"),
        upper_median(F.col("changed")).alias("changed"), F.min_by("files", F.struct("ts", "sha")).alias("root_files"), F.count_if(F.lower("subject").rlike(r"^revert\b")).alias("reverts"),
        F.count_if(F.lower("subject").rlike(r"\b(?:oops|typo|whoops|wip)\b")).alias("oops"), (F.max("ts") - F.min("ts")).alias("span"),
    )
    w = Window.partitionBy("repo").orderBy("ts", "sha")
    gaps = commits.withColumn("_g", F.col("ts") - F.lag("ts").over(w)).where("_g IS NOT NULL").groupBy("repo").agg(upper_median(F.col("_g")).alias("gap"))
    j = per.join(burst(commits.select("repo", "ts"), "repo", "ts"), "repo", "left").join(gaps, "repo", "left")
    checks = [
        ("trailer", "high", F.col("trailers") >= 1), ("uniform", "low", (F.col("n") >= 30) & (F.col("uniform") >= 0.85 * F.col("n"))), ("bullets", "medium", (F.col("n") >= 10) & (F.col("bulleted") * 2 >= F.col("n"))),
        ("long bodies", "medium", F.col("body") >= 120), ("burst", "medium", F.col("most") >= 60), ("gaps", "medium", (F.col("n") >= 50) & (F.col("gap") < 90)), ("changes", "medium", F.col("changed") >= 2_500),
        ("sprint", "medium", (F.col("n") >= 150) & (F.col("span") <= 14 * 86_400)), ("root", "low", F.col("root_files") >= 120), ("reverts", "against", F.col("reverts") >= 2), ("slips", "against", F.col("oops") >= 2),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("id"), F.lit(t).alias("tier"))) for i, t, c in checks]), lambda x: x.isNotNull())
    return j.select(F.col("repo").alias("subject"), F.explode(found).alias("_x")).select("subject", "_x.id", "_x.tier")


def newest_first(events: DataFrame, ts: str = "created", key: str = "event_id") -> DataFrame:
    """Events newest first, ties by id."""
    return events.orderBy(F.desc(ts), F.desc(key))


def event_fields(raw: Column, most: int = 30) -> Column:
    """One event's projection from its JSON: id, kind, actor, repo, org, created, detail by kind, identities of its commits (the first ``most``)."""
    pick = lambda p: F.get_json_object(raw, p)
    kind = pick("$.type")
    commits = F.from_json(pick("$.payload.commits"), "array<struct<author:struct<name:string,email:string>>>")
    who = F.array_distinct(F.transform(F.slice(F.coalesce(commits, F.array().cast("array<struct<author:struct<name:string,email:string>>>")), F.lit(1), F.lit(most)), lambda c: F.concat_ws(" ", c["author"]["name"], F.concat(F.lit("<"), c["author"]["email"], F.lit(">")))))
    detail = (
        F.when(kind == "PushEvent", F.concat_ws(" ", pick("$.payload.ref"), pick("$.payload.head"))).when(kind.isin("CreateEvent", "DeleteEvent"), F.concat_ws(" ", pick("$.payload.ref_type"), pick("$.payload.ref")))
        .when(kind == "ReleaseEvent", pick("$.payload.release.tag_name")).when(kind == "MemberEvent", F.concat_ws(" ", pick("$.payload.action"), pick("$.payload.member.login")))
        .when(kind == "ForkEvent", pick("$.payload.forkee.full_name")).otherwise(pick("$.payload.action"))
    )
    return F.struct(
        pick("$.id").alias("event_id"), kind.alias("kind"), pick("$.actor.login").alias("actor"), pick("$.repo.name").alias("repo"), pick("$.org.login").alias("org"), pick("$.created_at").alias("created"),
        pick("$.payload.before").alias("before"), pick("$.payload.head").alias("head"), detail.alias("detail"), who.alias("identities"),
    )


def hour_stats(lines: DataFrame) -> DataFrame:
    """(file, lines, bytes, parsed): of each delivered hour file (file, value) its lines, bytes and whether all of them parsed."""
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value")).alias("bytes"), F.min(F.get_json_object("value", "$.id").isNotNull()).alias("parsed"))
