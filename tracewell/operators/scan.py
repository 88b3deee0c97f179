"""Rules as expressions: each rule yields an array of hits, uncapped and with their offsets.

``scan`` is the whole scan (one pass in Arrow batches, see ``operators.engine``). ``raw_hits`` evaluates a few rules as built-in
expressions that stay in the JVM and can be combined with other columns. Gates come first (path scope, required literals,
keywords, a killing pattern), so most texts never reach a rule's regular expression.

Input: ``files`` with key, target, path, text (and content BINARY, optional); keys are unique or their rows are counted each.

Defined results: a null text meets path and hash rules only; an empty text has no hits; a null path is outside any path
scope but '.*'; columns of the input other than these are ignored.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import text as X
from tracewell.operators.engine import CODE_PATH, GATE, MANIFESTS, MAX_HITS, MAX_SIZE, PINNED, SOURCE_HOSTS
from tracewell.operators.engine import scan as scan_rows
from tracewell.operators.flows import calls, python_calls, taint_flow  # noqa: F401
from tracewell.rules.model import SEVERITIES, Rule

CHUNK = 12
HIT = "array<struct<rule_idx:int,hit_idx:int,start:int,token:string,masked:boolean>>"


def _hits(idx: int, found: Column, masked: bool = False) -> Column:
    return F.transform(found, lambda h, i: F.struct(F.lit(idx).alias("rule_idx"), i.cast("int").alias("hit_idx"), h["start"].alias("start"), h["hit"].alias("token"), F.lit(masked).alias("masked")))


def literal_starts(text: Column, literal: str) -> Column:
    """All occurrences of a literal, overlapping ones included, as matches."""
    n = len(literal)
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    starts = F.filter(at, lambda i: F.substring(text, i, F.lit(n)) == literal)
    self_overlap = any(literal.startswith(literal[k:]) for k in range(1, n))
    return F.transform(starts, lambda i: F.struct((i - 1).cast("int").alias("start"), F.lit(literal).alias("hit"))) if self_overlap else X.matches(text, r"\Q" + literal + r"\E")


def near_keyword(text: Column, found: Column, keywords: Sequence[str]) -> Column:
    """Hits that start within GATE bytes of the start of some keyword (any case)."""
    low = F.lower(text)
    byte_at = lambda s: F.octet_length(F.substring(text, F.lit(1), s))
    spots = X.let(low, lambda t: F.flatten(F.array(*[F.transform(literal_starts(t, k.lower()), lambda m: byte_at(m["start"])) for k in keywords])))
    return X.let(spots, lambda ks: F.filter(found, lambda h: X.let(byte_at(h["start"]), lambda at: F.exists(ks, lambda k: F.abs(k - at) <= GATE))))


def any_contains(text: Column, literals: Sequence[str]) -> Column:
    return functools.reduce(operator.or_, [F.contains(text, F.lit(x)) for x in literals])


def rule_hits(idx: int, r: Rule, path: Column, text: Column, content: Column | None = None) -> Column:
    """The hits of one rule in one text."""
    none = F.array().cast(HIT)
    scope = path.rlike(r.path) if r.path and r.kind != "path" else F.lit(True)
    one = lambda token, start: F.array(F.struct(start.cast("int").alias("start"), token.alias("hit")))
    if r.kind == "path":
        return F.when(path.rlike(r.path or r.regex), _hits(idx, one(F.lit(None).cast("string"), F.lit(None)))).otherwise(none)
    if r.kind == "hash":
        if content is None:
            return none
        return F.when(scope & F.sha2(content, 256).isin(*[x.lower() for x in r.sha256]), _hits(idx, one(F.lit(None).cast("string"), F.lit(None)))).otherwise(none)
    gate = scope & text.isNotNull()
    if r.literals and not r.contains:
        gate = gate & any_contains(text, r.literals)
    if r.keywords and r.kind in ("content", "secret"):
        gate = gate & any_contains(F.lower(text), [k.lower() for k in r.keywords])
    if r.unless:
        gate = gate & ~text.rlike(r.unless)
    if r.kind == "content":
        parts = []
        if r.contains_all:
            first = r.contains[0]
            gate = gate & functools.reduce(operator.and_, [F.contains(text, F.lit(x)) for x in r.contains])
            parts.append(one(F.lit(first), F.locate(first, text) - 1))
        else:
            parts += [F.when(F.contains(text, F.lit(x)), literal_starts(text, x)).otherwise(F.array().cast("array<struct<start:int,hit:string>>")) for x in r.contains]
        if r.regex:
            m = X.matches(text, r.regex)
            parts.append(F.filter(m, lambda h: ~h["hit"].rlike(r.exclude)) if r.exclude else m)
        found = F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0]
        return F.when(gate, _hits(idx, near_keyword(text, found, r.keywords) if r.keywords else found)).otherwise(none)
    if r.kind == "secret":
        m = X.matches(text, r.regex)
        value = lambda h: F.regexp_extract(h["hit"], r.regex, r.group)
        kept = F.filter(m, lambda h: (F.length(value(h)) >= r.min_len) & ~X.placeholder(value(h)) & (X.entropy(value(h)) >= r.entropy))
        kept = near_keyword(text, kept, r.keywords) if r.keywords else kept
        return F.when(gate, _hits(idx, F.transform(kept, lambda h: F.struct(h["start"].alias("start"), value(h).alias("hit"))), True)).otherwise(none)
    if r.kind == "dataflow":
        lead = F.element_at(X.matches(text, r.source), 1)
        sink = F.regexp_extract(text, f"({r.sink})", 1)
        return F.when(gate & text.rlike(r.source) & text.rlike(r.sink), _hits(idx, one(sink, lead["start"]))).otherwise(none)
    if r.kind == "action_ref":
        m = X.matches(text, r"uses:\s*[\"']?[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+@[A-Za-z0-9_.:/-]+")
        return F.when(gate, _hits(idx, F.filter(m, lambda h: ~F.regexp_extract(h["hit"], "@(.*)$", 1).rlike(PINNED)))).otherwise(none)
    if r.kind == "package":
        names = "|".join(re.escape(n) if not n.endswith("/") else re.escape(n) + "[A-Za-z0-9._-]+" for n in sorted(r.names, key=lambda n: (-len(n), n)))
        m = X.matches(text, rf"(?<![A-Za-z0-9@/_.-])(?:{names})(?![A-Za-z0-9/_-])")
        if r.versions:
            versions = "|".join(map(re.escape, r.versions))
            m = F.filter(m, lambda h: F.substring(text, h["start"] + 1 + F.length(h["hit"]), F.lit(256)).rlike(rf"(?:^|[^0-9A-Za-z.])(?:{versions})(?:$|[^0-9A-Za-z.+-])"))
        return F.when(gate & path.rlike(MANIFESTS), _hits(idx, m)).otherwise(none)
    if r.kind == "source_url":
        hosts = [*SOURCE_HOSTS, *r.allowed_hosts]
        m = X.matches(text, r"https?://[A-Za-z0-9._-]+")
        host = lambda h: F.lower(F.regexp_extract(h["hit"], r"://([A-Za-z0-9._-]+)", 1))
        allowed = lambda h: functools.reduce(operator.or_, [(host(h) == x) | host(h).endswith("." + x) for x in hosts])
        return F.when(gate & path.rlike(MANIFESTS), _hits(idx, F.filter(m, lambda h: ~allowed(h)))).otherwise(none)
    return none


def sequential_hits(files: DataFrame, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """Hits of taint and ast rules: (key, rule_idx, hit_idx, line, excerpt); a fold over lines that needs Python."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, path, text in zip(b["key"], b["path"], b["text"], strict=True):
                for i, r in rules:
                    if not re.search(r.path or CODE_PATH, path or ""):
                        continue
                    got = taint_flow(text, r.source, r.sink, r.sanitizers) if r.kind == "taint" else calls(path or "", text, re.compile(r.calls) if r.calls else None, r.shell)
                    rows += [(key, i, k, n, t) for k, (n, t) in enumerate(got)]
            yield pd.DataFrame(rows, columns=["key", "rule_idx", "hit_idx", "line", "excerpt"])

    gates = [r.source for _, r in rules if r.kind == "taint"]
    rows = files.select("key", "path", "text").where(F.col("text").isNotNull() & F.coalesce(F.col("path").rlike("|".join(r.path or CODE_PATH for _, r in rules)), F.lit(False)))
    if gates and all(r.kind == "taint" for _, r in rules):
        rows = rows.where(functools.reduce(operator.or_, [F.col("text").rlike(re.sub(r"\\Z", r"\\z", g)) for g in gates]))
    return rows.mapInPandas(each, f"key {dict(files.dtypes)['key']}, rule_idx int, hit_idx int, line int, excerpt string")


def raw_hits(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key, target, path, rule_idx, hit_idx, line, excerpt, token) of all rules, uncapped."""
    text = F.when(F.octet_length("text") <= MAX_SIZE, F.col("text"))
    content = F.col("content") if "content" in files.columns else None
    other = {r.kind for r in rules} & {"typosquat", "yara"}
    if other:
        raise ValueError(f"rules of kind {sorted(other)} run in scan() only")
    built = [(i, r) for i, r in enumerate(rules) if r.kind not in ("taint", "ast")]
    base = files.select("key", "target", "path", text.alias("text"), *(["content"] if content is not None else []))
    frames = []
    for at in range(0, len(built), CHUNK):
        arrays = F.flatten(F.array(*[rule_hits(i, r, F.coalesce("path", F.lit("")), F.col("text"), content) for i, r in built[at : at + CHUNK]]))
        hits = base.select("key", "target", "path", "text", F.explode(arrays).alias("h"))
        line = F.when(F.col("h.start").isNotNull(), X.line_of(F.col("text"), F.col("h.start")))
        lined = hits.select("key", "target", "path", "h.rule_idx", "h.hit_idx", line.alias("line"), F.col("h.token").alias("token"), F.col("h.masked").alias("masked"), X.line_text(F.col("text"), line).alias("shown"), F.col("text"))
        frames.append(lined.select("key", "target", "path", "rule_idx", "hit_idx", "line", F.when(F.col("masked"), X.mask_in(F.col("shown"), F.col("token"))).otherwise(F.col("shown")).alias("excerpt"), "token"))
    seq = [(i, r) for i, r in enumerate(rules) if r.kind in ("taint", "ast")]
    if seq:
        extra = sequential_hits(base, seq).join(base.select("key", "target", "path"), "key")
        frames.append(extra.select("key", "target", "path", "rule_idx", "hit_idx", "line", "excerpt", F.lit(None).cast("string").alias("token")))
    return functools.reduce(DataFrame.unionByName, frames)


def scan(files: DataFrame, rules: Sequence[Rule], max_hits: int = MAX_HITS, suppress: bool = True, exclude: Sequence[str] = ()) -> DataFrame:
    """Findings of the rules in one pass over the texts (see ``operators.engine``); only findings are shuffled, to count those of rows that are
    delivered twice once."""
    return scan_rows(files, rules, max_hits, suppress, exclude).dropDuplicates(["key", "rule_id", "line", "excerpt"])


def entropy_findings(files: DataFrame, least: float = 4.5, min_len: int = 24, per_line: int = 8) -> DataFrame:
    """(key, line, token, entropy): long tokens of high entropy outside checksums, addresses and data; at most ``per_line`` a line."""
    lines = files.where(F.col("text").isNotNull() & ~F.coalesce(F.col("path").rlike(r"(?i)(?:\.lock|-lock\.json|\.sum|\.min\.js)$"), F.lit(False))).select("key", F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    lines = lines.where((F.length("l") >= min_len) & ~F.lower("l").rlike(r"sha256|sha512|integrity|https?:|data:"))
    toks = lines.select("key", (F.col("pos") + 1).alias("line"), F.posexplode(F.regexp_extract_all("l", F.lit(rf"[A-Za-z0-9+/=_.-]{{{min_len},}}"), F.lit(0))).alias("i", "token"))
    kept = toks.where(~F.col("token").rlike(r"^[0-9a-fA-F]+$") & ~F.col("token").rlike(r"^[A-Z0-9]+$")).withColumn("entropy", X.entropy(F.col("token"))).where(F.col("entropy") >= least)
    w = Window.partitionBy("key", "line").orderBy("i")
    return kept.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_line).select("key", "line", "i", "token", "entropy")


def severity_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)
