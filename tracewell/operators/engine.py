"""The scan in one pass: every rule of a pack over each text, in Arrow batches.

A multi-literal automaton finds, in one run over the folded text, which rules' required literals stand in it; only those
rules (and the few without a literal) run their expressions. Caps, suppressions and duplicates are settled within the
text's own row, so nothing is shuffled and every text is read once, however many rules a pack has. Expressions are
those of ``operators.scan``; on the packs both give the same hits.

Defined results: a null text meets path and hash rules only; texts over the size cap too; an empty text has no hits; a null path
is outside any path scope but one that matches the empty path; binary texts (a zero character in the first 8192) show no findings of
the ruleset 'secrets'; rows are judged one by one, so a key that is delivered twice gives its findings twice (see ``scan``).
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import deps
from tracewell.functions.codecs import osa
from tracewell.operators import flows
from tracewell.rules.model import Rule

GATE, MAX_HITS, MAX_SIZE = 250, 3, 8 << 20
#: Fixed value: a word that marks a finding as accepted on its line, the next line or in the file.
MARKER = "tracewell"
# Manifests and lock files that name dependencies; hosts of dependency sources; words that stand for a value.
MANIFESTS = r"(?:^|/)(?:package(?:-lock)?\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|requirements[^/]*\.txt|pyproject\.toml|poetry\.lock|uv\.lock|Pipfile(?:\.lock)?|Cargo\.(?:toml|lock)|go\.(?:mod|sum)|Gemfile(?:\.lock)?|pom\.xml|build\.gradle|composer\.(?:json|lock)|setup\.(?:py|cfg))$"
SOURCE_HOSTS = "registry.npmjs.org registry.yarnpkg.com pypi.org files.pythonhosted.org crates.io static.crates.io proxy.golang.org rubygems.org repo.maven.apache.org repo1.maven.org packagist.org github.com gitlab.com codeload.github.com".split()
CODE_PATH = r"\.(?:py|js|jsx|ts|tsx|mjs|cjs|rb|php|go|rs|java|kt|cs|c|cc|cpp|sh|pl|lua)$"
PINNED = r"^(?:[0-9a-f]{40}|sha256:[0-9a-f]{64})$"
DUMMY = r"(?i)(?:example|dummy|changeme|placeholder|your[_-]|xxxx|todo|redacted|sample|fixme|insert[_-])"

Hit = tuple[int | None, str | None, str | None, str | None]  # start, token to mask or show, excerpt if not the line's, severity if not the rule's


@functools.lru_cache(4096)
def compiled(pattern: str | None) -> re.Pattern | None:
    """The expression for Python, with the classes and case folding of the other engines: ASCII."""
    if not pattern:
        return None
    here = re.sub(r"\(\?<(?![=!])", "(?P<", pattern).replace(r"\z", r"\Z")
    here = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", here)
    try:
        return re.compile(here, re.ASCII)
    except re.error:
        import regex  # classes of Unicode, flags within a pattern

        return regex.compile(here, regex.ASCII | regex.V0)


@functools.lru_cache(4096)
def required(pattern: str | None, least: int = 3) -> tuple[str, ...]:
    """Lower-case literals of which one stands in the lower-case text of any match; empty if none is sure."""
    if not pattern or not isinstance(rx := compiled(pattern), re.Pattern):
        return ()
    from re import _constants as C
    from re import _parser

    def best(items) -> frozenset[str]:
        options, run = [], ""
        for op, av in items:
            if op is C.LITERAL and av < 128:
                run += chr(av).lower()
                continue
            options, run = options + ([frozenset({run})] if run else []), ""
            if op is C.BRANCH:
                parts = [best(x) for x in av[1]]
                if all(parts):
                    options.append(frozenset().union(*parts))
            elif op is C.SUBPATTERN or op is C.ATOMIC_GROUP:
                options.append(best(av[3] if op is C.SUBPATTERN else av))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and av[0] >= 1:
                options.append(best(av[2]))
        options += [frozenset({run})] if run else []
        usable = [o for o in options if o and len(o) <= 64 and min(map(len, o)) >= least]
        return max(usable, key=lambda o: (min(map(len, o)), -len(o)), default=frozenset())

    return tuple(sorted(best(_parser.parse(rx.pattern, rx.flags & ~re.LOCALE))))


def entropy(s: str) -> float:
    n = len(s)
    return round(-sum(c / n * math.log2(c / n) for c in Counter(s).values()), 6) if n else 0.0


def placeholder(s: str) -> bool:
    return bool(re.search(DUMMY, s)) or len(set(s)) <= 4


class Compiled:
    """One rule with its expressions."""

    def __init__(self, index: int, rule: Rule):
        self.index, self.rule = index, rule
        self.rx = {k: compiled(getattr(rule, k)) for k in ("path", "regex", "unless", "exclude", "source", "sink", "calls")}
        # Literals of which one must stand in the text, in lower case; empty: the rule always runs.
        need: tuple[str, ...] = ()
        if rule.kind in ("content", "secret"):
            by_regex = required(rule.regex)
            need = rule.contains if not rule.regex else (*rule.contains, *by_regex) if by_regex and not rule.contains_all else ()
            need = need or rule.keywords
        elif rule.kind in ("dataflow", "taint"):
            need = required(rule.source) or required(rule.sink)
        elif rule.kind == "ast":
            need = () if rule.shell else required(rule.calls)
        self.gate = tuple({x.lower() for x in need})
        if rule.kind == "package":
            self.gate = tuple({n.rstrip("/").lower() for n in rule.names})
            names = "|".join(re.escape(n) if not n.endswith("/") else re.escape(n) + "[A-Za-z0-9._-]+" for n in sorted(rule.names, key=lambda n: (-len(n), n)))
            self.names = re.compile(rf"(?<![A-Za-z0-9@/_.-])(?:{names})(?![A-Za-z0-9/_-])")
            self.versions = re.compile(r"(?:^|[^0-9A-Za-z.])(?:" + "|".join(map(re.escape, rule.versions)) + r")(?:$|[^0-9A-Za-z.+-])") if rule.versions else None
        if rule.kind == "action_ref":
            self.gate = ("uses:",)

    def in_scope(self, path: str) -> bool:
        r = self.rule
        if r.kind in ("package", "source_url", "typosquat") and not re.search(MANIFESTS, path):
            return False
        if r.kind == "taint" and not r.path:
            return bool(re.search(CODE_PATH, path))
        return r.kind == "path" or not self.rx["path"] or bool(self.rx["path"].search(path))

    def near(self, text: str, hits: list[Hit], low: str) -> list[Hit]:
        """Hits that start within GATE bytes of the start of some keyword (any case)."""
        if not self.rule.keywords or not hits:
            return hits
        byte = (lambda i: i) if text.isascii() else (lambda i: len(text[:i].encode()))
        spots = sorted({byte(m.start()) for k in self.rule.keywords for m in re.finditer(f"(?={re.escape(k.lower())})", low)})
        out = []
        for h in hits:
            at = byte(h[0])
            k = bisect_right(spots, at + GATE)
            if k and spots[k - 1] >= at - GATE:
                out.append(h)
        return out

    def hits(self, path: str, text: str, low: str) -> list[Hit]:
        r, rx = self.rule, self.rx
        if rx["unless"] and rx["unless"].search(text):
            return []
        if r.kind == "content":
            out: list[Hit] = []
            if r.contains_all:
                if not all(x in text for x in r.contains):
                    return []
                out.append((text.find(r.contains[0]), r.contains[0], None, None))
            else:
                for x in r.contains:
                    at = text.find(x)
                    while at >= 0:
                        out.append((at, x, None, None))
                        at = text.find(x, at + 1)
            if rx["regex"]:
                out += [(m.start(), m.group(), None, None) for m in rx["regex"].finditer(text) if not (rx["exclude"] and rx["exclude"].search(m.group()))]
            return self.near(text, out, low)
        if r.kind == "secret":
            out = []
            for m in rx["regex"].finditer(text):
                value = m.group(min(r.group, m.re.groups)) or ""
                if len(value) >= r.min_len and not placeholder(value) and entropy(value) >= r.entropy:
                    out.append((m.start(), value, None, None))
            return self.near(text, out, low)
        if r.kind == "dataflow":
            a, b = rx["source"].search(text), rx["sink"].search(text)
            return [(a.start(), b.group(), None, None)] if a and b else []
        if r.kind == "taint":
            return [(None, None, f"{n}\0{t}", None) for n, t in flows.taint_flow(text, r.source, r.sink, r.sanitizers)]
        if r.kind == "ast":
            return [(None, None, f"{n}\0{t}", None) for n, t in flows.calls(path, text, rx["calls"], r.shell)]
        if r.kind == "action_ref":
            out = []
            for m in re.finditer(r"uses:\s*[\"']?([A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+)@([A-Za-z0-9_.:/-]+)", text):
                if r.repo and not (m.group(1) + "/").startswith(r.repo.rstrip("/") + "/"):
                    continue
                pinned = bool(re.search(PINNED, m.group(2)))
                if m.group(2) in r.malicious_shas:
                    out.append((m.start(), m.group(), None, "critical"))
                elif not pinned or r.unsafe_refs == "all":
                    out.append((m.start(), m.group(), None, None))
            return out
        if r.kind == "package":
            return [(m.start(), m.group(), None, None) for m in self.names.finditer(text) if not self.versions or self.versions.search(text[m.end() : m.end() + 256])]
        if r.kind == "source_url":
            hosts = [*SOURCE_HOSTS, *r.allowed_hosts]
            found = ((m, m.group(1).lower()) for m in re.finditer(r"https?://([A-Za-z0-9._-]+)", text))
            return [(m.start(), m.group(), None, None) for m, h in found if not any(h == x or h.endswith("." + x) for x in hosts)]
        if r.kind == "typosquat":
            popular, out = set(r.names), []
            for name in dict.fromkeys(n.lower() for _, n, _ in deps.parse(path, text)):
                bare = name.encode("ascii", "ignore").decode()
                if name not in popular and (any(osa(name, p, 1) == 1 for p in popular) or (bare != name and bare in popular)):
                    at = low.find(name)
                    out.append((max(at, 0), name, None, None))
            return out
        if r.kind == "yara":
            return [(at, what, None, None) for at, what in flows.yara_hits(r, text)]
        return []


class Engine:
    def __init__(self, rules: Sequence[Rule], max_hits: int = MAX_HITS, suppress: bool = True, exclude: Sequence[str] = ()):
        self.rules = [Compiled(i, r) for i, r in enumerate(rules)]
        self.max_hits, self.suppress, self.exclude = max_hits, suppress, [re.compile(x) for x in exclude]
        for c in self.rules:
            c.by_path = c.rx["path"] if c.rule.kind in ("content", "secret", "ast", "dataflow", "taint") else None
        self.always = [c for c in self.rules if not c.gate and c.rule.kind not in ("path", "hash")]
        self.pathwise = [c for c in self.rules if c.rule.kind == "path"]
        self.hashed = [c for c in self.rules if c.rule.kind == "hash"]
        marks: dict[str, list[int]] = {}
        for c in self.rules:
            for g in c.gate:
                marks.setdefault(g, []).append(c.index)
        self.automaton = ahocorasick.Automaton()
        for g, xs in marks.items():
            self.automaton.add_word(g, tuple(xs))
        if marks:
            self.automaton.make_automaton()
        self.has_marks = bool(marks)

    def live(self, low: str) -> list[Compiled]:
        found = {i for _, xs in self.automaton.iter(low) for i in xs} if self.has_marks else set()
        return sorted([*self.always, *(self.rules[i] for i in found)], key=lambda c: c.index)

    def accepted(self, lines: list[str]) -> list[tuple[int | None, frozenset[str]]]:
        """(line or None for all, rule ids or none for all) of the marks."""
        out = []
        for n, line in enumerate(lines, 1):
            at = line.find(f"{MARKER}:ignore")
            if at < 0:
                continue
            kind = re.match(r"-next-line|-file|", line[at + len(MARKER) + 7 :]).group()
            tail = line[at + len(MARKER) + 7 + len(kind) :].upper()
            ids = frozenset(x for x in re.split(r"[\s,]+", tail) if re.fullmatch(r"[A-Z][A-Z0-9]*-[A-Z0-9-]+|\*", x))
            out += [(None, ids)] * (kind == "-file" and n <= 20) + [(n, ids)] * (kind != "-file") + [(n + 1, ids)] * (kind == "-next-line")
        return out

    def judge(self, path: str | None, text: str | None, content: bytes | None = None) -> list[tuple[int, int | None, str | None, str]]:
        """(rule index, line, excerpt, severity) of one text."""
        p = path or ""
        if any(x.search(p) for x in self.exclude):
            return []
        raw: list[tuple[Compiled, Hit]] = [(c, (None, None, None, None)) for c in self.pathwise if (c.rx["path"] or c.rx["regex"]).search(p)]
        if self.hashed and content is not None:
            digest = hashlib.sha256(content).hexdigest()
            raw += [(c, (None, None, None, None)) for c in self.hashed if c.in_scope(p) and digest in {x.lower() for x in c.rule.sha256}]
        if text and (len(text) <= MAX_SIZE // 4 or len(text.encode("utf-8", "surrogatepass")) <= MAX_SIZE):
            low = text.lower()
            binary = "\0" in text[:8192]
            for c in self.live(low):
                if c.in_scope(p) and not (binary and c.rule.ruleset == "secrets"):
                    raw += [(c, h) for h in c.hits(p, text, low)[: self.max_hits]]
        if not raw:
            return []
        lines = text.split("\n") if text else []
        starts = [0]
        for x in lines:
            starts.append(starts[-1] + len(x) + 1)
        off = self.accepted(lines) if self.suppress and text and f"{MARKER}:ignore" in text else []
        out: dict[tuple, tuple] = {}
        for c, (start, token, own, severity) in raw:
            if own is not None:
                n, excerpt = own.split("\0", 1)
                line = int(n)
            else:
                line = bisect_right(starts, start) if start is not None else None
                excerpt = lines[line - 1].strip(" ")[:200] if line is not None else None
                if c.rule.kind == "secret" and excerpt is not None and len(token) >= 8:
                    excerpt = excerpt.replace(token, f"{token[:4]}...{token[-3:]}")
            rid = c.rule.id.upper()
            if any((n is None or n == line) and (not ids or rid in ids or "*" in ids) for n, ids in off):
                continue
            out.setdefault((c.rule.id, line, excerpt), (c.index, line, excerpt, severity or c.rule.severity))
        return list(out.values())


def scan(files: DataFrame, rules: Sequence[Rule], max_hits: int = MAX_HITS, suppress: bool = True, exclude: Sequence[str] = ()) -> DataFrame:
    """Findings of the rules over ``files`` (key, target, path, text, content optional): one pass, no shuffle.

    Rows are judged one by one; where a key may be delivered twice, pass distinct rows.
    """
    spark, has = files.sparkSession, "content" in files.columns
    sent = spark.sparkContext.broadcast(list(rules))
    built: list[Engine] = []

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not built:
            built.append(Engine(sent.value, max_hits, suppress, exclude))
        for b in batches:
            rows = []
            for i, (p, t) in enumerate(zip(b["path"], b["text"], strict=True)):
                got = built[0].judge(p, t, bytes(c) if has and (c := b["content"].iloc[i]) is not None else None)
                rows += [(b["key"].iloc[i], b["target"].iloc[i], p, *x) for x in got]
            yield pd.DataFrame(rows, columns=["key", "target", "path", "rule_idx", "line", "excerpt", "severity"]).astype({"rule_idx": "int32", "line": "Int32"})

    key = dict(files.dtypes)["key"]
    found = files.select("key", "target", "path", "text", *(["content"] if has else [])).mapInPandas(each, f"key {key}, target string, path string, rule_idx int, line int, excerpt string, severity string")
    at = F.col("rule_idx") + 1
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), at)
    rank = F.array_position(F.array(*map(F.lit, ("info", "low", "medium", "high", "critical"))), F.col("severity")).cast("int") - 1
    return found.select(
        "key", pick([r.ruleset for r in rules]).alias("ruleset"), pick([r.id for r in rules]).alias("rule_id"), "severity", rank.alias("severity_rank"), "target", "path", "line", "excerpt",
        pick([r.description for r in rules]).alias("message"), pick([r.remediation for r in rules]).alias("remediation"), pick([r.reference for r in rules]).alias("reference"),
    ) if rules else found.where("false").select("key", F.lit("").alias("ruleset"), F.lit("").alias("rule_id"), "severity", F.lit(0).alias("severity_rank"), "target", "path", "line", "excerpt", F.lit("").alias("message"), F.lit("").alias("remediation"), F.lit("").alias("reference"))
