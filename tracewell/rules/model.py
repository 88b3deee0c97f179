"""Rules as data: loading, checking, overriding by id, and the literals a pattern cannot match without.

A pack is a TOML file with ``[[rule]]`` tables, and a ``[ruleset]`` table with its name where the rules do not say theirs.
Kinds (``kind`` or ``type``): content, secret, path, hash, action_ref (also ``action``), package, source_url, typosquat, taint,
dataflow, ast, yara. A later rule with the same id replaces an earlier one in its place. Lists of popular names that typosquat rules
name by ``list`` are given to ``load``. Of the queries of syntax rules the names of calls are taken (``#eq?`` and ``#match?``).
"""

from __future__ import annotations

import hashlib
import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

KINDS = ("content", "secret", "path", "hash", "action_ref", "package", "source_url", "typosquat", "taint", "dataflow", "ast", "yara")
SEVERITIES = ("info", "low", "medium", "high", "critical")
PACKS = Path(__file__).parent / "packs"


@dataclass(frozen=True)
class Rule:
    id: str
    ruleset: str
    severity: str
    kind: str
    description: str
    path: str | None = None
    contains: tuple[str, ...] = ()
    contains_all: bool = False
    regex: str | None = None
    unless: str | None = None
    exclude: str | None = None
    keywords: tuple[str, ...] = ()
    group: int = 1
    entropy: float = 3.8
    min_len: int = 20
    source: str | None = None
    sink: str | None = None
    sanitizers: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    versions: tuple[str, ...] = ()
    sha256: tuple[str, ...] = ()
    allowed_hosts: tuple[str, ...] = ()
    remediation: str | None = None
    reference: str | None = None
    window: tuple[str, str] | None = None
    repo: str | None = None
    unsafe_refs: str = "tags"
    malicious_shas: tuple[str, ...] = ()
    lang: str | None = None
    calls: str | None = None
    shell: bool = False
    condition: str = "any"
    literals: tuple[str, ...] = field(default=(), compare=False)

    @property
    def rank(self) -> int:
        return SEVERITIES.index(self.severity)


def dialect(pattern: str) -> str:
    """Named groups as Java spells them; '$' at the end of a pattern means the end of the text."""
    out = pattern.replace("(?P<", "(?<").replace("(?-u:", "(?:")
    return out[:-1] + r"\z" if out.endswith("$") and not out.endswith(r"\$") and "(?m" not in out else out


def required_literal(pattern: str) -> tuple[str, ...]:
    """Literals of which one must stand in any match: the longest run at the top level, per alternative; empty if unsure."""
    if re.search(r"\(\?[a-z]*i", pattern):
        return ()
    parts, depth, cur = [], 0, ""
    i, cls = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            cur += pattern[i : i + 2]
            i += 2
            continue
        if cls:
            cls = c != "]"
        elif c == "[":
            cls = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            parts.append(cur)
            cur = ""
            i += 1
            continue
        cur += c
        i += 1
    parts.append(cur)
    found = []
    for p in parts:
        flat, depth, cls, i = [""], 0, False, 0
        while i < len(p):
            c = p[i]
            nxt = p[i + 1] if i + 1 < len(p) else ""
            if c == "\\":
                lit = nxt if nxt and not nxt.isalnum() else None
                step = 2
            else:
                lit = c if c not in r".^$*+?{}[]()|" else None
                step = 1
            if cls:
                cls, lit = c != "]", None
            elif c == "[" and step == 1:
                cls = True
            elif c == "(" and step == 1:
                depth += 1
            elif c == ")" and step == 1:
                depth -= 1
            follow = p[i + step : i + step + 1]
            if lit is None or depth or cls or follow in ("?", "*", "{"):
                if flat[-1]:
                    flat.append("")
                if c == "{" and step == 1:
                    i = max(i, p.find("}", i))
            else:
                flat[-1] += lit
                if follow == "+":
                    flat.append("")
            i += step
        best = max(flat, key=len)
        if len(best) < 3:
            return ()
        found.append(best)
    return tuple(dict.fromkeys(found))


EXTENSIONS = {"python": "pyi?", "javascript": "[cm]?jsx?", "typescript": "tsx?", "go": "go", "rust": "rs", "java": "java", "ruby": "rb", "php": "php"}


def calls_of(query: str) -> str | None:
    """The names of calls that a syntax query asks for."""
    found = [f"^(?:{re.escape(v)})$" if how == "eq" else v for how, v in re.findall(r'#(eq|match)\? @\w+ "([^"]+)"', query)]
    return "|".join(f"(?:{x})" for x in found) or None


def rule_of(raw: dict, ruleset: str | None = None, lists: dict[str, list[str]] | None = None) -> Rule:
    """A checked rule; unknown keys, kinds, severities and patterns that do not compile are errors."""
    raw = dict(raw)
    if "type" in raw:
        raw["kind"] = raw.pop("type")
    if ruleset:
        raw.setdefault("ruleset", ruleset)
    if query := raw.pop("query", None):
        raw.setdefault("calls", calls_of(query))
        raw.setdefault("shell", "shell" in query)
    raw.pop("capture", None)
    if raw.get("lang") and not raw.get("path") and raw["kind"] in ("ast", "action_ref", "taint"):
        raw["path"] = rf"\.(?:{EXTENSIONS.get(raw['lang'], re.escape(raw['lang']))})$"
    if isinstance(raw.get("window"), list):
        raw["window"] = tuple(raw["window"])
    if isinstance(raw.get("names"), str):
        raw["names"] = [raw["names"]]
    if raw.get("list") and lists:
        raw["names"] = [n.lower() for n in lists.get(raw["list"], [])]
    known = {f.name for f in fields(Rule)}
    if unknown := set(raw) - known - {"list"}:
        raise ValueError(f"rule {raw.get('id')}: unknown keys {sorted(unknown)}")
    raw = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
    raw["kind"] = {"action": "action_ref"}.get(raw.get("kind", ""), raw.get("kind"))
    if raw["kind"] not in KINDS or raw.get("severity") not in SEVERITIES:
        raise ValueError(f"rule {raw.get('id')}: kind {raw['kind']!r}, severity {raw.get('severity')!r}")
    for k in ("path", "regex", "unless", "exclude", "source", "sink", "calls"):
        if raw.get(k):
            raw[k] = dialect(raw[k])
    r = Rule(**{k: v for k, v in raw.items() if k != "list"})
    need = {"content": r.regex or r.contains, "secret": r.regex, "path": r.path or r.regex, "hash": r.sha256, "package": r.names, "taint": r.source and r.sink, "dataflow": r.source and r.sink, "ast": r.calls or r.shell, "yara": r.contains}.get(r.kind, True)
    if not need:
        raise ValueError(f"rule {r.id}: a {r.kind} rule lacks its pattern")
    return replace(r, literals=required_literal(r.regex) if r.regex else ())


def merge(rules: Iterable[Rule]) -> list[Rule]:
    """Later rules replace earlier ones with the same id, in the earlier one's place."""
    out: dict[str, Rule] = {}
    for r in rules:
        out[r.id] = r
    return list(out.values())


def load(*paths: str | Path, builtin: bool = True, lists: dict[str, list[str]] | None = None) -> list[Rule]:
    """The rules of the built-in packs and of more files or folders of packs, later ones over earlier ones; '.yar' files are read as string rules."""
    from tracewell.operators.flows import parse_yara

    found = sorted(PACKS.glob("*.toml")) if builtin else []
    for p in map(Path, paths):
        found += sorted([*p.glob("*.toml"), *p.glob("*.yar")]) if p.is_dir() else [p]
    out = []
    for p in found:
        if p.suffix == ".yar":
            out += [rule_of(raw) for raw in parse_yara(p.read_text())]
            continue
        pack = tomllib.loads(p.read_text())
        out += [rule_of(raw, (pack.get("ruleset") or {}).get("name"), lists) for raw in pack.get("rule", [])]
    return merge(out)


def select(rules: Iterable[Rule], rulesets: Iterable[str] | None = None, disabled: Iterable[str] = ()) -> list[Rule]:
    keep, off = set(rulesets or ()), {x.lower() for x in disabled}
    return [r for r in rules if (not keep or r.ruleset in keep) and r.id.lower() not in off]


def fingerprint(rules: Iterable[Rule]) -> str:
    """First eight bytes of the SHA-256 over the sorted set:id:description lines, in hexadecimal."""
    lines = sorted(f"{r.ruleset}:{r.id}:{r.description}" for r in rules)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]
