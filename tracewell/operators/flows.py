"""What a rule tells by reading a whole text in order: taint over lines, calls in syntax trees, string conditions."""

from __future__ import annotations

import re
from collections.abc import Sequence

_HEAD = re.compile(r"^\s*(?:(?:export\s+|pub\s+|public\s+|private\s+|protected\s+|static\s+|async\s+)*(?:def|func|function|fn|sub)\b|(?:public|private|protected|static)\b[^=;]*\()")
_ASSIGN = re.compile(r"^\s*(?:(?:const|let|var|final|auto|my|local|mut)\s+)*\$?([A-Za-z_]\w*)\s*(?::[^=]+)?(?::?=|\+=)(?!=)\s*(.+)$")


def taint_flow(text: str, source: str, sink: str, sanitizers: Sequence[str] = ()) -> list[tuple[int, str]]:
    """(line, text) where outside data reaches a sink: one pass over the lines.

    Variables assigned outside any function keep their taint in the functions after them; what a function assigns ends with
    it: at a line that is no deeper than its head. A sanitizer on the right-hand side clears the target unless the source stands
    there as well; assigning something clean clears it, adding something clean does not.
    """
    from tracewell.operators.engine import compiled

    src, snk = compiled(source), compiled(sink)
    if not src.search(text):
        return []
    module: set[str] = set()
    frames: list[tuple[int, set[str]]] = []  # indentation of the head, tainted names seen from within
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip())
        closing = line.strip() in ("}", "};", "})", "});", "end")
        while frames and (depth < frames[-1][0] or (depth == frames[-1][0] and not closing)):
            frames.pop()
        tainted = frames[-1][1] if frames else module
        word = lambda v, s: re.search(rf"(?<![\w$]){re.escape(v)}(?![\w$])", s)
        at = snk.search(line)
        if at and (src.search(line) or any(word(v, line[at.start() :]) for v in tainted)):
            out.append((n, line.strip()[:200]))
        if m := _ASSIGN.match(line):
            name, rhs = m.groups()
            if src.search(rhs):
                tainted.add(name)
            elif any(s in rhs for s in sanitizers):
                tainted.discard(name)
            elif any(word(v, rhs) for v in tainted):
                tainted.add(name)
            elif "+=" not in line[: m.start(2)]:
                tainted.discard(name)
        if _HEAD.search(line):
            frames.append((depth, set(tainted)))
    return out


#: Calls that are risky in Python.
RISKY = r"^(?:eval|exec|pickle\.loads|yaml\.load|os\.system)$"


def python_calls(text: str, wanted: re.Pattern | None = re.compile(RISKY), shell: bool = True) -> list[tuple[int, str]]:
    """(line, dotted name) of calls in the syntax tree whose name or last part matches; ``shell`` takes calls with shell=True as well.

    Nothing for text that does not parse.
    """
    import ast

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            parts, f = [], node.func
            while isinstance(f, ast.Attribute):
                parts.append(f.attr)
                f = f.value
            name = ".".join([f.id if isinstance(f, ast.Name) else "?", *parts[::-1]])
            by_shell = shell and any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
            if by_shell or (wanted and (wanted.search(name) or wanted.search(parts[0] if parts else name))):
                out.append((node.lineno, name))
    return sorted(out)


_BLANKED = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)


def calls(path: str, text: str, wanted: re.Pattern | None, shell: bool = True) -> list[tuple[int, str]]:
    """Calls by name: from the syntax tree of Python, else from the text without its strings and remarks (an approximation)."""
    if path.endswith((".py", ".pyi")):
        return python_calls(text, wanted, shell)
    if not wanted:
        return []
    bare = _BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    found = ((m.group(1), m.start()) for m in re.finditer(r"([A-Za-z_$][\w$]*(?:\s*(?:\.|->|::)\s*[A-Za-z_$][\w$]*)*)\s*\(", bare))
    named = ((re.sub(r"\s", "", name).replace("->", ".").replace("::", "."), at) for name, at in found)
    return [(bare.count("\n", 0, at) + 1, name) for name, at in named if wanted.search(name) or wanted.search(name.rpartition(".")[2])]


def yara_hits(rule, text: str) -> list[tuple[int, str]]:
    """(start, string) of a string rule: ``contains`` are its strings, hexadecimal in braces; any, all or a number of them must stand in the text."""
    places = []
    for s in rule.contains:
        if s.startswith("{") and s.endswith("}"):
            rx = "".join("." if h == "??" else re.escape(chr(int(h, 16))) for h in s[1:-1].split())
            m = re.search(rx, text, re.S)
            places.append((m.start(), s) if m else None)
        else:
            at = text.find(s)
            places.append((at, s) if at >= 0 else None)
    found = [p for p in places if p]
    need = len(rule.contains) if rule.condition == "all" else 1 if rule.condition == "any" else int(rule.condition)
    return [min(found)] if found and len(found) >= need else []


def parse_yara(source: str) -> list[dict]:
    """Rules of the supported subset of YARA: text and hexadecimal strings; a condition of any, all or n of them; severity from meta."""
    out = []
    for m in re.finditer(r"rule\s+(\w+)[^{]*\{(.*?)\n\}", source, re.S):
        name, body = m.groups()
        strings = [a if a is not None else "{" + " ".join(re.findall(r"[0-9A-Fa-f]{2}|\?\?", h)) + "}" for a, h in re.findall(r"\$\w*\s*=\s*(?:\"((?:[^\"\\]|\\.)*)\"|\{([^}]*)\})", body) for a, h in [(a if not h else None, h)]]
        condition = body.rpartition("condition:")[2].strip()
        n = re.match(r"(any|all|\d+) of them", condition)
        meta = dict(re.findall(r"(\w+)\s*=\s*\"([^\"]*)\"", body.partition("strings:")[0]))
        if strings and n:
            out.append({"id": f"YARA-{name}", "ruleset": "yara", "kind": "yara", "severity": meta.get("severity", "medium"), "description": meta.get("description", name), "contains": strings, "condition": n.group(1)})
    return out
