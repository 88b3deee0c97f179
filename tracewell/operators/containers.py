"""Definitions of containers that are documents: services of compose files, pods of a cluster, steps of workflows.

Documents are read once per row in Arrow batches where a parser for them is at hand (``yaml``); without one they give nothing and
``available`` is false. Defined results: texts that do not parse, null and empty ones give no rows; ids are fixed per check.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # no parser at hand
    yaml = None

available = yaml is not None
Row = tuple[str, str, str]  # id, severity, where

# Capabilities that undo the separation; names that hold secrets; untrusted values of a workflow's event.
CAPS = {"ALL", "SYS_ADMIN", "SYS_PTRACE", "SYS_MODULE", "NET_ADMIN", "DAC_READ_SEARCH", "SYS_RAWIO"}
SECRET_NAME = re.compile(r"(?i)pass(?:word|wd)?|secret|token|api_?key|access_?key|private_?key|credential")
UNTRUSTED = re.compile(r"\$\{\{\s*(github\.(?:event\.(?:issue|pull_request|comment|review|review_comment|discussion|head_commit|commits)[\w.\[\]*]*\.(?:title|body|message|ref|name|email|label)|head_ref))")


def unpinned(image) -> bool:
    if not isinstance(image, str) or not image or "@sha256:" in image or image.startswith("$"):
        return False
    tag = image.rpartition("/")[2].partition(":")[2]
    return not tag or tag == "latest"


def literal_secrets(env) -> Iterator[str]:
    pairs = env.items() if isinstance(env, dict) else (str(x).split("=", 1) for x in env if "=" in str(x)) if isinstance(env, list) else ()
    for name, value in pairs:
        if SECRET_NAME.search(str(name)) and isinstance(value, (str, int)) and str(value).strip() and not str(value).startswith(("$", "/run/secrets")):
            yield str(name)


def compose(doc) -> Iterator[Row]:
    services = doc.get("services") if isinstance(doc, dict) else None
    for name, s in (services or {}).items() if isinstance(services, dict) else ():
        if not isinstance(s, dict):
            continue
        if s.get("privileged") is True:
            yield "CNT-101", "high", name
        mounts = [str(v.get("source", "")) if isinstance(v, dict) else str(v) for v in s.get("volumes") or []]
        if any("docker.sock" in v or "containerd.sock" in v for v in mounts):
            yield "CNT-102", "high", name
        if "host" in (s.get("network_mode"), s.get("pid"), s.get("ipc")):
            yield "CNT-103", "medium", name
        if unpinned(s.get("image")):
            yield "CNT-104", "medium", name
        if any(literal_secrets(s.get("environment"))):
            yield "CNT-105", "high", name
        if CAPS & {str(c).upper().removeprefix("CAP_") for c in s.get("cap_add") or []}:
            yield "CNT-106", "high", name
        if any(re.search(r"(?:^|:)2375(?::|$|/)", str(p.get("published") if isinstance(p, dict) else p)) for p in s.get("ports") or []):
            yield "CNT-107", "high", name


def cluster(doc) -> Iterator[Row]:
    if not isinstance(doc, dict) or "apiVersion" not in doc or "kind" not in doc:
        return
    spec = doc.get("spec") if isinstance(doc.get("spec"), dict) else {}
    for key in ("jobTemplate", "template"):
        inner = spec.get(key)
        spec = inner.get("spec", spec) if isinstance(inner, dict) and isinstance(inner.get("spec"), dict) else spec
    if any(spec.get(k) is True for k in ("hostNetwork", "hostPID", "hostIPC")):
        yield "CNT-203", "medium", doc["kind"]
    for v in spec.get("volumes") or []:
        if isinstance(v, dict) and "docker.sock" in str((v.get("hostPath") or {}).get("path", "") if isinstance(v.get("hostPath"), dict) else ""):
            yield "CNT-204", "high", str(v.get("name"))
    for c in [*(spec.get("containers") or []), *(spec.get("initContainers") or [])]:
        if not isinstance(c, dict):
            continue
        name, ctx = str(c.get("name")), {**(spec.get("securityContext") or {}), **(c.get("securityContext") or {})}
        if ctx.get("privileged") is True:
            yield "CNT-201", "high", name
        if ctx.get("runAsUser") == 0:
            yield "CNT-202", "medium", name
        if unpinned(c.get("image")):
            yield "CNT-205", "medium", name
        if any(SECRET_NAME.search(str(e.get("name"))) and e.get("value") for e in c.get("env") or [] if isinstance(e, dict)):
            yield "CNT-206", "high", name
        if ctx.get("allowPrivilegeEscalation") is True:
            yield "CNT-207", "medium", name


def workflow(doc) -> Iterator[Row]:
    jobs = doc.get("jobs") if isinstance(doc, dict) else None
    if not isinstance(jobs, dict):
        return
    on = doc.get("on", doc.get(True))
    events = {on} if isinstance(on, str) else set(on) if isinstance(on, (list, dict)) else set()
    outside = bool(events & {"pull_request_target", "workflow_run", "issue_comment"})
    if "permissions" not in doc and not all(isinstance(j, dict) and "permissions" in j for j in jobs.values()):
        yield "WFA-001", "medium", "workflow"
    for name, j in jobs.items():
        if not isinstance(j, dict):
            continue
        if "write-all" in (doc.get("permissions"), j.get("permissions")):
            yield "WFA-002", "high", name
        if j.get("secrets") == "inherit":
            yield "WFA-005", "medium", name
        if "self-hosted" in str(j.get("runs-on")) and any(e.startswith("pull_request") for e in map(str, events)):
            yield "WFA-007", "high", name
        box = j.get("container")
        if unpinned(box.get("image") if isinstance(box, dict) else box):
            yield "WFA-008", "info", name
        for k, s in enumerate(j.get("steps") or []):
            if not isinstance(s, dict):
                continue
            where, run, uses, given = f"{name}[{k}]", str(s.get("run") or ""), str(s.get("uses") or ""), s.get("with") if isinstance(s.get("with"), dict) else {}
            if UNTRUSTED.search(run) or (uses.startswith("actions/github-script") and UNTRUSTED.search(str(given.get("script", "")))):
                yield "WFA-003", "high", where
            if re.search(r">>\s*[\"']?\$\{?GITHUB_(?:ENV|PATH)", run) and outside:
                yield "WFA-004", "high", where
            if uses and not uses.startswith(("./", "docker://")) and not re.search(r"@[0-9a-f]{40}$", uses):
                yield "WFA-006", "medium", where
            if uses.startswith("actions/upload-artifact") and str(given.get("path", "")).strip() in (".", "./", "*"):
                yield "WFA-013", "medium", where
            if uses.startswith("actions/cache") and outside:
                yield "WFA-012", "low", where
            if uses.startswith("actions/checkout") and outside and re.search(r"github\.(?:event\.pull_request\.head|head_ref)", str(given.get("ref", ""))):
                yield "WFA-009", "high", where
            if uses.startswith("actions/checkout") and given.get("persist-credentials") is not False and outside:
                yield "WFA-011", "low", where
            if "ACTIONS_ALLOW_UNSECURE_COMMANDS" in str({**(j.get("env") or {}), **(s.get("env") or {})}):
                yield "WFA-010", "high", where


def audit(files: DataFrame, want: str | None = None) -> DataFrame:
    """(key, id, severity, place) of documents (key, text); texts without a word that such documents have do not reach the parser."""
    kinds = {"compose": compose, "cluster": cluster, "workflow": workflow}
    readers = [kinds[want]] if want else list(kinds.values())

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["key"], b["text"], strict=True):
                try:
                    docs = list(yaml.safe_load_all(text)) if yaml else []
                except (yaml.YAMLError, RecursionError, ValueError):
                    continue
                rows += [(key, i, s, str(w)) for d in docs for f in readers for i, s, w in f(d)]
            yield pd.DataFrame(rows, columns=["key", "id", "severity", "place"])

    kept = files.select("key", "text").where(F.col("text").rlike(r"(?m)^\s*(?:services|jobs|apiVersion):"))
    return kept.mapInPandas(each, f"key {dict(files.dtypes)['key']}, id string, severity string, place string")
