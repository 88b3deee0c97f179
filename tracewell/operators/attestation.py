"""Attestation bundles: what can be told without keys.

A bundle is JSON with a DSSE envelope (payload in base64), and may hold an inclusion proof of a transparency log. Checked are the
statement's form, the subject's digest against the file's own, the leaf's way to the root by hashes, and the pinned identity. Signatures and
certificate chains need a library that is not at hand: what passes all else is 'partial', never 'verified'.

Defined results: a bundle that does not parse, is null or empty is 'fail' with AT-001; repeated rows give equal rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def leaf_hash(entry: bytes) -> bytes:
    return hashlib.sha256(b"\x00" + entry).digest()


def root_of(index: int, size: int, leaf: bytes, path: list[bytes]) -> bytes | None:
    """The root that a leaf's audit path leads to, as logs of certificates define it; null for a path of the wrong length."""
    node, last, h = index, size - 1, leaf
    for p in path:
        if last == 0:
            return None
        if node & 1 or node == last:
            h = hashlib.sha256(b"\x01" + p + h).digest()
            while not node & 1 and node:
                node, last = node >> 1, last >> 1
        else:
            h = hashlib.sha256(b"\x01" + h + p).digest()
        node, last = node >> 1, last >> 1
    return h if last == 0 else None


def checks(bundle: str | None, digest: str | None = None, identity: str | None = None) -> tuple[str, list[str]]:
    """(verdict, ids): AT-001 no statement, AT-002 another subject, AT-003 another identity, AT-004 not in the log."""
    try:
        b = json.loads(bundle or "")
        envelope = b.get("dsseEnvelope", b)
        statement = json.loads(base64.b64decode(envelope["payload"], validate=True))
        subjects = {s["digest"]["sha256"].lower() for s in statement["subject"]}
    except (ValueError, KeyError, TypeError, AttributeError, binascii.Error, RecursionError):
        return "fail", ["AT-001"]
    found = []
    if digest is not None and digest.lower() not in subjects:
        found.append("AT-002")
    if identity is not None and b.get("identity") != identity:
        found.append("AT-003")
    proof = b.get("inclusionProof")
    if proof is not None:
        try:
            want = bytes.fromhex(proof["rootHash"])
            got = root_of(int(proof["logIndex"]), int(proof["treeSize"]), leaf_hash(base64.b64decode(proof["entry"])), [bytes.fromhex(x) for x in proof["hashes"]])
            ok = 0 <= int(proof["logIndex"]) < int(proof["treeSize"]) and got == want
        except (ValueError, KeyError, TypeError, binascii.Error):
            ok = False
        if not ok:
            found.append("AT-004")
    return ("fail" if found else "partial"), found


def verify(bundles: DataFrame) -> DataFrame:
    """(key, verdict, ids) of bundles (key, bundle, digest, identity)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [checks(x, d, i) for x, d, i in zip(b["bundle"], b["digest"], b["identity"], strict=True)]
            yield pd.DataFrame({"key": b["key"], "verdict": [g[0] for g in got], "ids": [g[1] for g in got]})

    return bundles.select("key", "bundle", "digest", "identity").mapInPandas(each, f"key {dict(bundles.dtypes)['key']}, verdict string, ids array<string>")
