"""Expressions over text: matches with offsets, lines, entropy, masks, extraction, names. All built-in, no UDF.

Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda's variable is bound, a repeated column would be computed again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their 0-based start: array<struct<start int, hit string>>.

    The starts follow from the lengths of what lies between the matches; the pattern must not match the empty string.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    total = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, x: a + x)
    return let(gaps, lambda g: let(hits, lambda hs: let(F.transform(hs, lambda x: F.length(x)), lambda z: F.transform(hs, lambda h, i: F.struct((total(g, i + 1) + total(z, i)).alias("start"), h.alias("hit"))))))


def line_of(text: Column, start: Column) -> Column:
    """1-based line number of a 0-based character offset."""
    before = F.substring(text, F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def line_text(text: Column, line: Column, most: int = 200) -> Column:
    """The line, trimmed and clipped."""
    return F.left(F.trim(F.element_at(F.split(text, "\n"), line)), F.lit(most))


def entropy(s: Column) -> Column:
    """Shannon entropy over characters in bits, rounded to six places; 0 for an empty string."""
    n = F.length(s).cast("double")
    chars = F.split(s, "")
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"))
    return F.round(F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(counts, F.lit(0.0), lambda a, c: a - (c / n) * F.log2(c / n))), 6)


def mask(s: Column) -> Column:
    """first4...last3 of a token of at least eight characters."""
    return F.when(F.length(s) >= 8, F.concat(F.left(s, F.lit(4)), F.lit("..."), F.right(s, F.lit(3)))).otherwise(s)


def mask_in(line: Column, token: Column) -> Column:
    return F.when(F.length(token) >= 8, F.replace(line, token, mask(token))).otherwise(line)


def distinct_chars(s: Column) -> Column:
    return F.size(F.array_distinct(F.split(s, "")))


DUMMY = r"(?i)(?:example|dummy|changeme|placeholder|your[_-]|xxxx|todo|redacted|sample|fixme|insert[_-])"


def placeholder(s: Column) -> Column:
    """A word that stands for a value, or at most four distinct characters."""
    return s.rlike(DUMMY) | (distinct_chars(s) <= 4)


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
URL = r"https?://[^\s\"'<>)\]}`]+"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
HEX_HASH = r"\b(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})\b"
WALLET = r"\b(?:0x[0-9a-fA-F]{40}|bc1[0-9a-z]{25,58}|[13][1-9A-HJ-NP-Za-km-z]{25,61})\b"


def found(text: Column, pattern: str) -> Column:
    """Distinct matches, in order of first sight; empty for null."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.array().cast("array<string>"))


def emails(text: Column) -> Column:
    return F.array_distinct(F.transform(found(text, EMAIL), lambda x: F.lower(x)))


def urls(text: Column) -> Column:
    return F.array_distinct(F.transform(found(text, URL), lambda x: F.regexp_replace(x, r"[.,;:!?]+$", "")))


def valid_ipv4(s: Column) -> Column:
    """Four octets of at most 255 without leading zeros."""
    return F.coalesce(s.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$") & ~s.endswith("."), F.lit(False))


def ipv4s(text: Column) -> Column:
    return F.filter(found(text, IPV4), valid_ipv4)


def ip_number(s: Column) -> Column:
    """An IPv4 address as a bigint; null where it is none."""
    o = F.split(s, r"\.")
    return F.when(valid_ipv4(s), sum((F.try_element_at(o, F.lit(i + 1)).cast("bigint") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("bigint")))


def in_cidr(ip: Column, cidr: Column) -> Column:
    """Whether an address number lies in a.b.c.d/n."""
    net, bits = ip_number(F.substring_index(cidr, "/", 1)), F.substring_index(cidr, "/", -1).cast("int")
    size = F.pow(F.lit(2.0), 32 - bits).cast("bigint")
    return F.floor(ip / size) == F.floor(net / size)


def public_ip(s: Column) -> Column:
    """Neither private, loopback, link-local, shared, documentation, multicast nor reserved."""
    n = ip_number(s)
    blocks = (
        "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 "
        "198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4"
    ).split()
    inside = functools.reduce(operator.or_, [_block(n, b) for b in blocks])
    return n.isNotNull() & ~inside


def _block(n: Column, cidr: str) -> Column:
    a, _, bits = cidr.partition("/")
    o = [int(x) for x in a.split(".")]
    low = sum(x << (8 * (3 - i)) for i, x in enumerate(o))
    return n.between(low, low + (1 << (32 - int(bits))) - 1)


def hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(found(text, HEX_HASH), lambda x: F.lower(x)))


def wallets(text: Column) -> Column:
    return found(text, WALLET)


def word_present(text: Column, word: str) -> Column:
    """The identifier stands in the text, bounded by other characters."""
    return text.rlike(rf"(?:^|[^A-Za-z0-9_$]){re.escape(word)}(?:$|[^A-Za-z0-9_$])")


def glob_regex(glob: str) -> str:
    """'*' within a segment, '**' over segments, '?' one character; anchored."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return rf"\A{out}\z"


def plain_path(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./+)+", "")


def package_name(c: Column) -> Column:
    """Lower case, '_' and '.' as '-'."""
    return F.translate(F.lower(F.trim(c)), "_.", "--")


def normal_name(ecosystem: Column, name: Column) -> Column:
    """PyPI collapses runs of separators; other ecosystems compare in lower case."""
    return F.when(ecosystem == "PyPI", F.regexp_replace(F.lower(name), r"[-_.]+", "-")).otherwise(F.lower(name))


def repo_of(url: Column) -> Column:
    """owner/repo of a forge address, else ''."""
    return F.regexp_replace(F.regexp_extract(url, r"(?i)(?:github|gitlab)\.com[/:]([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)", 1), r"\.git$", "")


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    kind = (
        F.when(ecosystem == "npm", "npm").when(ecosystem == "PyPI", "pypi").when(ecosystem == "crates.io", "cargo").when(ecosystem == "Go", "golang")
        .when(ecosystem == "RubyGems", "gem").when(ecosystem == "Maven", "maven").otherwise("generic")
    )
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), percent(name), F.lit("@"), version)


def percent(s: Column) -> Column:
    """Percent-encoding with %20 for a blank; '/' is kept."""
    return F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def camelize(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, "[-_]"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1_000_000))), "")


def version_key(v: Column, width: int = 6) -> Column:
    """A dotted version as bigints padded with zeros; null where it does not start with a number."""
    digits = F.regexp_extract(v, r"^[vV]?([0-9]{1,18}(?:\.[0-9]{1,18})*)", 1)
    nums = F.transform(F.split(digits, r"\."), lambda x: x.cast("bigint"))
    zeros = F.array(*[F.lit(0).cast("bigint")] * width)
    return F.when(digits != "", F.slice(F.concat(nums, zeros), 1, width))


ZERO_WIDTH = "​‌‍⁠﻿᠎"


def zero_width(s: Column) -> Column:
    """Number of zero-width characters."""
    return F.length(s) - F.length(F.translate(s, ZERO_WIDTH, ""))


def collapse(s: Column, most: int = 240) -> Column:
    """White space collapsed, clipped with '...'."""
    flat = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit("..."))).otherwise(flat)


def redact_url(s: Column) -> Column:
    """Credentials in an address hidden."""
    return F.regexp_replace(s, r"([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@\s:]+(?::[^/@\s]*)?@", "$1***@")


def html_text(s: Column) -> Column:
    """Visible text: scripts, styles, comments and tags dropped, common entities decoded."""
    t = F.regexp_replace(s, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def mask_entropy(s: Column, least: float = 3.4, min_len: int = 16) -> Column:
    """Runs of token characters of enough entropy masked as ``mask`` does, longest first so that no run hides in another."""
    runs = F.filter(F.array_distinct(F.regexp_extract_all(s, F.lit(rf"[A-Za-z0-9+/=_-]{{{min_len},}}"), F.lit(0))), lambda x: entropy(x) >= least)
    ordered = F.array_sort(runs, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(ordered, s, lambda acc, x: F.replace(acc, x, mask(x)))


def redact_config(s: Column) -> Column:
    """A configuration's text with the credentials of addresses hidden and the values of secret-named keys and of authorization headers masked."""
    t = redact_url(s)
    t = F.regexp_replace(t, r"(?im)^(\s*[\w.\-]*(?:password|passwd|secret|token|api_?key|_auth(?:token)?)[\w.\-]*\s*[=:]\s*)\S.*$", "$1***")
    return F.regexp_replace(t, r"(?i)(authorization:\s*\w+\s+)\S+", "$1***")
