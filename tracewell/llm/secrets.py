"""Credentials quoted in source and configuration lines: which lines show one, and the lines redacted.

A literal near an assignment context (a credential's name, an authorization header, a login in
an address or on a command line, a signed link, a key block, or a bare value in a file whose path says
what it is) is segmented by Viterbi into dictionary words, pronounceable words and separators. What no
word explains is the residual; a literal with enough residual is a credential. Masked values, placeholders,
references to stores and variables, public keys, certificates, digests and ids are excluded by their form or by
their context.

The dictionary is learned: words of all texts and of identifiers in all code at hand, with the number of texts they stand in,
of which the most frequent (a bounded number) are broadcast; a word costs by its frequency. The scan of a line is
pure and reads the whole line; it costs one pass of a handful of expressions and one segmentation per candidate, linear in
its length.

Defined results: a null excerpt shows nothing, an empty one too; a null path tells nothing; rows delivered twice
count once; redaction leaves every character outside the credential's value as it was.
"""

from __future__ import annotations

import base64
import binascii
import functools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "[REDACTED]"

# Words that name a credential, in several languages; as parts of an identifier.
NAMES = (
    "password passwd passphrase passwort kennwort kennwoert geheimnis schluessel clave contrasena contraseña "
    "motdepasse mot_de_passe mot-de-passe mot.de.passe secret apikey api_key api-key api.key accesskey access_key access-key "
    "access.key signingkey signing_key signing-key signing.key privatekey private_key private-key encryption_key "
    "master_key session_key shared_key authtoken token credential dbpass db_pass db-pass db.pass pwd"
).split()
# What a credential's name may end with when its value is something about it.
ABOUT = (
    "type length len min max days count ttl rotation policy file path dir ref name id url uri host header field label "
    "hint version expiry expires expiration lifetime timeout algorithm format prefix regex pattern env var keyref provider scope scopes"
).split()
# Words of code and configuration that are known without a corpus; the others are learned (``learn_words``).
WORDS = (
    "a an and api app application arn auth authorization bar bearer basic begin bucket build cache certificate change changeme check "
    "client clone code command commit config connect const copy credential credentials cursor data database date db default demo digest "
    "directory docker dummy empty end env environ environment error eval example exec execute export false file fill fixme foo for frame from "
    "function get git github handle header headers here host html http https id image import insert integrity invalid is it key keys kind label "
    "legacy length lib line list load loader local login machine mail masked master me message min mode my mysql name new no nobody none not null "
    "nil of old on only or output params parser pass password passwd passphrase path pickle placeholder policy port postgres private process "
    "profile project prod production property proxy public put queue random read record redacted ref release remote removed replace request "
    "reset return root run sample secret secrets section select self send server service services session set shard shell should signing skip "
    "socket some start store string sudo sync system target temp template test text the this to todo token true type undefined unknown unset update "
    "url user username value values var vault verify version web webhook window with write yaml yes you your xxx "
    "access account admin"
).split()
# Fillers that stand for a value.
FILLERS = (
    "changeme change-me change_me dummy example sample placeholder todo tbd fixme none null nil undefined empty test testing "
    "replace-me replaceme replace_me insert-key-here your-password your-token your-key your-secret password secret token xxx n/a na unset redacted masked hidden removed"
).split()

_NAME = "|".join(sorted(map(re.escape, NAMES), key=len, reverse=True))
_IDENT = r"[\w.\-]*"
_KEY = rf"(?P<key>{_IDENT}?(?:{_NAME}|(?<![A-Za-z0-9])pw(?![A-Za-z0-9])|(?<![A-Za-z])pass(?![A-Za-z])){_IDENT})"
_QUOTED = r"""(?P<q>["'`])(?P<quoted>(?:(?!(?P=q)).)*)(?P=q)"""
_BARE = r"""(?P<bare>[^\s"'`,;(){}\[\]<>]+)"""
_ASSIGNED = re.compile(rf"""(?is)(?<![\w.\-]){_KEY}["'`\]]*\s*(?::=|=>|={{1,2}}|:)\s*(?:{_QUOTED}|{_BARE})(?P<next>\s*\(|)""")
_SPACED = re.compile(rf"""(?i)^\s*ENV\s+{_KEY}\s+(?:{_QUOTED}|{_BARE})""")
_PAIRED = re.compile(rf"""(?i)(?:set\w*|put|add|insert|property|define|header)\w*\s*\(\s*["'`]?{_KEY}["'`]?\s*,\s*(?:{_QUOTED}|(?P<bare>[^\s"'`,;()<>]+))""")
_ELEMENT = re.compile(rf"""(?i)(?:key|name)\s*=\s*["']{_KEY}["']\s+value\s*=\s*(?:{_QUOTED})""")
_NAME_RE = re.compile(rf"(?i)(?:{_NAME})")
_PARTS = re.compile(r"""["'`]([^"'`]*)["'`](?:\s*[+.,]\s*["'`]([^"'`]*)["'`])+""")
_PART = re.compile(r"""["'`]([^"'`]*)["'`]""")

#: Contexts whose value needs no credential's name: (expression, least residual).
_CONTEXTS = [
    (re.compile(r"""(?i)\bBearer\s+(?P<v>[^\s"'`,;]+)"""), 3),
    (re.compile(r"""(?i)\bx-(?:api|auth)[\w-]*\s*[:=]\s*["']?(?P<v>[^\s"'`,;]+)"""), 3),
    (re.compile(r"""(?i)_authToken\s*=\s*["']?(?P<v>[^\s"'`,;]+)"""), 3),
    (re.compile(r"""(?i)\b[a-z][a-z0-9+.\-]*://[^\s/:@"'`]*:(?P<v>[^\s/@"'`]+(?:/[^\s/@"'`]+)*)@"""), 2),
    (re.compile(r"""(?i)(?<![\w/:.@-])(?P<user>[\w.\-]+):(?P<v>[^\s:@"'`/]{6,})@[\w\-]+\.[\w.\-]+"""), 2),
    (re.compile(r"""(?i)[?&;](?:sig|signature|x-amz-signature|x-goog-signature|sas|access_token|auth|token|key)=(?P<v>[^\s&"'`#]{12,})"""), 8),
    (re.compile(r"""(?i)://hooks?\.[^\s/"'`]+/(?:\w+/)*?(?P<v>[A-Z0-9]{6,}/[A-Z0-9]{6,}/[A-Za-z0-9]{12,})"""), 12),
    (re.compile(r"""(?i)\b(?:Account|SharedAccess|Primary|Secondary)Key\s*=\s*(?P<v>[A-Za-z0-9+/=]{20,})"""), 12),
    (re.compile(r"""(?i)\bsshpass\s+-p\s*["']?(?P<v>[^\s"']+)"""), 2),
    (re.compile(r"""(?i)\b(?:mysql|mysqldump|mysqladmin|psql|mariadb|mongo\w*|redis-cli)\b.*?\s-(?:p|a)\s*["']?(?P<v>[^\s"']+)"""), 2),
    (re.compile(r"""(?i)(?:^|\s)--?(?:password|passwd|pass|token|secret|api-?key)(?:=|\s+)["']?(?P<v>[^\s"']+)"""), 2),
    (re.compile(r"""(?i)\bcurl\b.*?\s(?:-u|--user)\s*["']?[^\s:"']+:(?P<v>[^\s"']+)"""), 2),
    (re.compile(r"""(?i)\b(?:login|authenticate|sign_?in|auth)\w*\s*\(\s*["'][^"']*["']\s*,\s*["'](?P<v>[^"']+)["']"""), 2),
    (re.compile(r"""(?i)\bmachine\s+\S+\s+login\s+\S+\s+password\s+(?P<v>\S+)"""), 2),
    (re.compile(r"""(?i)\b(?:old|new|our|the)?\s*(?:login|credentials?)\s+for\s+\S+?:?\s+\S+\s+/\s+(?P<v>\S+)"""), 2),
    (re.compile(r"""(?i)\b(?:otpauth|totp|otp)\b.*?\bsecret\b[\s=:]+(?P<v>[A-Z2-7]{16,}=*)"""), 8),
]
_BASIC = re.compile(r"""(?i)\bBasic\s+(?P<v>[A-Za-z0-9+/]{8,}={0,2})""")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<v>(?:\\[nr]|\s|[A-Za-z0-9+/=:,\-]){24,})")
#: Forms of tokens that issuers give a prefix; no name is needed beside them.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:gh[oprsu]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_\-]{18,}|npm_[A-Za-z0-9]{30,}"
    r"|xox[abprs]-[A-Za-z0-9\-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{20,}|AKIA[A-Z0-9]{16}|whsec_[A-Za-z0-9+/]{24,}"
    r"|AIza[A-Za-z0-9_\-]{35}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{16,})(?![A-Za-z0-9_]|\.\.\.|\*)"
)
_TOKEN = re.compile(r"""^[\s;,"'`]*(?P<v>[A-Za-z0-9+/=_\-.!@#$%]{12,})[\s;,"'`]*$""")
#: What a file of a bare value is, by its path.
_SECRET_PATH = re.compile(r"(?i)(?:^|[/._\-])(?:secrets?|credentials?|private|passwords?|passwd|tokens?|vault|keystore|id_rsa|id_ed25519|htpasswd|[\w]*(?:master|session|signing|private|secret|api)[._\-]?key|[\w]*[._\-]token|db_password)(?:$|[/._\-])")
_DIGEST_PATH = re.compile(r"(?i)(?:^|[/._\-])(?:sha\d*(?:sums?)?|md5(?:sums?)?|checksums?|digests?|hash(?:es)?|manifest|integrity|fingerprints?|etags?|lock|sums?)(?:$|[/._\-])")

_MASKED = re.compile(r"(?i)\*{3,}|\.{3,}|…|•{3,}|\[(?:redacted|masked|hidden|filtered|removed|secret)[^\]]*\]|<[^<>]*>|^x{4,}$|^(.)\1{5,}$|#{4,}|_{5,}")
_REFERENCE = re.compile(
    r"(?i)^\s*(?:\$\{[^}]*(?:\}|$)|\{\{|%\(|\$\(|@\{|#\{|<%|!ref\b|ref\+|arn:|vault:|secretsmanager|ssm:|kms:|op://|env[:.(\[]|os\.|process\.env|getenv|system\.getenv|"
    r"environ|getpass|vault[.:]|secrets?[.\[(]|config[.\[(]|settings[.\[]|keyring|file:|/run/|/etc/|/var/|https?://)|\}\}|%\(\s*\w+\s*\)s|\$\{[^}]*\}"
)
#: Forms of hashes. Those that name their method are hashes under any name, the others where the name or a remark says so.
_HASH_NAMED = re.compile(
    r"(?i)^(?:\$(?:2[abxy]?|1|5|6|7|y|gy|apr1|sha1|md5|argon2(?:id|i|d)|scrypt|s0|pbkdf2[\w\-]*)\$[\w./+=,$\-]{20,}|pbkdf2[\w\-]*\$\d+\$[\w./+=$\-]{20,}"
    r"|\{(?:s?sha\d*|s?md5|crypt)\}[\w./+=$]{12,}|(?:sha-?\d+|sha|md5|blake[23]\w*)[:\-=](?:[0-9a-f]{32,128}|[a-z0-9+/_\-]{22,88}={0,2}))$"
)
_HASH_PLAIN = re.compile(
    r"(?i)^(?:0x)?(?:[0-9a-f]{8}|[0-9a-f]{16}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|(?:[0-9a-f]{2}:){15,63}[0-9a-f]{2}"
    r"|[a-z0-9+/_\-]{22}(?:==)?|[a-z0-9+/_\-]{27}=?|[a-z0-9+/_\-]{43}=?|[a-z0-9+/_\-]{64}|[a-z0-9+/_\-]{86}(?:==)?)$"
)
_HASH_WORD = r"(?:hash(?:es|ed)?|digests?|checksums?|fingerprints?|thumbprints?|sha\d*|md5(?:sum)?|crc\d*)"
#: What may follow the word in a name without making it another thing.
_HASH_TAIL = re.compile(r"(?i)hex|base64|b64|value|string|str|expected|actual|old|new|current|\d+")
_HASH_REMARK = re.compile(rf"""(?i)^["'`]?[\s,;)\]}}]*(?:\#|//|--|/\*|<!--|\().*(?<![^\W_]){_HASH_WORD}(?![^\W_])""")
_LAST_NAME = re.compile(r"""([\w.\-]+)["'`\s:=>,(\[]*$""")
#: A variable, with the fields it is asked for.
_VARIABLE = re.compile(r"\$(?:env:)?(?P<name>[A-Za-z_]\w*)(?:(?:->|::)\w*)*")
#: Words of running text: letters in one case with a vowel, short or upper-case ones without, numbers, names of standards, figures with a unit.
_PLAIN_WORD = re.compile(
    r"(?:(?=\w*?(?:[aeiouyAEIOUY]|[^\x00-\x7f]))(?:[^\W\d_A-Z]+|[^\W\d_a-z][^\W\d_A-Z]*|[^\W\d_a-z]+)|[a-z]{1,3}|[A-Z]{1,5}|\d{1,4}"
    r"|(?i:sha\d*|md5|base\d+|utf\d*|oauth\d|ipv[46]|x509|v\d+|rfc\d*|iso\d*|aes\d*|rsa\d*|[hre]s\d{3}|pkcs\d*|p12|s3|ec2|k8s|http\d?|tls\d*|\d+(?:st|nd|rd|th|[hdms]|[km]b|bits?|chars?)))"
)
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_SEED = {w: 1.0 + 0.12 * len(w) for w in {*WORDS, *NAMES} if w.isalpha() and len(w) >= 2}
#: Bounds of the learned dictionary: words, texts that a word must stand in, letters; words of two or three letters must be among the first of all.
MOST_WORDS, LEAST_TEXTS, LONGEST, SHORT_AMONG = 50_000, 3, 16, 400
_SYLLABLES = re.compile(r"(?:[bcdfghjklmnpqrstvwz][aeiou]){2,}")
_SEPARATORS = frozenset("-_./:@ ,")
_CASED = re.compile(r"^(?:[a-z]+|[A-Z][a-z]+|[A-Z]+)$")


#: What every line that can show a credential holds, by itself or by its path; a superset of all contexts above, for Spark.
LINE_GATE = (
    r"(?iu)" + "|".join(re.escape(n).replace("\\-", "-") for n in NAMES) + r"|(?<![a-z0-9])pw(?![a-z0-9])|(?<![a-z])pass(?![a-z])|bearer|basic|x-(?:api|auth)|@|[?&;](?:sig|signature|x-amz-signature|x-goog-signature|sas|auth|key)="
    r"|://hooks?\.|key\s*=|sshpass|mysql|psql|mariadb|mongo|redis-cli|curl|(?:login|authenticate|sign_?in|auth)\w*\s*\(|machine|(?:login|credentials?)\s+for|otp"
    r"|private key|gh[oprsu]_|github_pat_|glpat-|npm_|xox[abprs]-|[sr]k_(?:live|test)_|akia|whsec_|aiza|eyj"
)
PATH_GATE = _SECRET_PATH.pattern


class _Words:
    """The dictionary of this process: cost of each word."""

    costs: dict[str, float] = dict(_SEED)
    longest = max(map(len, _SEED))


def use_words(counts: dict[str, int] | None) -> None:
    """Take a learned dictionary (word: number of texts) beside the known words: a word costs by how rare it is."""
    total = sum((counts or {}).values()) or 1
    costs = {**_SEED, **{w: 0.6 + 0.1 * -math.log2(n / total) for w, n in (counts or {}).items()}}
    if costs != _Words.costs:
        _Words.costs, _Words.longest = costs, max(map(len, costs))
        _residual.cache_clear()
        _spans.cache_clear()


def learn_words(texts: DataFrame, column: str = "text") -> dict[str, int]:
    """Words of texts and of identifiers in code (runs of letters, cut where the case changes) with the number of texts they stand in, over all rows.

    At most ``MOST_WORDS`` of the most frequent leave the executors, a few hundred KB.
    """
    found = F.regexp_extract_all(F.col(column), F.lit(rf"[A-Z]?[a-z]{{1,{LONGEST - 1}}}|[A-Z]{{2,{LONGEST}}}(?![a-z])"), F.lit(0))
    each = texts.where(F.col(column).isNotNull()).select(F.explode(F.array_distinct(F.transform(F.array_distinct(found), lambda w: F.lower(w)))).alias("w"))
    counted = each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS)
    rows = counted.orderBy(F.desc("n"), "w").limit(MOST_WORDS).collect()
    return {r["w"]: r["n"] for k, r in enumerate(rows) if len(r["w"]) >= 4 or (len(r["w"]) >= 2 and k < SHORT_AMONG)}


def residual(literal: str) -> int:
    """Characters of the literal that no word, pronounceable word or separator explains, in the cheapest segmentation (Viterbi, whole length)."""
    return _residual(literal) if len(literal) <= 300 else _residual.__wrapped__(literal)


@functools.lru_cache(50_000)
def _residual(literal: str) -> int:
    words, longest = _Words.costs, _Words.longest
    n = len(literal)
    low = literal.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in literal)
    cost, back = [0.0] + [1e9] * n, [(0, 0)] * (n + 1)
    for i in range(n):
        here = cost[i]
        sep = literal[i] in _SEPARATORS
        step = here + (0.6 if sep else 2.0)
        if step < cost[i + 1]:
            cost[i + 1], back[i + 1] = step, (i, 0 if sep else 1)
        for j in range(i + 2, min(n, i + longest) + 1) if low[i].isalpha() else ():
            c = words.get(low[i:j])
            if c is not None and _CASED.match(literal[i:j]) and here + c < cost[j]:
                cost[j], back[j] = here + c, (i, 0)
        m = _SYLLABLES.match(low, i)
        if m:
            for j in range(i + 4, m.end() + 1, 2):
                c = here + 2.0 + 0.35 * (j - i)
                if c < cost[j] and _CASED.match(literal[i:j]):
                    cost[j], back[j] = c, (i, 0)
    left, at = 0, n
    while at:
        at, r = back[at]
        left += r
    return left


def spaced_residual(value: str) -> int:
    """Residual of a literal with blanks: of its words, those of running text, templates and addresses are explained as well."""
    left = 0
    for word in re.sub(r"\{\w*\}|%[sdr]\b|\$\w+|\w+://\S*", " ", value).split():
        bare = word.strip("""()[]{}<>.,;:!?"'`…""")
        pieces = [x for x in re.split(r"[-_./:@'’=,()\[\]]+|(?<=[a-z])(?=[A-Z][a-z])", bare) if x]
        if not all(_PLAIN_WORD.fullmatch(x) for x in pieces):
            left += residual(bare)
    return left


def dollar_reference(v: str) -> bool:
    """A value that begins with a variable: it alone, or with so little else that no credential is left beside it."""
    if re.fullmatch(r"\$\d|\$[A-Za-z_]\w*", v):
        return True
    # A name like a credential's own characters is no variable's, unless a field is asked for.
    rest = _VARIABLE.sub(lambda m: "" if m.group("name").isupper() or not m.group().endswith(m.group("name")) or residual(m.group("name")) < 3 else m.group(), v)
    return rest != v and residual(rest) < 3


def filler(value: str) -> bool:
    """Masked values, placeholders and references."""
    v = value.strip().strip("\"'`")
    low = v.lower()
    if not v or low in FILLERS or _MASKED.search(v) or _REFERENCE.search(v):
        return True
    if v[0] == "$" and not any(c.isspace() for c in v) and dollar_reference(v):
        return True
    if re.fullmatch(r"(?i)(?:your|my|some|the|insert|replace|enter|put|add|change)[-_ ].*", v) and not residual(v):
        return True
    return len(set(low)) <= 2 or bool(re.fullmatch(r"(?i)(?:true|false|yes|no|on|off|\d{1,6})", v))


def shows(value: str, least: int) -> bool:
    """Whether a literal in a credential's place gives access."""
    if filler(value):
        return False
    if any(c.isspace() for c in value.strip()):
        return spaced_residual(value) >= max(least, 3)
    left = residual(value)
    if left >= max(least, 3):
        return True
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and (any(c.isupper() for c in value) or any(not c.isalnum() for c in value))
    return left >= least and mixed


def about(key: str) -> bool:
    """The name tells something about a credential rather than holding one."""
    tail = re.split(r"[\W_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", key))
    return bool(tail) and (tail[-1].lower() in ABOUT or any(t.lower() in ("min", "max", "rotation") for t in tail))


def names_hash(key: str) -> bool:
    """The name is that of a hash: token_sha256, hashedPassword, md5_of_key; not hash_key, which is a key's."""
    parts = [x for x in re.split(r"[\W_]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key)) if x]
    while len(parts) > 1 and _HASH_TAIL.fullmatch(parts[-1]):
        parts.pop()
    is_hash = [bool(re.fullmatch(_HASH_WORD, x, re.I)) for x in parts]
    return bool(parts) and (is_hash[-1] or any(x.lower() == "hashed" for x in parts) or any(h and x.lower() == "of" for h, x in zip(is_hash, parts[1:], strict=False)))


def a_hash(value: str, before: str, behind: str) -> bool:
    """The value has a hash's form and the form itself, the name before it or a remark behind it says that it is one."""
    if _HASH_NAMED.match(value):
        return True
    if not _HASH_PLAIN.match(value):
        return False
    m = _LAST_NAME.search(before)
    return bool(m and names_hash(m.group(1))) or bool(_HASH_REMARK.match(behind))


def spans(excerpt: str | None, path: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each credential value that the excerpt shows."""
    if not excerpt:
        return []
    return list(_spans(excerpt, (path or "").replace("\\", "/")))


@functools.lru_cache(20_000)
def _spans(text: str, path: str) -> tuple[tuple[int, int], ...]:
    found: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        if b > a and not any(a < y and x < b for x, y in found):
            found.append((a, b))

    for m in _PEM.finditer(text):
        body = m.group("v")
        stop = body.find("-----END")
        shown = re.sub(r"\\[nr]|\s|-", "", body if stop < 0 else body[:stop])
        if not filler(shown) and residual(shown) >= 12:
            a = m.start("v")
            lead = len(body) - len(re.sub(r"^(?:\\[nr]|\s)+", "", body))
            add(a + lead, a + (len(body.rstrip(" \t\n\r-,;")) if stop < 0 else stop))
    for m in _ISSUED.finditer(text):
        if residual(m.group()) >= 8 and not filler(m.group()):
            add(*m.span())
    for m in _BASIC.finditer(text):
        try:
            plain = base64.b64decode(m.group("v") + "=" * (-len(m.group("v")) % 4)).decode()
        except (binascii.Error, UnicodeDecodeError, ValueError):
            plain = ""
        if ":" in plain and shows(plain.split(":", 1)[1], 2):
            add(*m.span("v"))
    for rx, least in _CONTEXTS:
        for m in rx.finditer(text):
            if shows(m.group("v"), least) and not a_hash(m.group("v"), text[: m.start("v")], text[m.end("v") :]):
                add(*m.span("v"))
    # Literals split into parts: joined they are one value; the credential's name may stand before or in a remark.
    for m in _PARTS.finditer(text):
        parts = [x for x in _PART.finditer(m.group())]
        joined = "".join(x.group(1) for x in parts)
        around = text[: m.start()] + " " + text[m.end() :]
        call = re.search(r"[.\w]+\s*\($", text[: m.start()]) and not re.search(r"(?i)join|concat|format", text[: m.start()])
        if not call and _NAME_RE.search(around) and shows(joined, 3) and not a_hash(joined, text[: m.start()], text[m.end() :]):
            for x in parts:
                add(m.start() + x.start(1), m.start() + x.end(1))
    for rx in (_ELEMENT, _PAIRED, _SPACED, _ASSIGNED):
        for m in rx.finditer(text):
            which = "quoted" if m.groupdict().get("quoted") is not None else "bare"
            value = m.groupdict().get(which)
            if not value or about(m.group("key")) or (which == "bare" and m.groupdict().get("next")):
                continue
            a, b = m.span(which)
            if which == "bare":
                value = value.rstrip(".")
                b = a + len(value)
            if _UUID.match(value):
                continue
            # A quote that closes a literal opens none: what follows it is code.
            if which == "quoted" and text[: a - 1].count(m.group("q")) % 2 and re.match(r"\s*(?:[,+;:)\]}.%&|?=]|$)", value):
                continue
            if shows(value, 2) and not a_hash(value, m.group("key"), text[b:]):
                add(a, b)
    if not found and (m := _TOKEN.match(text)) and _SECRET_PATH.search(path) and not _DIGEST_PATH.search(path.rpartition("/")[2]):
        if shows(m.group("v"), 8):
            add(*m.span("v"))
    return tuple(sorted(found))


def redact(excerpt: str, path: str | None = None, mask: str = MASK) -> str:
    out, at = [], 0
    for a, b in spans(excerpt, path):
        out += [excerpt[at:a], mask]
        at = b
    return "".join([*out, excerpt[at:]])


def find_credentials(findings: DataFrame, mask: str = MASK, words: dict[str, int] | None = None) -> DataFrame:
    """(finding_id, excerpt, redacted, n_values) of the findings whose excerpt shows a credential; ``words`` is a dictionary from ``learn_words``."""
    held = findings.sparkSession.sparkContext.broadcast(words)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use_words(held.value)
        for b in batches:
            rows = []
            for i, e, p in zip(b["finding_id"], b["excerpt"], b["path"], strict=True):
                if e and (s := spans(e, p)):
                    rows.append((i, e, redact(e, p, mask), len(s)))
            yield pd.DataFrame(rows, columns=["finding_id", "excerpt", "redacted", "n_values"])

    rows = findings.select("finding_id", "excerpt", "path").where("finding_id IS NOT NULL AND excerpt <> ''")
    gated = rows.where(F.col("excerpt").rlike(LINE_GATE) | F.coalesce(F.translate("path", "\\", "/").rlike(PATH_GATE), F.lit(False)))
    return gated.mapInPandas(scan, "finding_id bigint, excerpt string, redacted string, n_values int").dropDuplicates(["finding_id"])
