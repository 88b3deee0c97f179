"""Records that hold template residue, filler, error pages or notices instead of content.

Labelled residue exemplars are a table (kind, text) that the operator reads and puts into an inverted index. Every passage of a
record's visible text (windows of its sentences, and of its blocks for exemplars of several sentences; scripts, styles, code and comments left out) retrieves the
exemplars it shares words with and is compared by TF-IDF containment, both of the exemplar in the window and of the window in the
exemplar; the document frequencies of the exemplars' words are counted over all bodies of both tables. A record whose
visible words are mostly covered by such passages is residue. A notice inside a no-script element counts only if nothing else
is visible. Open template marks are exemplars as well: text and exemplars are spelled in shapes (the signs around a
name, without the name), the first shape retrieves the mark and the whole mark must be contained at one place in running text
or in a data field; one is enough. Marks in code, in scripts and in fetched source files are not looked at.

The counts leave the executors for the exemplars' words only, a vocabulary bounded by the exemplars. Bodies are read whole
and never shuffled.

Defined results: null and blank bodies are no residue; the status is not looked at; rows delivered twice count once, as
loaded last; wrongly decoded text is mended where it can be; a challenge header beside content decides nothing.
"""

from __future__ import annotations

import html
import json
import math
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTAINED, COVERED = 0.75, 0.35

#: The labelled exemplars that come with the package: a table (kind, text); another may be given to the operator.
TABLE = Path(__file__).parent / "data" / "residue_exemplars.tsv"
#: Words that a page may show beside a notice in its no-script element and still be an empty shell.
SHELL_WORDS = 3


def exemplars(path: str | Path = TABLE) -> list[tuple[str, str]]:
    rows = [line.split("\t", 1) for line in Path(path).read_text(encoding="utf-8").splitlines()[1:]]
    return [(r[0], r[1]) for r in rows if len(r) == 2 and r[1].strip()]


#: Words of the frame around a message; they count neither for nor against it.
CHROME = frozenset("error home reference id ray back menu ok warning detail".split())

_CLOSES = {"{{": "}}", "${": "}", "#{": "}", "{%": "%}", "<%": "%>", "[[": "]]", "%%": "%%", "@@": "@@", "*|": "|*", "__": "__"}
_NAMED = "|".join(
    rf"(?:{re.escape(o)}[-#/>&=]?\s*[A-Za-z][\w .\-]*?\s*(?:\|[^{{}}<>|\n]*?)?\s*-?{re.escape(c)})" for o, c in _CLOSES.items() if o != "__"
) + r"|(?<![A-Za-z0-9_])__[A-Z][A-Z0-9_]*?__(?![A-Za-z0-9])"
#: A name between brackets or repeated signs, whatever it is; else words, of which those at the end of a line are told.
_SHAPED = re.compile(rf"(?P<o>{_NAMED})" r"|\{(?P<d>\d{1,2})\}|(?<![\w\"'])%\((?P<p>[A-Za-z_]\w*)\)[sd]|\[(?P<b>[A-Z]{2,})\b[^\]\[\n]*\]|<\s*[A-Za-z][\w .\-]*? (?P<g>\w+ \w+)\s*>|(?P<w>[^\W_]+)(?P<e>[ \t]*[:.]?[ \t]*(?=$|\n|<))?")
SLOT = "~"


def shapes(text: str) -> Iterator[str]:
    """The text as words and shapes: a mark's signs without its name (``{{}}``), the first word in square brackets, the last two in angles.

    Words keep their case; one at the end of a line or before markup has a '$' behind it as well.
    """
    for m in _SHAPED.finditer(text):
        kind = m.lastgroup
        if kind == "w":
            yield m.group("w")
        elif kind == "e":
            yield m.group("w")
            yield "$"
        elif kind == "o":
            found = m.group()
            yield found[:2] + _CLOSES[found[:2]]
        elif kind == "d":
            yield "{9}"
        elif kind == "p":
            yield "%()"
        else:
            yield f"[{m.group('b')}]" if kind == "b" else f"<{m.group('g')}>"
            yield from re.findall(r"[^\W_]+", m.group())


_TOKEN = re.compile(r"[^\W_]+|\.{4,}|…+|\x00")
#: The end of a sentence among tokens.
END = "\0"
#: Ends of sentences: white space behind a sign, line ends, quotes and brackets; and a capital right behind a sign.
_SENTENCE = re.compile(r"[\n\r\"“”«»()]|\s(?<=[.!?:;]\s)")
_RUN_ON = re.compile(r"([.!?])(?=[A-ZÀ-Ý])")
_DROP = re.compile(r"(?is)<(script|style|template|svg|textarea)\b[^>]*>.*?</\1\s*>|<!--.*?-->")
_CODE = re.compile(r"(?is)<(pre|code|samp|kbd|xmp)\b[^>]*>.*?</\1\s*>|```.*?```|~~~.*?~~~|`[^`\n]*`")
_NOSCRIPT = re.compile(r"(?is)<noscript\b[^>]*>(.*?)</noscript\s*>")
_TITLE = re.compile(r"(?is)<(title|h[1-6])\b[^>]*>(.*?)</\1\s*>")
_NAV = re.compile(r"(?is)<(nav|footer)\b[^>]*>.*?</\1\s*>|<a\b[^>]*>.*?</a\s*>")
_BLOCK = re.compile(r"(?is)</?(?:p|div|li|td|th|tr|br|h\d|title|body|html|head|section|article|header|main|ul|ol|table|dt|dd|dl|option|label|button|form|nav|footer|entry|item|feed|error|code|message|requestid)\b[^>]*>")
_TAG = re.compile(r"(?s)<[A-Za-z/!?](?:[^<>]|\"[^\"]*\"|'[^']*')*>")
_HELD = re.compile(r"""(?i)\b(?:content|alt|title)=(?:"([^"]*)"|'([^']*)')""")
_HTML = re.compile(r"(?i)<(?:!doctype|html|head|body|p|div|h\d|b|\?xml|feed|error|form|span|table|ul)\b")
_ID = re.compile(r"^(?=.*\d)[0-9a-f]{6,}$|^\d+$")
_SOURCE_PATH = re.compile(r"(?i)(?:^|/)\.github/|\.(?:ya?ml|js|jsx|ts|tsx|mjs|cjs|py|rb|go|rs|java|kt|c|cc|cpp|h|hpp|cs|php|sh|bash|ps1|pl|lua|scala|sql|toml|ini|cfg|conf|tmpl|tpl|j2|jinja2?|erb|ejs|hbs|mustache|vue|tf|gradle|css|scss|less)(?:$|[?#])|(?:^|/)(?:Dockerfile|Makefile|Jenkinsfile)(?:$|[?#])")
_SOURCE_TYPE = re.compile(r"(?i)yaml|javascript|ecmascript|x-(?:python|sh|ruby|c|java|php)|css")
_WORKFLOW = re.compile(r"(?m)^\s*(?:runs-on|steps|jobs|on|uses|run)\s*:|^\s*-\s+(?:run|uses|name)\s*:")
_CODELIKE = re.compile(r"(?m)^\s*(?:#!|import \w|from \w+ import|package \w+;?$|#include|def \w+\(|class \w+|func \w+\(|const \w+\s*=|var \w+\s*=|let \w+\s*=|public |private )")
_MOJIBAKE = re.compile("[ÂÃâäåæçèéïðÐÑ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ ]{1,3}")


def mend(text: str) -> str:
    """Undo UTF-8 read as a one-byte code page, place by place."""

    def fix(m: re.Match) -> str:
        for page in ("cp1252", "latin-1"):
            try:
                return m.group().encode(page).decode("utf-8")
            except UnicodeError:
                continue
        return m.group()

    return _MOJIBAKE.sub(fix, text) if "Ã" in text or "Â" in text or "â" in text else text


_MARKS_OF_ACCENT = re.compile("[\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u302a-\u302f\u3099\u309a\ufe20-\ufe2f]+")


def tokens(text: str) -> list[str]:
    low = text.casefold().replace("_", " ")
    if not low.isascii():
        low = _MARKS_OF_ACCENT.sub("", unicodedata.normalize("NFKD", low))
    return _TOKEN.findall(low.replace("’", "").replace("'", ""))


def sentences(block: str) -> list[list[str]]:
    """The tokens of a block by sentences; the block is spelled once."""
    out: list[list[str]] = [[]]
    for t in tokens(_RUN_ON.sub(r"\1" + END, _SENTENCE.sub(END, block.replace(END, " ")))):
        if t == END:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def json_strings(value) -> Iterator[str]:
    """The strings of a parsed value in their order, however deep."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, dict):
            stack += reversed(v.values())
        elif isinstance(v, list):
            stack += reversed(v)


def parts(body: str, url: str | None = None, content_type: str | None = None, leads: Sequence[str] = ("",)) -> tuple[list[str], list[str], str, bool]:
    """(blocks, no-script blocks, running text for marks, is a source file) of a body; running text without any of ``leads`` is left out."""
    text = mend(body)
    bare = text.strip()
    if bare[:1] in "{[":
        try:
            strings = list(json_strings(json.loads(bare)))
        except (ValueError, RecursionError):
            strings = None
        if strings is not None:
            running = [_CODE.sub(" ", s) for s in strings]
            return running, [], "\n".join(running), False
    markup = bool(_HTML.search(text))
    path = (url or "").split("?", 1)[0]
    source = not markup and bool(_SOURCE_PATH.search(path) or _SOURCE_TYPE.search(content_type or "") and not re.search(r"(?i)\.(?:html?|json|xml|txt|md)$", path) or len(_WORKFLOW.findall(text)) >= 3 or len(_CODELIKE.findall(text)) >= 3)
    text = _DROP.sub(" ", text)
    # In an XML error the element <Code> holds the error's name.
    text = text if re.search(r"<Error>\s*<Code>", text) else _CODE.sub(" ", text) if markup else re.sub(r"(?s)```.*?```|`[^`\n]*`", " ", text)
    if not markup:
        return [text], [], "" if source else html.unescape(text), source
    hidden = [html.unescape(_TAG.sub(" ", x)) for x in _NOSCRIPT.findall(text)]
    text = _NOSCRIPT.sub(" ", text)
    shown = [x for x in html.unescape("\n".join(_TAG.sub(" ", t) for t in _BLOCK.split(_NAV.sub(" ", text)))).split("\n") if x.strip()]
    plain = html.unescape(text)
    wanted = any(x in plain for x in leads)
    # Attribute values are data fields as well (meta descriptions); so are titles, which are in the text.
    held = " ".join(a or b for a, b in _HELD.findall(text)) if wanted else ""
    running = "" if not wanted else html.unescape(re.sub(r"(?s)<(?=[A-Za-z/!?])(?![^<>]{0,40} goes here)(?:[^<>]|\"[^\"]*\"|'[^']*')*>", "\n", text)) + "\n" + html.unescape(held)
    heads = {" ".join(tokens(html.unescape(_TAG.sub(" ", x)))) for _, x in _TITLE.findall(text)}
    longest = 4 * max(map(len, heads), default=0) + 20
    body_blocks = [x for x in shown if len(x) > longest or " ".join(tokens(x)) not in heads]
    return (body_blocks if any(_words(x) for x in body_blocks) else shown), hidden, running, source


def _words(text: str) -> list[str]:
    return [t for t in tokens(text) if not _ID.match(t) and t not in CHROME]


class Index:
    """Inverted index over the exemplars with the corpus's document frequencies."""

    def __init__(self, df: dict[str, int] | None = None, n: int = 0, table: list[tuple[str, str]] | None = None):
        rows = exemplars() if table is None else table
        self.texts = [(kind, tokens(x)) for kind, x in rows if kind != "mark"]
        df = df or {}
        self.idf = {t: math.log((n + 2) / (df.get(t, 0) + 1)) + 0.3 for _, ts in self.texts for t in ts}
        self.unseen = math.log(n + 2) + 0.3
        self.postings: dict[str, set[int]] = defaultdict(set)
        self.sets = [set(ts) for _, ts in self.texts]
        # Exemplars of several sentences are sought over the ends of sentences as well.
        self.several = frozenset(i for i, x in enumerate(x for kind, x in rows if kind != "mark") if len(sentences(x)) > 1)
        self.mass = [sum(self.idf[t] for t in s) for s in self.sets]
        # How many words of an exemplar it takes at least to contain it.
        self.least = []
        for i, s in enumerate(self.sets):
            held, k = 0.0, 0
            for x in sorted((self.idf[t] for t in s), reverse=True):
                held, k = held + x, k + 1
                if held >= CONTAINED * self.mass[i] - 1e-9:
                    break
            self.least.append(k)
            # An exemplar is retrieved by its words that stand in no more than half of all bodies, and at least by its rarest ones, a
            # quarter of its mass and more, without which no passage contains it.
            held = 0.0
            for t in sorted(s, key=lambda t: (-self.idf[t], t)):
                if held <= (1 - CONTAINED) * self.mass[i] or df.get(t, 0) <= (n + 1) / 2:
                    self.postings[t].add(i)
                held += self.idf[t]
        self.words = frozenset(self.idf)
        # Marks are looked up by their first shape; one of a word alone counts at the end of a line only.
        self.marks: dict[str, list[list[str]]] = defaultdict(list)
        for kind, x in rows:
            if kind == "mark":
                seq = [SLOT if y == SLOT else y for part in x.split(SLOT) for y in (*(s for s in shapes(part) if s != "$"), SLOT)][:-1]
                seq = seq if len(seq) > 1 or not seq[0].isalpha() else [*seq, "$"]
                if not seq[0][0].isalnum():
                    seq = seq[:1]
                if seq not in self.marks[seq[0]]:
                    self.marks[seq[0]].append(seq)
        # What a text must hold somewhere to have a shape: the signs before its name, or its longest word.
        longest = lambda seq: max((w for w in seq if w not in (SLOT, "$")), key=len)
        lead = lambda x: "{" if x == "{9}" else "%(" if x == "%()" else x[:-1] if x[0] == "[" and x[1].isalnum() else x[1:-1] if x[0] == "<" and x[1].isalnum() else x[:2] if not x[0].isalnum() else x
        self.leads = sorted({lead(longest(seq)) for seqs in self.marks.values() for seq in seqs})

    def marked(self, running: str) -> bool:
        """Whether a mark exemplar is wholly contained in the running text, at one place; a slot stands for one to six words."""
        if not running or not any(x in running for x in self.leads):
            return False
        seen = list(shapes(running))
        for i, x in enumerate(seen):
            if x in self.marks and any(self._stands(seq, seen, i) for seq in self.marks[x]):
                return True
        return False

    @staticmethod
    def _stands(seq: list[str], seen: list[str], at: int) -> bool:
        for k, want in enumerate(seq):
            while want != "$" and at < len(seen) and seen[at] == "$" and k:
                return False
            if at >= len(seen):
                return False
            if want == SLOT:
                return any(Index._stands(seq[k + 1 :], seen, at + n) for n in range(1, 7) if "$" not in seen[at : at + n])
            if seen[at] != want:
                return False
            at += 1
        return True

    def covered(self, sentence: list[str], only: frozenset[int] | None = None) -> frozenset[int]:
        """Positions of the sentence's words that lie in a window contained in, or containing, an exemplar (of ``only`` these)."""
        best: set[int] = set()
        n = len(sentence)
        met = self.postings.keys() & sentence if len(sentence) < 40 else self.postings.keys() & set(sentence)
        if not met:
            return frozenset()
        near = set().union(*(self.postings[t] for t in met))
        for i in near if only is None else near & only:
            own = self.sets[i]
            hits = [k for k, t in enumerate(sentence) if t in own]
            need = min(2, len(own))
            if len(hits) < need:
                continue
            width = len(self.texts[i][1]) + 2
            shared = sum(self.idf[t] for t in {sentence[k] for k in hits})
            whole = shared >= CONTAINED * self.mass[i]
            # So many words of the exemplar must lie in one window: those that make up its mass, or half of the window.
            least = -(-min(width, n) // 2)
            least = max(need, min(least, self.least[i]) if whole else least)
            if not any(y - x < width for x, y in zip(hits, hits[least - 1 :], strict=False)):
                continue
            last, end = -1, 0
            # A window begins with a word of the exemplar (or as late as one can); it holds the exemplar, or is mostly made of its words.
            for j, k in enumerate(hits):
                a = min(k, max(0, n - width))
                if a == last:
                    continue
                last = a
                while end < len(hits) and hits[end] < a + width:
                    end += 1
                first = j if hits[j] == a else bisect_left(hits, a)
                inside = hits[first:end]
                size = min(width, n - a)
                if len(inside) < least:
                    continue
                found = {sentence[x] for x in inside}
                if len(found) < need:
                    continue
                mass = sum(self.idf[t] for t in found)
                if (whole and mass >= CONTAINED * self.mass[i]) or (size >= 3 and mass >= CONTAINED * sum(self.idf.get(t, self.unseen) for t in set(sentence[a : a + size]))):
                    best.update(inside)
        return frozenset(best)

    def share(self, blocks: list[str]) -> float:
        """Share of the words of the blocks that residue passages cover; 0 if it cannot reach ``COVERED``."""
        counts = lambda ts: [t not in CHROME and (t.isalpha() or not _ID.match(t)) for t in ts]
        # Covered are words of exemplars only: where too few of those that are left may be, the rest need not be looked at.
        may = lambda ts, c: sum(1 for t, k in zip(ts, c, strict=True) if k and (t in self.words or not t[0].isalnum()))
        spelled = [(block, ts := tokens(block.replace(END, " ")), counts(ts)) for block in blocks]
        words = sum(sum(c) for _, _, c in spelled)
        left = sum(may(ts, c) for _, ts, c in spelled)
        enough, hit = COVERED * words, 0
        if not words or left < enough:
            return 0.0
        for block, whole, c in spelled:
            ss = sentences(block)
            over = self.covered(whole, self.several) if len(ss) > 1 else frozenset()
            at = 0
            for s in ss:
                end = at + len(s)
                marked, own = self.covered(s), c[at:end]
                hit += sum(1 for k, t in enumerate(s) if own[k] and (k in marked or at + k in over or not t[0].isalnum()))
                left -= may(s, own)
                at = end
                if hit + left < enough:
                    return 0.0
        return hit / words

    def residue(self, body: str | None, url: str | None = None, content_type: str | None = None) -> tuple[str, float] | None:
        """(kind of evidence, share) if the record is residue."""
        if not body or not body.strip():
            return None
        blocks, hidden, running, source = parts(body, url, content_type, self.leads)
        if self.marked(running):
            return "mark", 1.0
        if source:
            return None
        visible = [b for b in blocks if tokens(b)]
        share = self.share(visible)
        if share >= COVERED:
            return "passage", share
        if hidden and sum(len(_words(b)) for b in visible) <= SHELL_WORDS and (share := self.share(hidden)) >= COVERED:
            return "notice", share
        return None


def records(responses: DataFrame, raw_bodies: DataFrame) -> DataFrame:
    """Both tables as (tab, rec_id, at, url, content_type, body), as delivered; rows without an id are left out."""
    a = responses.select(F.lit("responses").alias("tab"), F.col("resp_id").alias("rec_id"), *at_of(responses, "loaded_at"), "url", F.element_at("headers", "content-type").alias("content_type"), F.col("body"))
    b = raw_bodies.select(F.lit("raw_bodies").alias("tab"), F.col("body_id").alias("rec_id"), *at_of(raw_bodies, "fetched_at"), "url", "content_type", F.col("text").alias("body"))
    return a.unionByName(b).where(F.col("rec_id").isNotNull())


def at_of(df: DataFrame, column: str) -> list:
    return [(F.col(column).cast("timestamp") if column in df.columns else F.lit(None).cast("timestamp")).alias("at")]


def document_frequencies(rows: DataFrame, table: list[tuple[str, str]]) -> tuple[dict[str, int], int]:
    """In how many bodies each word of the exemplars occurs, and the number of bodies that are not blank; built-in expressions only."""
    known = sorted({t for kind, x in table if kind != "mark" for t in tokens(x)})
    low = F.lower("body")
    plain = F.when(F.octet_length("body") == F.length("body"), F.replace(low, F.lit("'"), F.lit(""))).otherwise(F.translate(low, "àâáäçéèêëíìîïñóòôöúùûüÿæœ'’", "aaaaceeeeiiiinoooouuuuyao"))
    words = F.array_intersect(F.split(plain, "[^a-z0-9]+"), F.array(*map(F.lit, known)))  # the exemplars' words without accents
    bodies = rows.where(F.col("body").rlike(r"\S"))
    got = {r["t"]: r["n"] for r in bodies.select(F.explode(F.concat(words, F.array(F.lit("")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as the exemplars have words
    return got, got.pop("", 0)


def find_residue(responses: DataFrame, raw_bodies: DataFrame, table: list[tuple[str, str]] | None = None) -> DataFrame:
    """(tab, rec_id, evidence, share) of the records to exclude; of what was delivered twice the row loaded last counts.

    Bodies are judged where they lie: only ids and evidence are shuffled.
    """
    table = exemplars() if table is None else table
    rows = records(responses, raw_bodies)
    df, n = document_frequencies(rows, table)
    built: list[Index] = []

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not built:
            built.append(Index(df, n, table))
        for b in batches:
            out = [built[0].residue(body, u, c) or (None, None) for u, c, body in zip(b["url"], b["content_type"], b["body"], strict=True)]
            yield pd.DataFrame({"tab": b["tab"], "rec_id": b["rec_id"], "at": b["at"], "evidence": [x[0] for x in out], "share": pd.Series([x[1] for x in out], dtype="float64")})

    judged = rows.mapInPandas(judge, "tab string, rec_id bigint, at timestamp, evidence string, share double")
    last = judged.groupBy("tab", "rec_id").agg(F.max_by(F.struct("evidence", "share"), F.struct("at", "evidence")).alias("v"))
    return last.where("v.evidence IS NOT NULL").select("tab", "rec_id", "v.evidence", "v.share")
