"""Secret scan with a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query over lower-cased trigrams that every match must hold. A
block of texts is indexed once: for each trigram of any query the sorted numbers of the texts that hold it. A query is
evaluated by intersecting and uniting those postings, and only the texts left are verified with the expression itself.
A rule without mandatory trigrams scans every text.

Spans are found per rule, leftmost and without overlap; a match that is too short is dropped after it was found. Offsets
are code points, the end exclusive. Base rules: ``assign``, ``access``, ``hex``; all others come after them. Where a rule
begins with a long run of characters, its ``anchor`` behind that run is looked for and the run is read backwards from it,
so that a text takes time in proportion to its length whatever it holds.

Edge cases: a null text is an empty one and has no span. Repeated rows are scanned alike. Very long texts are scanned
whole. Columns that are kept stay as they are, but one named ``spans``, which the result replaces (the pipeline's stage
keeps it). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from re import _constants as C
from re import _parser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamcover.llm.common import CONTINUATION, add_columns, code_points, free_prefix, quoted, read_table, shared

#: Character classes of up to so many characters are spelled out in a query.
WIDE = 8
#: Exact strings of an expression are followed up to so many.
MANY = 64
FIELDS = {"spans": "array<struct<kind:string,start:long,end:long>>"}


@dataclass(frozen=True)
class Rule:
    """group: the part whose length counts; least: characters it needs. A pattern of the form ``head run* anchor ...``
    may name these three: the anchor's bytes, the run's characters, none of them the anchor's first, and the head."""

    kind: str
    pattern: bytes
    group: int = 0
    least: int = 1
    flags: int = 0
    base: bool = False
    anchor: bytes = b""
    run: bytes = b""
    head: bytes = b""


#: Characters of tokens and of the names of protocols.
NAME = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
SCHEME = b"abcdefghijklmnopqrstuvwxyz0123456789+.-"

#: The base kinds and published formats of credentials.
RULES = (
    Rule("assign", rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.IGNORECASE, True),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 16, 0, True),
    Rule("hex", rb"[0-9a-f]+", 0, 32, 0, True),
    Rule("private_key", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", rb"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", anchor=b".eyJ", run=NAME, head=rb"eyJ[A-Za-z0-9_-]"),
    Rule("stripe", rb"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("url_password", rb"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@", anchor=b"://", run=SCHEME, head=rb"[a-z]"),
)


@dataclass
class Query:
    """What a match holds: ``all`` trigrams and, of each set in ``any``, one of the queries."""

    all: set[bytes] = field(default_factory=set)
    any: list[list[Query]] = field(default_factory=list)

    def empty(self) -> bool:
        return not self.all and not self.any

    def trigrams(self) -> set[bytes]:
        return self.all.union(*[q.trigrams() for part in self.any for q in part])


def trigram_query(pattern: bytes, flags: int = 0) -> Query:
    """The query of an expression: a text without it can't match."""
    query = Query()
    runs = _walk(_parser.parse(pattern.decode("latin-1"), flags & ~re.ASCII), query)
    _close(runs, query)
    return query


def _close(runs: set[str], query: Query) -> None:
    """Adds what follows from one of the strings being held."""
    each = [{s[i : i + 3].encode("latin-1") for i in range(len(s) - 2)} for s in {r.lower() for r in runs}]
    if not each or not all(each):
        return
    if len(each) == 1:
        query.all |= each[0]
    else:
        query.any.append([Query(all=e) for e in each])


def _walk(parsed, query: Query, runs: set[str] | None = None) -> set[str]:
    """Follows the strings that may stand just before; what is certain goes to the query."""
    runs = {""} if runs is None else runs
    for op, arg in parsed:
        options: set[str] | None = None
        if op is C.LITERAL:
            options = {chr(arg)}
        elif op is C.IN and (chars := _spelled(arg)):
            options = chars
        elif op is C.SUBPATTERN:
            runs = _walk(arg[3], query, runs)
            continue
        elif op is C.BRANCH:
            inner = [Query() for _ in arg[1]]
            ends = [_walk(branch, q, set(runs)) for branch, q in zip(arg[1], inner, strict=True)]
            if all(q.empty() for q in inner):
                runs = set().union(*ends)
                continue
            for e, q in zip(ends, inner, strict=True):
                _close(e, q)
            if not any(q.empty() for q in inner):
                query.any.append(inner)
            runs = {""}
            continue
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, what = arg
            if (low, high) == (0, 1):
                ends = _walk(what, Query(), set(runs))
                runs = runs | ends if len(runs | ends) <= MANY else _cut(runs, query)
                continue
            for _ in range(min(low, 3)):
                runs = _walk(what, query, runs)
            if (low, high) != (low, low) or low > 3:
                runs = _cut(runs, query)
            continue
        elif op is C.AT:
            continue
        if options is None or len(runs) * len(options) > MANY:
            runs = _cut(runs, query)
        else:
            runs = {r + o for r in runs for o in options}
    return runs


def _cut(runs: set[str], query: Query) -> set[str]:
    _close(runs, query)
    return {""}


def _spelled(items) -> set[str]:
    chars: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            chars.add(chr(arg))
        elif op is C.RANGE and arg[1] - arg[0] < WIDE:
            chars |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return set()
    return chars if len(chars) <= WIDE else set()


class Scanner:
    """Indexes blocks of texts and verifies the rules' candidates."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]
        self.codes = sorted({t for _, _, q in self.rules for t in q.trigrams()})
        self.number = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(self.codes):
            self.number[int.from_bytes(t)] = k + 1

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """For each trigram of a query the sorted numbers of the texts that hold it, letters taken as lower case."""
        line = np.frombuffer(b"\n".join(texts).lower(), np.uint8).astype(np.uint32)
        if len(line) < 3:
            return {t: np.zeros(0, np.int64) for t in self.codes}
        found = self.number[(line[:-2] << 16) | (line[1:-1] << 8) | line[2:]]
        at = np.flatnonzero(found)
        ends = np.cumsum([len(t) + 1 for t in texts])
        pair = np.unique(found[at].astype(np.int64) * (len(texts) + 1) + np.searchsorted(ends, at, side="right"))
        cuts = np.searchsorted(pair // (len(texts) + 1), np.arange(1, len(self.codes) + 2))
        return {t: pair[cuts[k] : cuts[k + 1]] % (len(texts) + 1) for k, t in enumerate(self.codes)}

    def candidates(self, query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        out = np.arange(n)
        for t in sorted(query.all, key=lambda x: len(postings[x])):
            out = np.intersect1d(out, postings[t], assume_unique=True)
        for part in query.any:
            either = np.unique(np.concatenate([self.candidates(q, postings, n) for q in part]))
            out = np.intersect1d(out, either, assume_unique=True)
        return out

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, str, bool]]]:
        """Byte spans (start, end, kind, base) of each text, by start, then by the order of the rules."""
        postings = self.postings(texts)
        out: list[list[tuple]] = [[] for _ in texts]
        for order, (rule, regex, query) in enumerate(self.rules):
            for i in self.candidates(query, postings, len(texts)).tolist():
                for m in matches(texts[i], rule, regex, query):
                    if len(m.group(rule.group).translate(None, CONTINUATION)) >= rule.least:
                        out[i].append((m.start(), order, m.end(), rule.kind, rule.base))
        return [[(a, b, kind, base) for a, _, b, kind, base in sorted(found)] for found in out]

    def __call__(self, texts: list[bytes | None]) -> dict[str, list]:
        whole = [t or b"" for t in texts]
        out = []
        for t, spans in zip(whole, self.spans(whole), strict=True):
            places = code_points(t, [x for a, b, *_ in spans for x in (a, b)])
            out.append([{"kind": s[2], "start": a, "end": b} for s, a, b in zip(spans, places[::2], places[1::2], strict=True)])
        return {"spans": out}


def matches(text: bytes, rule: Rule, regex: re.Pattern, query: Query):
    """All matches of a rule, leftmost and without overlap."""
    if rule.anchor:
        return _anchored(text, rule, regex)
    return _long_runs(text, rule, regex) if query.empty() else regex.finditer(text)


def _anchored(text: bytes, rule: Rule, regex: re.Pattern):
    """The same by the anchors. The run before an anchor ends where the text between it and the last one has another
    character; if the run's first head begins no match, no other one does, as what follows the anchor is the same."""
    head, low = re.compile(rule.head), 0
    at = text.find(rule.anchor)
    while at >= 0:
        run = low + len(text[low:at].rstrip(rule.run))
        first = head.search(text, run, at)
        m = regex.match(text, first.start()) if first else None
        if m:
            yield m
        low = m.end() if m else at + 1
        at = text.find(rule.anchor, max(low, at + 1))


def _long_runs(text: bytes, rule: Rule, regex: re.Pattern):
    """All matches of a rule that scans whole texts; a repeated class is asked for its least length at once, as a
    shorter run of it can't be a part of a longer match."""
    if rule.group == 0 and re.fullmatch(rb"\[[^\]]+\]\+", rule.pattern):
        regex = re.compile(rule.pattern[:-1] + b"{%d,}" % rule.least, rule.flags)
    return regex.finditer(text)


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df``'s kept columns and ``spans`` (kind, start, end), ordered by start, then by the rules' order."""
    scanner = shared(df.sparkSession, rules, Scanner)
    return add_columns(df, text, lambda texts: scanner()(texts), FIELDS, keep)


def joined(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    kinds = [r.kind for r in RULES if r.base]
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(line(F.filter("spans", lambda s: s.kind.isin(kinds))), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def redact(text: bytes, spans: list[tuple[int, int, str, bool]]) -> bytes:
    """The text with each run of overlapping spans replaced by <secret>."""
    out, at = [], 0
    for a, b, *_ in sorted(spans):
        if a >= at:
            out += [text[at:a], b"<secret>"]
        at = max(at, b)
    return b"".join([*out, text[at:]])


def redaction_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced in the text; n_chars is the new length where the text changed."""
    scanner = shared(spark, RULES, Scanner)

    def run(texts):
        found = scanner().spans([t or b"" for t in texts])
        return {"clean": [redact(t, s).decode("utf-8", "replace") if s else None for t, s in zip(texts, found, strict=True)]}

    own = free_prefix(docs.columns)
    clean, new = add_columns(docs, "text", run, {"clean": "string"}, prefix=own), F.col(f"{own}clean")
    changes = {"text": F.coalesce(new, "text")}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(new.isNotNull(), F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumns(changes).select(*map(quoted, docs.columns))


def digest(line: str) -> str:
    return hashlib.sha256(line.encode()).hexdigest()
