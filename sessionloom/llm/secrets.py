"""Credentials embedded in source code and configuration: find and redact.

Per Arrow batch a trigram index is built over the texts, every detection regex
is planned as a formula over required trigrams, postings are intersected, and
only candidate texts are verified, each as a whole.

Defined cases: unreadable lines and lines without text give no rows; a match
may be of any length; overlapping findings keep the first of
private key, known token, password, assigned token; equal credentials at
several places count each time; a key block without an end reaches to the end
of its text.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.records import batch_of, column, parse
from sessionloom.llm import trigrams
from sessionloom.llm.texts import replace_at, texts_of

_END = r"(?![A-Za-z0-9_\-])"
_START = r"(?<![A-Za-z0-9_\-])"
_VALUE = r"(?P<v>[A-Za-z0-9+/_.=\-]{16,})"
_NAME = r"(?:[Aa][Pp][Ii][_\-]?[Kk][Ee][Yy]|[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Aa][Uu][Tt][Hh][_\-]?[Kk][Ee][Yy]|[Aa][Cc][Cc][Ee][Ss][Ss][_\-]?[Kk][Ee][Yy])"
_PASS = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Pp][Aa][Ss][Ss][Pp][Hh][Rr][Aa][Ss][Ee]|_[Pp][Aa][Ss][Ss]|[Pp][Ww][Dd])"

#: (kind, pattern) in order of precedence; group v is the credential itself.
PATTERNS = [
    ("private_key", r"(?P<v>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN )[\s\S])*?(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z|(?=-----BEGIN )))"),
    # tokens that carry their issuer's mark
    ("key_or_token", _START + r"(?P<v>gh[opsur]_[A-Za-z0-9]{20,})" + _END),
    ("key_or_token", _START + r"(?P<v>github_pat_[A-Za-z0-9_]{20,})" + _END),
    ("key_or_token", _START + r"(?P<v>glpat-[A-Za-z0-9_\-]{18,})" + _END),
    ("key_or_token", _START + r"(?P<v>[srp]k_(?:live|test)_[A-Za-z0-9]{16,})" + _END),
    ("key_or_token", _START + r"(?P<v>sk-[A-Za-z0-9_\-]{20,})" + _END),
    ("key_or_token", _START + r"(?P<v>A(?:KIA|SIA)[0-9A-Z]{16})" + _END),
    ("key_or_token", _START + r"(?P<v>AIza[0-9A-Za-z_\-]{30,})" + _END),
    ("key_or_token", _START + r"(?P<v>xox[a-z]-[0-9A-Za-z\-]{20,})" + _END),
    ("key_or_token", _START + r"(?P<v>eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})" + _END),
    ("key_or_token", _START + r"(?P<v>(?:npm|pypi|dop_v1|hf|shpat|sq0atp|SG)[_\-.][A-Za-z0-9_\-.]{20,})" + _END),
    # passwords
    ("password", _PASS + r"""["']?[ \t]*(?:=>|:=|[:=])[ \t]*[rbuf]?(?P<q>["'])(?P<v>[^"'\n]{4,})(?P=q)"""),
    ("password", _PASS + r"""[ \t]*[:=][ \t]*(?P<v>[^\s"'<>;,(){}]{4,})(?=[\s;,"'<]|\Z)"""),
    ("password", r"<[Pp]ass(?:word|wd)>(?P<v>[^<\n]{4,})</"),
    ("password", r"(?:machine|login)[ \t]+\S+(?:[ \t]+login[ \t]+\S+)?[ \t]+password[ \t]+(?P<v>\S{4,})"),
    ("password", r"(?:mysql|mysqldump|mariadb)[ \t][^\n]*?[ \t]-p(?P<v>[^\s\-]\S{3,})"),
    ("password", r"""login\([ \t]*["'][^"'\n]*["'][ \t]*,[ \t]*["'](?P<v>[^"'\n]{4,})["']"""),
    ("password", r"[a-z][a-z0-9+.\-]*://[^\s/:@\"']*:(?P<v>[^\s/@\"']{3,})@[A-Za-z0-9]"),
    # tokens named by what they are assigned to
    ("key_or_token", _NAME + r"""[A-Za-z_]*["']?[ \t]*(?:=>|:=|[:=])[ \t]*(?:[rbuf]?["'])?""" + _VALUE),
    ("key_or_token", r"Bearer[ \t]+" + _VALUE),
    ("key_or_token", r"[a-z]+://(?P<v>[A-Za-z0-9_\-.+=%]{16,})@[A-Za-z0-9]"),
    ("key_or_token", r"""(?:value|key)["']?[ \t]*:[ \t]*["']?(?P<v>[A-Za-z0-9+/_.=\-]{16,})["']?,?[ \t]+(?:#|//)[^\n]*(?:[Kk]ey|[Tt]oken|[Ss]ecret)"""),
    # a prefix, a mark and a long mixed run
    ("key_or_token", _START + r"(?P<v>[a-z]{2,8}[_\-][A-Za-z0-9]{24,})" + _END),
    ("key_or_token", r"""(?<![A-Za-z0-9_])(?:[A-Z][A-Za-z0-9_]*|[a-z_]*(?:connect|auth|login|client|session)[a-z_]*)\([ \t]*["'](?P<v>[A-Za-z0-9+/_.=\-]{20,})["']"""),
    ("key_or_token", r"""(?m:^[ \t]*(?:-[ \t]+["']?|["'])(?P<v>[A-Za-z0-9+/_.=\-]{32,})["']?,?[ \t]*$)"""),
]

_BLANKED = re.compile(r"^(?:(.)\1*|[xX*.\-_]+|[x*]{3,}.*|.*[x*]{6,}|(?i:change[_\-]?me|your.*|example|redacted|none|null|true|false|todo|secret|password|token))$")
_REFERENCE = re.compile(r"^(?:\$|\{\{|<|%\(|%[A-Z_]+%)|(?:environ|getenv|process\.env|getpass|vault|secrets?/|ssm:|arn:)|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$|^[a-z_]+\(|^(?:self|str|int|None|user|args|options|config)\b")
_SHAPED = re.compile(r"^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|sha\d+[-:].*|(?:toolu|msg|req|agent|srvtoolu|call)[_\-].*)$")


_SYLLABLES = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{2,}(?=[_\-./]|$)")


def _is_random(value: str) -> bool:
    """Letters in an order of cases that no joined words have."""
    return len(re.sub(r"[^A-Za-z]", "", _SYLLABLES.sub("", value))) >= 8


def _is_credential(kind: str, value: str, known: bool) -> bool:
    if kind == "private_key":
        return True
    if _BLANKED.match(value) or _REFERENCE.search(value) or _SHAPED.match(value):
        return False
    if kind == "password":
        return not (value.isdigit() and len(value) < 6) and not value.endswith("(")
    if known:
        return True
    if not any(c.isalpha() for c in value) or not (any(c.isdigit() for c in value) or _is_random(value)):
        return False
    words = re.split(r"[_\-./]", value)
    return not (len(words) > 2 and all(w.isalpha() or w.isdigit() for w in words)) and len(set(value)) >= 8


KNOWN = 11  #: the patterns up to here carry their own proof
PLANS, GRAMS = trigrams.compiled(PATTERNS)


_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_CLOSE = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|(?=-----BEGIN )")
#: patterns that begin with a run of these before "://", and the run's first letter
_RUNS = {r"[a-z][a-z0-9+.\-]*://": re.compile(r"[a-z0-9+.\-]"), r"[a-z]+://": re.compile(r"[a-z]")}


def _key_blocks(text: str):
    """What the private key pattern finds, in memory that a block's length doesn't raise."""
    at = 0
    while m := _BEGIN.search(text, at):
        end = _CLOSE.search(text, m.end())
        at = end.end() if end else len(text)
        yield m.start(), at


def _by_scheme(regex: re.Pattern, run: re.Pattern, text: str):
    """finditer from each "://" backwards: a long run of letters is read once."""
    done, mark = 0, text.find("://")
    while mark >= 0:
        first = mark
        while first > done and run.match(text, first - 1):
            first -= 1
        while first < mark and not "a" <= text[first] <= "z":
            first += 1
        m = regex.match(text, first) if first < mark else None
        if m:
            yield m.span("v")
            done = m.end()
        else:
            done = max(done, mark)
        mark = text.find("://", max(mark + 1, done))


def _by_line(regex: re.Pattern, text: str):
    """finditer of a pattern within one line: where a match fails, those that
    begin later on the line fail too."""
    start = re.compile(r"(?:mysql|mysqldump|mariadb)[ \t]")
    at = 0
    while m := start.search(text, at):
        if found := regex.match(text, m.start()):
            yield found.span("v")
            at = found.end()
        else:
            at = text.find("\n", m.end())
            if at < 0:
                return


def _spans(which: int, text: str):
    """Spans of the credential in each match of a pattern, in linear time."""
    regex = PLANS[which][1]
    if PLANS[which][0] == "private_key":
        return _key_blocks(text)
    for prefix, run in _RUNS.items():
        if regex.pattern.startswith(prefix):
            return _by_scheme(regex, run, text)
    if regex.pattern.startswith("(?:mysql|"):
        return _by_line(regex, text)
    return (m.span("v") for m in regex.finditer(text))


def verify(text: str, which: list[int]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the credentials that the given patterns find."""
    taken: list[tuple[int, int, str]] = []  # sorted, none overlaps another
    for i in which:
        kind = PLANS[i][0]
        for a, b in _spans(i, text):
            k = bisect_left(taken, (b,))
            if k and taken[k - 1][1] > a:
                continue
            if _is_credential(kind, text[a:b], i < KNOWN):
                taken.insert(k, (a, b, kind))
    return taken


def scan(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Credentials of each text, by index, postings and verification."""
    index = trigrams.Index(texts, GRAMS)
    hits: list[list[int]] = [[] for _ in texts]
    for p, (_, _, formula) in enumerate(PLANS):
        for c in index.candidates(formula).nonzero()[0].tolist():
            hits[c].append(p)
    return [verify(t, h) if h else [] for t, h in zip(texts, hits)]


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each credential replaced; quotes and code around it stay."""
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], f"<REDACTED:{kind}>"]
        last = b
    return "".join([*out, text[last:]])


FOUND = pa.schema([("line_id", pa.int64()), ("secret_kind", pa.string()), ("nth", pa.int32())])


def found(lines: DataFrame, *, id_col="line_id", raw_col="raw") -> DataFrame:
    """(line_id, secret_kind, nth) of every credential."""

    def run(batches):
        for batch in batches:
            ids, texts = [], []
            for line_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = parse(raw)
                if record is not None:
                    for _, t in texts_of(record, last_prompt=False):
                        ids.append(line_id)
                        texts.append(t)
            counts: dict[tuple, int] = {}
            out = []
            for line_id, spans in zip(ids, scan(texts)):
                for _, _, kind in spans:
                    n = counts[line_id, kind] = counts.get((line_id, kind), 0) + 1
                    out.append((line_id, kind, n))
            yield batch_of(FOUND, out)

    source = lines.select(F.col(id_col).cast("bigint").alias("line_id"), F.col(raw_col).alias("raw"))
    return source.mapInArrow(run, "line_id bigint, secret_kind string, nth int")


def redact(lines: DataFrame, *, id_col="line_id", raw_col="raw") -> DataFrame:
    """(line_id, raw) with every credential replaced; other lines unchanged."""
    schema = pa.schema([("line_id", pa.int64()), ("raw", pa.string())])

    def run(batches):
        for batch in batches:
            raws = batch.column(1).to_pylist()
            places, texts = [], []
            records = [parse(r) for r in raws]
            for i, record in enumerate(records):
                if record is not None:
                    for path, t in texts_of(record, last_prompt=True):
                        places.append((i, path))
                        texts.append(t)
            changed = set()
            for (i, path), t, spans in zip(places, texts, scan(texts)):
                if spans:
                    replace_at(records[i], path, redact_text(t, spans))
                    changed.add(i)
            out = [json.dumps(records[i], ensure_ascii=False, separators=(",", ":")) if i in changed else r for i, r in enumerate(raws)]
            yield pa.RecordBatch.from_arrays([batch.column(0), column(out, pa.string())], schema=schema)

    source = lines.select(F.col(id_col).cast("bigint").alias("line_id"), F.col(raw_col).alias("raw"))
    return source.mapInArrow(run, "line_id bigint, raw string")
