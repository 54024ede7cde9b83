"""Personal information inside free text: find it, label it consistently, and
replace it with typed placeholders.

Candidates of each kind come from shapes; a skip-chain conditional random field
(``crf``) over the candidates of a line decides.  Name candidates also use two
lexicons (given and family names; sent to the tasks up to a checked size, met by a
join beyond it) learned beforehand from all lines: tokens that
stand where names are introduced ("reported by", "attention", a title, a
contact field), weighed against all their other capitalised uses.  There are no
labelled rows to fit weights on, so the potentials are stated parameters.

Defined cases: unreadable lines and texts without candidates give no rows; equal
mentions count each time; a name inside an e-mail address is part of the
address; an address over two lines is one case; overlapping candidates keep the
likelier, then the longer, then the earlier.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.records import batch_of, column, parse
from sessionloom.llm import crf
from sessionloom.llm.texts import replace_at, texts_of
from sessionloom.plans.runtime import stage

LEAST_SEEN, LEAST_SHARE = 2, 0.1  #: introductions of a token, and their share of its uses
SENT = 300_000  #: names up to which the lexicons are sent to the tasks; beyond it lines meet theirs by a join

EMAIL = re.compile(r"(?<![\w.+%-])(?:mailto:)?[\w.+%-]+@(?:[\w-]+\.)+[A-Za-z]{2,}(?![\w-]|:[\w/~])")
WORDED_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+ at (?:[\w-]+ dot )+(?:[a-z]{2,6})(?!\w)")
SPELT_EMAIL = re.compile(r"(?<![\w.+%-])(?:mailto:)?[\w.+%-]+ ?[\[({<]at[\])}>] ?[\w-]+(?:(?:\.| ?[\[({<]dot[\])}>] ?)[\w-]+)+")
PHONE = re.compile(
    r"(?<![\w.+/=-])(?:"
    r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,5}){1,4}"
    r"|\(\d{3}\) ?\d{3}[-. ]\d{4}"
    r"|\d{3}[-.]\d{3}[-.]\d{4}"
    r"|0\d{2,4} \d{3,4} \d{3,4}"
    r"|(?P<bare>\d{3} \d{3} \d{4})"
    r")(?: ?(?:ext\.?|x) ?\d{1,5})?(?![\w-]|\.\d)"
)
ID_NUMBER = re.compile(
    r"(?<![\w-])(?:(?P<ssn>\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})"
    r"|(?P<run>(?<=is )\d{9}|(?<=: )\d{9}|(?<=#)\d{9}|(?<=no\. )\d{9})"
    r"|(?P<ni>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])"
    r"|(?P<card>[A-Z]\d{2}[A-Z]\d{4}[A-Z]\d)"
    r"|(?P<passport>[A-Z]\d{8}|(?<=passport no\. )[A-Z0-9]{7,9}))(?![\w-])"
)
PHONE_CUE = re.compile(r"(?i)\b(?:phone|tel|telephone|mobile|cell|call|fax|ring|text|reach|number)\b")
ID_CUE = re.compile(r"(?i)passport|national|\bid\b|identity|insurance|social security|\bssn\b|\bni\b|tax|licen[cs]e|citizen|resident|birth")
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Close|Court|Ct|Lane|Ln|Terrace|Boulevard|Blvd|Drive|Dr|Way|Place|Pl|Square|Sq|Crescent|Gardens|Row|Hill|Walk|Mews|Parade)"
_CAP = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'-]+"
ADDRESS = re.compile(
    rf"(?<![\w.-])(?:Flat \d+[A-Za-z]?, ?)?\d{{1,5}}[a-z]? (?:{_CAP} ){{1,3}}{_STREET}\b\.?(?:, ?(?:Apt|Unit|Suite|Flat)\.? ?\w+)?(?:,?[ \n]\s*{_CAP}(?: \d{{5}}\b)?(?=[\s.,\"');]|$))?"
    r"|(?<!\w)(?:[A-ZÄÖÜ][a-zäöüß-]+(?:straße|strasse|weg|gasse|zeile|platz|allee|ufer|ring|damm|graben|steig|markt|hof|wall|chaussee)|(?:Rua|Avenida|Av\.|Calle|Carrer|Via|Viale|Piazza|Plaza|Praça|Rue|Place|Quai|ul\.|Ulica)(?: (?:d[aeiou]s?|del|della|de la|de|du|des|l'))*(?: [A-ZÀ-ÖØ-Þ][\wà-öø-ÿ'-]+){1,3},?|(?:Am|An der|An den|Im|In der|Auf dem|Zum|Zur|Unter den) (?:[A-ZÄÖÜ][a-zäöüß]+ ?){1,2}) \d{1,4}[a-z]?(?!\w)(?:,?[ \n]\s*\d{5} [A-ZÄÖÜ][\wäöüß-]+)?"
)
_LETTER = r"A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = rf"[{_LETTER}]+(?:['’-][{_LETTER}]+)*"
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "frau", "herr", "sir", "dame", "mme", "señor", "señora"}
#: Two capitalised words, perhaps with an initial or a comma between them.
PAIR = re.compile(rf"(?<![{_LETTER}.'-])(?P<a>[A-ZÀ-ÖØ-Þ](?:[{_LETTER}'’-]+\.?|\.))(?P<c>,?) (?:[A-Z]\. )?(?P<b>[A-ZÀ-ÖØ-Þ][{_LETTER}'’-]+)")
#: Words and marks that introduce a name, at the end of the text before it.
INTRODUCES = re.compile(r"(?i)(?:\b(?:reporter|author|contact|name|assignee|owner|reviewer|signed-off-by|regards|thanks|cheers|attention|attn|dear|hi|hello)[\"']?\s?[:=,]?\s?[\"']?|\b(?:by|ask|belongs to|from|assigned to)\s|\d: )$")
CUE_LEFT = re.compile(r"(?i)(?:(?:reporter|author|contact|name|assignee|owner|regards|thanks|cheers|attention|attn|dear)[\"']?\s?[:=,]?\s?[\"']?|\b(?:reported by|ask|belongs to|written by|assigned to)\s)$")
CUE_RIGHT = re.compile(r"(?i)^(?:\"?\s*[<(;]|\",|\s+(?:said|says|wrote|writes|reported|called|asked|told|replied|mentioned|signed|confirmed)|[,;]\s*\S+@)")

#: Potentials, in log-odds.
POTENTIALS = {
    "bias": -2.5, "given": 2.0, "family": 3.0, "title": 3.0, "initial": 0.8, "two_caps": 0.6, "lower": -1.5,
    "cue_left": 1.6, "cue_right": 1.2, "unknown_family": -1.5, "alone": -2.0, "skip": 1.2, "alike": 0.5, "chain": 0.2,
}


class Lexicon:
    """Given and family names; an automaton finds family names in a text."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family, self._find = given, family, None

    def __getstate__(self):
        return self.given, self.family

    def __setstate__(self, state):
        self.given, self.family = state
        self._find = None

    def places(self, low: str) -> list[tuple[int, int]]:
        """(start, end) of whole-word family names in a lower-case text."""
        if self._find is None:
            self._find = ahocorasick.Automaton()
            for w in self.family:
                self._find.add_word(w, len(w))
            self._find.make_automaton()
        if not self.family:
            return []
        out = []
        for last, n in self._find.iter(low):
            a, b = last + 1 - n, last + 1
            if (a and (low[a - 1].isalpha() or low[a - 1] in "'’-")) or (b < len(low) and low[b].isalpha()):
                continue
            if out and out[-1][0] >= a:
                out.pop()
            out.append((a, b))
        return out


def _line(text: str, a: int, b: int, reach: int) -> tuple[str, str]:
    return text[max(0, a - reach) : a], text[b : b + reach]


#: What may stand before a family name: titles, given names and initials.
_BEFORE = re.compile(rf"((?:(?:{_WORD}|[A-Za-z])\.? ){{1,3}})$")
#: What may follow "Family,": a given name or an initial.
_AFTER = re.compile(rf", ({_WORD})(\.?)(?: ([A-Z]\.))?")


def _name_candidates(text: str, lexicon: Lexicon, blocked: list[tuple[int, int]]):
    """(start, end, log-odds, key) of possible name mentions."""
    p, given, family = POTENTIALS, lexicon.given, lexicon.family
    free = lambda a, b: not any(x < b and a < y for x, y in blocked)
    out = []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)

    def context(a: int, b: int) -> float:
        left, right = _line(text, a, b, 40)
        return (p["cue_left"] if CUE_LEFT.search(left) else 0.0) + (p["cue_right"] if CUE_RIGHT.match(right) else 0.0)

    for a, b in lexicon.places(low):
        if not free(a, b) or (a and text[a - 1] in "@/\\_.+") or (b < len(text) and text[b] in "@_/\\"):
            continue
        upper = text[a].isupper()
        own = p["bias"] + p["family"] + (0.0 if upper else p["lower"])
        offers = []
        m = _AFTER.match(text, b)
        if m:  # Family, Given
            word = m[1]
            if len(word) > 1 and word.lower() in given and word.lower() not in family:
                stop = m.end(3) if m[3] else m.end(1)
                offers.append((a, stop, own + p["given"] + p["two_caps"]))
            elif len(word) == 1 and word.isupper() and m[2]:
                offers.append((a, m.end(2), own + p["initial"] + p["two_caps"]))
        m = _BEFORE.search(text, max(0, a - 60), a)
        if m:
            words = [(m.start(1) + w.start(), w.group()) for w in re.finditer(r"\S+", m[1])]
            start, score, at = None, own, len(words) - 1
            stem = lambda w: w.rstrip(".").lower()
            initials = 0
            while at >= 0 and initials < 2 and len(stem(words[at][1])) == 1 and words[at][1].endswith(".") and words[at][1][0].isupper():
                start, score = words[at][0], score + (p["initial"] + 1.2 if not initials else 0.0)
                at, initials = at - 1, initials + 1
            if at >= 0 and stem(words[at][1]) in given and not words[at][1].endswith(".") and stem(words[at][1]) not in TITLES:
                start, score = words[at][0], score + p["given"] + (p["two_caps"] if words[at][1][0].isupper() else 0.0)
                at -= 1
            elif at >= 0 and not initials and not offers and upper and words[at][1][0].isupper() and words[at][1][-1].isalpha():
                if stem(words[at][1]) not in TITLES and not INTRODUCES.search(text[max(0, words[at][0] - 1) : a]):
                    start, score = words[at][0], score + p["two_caps"]
                    at -= 1
            if at >= 0 and stem(words[at][1]) in TITLES:
                start, score = words[at][0], score + p["title"]
            if start is not None:
                offers.append((start, b, score))
        if offers:
            x, y, score = max(((x, y, s + context(x, y)) for x, y, s in offers), key=lambda o: (o[2], o[1] - o[0]))
            out.append((x, y, score, low[a:b]))
    # introduced pairs whose family name is not in the lexicon
    for m in PAIR.finditer(text):
        first, second = (m["b"], m["a"]) if m["c"] else (m["a"], m["b"])
        key = second.rstrip(".").lower()
        a, b = m.span()
        if key in family or first.rstrip(".").lower() in family or not free(a, b) or not INTRODUCES.search(text[max(0, a - 25) : a]):
            continue
        score = p["bias"] + p["two_caps"] + p["unknown_family"] + context(a, b)
        score += p["given"] if first.rstrip(".").lower() in given else 0.0
        score += p["title"] if first.rstrip(".").lower() in TITLES else 0.0
        out.append((a, b, score, key))
    return out


def _email_odds(text: str, a: int, b: int) -> float:
    left = re.search(r"[^\s\"'<>(),;]*$", text[max(0, a - 200) : a]).group()
    if "://" in left or left.endswith((":", "//")) and not left.lower().endswith("mailto:") and "/" in left:
        return -4.0  # account of a URL
    local = text[a:b].partition("@")[0].lower().removeprefix("mailto:")
    if local in ("git", "svn", "hg", "root", "noreply", "no-reply", "postmaster", "mailer-daemon", "localhost"):
        return -4.0
    return 4.0


def candidates(text: str, lexicon: Lexicon):
    """[start, end, kind, log-odds, key] of a text's candidates."""
    out = []
    for mark, shape in (("@", EMAIL), ("at)", SPELT_EMAIL), ("at]", SPELT_EMAIL), (" dot ", WORDED_EMAIL)):
        if mark in text and not (shape is SPELT_EMAIL and out and "at)" in text and mark == "at]"):
            for m in shape.finditer(text):
                out.append((m.start(), m.end(), "email", _email_odds(text, *m.span()), m.group().lower().removeprefix("mailto:")))
    out = sorted(set(out))
    blocked = [(a, b) for a, b, *_ in out]
    clear = lambda m: not any(x < m.end() and m.start() < y for x, y in blocked)
    for m in PHONE.finditer(text):
        digits = re.sub(r"\D", "", re.split(r"(?i)ext|x", m.group())[0])
        if clear(m):
            odds = 3.0 if 8 <= len(digits) <= 15 else -3.0
            if m["bare"]:  # three groups of digits are many things
                odds = 1.0 if PHONE_CUE.search(text[max(0, m.start() - 30) : m.start()]) else -3.0
            out.append((*m.span(), "phone", odds, digits))
    for m in ID_NUMBER.finditer(text):
        if clear(m):
            cue = ID_CUE.search(text[max(0, m.start() - 45) : m.start()])
            odds = 0.8 + (2.0 if cue else 0.0)
            if m["passport"] and not cue:
                odds = -0.5
            if m["ssn"] and " " in m["ssn"] and not cue:
                odds = -0.8
            if m["run"]:
                odds = 1.0 if ID_CUE.search(text[max(0, m.start() - 25) : m.start()]) else -4.0
            out.append((*m.span(), "id_number", odds, re.sub(r"\W", "", m.group())))
    for m in ADDRESS.finditer(text):
        if clear(m):
            out.append((*m.span(), "address", 2.5, None))
            blocked.append(m.span())
    for a, b, odds, key in _name_candidates(text, lexicon, blocked):
        out.append((a, b, "person_name", odds, "n:" + key))
    return out


def label(texts: list[str], lexicon: Lexicon) -> list[list[tuple[int, int, str]]]:
    """Entities of the texts of one document: (start, end, kind) per text."""
    nodes, unary, keys = [], [], []
    for t, text in enumerate(texts):
        for a, b, kind, odds, key in sorted(candidates(text, lexicon)):
            nodes.append((t, a, b, kind))
            unary.append(odds)
            keys.append(key)
    if not nodes:
        return [[] for _ in texts]
    p = POTENTIALS
    edges = [
        (i, i + 1, p["chain"])
        for i in range(len(nodes) - 1)
        if nodes[i][0] == nodes[i + 1][0] and nodes[i][3] == nodes[i + 1][3] == "person_name" and nodes[i + 1][1] - nodes[i][2] < 40
    ]
    count = len(nodes)
    edges += crf.skip_edges(keys, p["skip"], unary)
    edges += crf.similar_edges(keys, p["alike"])
    chance = crf.marginals(unary, edges, count)
    taken: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i in sorted(range(len(nodes)), key=lambda i: (-round(chance[i], 2), nodes[i][1] - nodes[i][2], nodes[i][1])):
        t, a, b, kind = nodes[i]
        if chance[i] > 0.5 and not any(x < b and a < y for x, y, _ in taken[t]):
            taken[t].append((a, b, kind))
    return [sorted(x) for x in taken]


def learn_names(lines: DataFrame, *, raw_col="raw") -> DataFrame:
    """(token, is_given, is_family) of all lines, by where names are introduced."""
    schema = pa.schema([("role", pa.string()), ("token", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for raw in batch.column(0).to_pylist():
                record = parse(raw)
                if record is None:
                    continue
                for _, text in texts_of(record, last_prompt=True):
                    if " " not in text:
                        continue
                    for m in PAIR.finditer(text):
                        first, second = (m["b"], m["a"]) if m["c"] else (m["a"], m["b"])
                        first, second = first.rstrip(".").lower(), second.rstrip(".").lower()
                        counts["use", first] += 1
                        counts["use", second] += 1
                        if len(second) < 3 or not INTRODUCES.search(text[max(0, m.start() - 25) : m.start()]):
                            continue
                        if len(first) > 2 and first not in TITLES:
                            counts["given", first] += 1
                        counts["family", second] += 1
            yield batch_of(schema, [(r, t, n) for (r, t), n in counts.items()])

    counted = (
        lines.select(F.col(raw_col).alias("raw"))
        .mapInArrow(run, "role string, token string, n bigint")
        .groupBy("token")
        .agg(*[F.sum(F.when(F.col("role") == r, F.col("n"))).alias(r) for r in ("given", "family", "use")])
    )
    given, family = F.coalesce("given", F.lit(0)), F.coalesce("family", F.lit(0))
    is_given = (given >= LEAST_SEEN) & (given >= 0.2 * family)
    is_family = (family >= LEAST_SEEN) & (family >= LEAST_SHARE * F.col("use")) & (family >= 0.2 * given)
    named = counted.select("token", is_given.alias("is_given"), F.coalesce(is_family, F.lit(False)).alias("is_family"))
    return stage(named.where("is_given or is_family"), "names")


_TOKEN = re.compile(rf"[{_LETTER}]+(?:['’-][{_LETTER}]+)*")


def _tokens(texts: list[str]) -> set[str]:
    """What of the texts may be a name: words, and the beginnings of joined words."""
    out = set()
    for text in texts:
        for w in _TOKEN.findall(text.lower()):
            out.add(w)
            out.update(w[: m.start()] for m in re.finditer("['’-]", w))
    return out


def _named(source: DataFrame, names: DataFrame | Lexicon):
    """Lines (line_id, raw), and the function that gives the lexicon of each line of a
    batch: one for all, or beyond ``SENT`` names that of the line's own words."""
    if isinstance(names, Lexicon) or names.count() <= SENT:
        rows = [] if isinstance(names, Lexicon) else names.collect()
        lexicon = names if isinstance(names, Lexicon) else Lexicon({r["token"] for r in rows if r["is_given"]}, {r["token"] for r in rows if r["is_family"]})
        held = source.sparkSession.sparkContext.broadcast(lexicon)
        return source, lambda batch: [held.value] * len(batch)
    schema = pa.schema([("line_id", pa.int64()), ("token", pa.string())])

    def words(batches):
        for batch in batches:
            out = []
            for line_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = parse(raw)
                if record is not None:
                    out += [(line_id, t) for t in _tokens([t for _, t in texts_of(record, last_prompt=True)])]
            yield batch_of(schema, out)

    met = source.mapInArrow(words, "line_id bigint, token string").join(names, "token").groupBy("line_id").agg(
        F.collect_set(F.when(F.col("is_given"), F.col("token"))).alias("given"), F.collect_set(F.when(F.col("is_family"), F.col("token"))).alias("family")
    )

    def own(batch):
        return [Lexicon(set(g or ()), set(f or ())) for g, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]

    return source.join(met, "line_id", "left").select("line_id", "raw", "given", "family"), own


FOUND = pa.schema([("line_id", pa.int64()), ("pii_kind", pa.string()), ("nth", pa.int32())])


def found(lines: DataFrame, names: DataFrame | Lexicon | None = None, *, id_col="line_id", raw_col="raw") -> DataFrame:
    """(line_id, pii_kind, nth) of every occurrence."""
    source = lines.select(F.col(id_col).cast("bigint").alias("line_id"), F.col(raw_col).alias("raw"))
    source, lexicons = _named(source, learn_names(lines, raw_col=raw_col) if names is None else names)

    def run(batches):
        for batch in batches:
            out = []
            for line_id, raw, lexicon in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lexicons(batch)):
                record = parse(raw)
                if record is None:
                    continue
                texts = [t for _, t in texts_of(record, last_prompt=True)]
                counts: dict[str, int] = {}
                for spans in label(texts, lexicon):
                    for _, _, kind in spans:
                        counts[kind] = counts.get(kind, 0) + 1
                        out.append((line_id, kind, counts[kind]))
            yield batch_of(FOUND, out)

    return source.mapInArrow(run, "line_id bigint, pii_kind string, nth int")


def replace_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each entity replaced by ``[KIND]``."""
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def redact(lines: DataFrame, names: DataFrame | Lexicon | None = None, *, id_col="line_id", raw_col="raw") -> DataFrame:
    """(line_id, raw) with every entity replaced; other lines unchanged."""
    source = lines.select(F.col(id_col).cast("bigint").alias("line_id"), F.col(raw_col).alias("raw"))
    source, lexicons = _named(source, learn_names(lines, raw_col=raw_col) if names is None else names)
    schema = pa.schema([("line_id", pa.int64()), ("raw", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for raw, lexicon in zip(batch.column(1).to_pylist(), lexicons(batch)):
                record = parse(raw)
                if record is not None:
                    places = texts_of(record, last_prompt=True)
                    spans = label([t for _, t in places], lexicon)
                    for (path, text), s in zip(places, spans):
                        if s:
                            replace_at(record, path, replace_text(text, s))
                    if any(spans):
                        raw = json.dumps(record, ensure_ascii=False, separators=(",", ":"))
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), column(out, pa.string())], schema=schema)

    return source.mapInArrow(run, "line_id bigint, raw string")
