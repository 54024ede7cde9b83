"""Ends of a publication: what may be read, where rules are found, what is written.

Everything here runs on the driver over one transcript's verified lines, rules or
a bounded report; the lines themselves are rewritten and verified in tasks
(``operators.sanitize``) and stream through the driver only while being written.

Exit codes: 1 usage, 2 safety (something forbidden or malformed), 3 configuration.

Defined cases: no lines give an empty file; a target that exists is refused unless
forced, also a dangling link; a dry run writes nothing; bytes that are already
there are not written again.
"""

from __future__ import annotations

import hashlib
import json
import os
import stat
import subprocess
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import sanitize

USAGE, SAFETY, CONFIG = 1, 2, 3
CONFIG_NAMES = ("sanitize.yaml", "sanitize.yml", "sanitize.json")


class UsageError(sanitize.SanitizeError):
    """A wrong argument: a path that is missing, taken or no regular file."""


class LeakError(sanitize.SanitizeError):
    """The audit record itself would show what was taken out."""


def exit_code(error: BaseException | None) -> int:
    if error is None:
        return 0
    if isinstance(error, sanitize.ConfigError):
        return CONFIG
    return USAGE if isinstance(error, UsageError) else SAFETY


def check_input(path: str) -> str:
    """The path of a regular file that is no link; anything else is an error."""
    try:
        mode = os.lstat(path).st_mode
    except OSError:
        raise UsageError("the input is missing") from None
    if stat.S_ISLNK(mode) or not stat.S_ISREG(mode):
        raise UsageError("the input is no regular file")
    return path


def check_target(path: str, force: bool = False) -> str:
    """A path that is free, or may be overwritten; a dangling link is not free."""
    if os.path.lexists(path) and not force:
        raise UsageError("the target exists")
    return path


def find_config(given: str | None, here: str, beside: str) -> str | None:
    """Rules: the given file, else one in the working folder, else beside the input."""
    if given is not None:
        return check_input(given)
    for folder in (here, os.path.dirname(os.path.abspath(beside))):
        for name in CONFIG_NAMES:
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                return path
    return None


def check_ignored(config: str) -> None:
    """Rules name what must stay private: in a work tree git has to ignore them."""
    folder = os.path.dirname(os.path.abspath(config))
    inside = subprocess.run(["git", "-C", folder, "rev-parse", "--is-inside-work-tree"], capture_output=True, check=False)
    if inside.returncode:
        return  # no work tree, or no git
    ignored = subprocess.run(["git", "-C", folder, "check-ignore", "-q", os.path.abspath(config)], capture_output=True, check=False)
    if ignored.returncode:
        raise UsageError("the rules lie in a work tree that does not ignore them")


def read_config(path: str) -> sanitize.Rules:
    """Rules of a JSON file, or of a YAML file of mappings, lists and scalars."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return sanitize.load_rules(json.loads(text) if path.endswith(".json") else read_yaml(text))
    except ValueError:
        raise sanitize.ConfigError("the rules can't be read") from None


def read_yaml(text: str):
    """The block mappings, block lists and scalars of YAML that rules are written in."""
    rows = []
    for raw in text.splitlines():
        bare = raw.rstrip()
        if bare.strip() and not bare.lstrip().startswith("#") and bare.strip() != "---":
            rows.append([len(bare) - len(bare.lstrip()), bare.lstrip()])

    def scalar(x: str):
        x = x.strip()
        if x[:1] in ("'", '"'):
            end = x.rfind(x[0])
            if end < 1:
                raise ValueError("open quote")
            return json.loads(x[: end + 1]) if x[0] == '"' else x[1:end].replace("''", "'")
        x = x.split(" #", 1)[0].strip()
        known = {"true": True, "false": False, "null": None, "~": None, "": None, "[]": [], "{}": {}}
        return known[x] if x in known else int(x) if x.lstrip("-").isdigit() else x

    def key_of(x: str) -> tuple[str, str] | None:
        if x[:1] in ("'", '"'):
            return None
        key, colon, rest = x.partition(":")
        return (key.strip(), rest) if colon and (not rest or rest[0] == " ") else None

    def block(at: int, indent: int):
        first = rows[at][1]
        if first.startswith("- ") or first == "-":
            out = []
            while at < len(rows) and rows[at][0] == indent and (rows[at][1].startswith("- ") or rows[at][1] == "-"):
                rest = rows[at][1][1:].lstrip()
                if key_of(rest):
                    rows[at] = [indent + 2, rest]
                    value, at = block(at, indent + 2)
                elif rest:
                    value, at = scalar(rest), at + 1
                else:
                    value, at = block(at + 1, rows[at + 1][0])
                out.append(value)
            return out, at
        mapping: dict = {}
        while at < len(rows) and rows[at][0] == indent:
            pair = key_of(rows[at][1])
            if pair is None or pair[0] in mapping:
                raise ValueError("no mapping entry, or one twice")
            key, rest = pair
            at += 1
            deeper = at < len(rows) and (rows[at][0] > indent or rows[at][0] == indent and rows[at][1].startswith("-"))
            if not rest.strip() and deeper:
                mapping[key], at = block(at, rows[at][0])
            else:
                mapping[key] = scalar(rest)
        return mapping, at

    if not rows:
        return {}
    value, end = block(0, rows[0][0])
    if end != len(rows):
        raise ValueError("indentation")
    return value


def output_bytes(lines: Iterable[str]) -> bytes:
    """Lines joined by LF with one at the end; nothing gives no bytes."""
    text = "\n".join(lines)
    return (text + "\n").encode() if text else b""


#: Fields of an audit record, in order.
AUDIT_FIELDS = ("schema", "input_sha256", "lines_processed", "survivors", "blanks", "stripped", "paths", "identifiers", "secrets", "jitter", "substitutions")


def audit_record(input_bytes: bytes, audited, changes: list) -> dict:
    """Counts and placeholders of one rewritten file; originals never stand in it.

    ``changes`` are (layer, replacement, occurrences, first_line) in order of first
    appearance within their layer, which numbers them.
    """
    places: dict[str, int] = {}
    told = []
    for layer, replacement, occurrences, _ in sorted(changes, key=lambda c: (c[0], c[3], c[1])):
        places[layer] = places.get(layer, 0) + 1
        told.append({"layer": layer, "place": places[layer], "replacement": replacement, "occurrences": occurrences})
    counted = {k: audited[k] for k in ("lines_processed", "survivors", "blanks", "stripped", "paths", "identifiers", "secrets")}
    record = {"schema": 1, "input_sha256": hashlib.sha256(input_bytes).hexdigest(), **counted, "jitter": "disabled", "substitutions": told}
    return {k: record[k] for k in AUDIT_FIELDS}


def write_yaml(record: dict) -> str:
    """The record as YAML with its fields in their order."""
    out = []
    for k, v in record.items():
        if isinstance(v, list):
            out.append(f"{k}:" if v else f"{k}: []")
            for e in v:
                pairs = [f"{a}: {json.dumps(b, ensure_ascii=False)}" for a, b in e.items()]
                out += [("  - " if i == 0 else "    ") + p for i, p in enumerate(pairs)]
        else:
            out.append(f"{k}: {json.dumps(v, ensure_ascii=False)}")
    return "\n".join(out) + "\n"


def check_record(text: str, originals: Iterable[str], rules: sanitize.Rules) -> None:
    """No original and no match of a rule or credential pattern may be in it."""
    for original in originals:
        if original and len(original) > 3 and original in text:
            raise LeakError("the audit record shows an original")
    for kind, pattern in rules.credentials():
        if pattern.search(text):
            raise LeakError(f"the audit record holds a {kind}")
    for section in ("paths", "identifiers"):
        for i, rule in enumerate(getattr(rules, section)):
            if any(m.group() for m in rule.compiled().finditer(text)):
                raise LeakError(f"the audit record matches {section}[{i}]")


def write_pair(output: str, data: bytes, sidecar: str, record: str) -> None:
    """Both files or none: written beside their targets, the record renamed first,
    and taken back if the output can't follow."""
    staged = [(sidecar, record.encode()), (output, data)]
    names = [f"{path}.{os.getpid()}.part" for path, _ in staged]
    try:
        for name, (_, content) in zip(names, staged):
            with open(name, "xb") as f:
                f.write(content)
                f.flush()
                os.fsync(f.fileno())
        had = os.path.lexists(sidecar)
        os.replace(names[0], sidecar)
        try:
            os.replace(names[1], output)
        except OSError:
            if not had:
                os.unlink(sidecar)
            raise
    finally:
        for name in names:
            if os.path.lexists(name):
                os.unlink(name)


def write_if_changed(path: str, data: bytes) -> bool:
    """Write unless the same bytes are there; whether it wrote."""
    try:
        with open(path, "rb") as f:
            if f.read() == data:
                return False
    except OSError:
        pass
    with open(path, "wb") as f:
        f.write(data)
    return True


def append_record(path: str, record: dict) -> None:
    """One compact JSON line in a single appending write."""
    line = (sanitize.serialize(record) + "\n").encode()
    at = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o600)
    try:
        os.write(at, line)
    finally:
        os.close(at)


def publish(spark: SparkSession, source: str, output: str, *, config: str | None = None, force: bool = False, dry_run: bool = False) -> dict:
    """Rewrite one transcript, verify it and write it with its audit record.

    Nothing is written unless every check passes.
    """
    check_input(source)
    sidecar = output + ".audit.yaml"
    if not dry_run:
        check_target(output, force)
        check_target(sidecar, force)
    found = find_config(config, os.getcwd(), source)
    if found is None:
        raise sanitize.ConfigError("no rules were found")
    check_ignored(found)
    rules = read_config(found)
    with open(source, "rb") as f:
        data = f.read()
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        raise sanitize.InputError("the input is no UTF-8") from None
    parts = text.split("\n")  # LF only: other separators may stand in texts
    parts = parts[:-1] if parts[-1] == "" else parts
    rows = [("input", i, p.removesuffix("\r")) for i, p in enumerate(parts, 1)]
    lines = spark.createDataFrame(rows, "file_name string, line_no bigint, raw string")
    kept, audited = sanitize.sanitize(lines, rules)
    changed = sanitize.substitutions(sanitize.rewrite(lines, rules)).collect()  # one file's rules and placeholders
    counts = audited.first()
    empty = dict.fromkeys(("lines_processed", "survivors", "blanks", "stripped", "paths", "identifiers", "secrets"), 0)
    record = audit_record(data, counts.asDict() if counts else empty, [(c["layer"], c["replacement"], c["occurrences"], c["first_line"]) for c in changed])
    told = write_yaml(record)
    check_record(told, [c["original"] for c in changed if c["layer"] != "secrets"], rules)
    if not dry_run:
        write_pair(output, output_bytes(r["out"] for r in kept.orderBy("line_no").toLocalIterator()), sidecar, told)
    return record


def markdown(title: str, sections: dict[str, DataFrame], limit: int = 100_000) -> str:
    """Report sections as Markdown tables; a section is a bounded aggregate."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        rows = df.orderBy(*df.columns).limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{name} is no report section: more than {limit} rows")
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("-" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)


#: Fixed value: columns of a firing log written as tab-separated text.
FIRING_LOG = "stamp string, event string, tool string, script string, outcome string"


def read_firing_log(spark: SparkSession, path: str) -> DataFrame:
    """Firings of a tab-separated log; short rows keep nulls."""
    return spark.read.schema(FIRING_LOG).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path)


GUARD_LOG = "recv_ms double, sent_ms double, mode string, path string, session_id string, tool_use_id string, event string, tool string, sentinel string, status int, decision string, delivered boolean"
JUDGE_LOG = "ts_ms double, session_id string, tool_use_id string, model string, import_ms double, api_ms double, total_ms double, stop_reason string, usage struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>, ok boolean, error string, decision string"
DISPATCH_LOG = "ts_ms double, phase string, pid bigint, session_id string, tool_use_id string, agent_id string, agent_type string, event string, tool string, route string, decision string, signal string, tool_duration_ms double, duration_ms double, exit_code int"


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int] | tuple[None, int]:
    """Records of a JSON-lines log and the number of lines that are none; (None, 0)
    where there is no such file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None, 0
    lines = spark.read.text(path).where("trim(value) <> ''")
    sound = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    records = lines.where(sound).select(F.from_json("value", schema).alias("r")).select("r.*")
    return records, lines.where(~sound).count()


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(category, item) of a vocabulary file: lists under the names of categories."""
    doc = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    each = spark.sql("select e.key category, e.value items from {d} d, lateral variant_explode(d.v) e where left(e.key, 1) <> '_'", d=doc)
    return spark.sql("select c.category, try_variant_get(e.value, '$', 'string') item from {c} c, lateral variant_explode(c.items) e", c=each).where("item is not null").distinct()
