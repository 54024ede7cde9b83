"""Schemas that drift between files: departures from an agreed schema, renames
found by matching column profiles, and one consistent table.

Pass one parses every line once and emits, pre-aggregated per task, (a) the
distinct signatures of records per file (unlisted paths, absent paths, retyped
paths) and (b) partial column profiles (type counts, a k-minimum-values sketch
of the values, a histogram of value shapes).  Profiles merge into one row per
path, new paths one row per version of the emitter, so what reaches the driver is
bounded by the number of distinct paths (``MAX_PATHS``, an error beyond it).
There, for every version, a maximum-weight bipartite matching between the agreed
paths that its records lack and its new paths finds the renames; names that never
stand in one record may then match the same agreed path in a further round, as
two emitters can rename one field.  Pass two only touches the small signature table.

Defined cases: blank, cut off and non-object lines give no rows; a null value
is neither absence nor a retyping; an empty table gives an empty report; repeated
lines change nothing; a type outside the agreed schema gives the single row
(file, type, ``type``, ``added``); a record without any type gives
(file, '', ``type``, ``removed``).
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions.records import batch_of, blocks, column, json_type, parse, storable, text_of
from sessionloom.plans.runtime import stage

SKETCH = 128  #: values kept per k-minimum-values sketch
SHAPES = 64  #: value shapes kept per profile, those of the least hashes
ACCEPT = 0.5  #: least score of a rename
FLUSH = 50_000  #: distinct signatures a task holds before it emits them
MAX_PATHS = 20_000  #: distinct paths the driver accepts for matching

PASS_ONE = pa.schema(
    [
        ("part", pa.string()),
        ("version", pa.string()),
        ("file_name", pa.string()),
        ("record_type", pa.string()),
        ("unlisted", pa.list_(pa.string())),
        ("absent", pa.list_(pa.string())),
        ("retyped", pa.list_(pa.string())),
        ("path", pa.string()),
        ("n", pa.int64()),
        ("sketch", pa.list_(pa.int64())),
        ("shapes", pa.list_(pa.string())),
        ("shape_counts", pa.list_(pa.int64())),
    ]
)
PASS_ONE_DDL = (
    "part string, version string, file_name string, record_type string, unlisted array<string>, absent array<string>, "
    "retyped array<string>, path string, n bigint, sketch array<bigint>, shapes array<string>, shape_counts array<bigint>"
)


class Agreed:
    """The agreed schema: per record type the types and duty of each path."""

    def __init__(self, rows) -> None:
        self.types: dict[str, dict[str, set[str]]] = defaultdict(dict)
        self.required: dict[str, set[str]] = defaultdict(set)
        for r in rows:
            self.types[r["record_type"]].setdefault(r["field_path"], set()).add(r["json_type"])
            if r["is_required"]:
                self.required[r["record_type"]].add(r["field_path"])
        self.paths = {p for t in self.types.values() for p in t}
        self.levels = {
            t: ({p for p in ps if "[]" not in p}, {p for p in ps if "[]" in p}) for t, ps in self.types.items()
        }


def _shape(value, kind: type) -> str:
    """Coarse look of a value: type, first letters, length class, marks."""
    if kind is str:
        lead = value[:4]
        if not lead.isalpha():
            lead = "".join(c if c.isalpha() else "-" if c in "-_/" else "9" for c in lead)
        marks = ("-" if "-" in value else "") + ("/" if "/" in value else "") + (" " if " " in value else "")
        return f"str:{lead}:{len(value).bit_length()}:{marks}"
    name = json_type(value)
    return name if kind is dict or kind is list else f"{name}:{len(str(value))}"


def _least(kept, size: int) -> tuple[list, int]:
    """The ``size`` elements of the least hashes, and the largest of these hashes."""
    some = sorted(kept, key=_mark)[:size]
    return some, _mark(some[-1])


def _mark(value) -> int:
    return value if isinstance(value, int) else zlib.crc32(value.encode("utf-8", "replace"))


class _Profile:
    """Count, k-minimum-values sketch and shape histogram of a column.

    Shapes are kept by their hashes too, so what merged profiles hold does not
    depend on which task met which rows.
    """

    __slots__ = ("n", "values", "most", "shapes", "widest")

    def __init__(self) -> None:
        self.n, self.values, self.most, self.shapes, self.widest = 0, set(), 1 << 32, {}, 1 << 32

    def add(self, value) -> None:
        self.n += 1
        kind = type(value)
        if kind is str or kind is int or kind is float:
            h = zlib.crc32((value if kind is str else repr(value)).encode("utf-8", "replace"))
            if h < self.most and h not in self.values:
                self.values.add(h)
                if len(self.values) > 2 * SKETCH:
                    kept, self.most = _least(self.values, SKETCH)
                    self.values = set(kept)
        s = _shape(value, kind)
        if s in self.shapes:
            self.shapes[s] += 1
        elif self.widest == 1 << 32 or _mark(s) < self.widest:
            self.shapes[s] = 1
            if len(self.shapes) > 2 * SHAPES:
                kept, self.widest = _least(self.shapes, SHAPES)
                self.shapes = {x: self.shapes[x] for x in kept}


def _levels(record: dict):
    """Paths with values of the record, and those of each of its blocks."""
    own = dict(record)
    message = record.get("message")
    parts = []
    if isinstance(message, dict):
        for k, v in message.items():
            own["message." + k] = v
        usage = message.get("usage")
        if isinstance(usage, dict):
            for k, v in usage.items():
                own["message.usage." + k] = v
        parts = [{"message.content[]." + k: v for k, v in b.items()} for b in blocks(message) if isinstance(b, dict)]
    return own, parts


def _pass_one(agreed: Agreed):
    known = set(agreed.types)

    def run(batches):
        signatures: dict[tuple, int] = {}
        profiles: dict[tuple[str, str], _Profile] = {}

        def emit():
            rows = [("sig", v, f, t, list(u), list(a), list(r), None, n, None, None, None) for (v, f, t, u, a, r), n in signatures.items()]
            signatures.clear()
            return batch_of(PASS_ONE, rows)

        for batch in batches:
            for file_name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = parse(raw)
                if record is None:
                    continue
                version = text_of(record.get("version")) or ""
                if "type" in record:
                    rtype = record["type"]
                    if not isinstance(rtype, str):
                        rtype = json.dumps(rtype)
                    if rtype not in known:
                        signatures[version, file_name, rtype, ("type",), (), ()] = 1
                        continue
                else:  # the type may stand under a new name: a key whose value is a known type
                    named = sorted(k for k, v in record.items() if isinstance(v, str) and v in known and k not in agreed.paths)
                    if not named:  # perhaps a new name and a type that is not agreed either
                        words = sorted(f"{k}\0{v}" for k, v in record.items() if isinstance(v, str) and k not in agreed.paths)
                        signatures[version, file_name, "", tuple(words), ("type",), ()] = 1
                        continue
                    rtype = record[named[0]]
                types = agreed.types[rtype]
                required = agreed.required[rtype]
                own, parts = _levels(record)
                for level, fields in ((0, own), *((1, p) for p in parts)):
                    unlisted, retyped = [], []
                    for path, value in fields.items():
                        ok = types.get(path)
                        if ok is None:
                            unlisted.append(path)
                        elif value is not None and json_type(value) not in ok:
                            retyped.append(path)
                        if value is not None:
                            whose = (version if ok is None else "", path)  # agreed columns have one profile
                            p = profiles.get(whose)
                            if p is None:
                                p = profiles[whose] = _Profile()
                            p.add(value)
                    wanted = agreed.levels[rtype][level]
                    absent = [p for p in wanted if p not in fields and (unlisted or p in required)]
                    if unlisted or absent or retyped:
                        key = (version, file_name, rtype, tuple(sorted(unlisted)), tuple(sorted(absent)), tuple(sorted(retyped)))
                        signatures[key] = signatures.get(key, 0) + 1
            if len(signatures) > FLUSH:
                yield emit()
        yield emit()
        yield batch_of(
            PASS_ONE,
            [
                ("prof", version, None, None, None, None, None, path, p.n, sorted(p.values)[:SKETCH], list(p.shapes), list(p.shapes.values()))
                for (version, path), p in profiles.items()
            ],
        )

    return run


def _words(name: str) -> set[str]:
    leaf = name.rsplit(".", 1)[-1]
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", leaf)}


def name_similarity(a: str, b: str) -> float:
    """The larger of word overlap and character-bigram Dice of two names."""
    x, y = _words(a), _words(b)
    words = len(x & y) / min(len(x), len(y)) if x and y else 0.0
    s, t = "".join(sorted(x)), "".join(sorted(y))
    g, h = {s[i : i + 2] for i in range(len(s) - 1)}, {t[i : i + 2] for i in range(len(t) - 1)}
    return max(words, 2 * len(g & h) / max(1, len(g) + len(h)))


def match(scores: list[list[float]]) -> list[int]:
    """Maximum-weight bipartite matching; per row the column or -1.

    Shortest augmenting paths on costs of the square completion.
    """
    n = max(len(scores), len(scores[0]) if scores else 0)
    if not n:
        return []
    cost = [[-(scores[i][j] if i < len(scores) and j < len(scores[0]) else 0.0) for j in range(n)] for i in range(n)]
    u, v, owner = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n):
        owner[n] = i
        j0, least, back, done = n, [float("inf")] * n, [n] * n, [False] * (n + 1)
        while owner[j0] != n:
            done[j0] = True
            i0, best, j1 = owner[j0], float("inf"), -1
            for j in range(n):
                if not done[j]:
                    c = cost[i0][j] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], back[j] = c, j0
                    if least[j] < best:
                        best, j1 = least[j], j
            for j in range(n + 1):
                if done[j]:
                    u[owner[j]] += best
                    v[j] -= best
                elif j < n:
                    least[j] -= best
            j0 = j1
        while j0 != n:
            owner[j0] = owner[back[j0]]
            j0 = back[j0]
    out = [-1] * len(scores)
    for j in range(n):
        if owner[j] < len(scores) and scores and j < len(scores[0]):
            out[owner[j]] = j
    return out


def similarity(old: dict, new: dict, old_path: str, new_path: str) -> float:
    """Score in 0..1 that the new column holds what the old one held."""
    a, b = dict(zip(old["shapes"], old["shape_counts"])), dict(zip(new["shapes"], new["shape_counts"]))
    dot = sum(n * b.get(s, 0) for s, n in a.items())
    shape = dot / ((sum(n * n for n in a.values()) ** 0.5) * (sum(n * n for n in b.values()) ** 0.5) or 1.0)
    x, y = set(old["sketch"]), set(new["sketch"])
    bound = min(max(x), max(y)) if x and y else -1
    near_x, near_y = {h for h in x if h <= bound}, {h for h in y if h <= bound}
    shared = len(near_x & near_y) / min(len(near_x), len(near_y)) if near_x and near_y else 0.0
    name = name_similarity(old_path, new_path)
    kinds = {s.split(":")[0] for s in a} & {s.split(":")[0] for s in b}
    if not kinds:
        return 0.0
    if kinds <= {"bool", "dict", "list", "int"}:  # such values say little about which column it is
        return 0.7 * name + 0.3 * shape
    return max(0.6 * shared + 0.2 * shape + 0.2 * name, 0.1 * shared + 0.45 * shape + 0.45 * name)


def _bottom(rows: DataFrame, size: int, *columns: str) -> DataFrame:
    """Per profile the ``size`` rows of the least first column, as one array.

    Reduced in two rounds, so that a path of many distinct values never is
    gathered in one task.
    """
    name, of = "kept" if len(columns) > 1 else "kept_h", ["version", "path"]
    least = lambda c: F.slice(F.array_sort(c), 1, size)
    some = rows.groupBy(*of, F.pmod("h", F.lit(1024)).alias("slice")).agg(least(F.collect_list(F.struct(*columns))).alias("some"))
    return some.groupBy(*of).agg(least(F.flatten(F.collect_list("some"))).alias(name))


def _pooled(profiles: dict[tuple[str, str], dict]) -> dict[str, dict]:
    """Profile per path over all versions."""
    out: dict[str, dict] = {}
    for (_, path), p in profiles.items():
        held = out.setdefault(path, {"counts": defaultdict(int), "sketch": set()})
        held["sketch"].update(p["sketch"])
        for shape, n in zip(p["shapes"], p["shape_counts"]):
            held["counts"][shape] += n
    return {
        path: {"shapes": list(h["counts"]), "shape_counts": list(h["counts"].values()), "sketch": sorted(h["sketch"])[:SKETCH]}
        for path, h in out.items()
    }


class Drift:
    """Result of profiling one corpus against an agreed schema."""

    def __init__(self, lines: DataFrame, baseline: DataFrame, *, file_col="file_name", raw_col="raw") -> None:
        spark = lines.sparkSession
        self.agreed = Agreed(baseline.collect())  # the agreed schema is a fixed configuration table
        raw = lines.select(F.col(file_col).alias("file_name"), F.col(raw_col).alias("raw"))
        self.staged = stage(raw.mapInArrow(_pass_one(self.agreed), PASS_ONE_DDL), "drift")
        self.spark = spark

    def signatures(self) -> DataFrame:
        return self.staged.where("part = 'sig'")

    def profiles(self) -> dict[tuple[str, str], dict]:
        """Merged profile per (version, path); agreed paths are under version ''."""
        of = ["version", "path"]
        shapes = (
            self.staged.where("part = 'prof'")
            .select(*of, F.explode(F.arrays_zip("shapes", "shape_counts")).alias("s"))
            .groupBy(*of, F.col("s.shapes").alias("shape"))
            .agg(F.sum("s.shape_counts").alias("n"))
        )
        sketches = self.staged.where("part = 'prof'").select(*of, F.explode("sketch").alias("h")).distinct()
        kept = _bottom(shapes.withColumn("h", F.crc32(F.encode("shape", "utf-8"))), SHAPES, "h", "shape", "n").join(_bottom(sketches, SKETCH, "h"), of, "left")
        rows = kept.limit(MAX_PATHS + 1).collect()
        if len(rows) > MAX_PATHS:
            raise ValueError(f"more than {MAX_PATHS} distinct paths; the keys look like data")
        return {
            (r["version"], r["path"]): {"shapes": [x["shape"] for x in r["kept"]], "shape_counts": [x["n"] for x in r["kept"]], "sketch": [x["h"] for x in r["kept_h"] or ()]}
            for r in rows
        }

    def learn_renames(self) -> dict[str, str]:
        """New path -> agreed path, by bipartite matching per version and level."""
        profiles = self.profiles()
        met = (
            self.signatures()
            .where("record_type <> '' and size(unlisted) > 0")
            .groupBy("version", "unlisted", "absent")
            .agg(F.sum("n").alias("n"))
            .select("version", "n", "absent", "unlisted", F.explode("unlisted").alias("new"))
        )
        seen: dict[str, dict[str, int]] = defaultdict(dict)
        beside: dict[tuple[str, str], set] = {}
        own = met.groupBy("version", "new").agg(F.sum("n").alias("n"), F.collect_set("unlisted").alias("beside"))
        for r in own.collect():  # a row per profile at most
            seen[r["version"]][r["new"]] = r["n"]
            beside[r["version"], r["new"]] = {p for others in r["beside"] for p in others}
        gaps: dict[tuple[str, str, str], int] = {}
        for r in met.select("version", "n", "new", F.explode("absent").alias("old")).groupBy("version", "old", "new").agg(F.sum("n").alias("n")).collect():
            gaps[r["version"], r["old"], r["new"]] = r["n"]
        pooled = _pooled(profiles)
        found: dict[str, tuple[float, str]] = {}
        for version, here in seen.items():
            for level in ("", "message.", "message.usage.", "message.content[]."):
                new = sorted(p for p in here if (version, p) in profiles and p.rpartition(".")[0] == level[:-1])
                old = sorted(p for p in self.agreed.paths if ("", p) in profiles and p.rpartition(".")[0] == level[:-1])
                taken: dict[str, set[str]] = defaultdict(set)  # agreed path -> new paths that hold it

                def score(n: str, o: str, version=version, here=here, taken=taken) -> float:
                    if gaps.get((version, o, n), 0) < 0.5 * here[n] or any(m in beside[version, n] for m in taken[o]):
                        return 0.0
                    alike = min(similarity(profiles["", o], p, o, n) for p in (profiles[version, n], pooled[n]))
                    return alike if alike >= ACCEPT else 0.0

                while new and old:
                    scores = [[score(n, o) for o in old] for n in new]
                    pairs = [(new[i], old[j], scores[i][j]) for i, j in enumerate(match(scores)) if j >= 0 and scores[i][j]]
                    if not pairs:
                        break
                    for n, o, alike in pairs:
                        taken[o].add(n)
                        found[n] = max(found.get(n, (0.0, "")), (alike, o))
                        new.remove(n)
        return {n: o for n, (_, o) in sorted(found.items())}

    def changes(self, renames: dict[str, str] | None = None) -> DataFrame:
        """(file_name, record_type, field_path, change_kind), distinct."""
        renames = self.learn_renames() if renames is None else renames
        required = {t: sorted(p) for t, p in self.agreed.required.items()}
        schema = pa.schema([(c, pa.string()) for c in ("file_name", "record_type", "field_path", "change_kind")])

        def run(batches):
            for batch in batches:
                out = set()
                for s in batch.to_pylist():
                    head = (s["file_name"], s["record_type"])
                    if not head[1]:
                        kinds = [v for k, v in (x.split("\0", 1) for x in s["unlisted"]) if renames.get(k) == "type"]
                        out.add((head[0], kinds[0], "type", "added") if kinds else (*head, "type", "removed"))
                        continue
                    absent, moved = set(s["absent"]), set()
                    for path in s["unlisted"]:
                        old = renames.get(path)
                        if old in absent:
                            moved.add(old)
                            out.add((*head, old, "renamed"))
                        else:
                            out.add((*head, path, "added"))
                    out.update((*head, p, "retyped") for p in s["retyped"])
                    must = required.get(s["record_type"], ("type",))
                    out.update((*head, p, "removed") for p in must if p in absent and p not in moved)
                yield batch_of(schema, list(out))

        found = self.signatures().select("file_name", "record_type", "unlisted", "absent", "retyped").mapInArrow(
            run, "file_name string, record_type string, field_path string, change_kind string"
        )
        return found.distinct()


def _folded(obj: dict, back: dict[str, str]) -> dict:
    """The object with renamed fields under their agreed names, in their places."""
    if not any(k in back for k in obj):
        return obj
    held, out = set(obj), {}
    for k, v in obj.items():
        if k in back and back[k] not in held:
            held.add(back[k])
            k = back[k]
        out[k] = v
    return out


def _fold_back(record: dict, back: dict[str, dict[str, str]]) -> dict:
    """``_folded`` at every level; ``back`` has each level's renames."""
    record = _folded(record, back.get("", {}))
    message = record.get("message")
    if not isinstance(message, dict):
        return record
    message = record["message"] = _folded(message, back.get("message", {}))
    if isinstance(message.get("usage"), dict):
        message["usage"] = _folded(message["usage"], back.get("message.usage", {}))
    content, names = message.get("content"), back.get("message.content[]", {})
    if isinstance(content, dict):
        message["content"] = _folded(content, names)
    elif isinstance(content, list):
        message["content"] = [_folded(b, names) if isinstance(b, dict) else b for b in content]
    return record


def unify(lines: DataFrame, baseline: DataFrame, renames: dict[str, str], *, raw_col="raw") -> DataFrame:
    """All lines in one consistent table.

    One column per agreed path outside blocks (dots become ``__``), text for
    scalars and JSON text for containers, with renamed fields folded back, also
    inside that text (message, its usage and its blocks); ``extras`` maps every unlisted path to its JSON text, so nothing is lost.
    Unreadable lines keep their row with ``readable`` false.  Input columns
    whose names clash with an output column are kept as ``in_<name>``.
    """
    agreed = Agreed(baseline.collect())
    paths = sorted(p for p in agreed.paths if "[]" not in p)
    names = [p.replace(".", "__") for p in paths]
    back: dict[str, dict[str, str]] = defaultdict(dict)
    for n, o in renames.items():
        back[n.rpartition(".")[0]][n.rpartition(".")[2]] = o.rpartition(".")[2]
    carried = [c for c in lines.columns if c != raw_col]
    kept = [f"in_{c}" if c in {*names, "readable", "extras"} else c for c in carried]
    source = lines.select(*[F.col(c).alias(k) for c, k in zip(carried, kept)], F.col(raw_col).alias("__raw"))
    ddl = source.drop("__raw").schema
    fields = ddl
    for n in names:
        fields = fields.add(n, "string")
    fields = fields.add("readable", "boolean").add("extras", T.MapType(T.StringType(), T.StringType()))
    text = lambda v: v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)

    def run(batches):
        for batch in batches:
            columns = [[] for _ in paths]
            ok, extras = [], []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                record = parse(raw)
                ok.append(record is not None)
                own = _levels(_fold_back(record, back))[0] if record is not None else {}
                rest = {}
                for p, v in own.items():
                    if p not in agreed.paths:
                        rest[p] = json.dumps(v, ensure_ascii=False)
                extras.append(list(rest.items()))
                for c, p in zip(columns, paths):
                    c.append(text(own.get(p)))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays += [column(c, pa.string()) for c in columns]
            arrays += [pa.array(ok, pa.bool_()), pa.array([storable(x) for x in extras], pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *names, "readable", "extras"])

    return source.mapInArrow(run, fields)
