import json
import os

import pytest

from sessionloom.operators import captures, rollups, sanitize, tables, validate
from sessionloom.plans import statements
from sessionloom.sources import publish

RULES = """# rules
version: 1
paths:
  - match: /home/kim/
    replace: "/home/user/"   # a comment
identifiers:
- match: 're:QX-\\d+'
  replace: TICKET
options:
  scrub_git_branch: true
"""
LINES = [
    {"type": "user", "cwd": "/home/kim/a", "gitBranch": "kim-fix", "message": {"content": "see QX-12 and QX-12, key ghp_" + "a1B2" * 9}},
    {"type": "attachment", "x": 1},
    {"type": "assistant", "message": {"content": [{"type": "text", "text": "é ok"}]}},
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sanitize.yaml").write_text(RULES)
    (tmp_path / "in.jsonl").write_text("\n".join([*(json.dumps(x, ensure_ascii=False) for x in LINES), "", ""]))
    return tmp_path


def test_publish_writes_both_or_nothing(spark, folder):
    out = str(folder / "out.jsonl")
    record = publish.publish(spark, str(folder / "in.jsonl"), out, config=str(folder / "sanitize.yaml"), dry_run=True)
    assert not os.path.exists(out) and list(record) == list(publish.AUDIT_FIELDS)
    publish.publish(spark, str(folder / "in.jsonl"), out, config=str(folder / "sanitize.yaml"))
    text = open(out, encoding="utf-8").read()
    assert text.endswith("\n") and "/home/user/a" in text and "TICKET" in text and "kim" not in text and "<REDACTED:github-token>" in text and "é ok" in text
    audit = open(out + ".audit.yaml").read()
    assert "kim" not in audit and "QX-12" not in audit and publish.read_yaml(audit)["secrets"] == 1 and "jitter: \"disabled\"" in audit
    assert [x["place"] for x in publish.read_yaml(audit)["substitutions"] if x["layer"] == "identifiers"] == [1, 2]
    with pytest.raises(publish.UsageError):
        publish.publish(spark, str(folder / "in.jsonl"), out, config=str(folder / "sanitize.yaml"))
    # a second pass changes nothing
    again = publish.publish(spark, out, str(folder / "again.jsonl"), config=str(folder / "sanitize.yaml"))
    assert open(folder / "again.jsonl", encoding="utf-8").read() == text and (again["paths"], again["identifiers"], again["secrets"]) == (0, 0, 0)


def test_every_failure_has_its_code_and_writes_nothing(spark, folder):
    config, out = str(folder / "sanitize.yaml"), str(folder / "x.jsonl")
    (folder / "bad.jsonl").write_text('{"type": "user"}\n{cut\n')
    (folder / "latin.jsonl").write_bytes(b'{"type": "\xe9"}\n')
    (folder / "wrong.yaml").write_text("version: 2\n")
    os.symlink(folder / "in.jsonl", folder / "link.jsonl")
    for source, rules, code in (("bad.jsonl", config, 2), ("latin.jsonl", config, 2), ("link.jsonl", config, 1), ("none.jsonl", config, 1), ("in.jsonl", str(folder / "wrong.yaml"), 3)):
        with pytest.raises(sanitize.SanitizeError) as error:
            publish.publish(spark, str(folder / source), out, config=rules)
        assert publish.exit_code(error.value) == code and not os.path.exists(out) and not os.path.exists(out + ".audit.yaml")
    assert publish.exit_code(None) == 0


def test_small_ends(folder):
    assert publish.output_bytes([]) == b"" and publish.output_bytes(["a", "b"]) == b"a\nb\n"
    path = str(folder / "log.jsonl")
    publish.append_record(path, {"b": 1, "a": "é"})
    publish.append_record(path, {})
    assert open(path, encoding="utf-8").read() == '{"b":1,"a":"é"}\n{}\n'
    assert publish.write_if_changed(path, b"x") and not publish.write_if_changed(path, b"x")
    assert publish.find_config(None, str(folder), "/nowhere/in") == str(folder / "sanitize.yaml") and publish.find_config(None, "/", "/nowhere/in") is None
    with pytest.raises(publish.LeakError):
        publish.check_record("a secret-name", ["secret-name"], sanitize.Rules())
    with pytest.raises(ValueError):
        publish.read_yaml("a: 1\na: 2\n")
    os.symlink("/nowhere", folder / "dangling")
    with pytest.raises(publish.UsageError):
        publish.check_target(str(folder / "dangling"))


def test_a_failed_rename_takes_the_record_back(folder):
    target = folder / "taken"
    target.mkdir()
    with pytest.raises(OSError):
        publish.write_pair(str(target), b"x", str(folder / "s.yaml"), "y")
    assert sorted(p.name for p in folder.iterdir()) == ["in.jsonl", "sanitize.yaml", "taken"]


def test_rules_inside_a_work_tree_must_be_ignored(folder):
    import subprocess

    publish.check_ignored(str(folder / "sanitize.yaml"))
    subprocess.run(["git", "init", "-q", str(folder)], check=True)
    with pytest.raises(publish.UsageError):
        publish.check_ignored(str(folder / "sanitize.yaml"))
    (folder / ".gitignore").write_text("sanitize.yaml\n")
    publish.check_ignored(str(folder / "sanitize.yaml"))


def test_logs_and_baselines(spark, folder):
    (folder / "fire.tsv").write_text("t1\tStop\tRead\ta.py\tok\nt2\tStop\n")
    got = [tuple(r) for r in publish.read_firing_log(spark, str(folder / "fire.tsv")).collect()]
    assert got == [("t1", "Stop", "Read", "a.py", "ok"), ("t2", "Stop", None, None, None)]
    (folder / "guard.jsonl").write_text('{"recv_ms": 1.5, "sent_ms": 3.26, "delivered": true, "tool_use_id": "toolu_12345678"}\n[1]\n{cut\n\n')
    records, bad = publish.read_log(spark, str(folder / "guard.jsonl"), publish.GUARD_LOG)
    assert bad == 2 and tuple(captures.guard_table(records).first()) == (None, "…12345678", "true", 1.8)
    assert publish.read_log(spark, str(folder / "none.jsonl"), publish.JUDGE_LOG) == (None, 0)
    (folder / "base.json").write_text('{"_meta": {"x": 1}, "versions": ["2.1.0", 3], "top_level_keys": ["a"]}')
    assert {tuple(r) for r in publish.read_baseline(spark, str(folder / "base.json")).collect()} == {("versions", "2.1.0"), ("versions", "3"), ("top_level_keys", "a")}
    text = publish.markdown("T", {"s": spark.createDataFrame([(1, "a|b"), (None, "c")], "n int, t string")})
    assert text == "# T\n\n## s\n\n| n | t |\n|---|---|\n| - | c |\n| 1 | a\\|b |\n"


def test_worked_cost_and_rollup_examples(spark, make_lines):
    usage = {"input_tokens": 2741, "output_tokens": 329, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 19227, "speed": "standard", "service_tier": "standard"}
    split = {"cache_creation": {"ephemeral_5m_input_tokens": 0, "ephemeral_1h_input_tokens": 19227}}
    line = lambda more, model="big-4-7": {"type": "assistant", "timestamp": "2026-06-26T10:00:00Z", "message": {"id": "m", "model": model, "usage": usage | more}}
    rows = [line(split), line({}), line(split | {"speed": "fast", "inference_geo": "us"}), line({"service_tier": "batch", "server_tool_use": {"web_search_requests": 3}}), line(split, "big-4-7-20251101[1M]"), line(split, "other"), line(split, "<synthetic>"), line(split, None)]
    rates = spark.createDataFrame([("big-4-7", "2026-01-01", None, 5.0, 25.0, 30.0, 150.0)], "model string, valid_from string, valid_to string, input double, output double, fast_input double, fast_output double")
    got = [r["cost"] for r in rollups.priced(tables.lines(make_lines(rows)), rates).orderBy("line_id").collect()]
    assert got[:2] == [pytest.approx(0.2142), pytest.approx(0.1421, abs=1e-4)]
    assert got[2] == pytest.approx((2741 * 30 + 329 * 150 + 19227 * 60) / 1e6 * 1.1) and got[3] == pytest.approx((2741 * 2.5 + 329 * 12.5 + 19227 * 6.25) / 1e6 + 0.03)
    assert got[4] == got[0] and got[5:] == [None, None, None]
    whole = rollups.cost_by(rollups.priced(tables.lines(make_lines(rows)), rates)).first()
    assert (whole["n"], whole["unpriced"]) == (7, 2)
    # a rollup is the last turn; the trace sums all of them
    turn = lambda i, a, b, c, d: {"type": "assistant", "agentId": "x", "message": {"id": f"m{i}", "usage": {"input_tokens": a, "output_tokens": b, "cache_creation_input_tokens": c, "cache_read_input_tokens": d}}}
    trace = [("-p/s/subagents/agent-x.jsonl", turn(i, 5, 250, 7250, 37500)) for i in range(4)]
    parent = {"type": "user", "toolUseResult": {"agentId": "x", "totalTokens": 28803, "usage": {"input_tokens": 3, "output_tokens": 300, "cache_creation_input_tokens": 500, "cache_read_input_tokens": 28000}}}
    lines = tables.lines(make_lines([*trace, parent]))
    rolled = rollups.rollups(lines)
    assert [r["adds_up"] for r in rolled.collect()] == [True]
    turns = lines.where("type = 'assistant'")
    got = rollups.against_traces(rolled, turns).first()
    assert (got["trace_tokens"], got["total_tokens"], got["coverage"]) == (180_020, 28_803, "both")


def test_reports_show_no_content(spark, make_lines):
    """A planted sentinel in every free field reaches no report."""
    from sessionloom.plans import corpus

    mark = "SENTINEL private text"
    rows = [
        {"type": mark, "version": mark, "subtype": mark, "toolDenialKind": mark, "sessionId": "s", "cwd": mark, "message": {"model": mark, "stop_reason": mark, "content": [{"type": "tool_use", "id": mark, "name": mark}, {"type": "tool_result", "tool_use_id": mark, "is_error": mark, "content": mark}]}},
        {"type": "system", "subtype": mark, "hookErrors": [mark], "hookCount": 1}, {"type": "assistant", "message": {"model": mark, "stop_reason": mark, "stop_sequence": mark}},
    ]
    import tempfile

    at = tempfile.mkdtemp()
    make_lines(rows).write.parquet(f"{at}/transcript_lines.parquet")
    safe = ("ag07_system_subtypes", "ag08_hook_shapes", "ag09_denials", "ag11_turn_lines", "ag12_stop_reasons", "ag13_stop_sequences", "ag14_content_shapes", "ag23_markers", "ag27_denials", "prj06_tool_fold", "prj13_envelopes", "prj22_error_labels", "mt33_hook_outcomes")
    for name in safe:
        for r in corpus.run(spark, at, statements.ALL[name]).collect():
            assert "SENTINEL" not in str(r.asDict()), name
    from pyspark.sql import functions as F

    words = spark.createDataFrame([(mark, "ok", None)], "a string, b string, c string").select(*[captures.word(F.col(c)).alias(c) for c in ("a", "b", "c")])
    assert tuple(words.first()) == ("<other>", "ok", "-")


def test_labels_do_not_collide_with_allowlists():
    labels = {"<other>", "<null>", "<absent>", "<no-type>", "<unnamed>", "<no-tool-result>"}
    assert not labels & {x.strip("'") for x in f"{statements.STOP_REASONS},{statements.SUBTYPES}".split(",")} and not labels & captures.ALLOWED


def test_documents_fixtures_and_releases(spark):
    good = "---\ntitle: T\ndescription: 'A description that is long enough'\ncard: a.png\ntarget: x\n---\nbody"
    docs = spark.createDataFrame([("a", good), ("b", good.replace("a.png", "no.png")), ("c", "no front matter"), ("d", good.replace("target: x", "target: y").replace(" that is long enough", ""))], "name string, text string")
    cards = spark.createDataFrame([("a.png",)], "path string")
    got = {(r["name"], r["rule"]) for r in validate.check_documents(docs, cards, {"title": "^T$"}).collect()}
    assert got == {("a", "collision"), ("b", "collision"), ("b", "card-missing"), ("c", "front-matter"), ("c", "description-length"), ("c", "field"), ("d", "description-length")}
    with pytest.raises(ValueError):
        validate.plan(validate.check_documents(docs, cards, {}))
    files = spark.createDataFrame([("a.jsonl", "1"), ("a.yaml", None), ("b.jsonl", "2"), ("c.yaml", None), ("d.txt", None)], "path string, version string")
    versions = spark.createDataFrame([("1",)], "version string")
    assert {tuple(r) for r in validate.check_fixtures(files, versions).collect()} == {("b.jsonl", "no-sidecar"), ("b.jsonl", "unknown-version"), ("c.yaml", "stray"), ("d.txt", "stray")}
    runs = spark.createDataFrame([("t", 1, 1, "failure"), ("t", 2, 2, "success"), ("u", 1, 3, "success")], "name string, started_at int, id int, conclusion string")
    assert validate.release_ready(versions, "1", runs) == "the version is published" and validate.release_ready(versions, "2", runs) is None
    assert validate.release_ready(versions, "2", runs.where("id <> 2")) == "t did not pass"
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "run_id int")
    assert captures.only_new_run(ids(1, 2), ids(1, 2, 3)) == 3
    for after in (ids(1, 2), ids(1, 4, 5)):
        with pytest.raises(ValueError):
            captures.only_new_run(ids(1, 2), after)
