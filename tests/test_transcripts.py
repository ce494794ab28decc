from __future__ import annotations

import datetime
import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from spanforge.plans import analyze, cli, report
from spanforge.plugins import Config, Registry, parse_cost_model
from spanforge.sources import history, transcripts


def entry(kind, content, uuid="u", request=None, usage=None, stop=None, session="s1", ts="2026-01-01T00:00:00Z"):
    out = {"type": kind, "uuid": uuid, "sessionId": session, "timestamp": ts, "message": {"role": kind, "content": content}}
    if request:
        out["requestId"] = request
    if usage:
        out["message"]["usage"] = usage
    if stop:
        out["message"]["stop_reason"] = stop
    return out


def write(path, entries):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries) + "\n")
    return str(path)


SESSION = [
    entry("user", "Fix the failing test in the parser module", "m1"),
    entry("assistant", [{"type": "text", "text": "partial"}], "m2", "r1", {"input_tokens": 100, "output_tokens": 3}),
    entry("assistant", [{"type": "thinking", "text": "I should look at the parser test file first"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"z": 1, "file_path": "a.py"}}], "m3", "r1", {"input_tokens": 100, "output_tokens": 20, "cache_read_input_tokens": 300}),
    entry("user", [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "def f(): pass"}, {"type": "text", "text": "x"}]}], "m4"),
    {"type": "summary", "summary": "meta"},
    entry("assistant", "Done, the parser test passes now", "m5", "r2", {"input_tokens": 200, "output_tokens": 30}, "end_turn"),
]


def test_request_keeps_largest_at_first_place(spark, tmp_path):
    path = write(tmp_path / "s1.jsonl", SESSION)
    msgs = transcripts.messages(transcripts.parse_entries(transcripts.read_lines(spark, path))).orderBy("position").collect()
    assert [m.uuid for m in msgs] == ["m1", "m3", "m4", "m5"]
    assert [m.output_tokens for m in msgs] == [0, 20, 0, 30]


def test_spans_phases_and_tokens(spark, tmp_path):
    a = analyze.transcripts_at(spark, write(tmp_path / "s1.jsonl", SESSION))
    got = [(s.phase, s.text, s.token_count) for s in a.spans.orderBy("position").collect()]
    assert [p for p, _, _ in got] == ["generation", "reasoning", "tool_use", "tool_use", "generation"]
    assert got[2][1] == 'Read {"z":1,"file_path":"a.py"}' and got[3][1] == "def f(): pass x"
    assert all(n == max(1, len(t) // 4) for _, t, n in got)


def test_content_that_looks_like_json_and_escapes(spark, tmp_path):
    path = write(tmp_path / "s2.jsonl", [entry("user", "[1]"), entry("assistant", [{"type": "tool_use", "id": "a", "name": "Edit", "input": {"k": "é😀"}}, "bare", 7, {"type": "odd", "text": "no"}])])
    blks = transcripts.blocks(transcripts.messages(transcripts.parse_entries(transcripts.read_lines(spark, path))))
    got = transcripts.spans(blks).orderBy("position").collect()
    assert [got[0].text, got[2].text] == ["[1]", "bare"]
    assert got[1].text in ('Edit {"k":"é😀"}', 'Edit {"k":"é\\uD83D\\uDE00"}')  # either spelling of a pair counts alike
    assert got[1].token_count == len("Edit " + json.dumps({"k": "é😀"}, separators=(",", ":"))) // 4


def test_malformed_lines(spark, tmp_path):
    path = write(tmp_path / "s3.jsonl", [SESSION[0], "{broken", SESSION[5]])
    lines = transcripts.read_lines(spark, path)
    assert transcripts.messages(transcripts.parse_entries(lines, "skip")).count() == 2
    assert transcripts.parse_entries(lines, "report").where("malformed").select("line_no").collect()[0].line_no == 2
    with pytest.raises(Exception, match="malformed line 2"):
        transcripts.messages(transcripts.parse_entries(lines)).collect()


def test_subagents_group_and_listing(spark, tmp_path):
    write(tmp_path / "p.jsonl", SESSION)
    time.sleep(0.02)
    write(tmp_path / "p" / "subagents" / "agent-1.jsonl", SESSION[:1] + SESSION[5:])
    a = analyze.transcripts_at(spark, str(tmp_path))
    assert {r.session_id for r in a.results.collect()} == {"s1", "agent-1"}
    listed = transcripts.sessions(spark, str(tmp_path)).collect()
    assert [(r.name, r.subagents) for r in listed] == [("p.jsonl", 1)]


def test_grouped_reports(spark, tmp_path):
    write(tmp_path / "p.jsonl", SESSION)
    write(tmp_path / "p" / "subagents" / "agent-1.jsonl", SESSION[:1] + SESSION[5:])
    a = analyze.transcripts_at(spark, str(tmp_path))
    (g,) = report.grouped(a)
    assert g["group"]["parent_session_id"] == "s1" and g["group"]["subagent_count"] == 1
    assert g["parent"]["session_id"] == "s1" and [x["session_id"] for x in g["subagents"]] == ["agent-1"]
    assert g["group"]["total_tokens"] == g["parent"]["total_tokens"] + g["subagents"][0]["total_tokens"]
    text = report.grouped_text(a)
    assert "agents 1" in text and "agent-1" in text


def test_listing_under_a_folder_named_like_agents(spark, tmp_path):
    root = tmp_path / "subagents" / "my_subagents_here"
    write(root / "p.jsonl", SESSION)
    write(root / "p" / "subagents" / "agent-1.jsonl", SESSION)
    assert [(r.name, r.subagents) for r in transcripts.sessions(spark, str(root)).collect()] == [("p.jsonl", 1)]


def reads(n, tool="Read", file="a.py", extra=""):
    return [entry("assistant", [{"type": "tool_use", "id": f"t{i}", "name": tool, "input": {"file_path": file, "note": "x" * 40 + extra}}], f"a{i}", f"r{i}", {"input_tokens": 1, "output_tokens": 5}) for i in range(n)]


def test_over_reading_counts_spans_tokens(spark, tmp_path):
    a = analyze.transcripts_at(spark, write(tmp_path / "s.jsonl", [SESSION[0], *reads(4)]))
    each = [s.token_count for s in a.spans.where("block_type = 'tool_use'").orderBy("position").collect()]
    assert len(each) == 4 and each[0] > 10
    (got,) = [p for p in a.patterns.collect() if p.pattern_type == "over_reading"]
    assert (got.start_position, got.end_position, got.spans_involved, got.tokens_wasted, got.detail) == (1, 4, 4, sum(each[1:]), "a.py")


def test_abandoned_counts_spans_tokens(spark, tmp_path):
    a = analyze.transcripts_at(spark, write(tmp_path / "s.jsonl", [SESSION[0], *reads(2, "Edit"), *reads(3, file="b.py")[2:]]))
    (got,) = [p for p in a.patterns.collect() if p.pattern_type == "abandoned_approach"]
    own = [s.token_count for s in a.spans.where("tool = 'Edit'").collect()]
    assert (got.start_position, got.end_position, got.spans_involved, got.tokens_wasted) == (1, 2, 2, sum(own))


def test_every_detector_on_a_transcript(spark, tmp_path):
    use = lambda i, name, **given: entry("assistant", [{"type": "tool_use", "id": f"u{i}", "name": name, "input": given}], f"m{i}", f"q{i}", {"input_tokens": 1, "output_tokens": 9})
    said = lambda i, text: entry("user", [{"type": "tool_result", "tool_use_id": f"u{i}", "content": text}], f"n{i}")
    thought = "x" * 8000
    rows = [SESSION[0]]
    for i in range(3):
        rows += [use(i, "Read", file_path="a.py"), said(i, "def f(): return 1  # file text " * 4)]
    for i in range(3, 6):
        rows += [use(i, "Edit", file_path="b.py", old="x", new=str(i)), said(i, "done")]
    for i in range(6, 9):
        rows += [use(i, "Bash", command=f"cat  log.txt | tail -{i}"), said(i, "Permission denied")]
    rows += [entry("assistant", [{"type": "thinking", "text": thought}, {"type": "text", "text": "ok"}], "th", "qt", {"input_tokens": 1, "output_tokens": 3000})]
    rows += [entry("assistant", "This very sentence is told twice in the session", f"d{i}", f"e{i}", {"input_tokens": 1, "output_tokens": 9}) for i in range(2)]
    a = analyze.transcripts_at(spark, write(tmp_path / "s.jsonl", rows))
    got = {p.pattern_type: p for p in a.patterns.collect()}
    file_tokens = len("def f(): return 1  # file text " * 4) // 4
    assert got["repetitive_read"].tokens_wasted == 2 * file_tokens and got["repetitive_read"].detail == "a.py"
    assert (got["edit_fragmentation"].spans_involved, got["edit_fragmentation"].tokens_wasted) == (3, 0)
    denied = len("Permission denied") // 4
    assert (got["bash_antipattern"].spans_involved, got["bash_antipattern"].tokens_wasted) == (3, 3 * denied)
    assert (got["failed_tool_retry"].spans_involved, got["failed_tool_retry"].tokens_wasted) == (3, 3 * denied)
    assert (got["repeated_command"].spans_involved, got["repeated_command"].tokens_wasted, got["repeated_command"].detail) == (3, 2 * denied, "cat log.txt")
    assert got["permission_loop"].spans_involved == 3
    assert got["duplicate_tool_call"].detail == 'Read {"file_path":"a.py"}'
    assert got["context_restatement"].tokens_wasted == len("This very sentence is told twice in the session") // 4
    assert got["verbose_thinking"].tokens_wasted == 2000 - 10 and got["over_reading"].detail == "a.py"


def test_cost_model_and_calibration(spark, tmp_path):
    path = write(tmp_path / "s1.jsonl", SESSION)
    plain = report.collect(analyze.transcripts_at(spark, path))[0]
    dear = report.collect(analyze.transcripts_at(spark, path, Config(model=parse_cost_model("6,30,0.6,7.5"))))[0]
    assert dear["economics"]["cost_usd"] == pytest.approx(2 * plain["economics"]["cost_usd"])
    own = [entry("assistant", "word " * 60, f"d{i}", f"e{i}", {"input_tokens": 10, "output_tokens": 300}) for i in range(2)]
    r = report.collect(analyze.transcripts_at(spark, write(tmp_path / "s2.jsonl", [SESSION[0], *own])))[0]
    (source,) = [x for x in r["waste_breakdown"]["sources"] if x["source"] == "over_explanation"]
    assert r["economics"]["calibration"] == pytest.approx(600 / 150)
    assert source["cost_usd"] == pytest.approx(source["tokens"] * 4 * 15 / 1e6)
    assert r["waste_summary"]["by_phase"] == {"generation": source["tokens"]} and "waste" in r["waste_summary"]["explanation"]


def test_quick_reading(spark, tmp_path):
    rows = [
        entry("user", "second", ts="2026-01-01T00:00:05Z"),
        entry("assistant", [{"type": "thinking", "thinking": "deep thought", "text": "t"}, "bare", {"type": "tool_use", "id": "t", "name": "Read", "input": {"a": 1}}], request="r1", usage={"output_tokens": 1}, ts="2026-01-01T00:00:01Z"),
        "{broken",
        entry("assistant", "longer answer", request="r1", usage={"output_tokens": 9}, ts="2026-01-01T00:00:09Z"),
        entry("user", [{"type": "tool_result", "tool_use_id": "t", "content": "result"}, {"type": "text", "text": "third"}], ts="2026-01-01T00:00:06Z"),
        entry("assistant", [{"type": "thinking", "thinking": "deep thought", "text": "t"}, "bare", {"type": "tool_use", "id": "t", "name": "Read", "input": {"a": 1}}], ts="2026-01-01T00:00:01Z"),
    ]
    lines = transcripts.read_lines(spark, write(tmp_path / "q.jsonl", rows))
    prompts, found = transcripts.quick(transcripts.parse_entries(lines, "skip"))
    assert [(p.session_id, p.text) for p in prompts.orderBy("prompt_index").collect()] == [("s1", "second"), ("s1", "third")]
    assert [(s.phase, s.text) for s in found.orderBy("position").collect()] == [("reasoning", "deep thought"), ("tool_use", 'Read: {"a":1}'), ("tool_use", "result"), ("generation", "longer answer")]


def test_wrong_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        transcripts.read_lines(spark, str(tmp_path / "none.jsonl"))
    (tmp_path / "x.txt").write_text("{}")
    with pytest.raises(ValueError, match="not a .jsonl"):
        transcripts.read_lines(spark, str(tmp_path / "x.txt"))
    (tmp_path / "e.jsonl").write_text(" \n\n")
    with pytest.raises(Exception, match="empty file"):
        transcripts.messages(transcripts.parse_entries(transcripts.read_lines(spark, str(tmp_path / "e.jsonl")))).collect()


def test_polls(spark, tmp_path):
    folder, held = tmp_path / "t", str(tmp_path / "held")
    write(folder / "a.jsonl", SESSION[:2])
    assert [r.event for r in transcripts.poll_changes(spark, str(folder), held + "1").collect()] == ["new_session"]
    got = []
    gained = lambda batch: got.extend((r.session, json.loads(r.raw)) for r in batch.orderBy("session", "offset").collect())
    transcripts.poll_lines(spark, str(folder), held + "2", gained)
    assert got == [("a", x) for x in SESSION[:2]]
    assert transcripts.poll_changes(spark, str(folder), held + "1").count() == 0
    with open(folder / "a.jsonl", "a") as f:
        f.write(json.dumps(SESSION[2]) + "\n" + json.dumps(SESSION[3])[:20])
    os.utime(folder / "a.jsonl", (time.time() + 5, time.time() + 5))
    write(folder / "b.jsonl", SESSION[:1])
    assert {r.path.rsplit("/", 1)[-1]: r.event for r in transcripts.poll_changes(spark, str(folder), held + "1").collect()} == {"a.jsonl": "modified_session", "b.jsonl": "new_session"}
    got.clear()
    transcripts.poll_lines(spark, str(folder), held + "2", gained)
    assert got == [("a", SESSION[2]), ("b", SESSION[0])]


def test_large_files_are_read_in_splits(spark, tmp_path):
    lines = {s: [f"{s} {k} " + "x" * (k * 7 % 90) if k % 5 else "" for k in range(300)] for s in ("a", "b")}
    for s, own in lines.items():
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / "t" / f"{s}.jsonl").write_text("\n".join(own) + "\r\n" * (s == "b"))
    (tmp_path / "t" / "c.jsonl").write_text("")
    (tmp_path / "t" / "d.jsonl").write_text(" \n\n")
    for size in ("200", "4096", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = transcripts.read_lines(spark, str(tmp_path / "t")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        for s, own in lines.items():
            assert [(r.line_no, r.raw.rstrip("\r")) for r in sorted(rows, key=lambda r: r.line_no) if r.stem == s] == list(enumerate(own, 1))
        assert {r.stem for r in rows if r.blank} == {"d"}
    assert [(r.stem, r.blank) for r in transcripts.read_lines(spark, str(tmp_path / "t" / "c.jsonl")).collect()] == [("c", True)]


def test_plugins_take_part(spark, tmp_path, capsys):
    from pyspark.sql import functions as F

    class Long:
        name = "long"

        def detect(self, labelled):
            return labelled.where("token_count > 5").select("session_id", F.lit("long_span").alias("pattern_type"), F.col("position").alias("start_position"), F.col("position").alias("end_position"), F.lit(1).cast("long").alias("spans_involved"), F.col("token_count").alias("tokens_wasted"), F.lit(None).cast("string").alias("detail"))

    class NoReasoning:
        name = "none"

        def pre_process(self, spans):
            return spans.where("phase <> 'reasoning'")

        def post_process(self, results):
            return results.withColumn("mark", F.lit("seen"))

    class Shout:
        name = "shout"

        def format_result(self, result):
            return f"TER!! {result['aggregate_ter']}"

        def format_comparison(self, results):
            return f"{len(results)}!!"

    registry = Registry()
    for kind, plugin in (("detector", Long()), ("middleware", NoReasoning()), ("formatter", Shout())):
        registry.register(kind, plugin)
    a = analyze.transcripts_at(spark, write(tmp_path / "s1.jsonl", SESSION), registry=registry)
    assert a.spans.where("phase = 'reasoning'").count() == 0 and a.results.first().mark == "seen"
    assert a.patterns.where("pattern_type = 'long_span'").count() > 0
    assert report.rendered(report.collect(a), "shout", registry=registry).startswith("TER!!")
    with pytest.raises(ValueError, match="no output format"):
        report.rendered([], "other")


def test_repeated_result_is_waste_and_cost(spark, tmp_path):
    result = lambda i: entry("user", [{"type": "tool_result", "tool_use_id": i, "content": "the very same output again"}])
    a = analyze.transcripts_at(spark, write(tmp_path / "s4.jsonl", [SESSION[0], result("a"), result("b"), SESSION[5]]))
    r = a.results.first()
    assert r.waste_tokens == 6 and r.tool_use_score == 0.5
    assert a.economics.first().cost_usd == pytest.approx((200 * 3 + 30 * 15) / 1e6)


def test_reports_and_command_line(spark, tmp_path, capsys):
    path = write(tmp_path / "s1.jsonl", SESSION)
    a = analyze.transcripts_at(spark, path)
    one = report.collect(a)[0]
    assert json.loads(report.as_json([one]))["session_id"] == "s1"
    assert "TER" in report.as_text([one]) and "# Session s1" in report.as_markdown(one)
    assert "| aggregate_ter |" in report.baseline_markdown(one, one)
    assert cli.main(["analyze", path, "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["total_tokens"] == one["total_tokens"]
    assert cli.main(["list", str(tmp_path), "--format", "json"]) == 0
    assert cli.main(["analyze", path, "--phase-weights", "1,1,1"]) == 1
    assert cli.main(["report", path, "-o", str(tmp_path / "r.md")]) == 0 and os.path.getsize(tmp_path / "r.md") > 50
    capsys.readouterr()
    assert cli.main(["analyze", path, "--format", "json", "--cost-model", "6,30,0.6,7.5"]) == 0
    assert json.loads(capsys.readouterr().out)["economics"]["cost_usd"] == pytest.approx(2 * one["economics"]["cost_usd"])
    assert cli.main(["analyze", path, "--cost-model", "dear"]) == 1
    write(tmp_path / "t" / "s2.jsonl", [entry("user", "another task", session="s2"), entry("assistant", "fine", "x", "y", {"output_tokens": 4}, session="s2")])
    capsys.readouterr()
    assert cli.main(["compare", path, str(tmp_path / "t"), "--baseline"]) == 0 and "| cost_usd |" in capsys.readouterr().out
    assert cli.main(["compare", path, str(tmp_path / "t"), "--format", "json"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert len(got["sessions"]) == 2 and got["total_cost_usd"] >= one["economics"]["cost_usd"]
    text = report.as_text([one])
    assert "Waste by source" in text or not one.get("waste_breakdown")
    assert "Input:" in text and "Phases:" in text and "Context grew" in text and report.as_text([one], True).count("\x1b[") > 3


def test_reports_are_written_by_tasks(spark, tmp_path):
    write(tmp_path / "in" / "s1.jsonl", SESSION)
    write(tmp_path / "in" / "s2.jsonl", [entry("user", text, session="s2") for text in ["please mend the parser"] * 5] + [entry("assistant", "fine", "x", "y", {"output_tokens": 4}, session="s2")])
    a = analyze.transcripts_at(spark, str(tmp_path / "in")).persist()
    want = report.collect(a)
    read = lambda form, name: [x for p in sorted(glob.glob(str(tmp_path / form / name / "part-*"))) for x in open(p).read().splitlines()]
    for form in ("json", "text"):
        report.write(a, str(tmp_path / form), form, with_inputs=form == "json")
    got = [json.loads(x) for x in read("json", "sessions")]
    assert [(x["session_id"], x["total_tokens"]) for x in got] == [(x["session_id"], x["total_tokens"]) for x in want]
    whole, shown = want[1]["input_analysis"]["prompt_similarity"], got[1]["input_analysis"]["prompt_similarity"]
    assert (whole["n_similar"], len(whole["similar_pairs"])) == (10, 10) and (shown["n_similar"], shown["similar_pairs"]) == (10, whole["similar_pairs"][: report.MOST_PAIRS])
    pairs = [json.loads(x) for x in read("json", "similar_pairs")]
    assert sorted((x["i"], x["j"]) for x in pairs if x["session_id"] == "s2") == [(i, j) for i in range(5) for j in range(i + 1, 5)]
    (sums,) = [json.loads(x) for x in read("json", "totals")]
    assert {k: sums[k] for k in report.totals(want)} == report.totals(want) and sums["sessions"] == 2
    # The written text is that of the command line, but for the sums, which are of their own.
    plain = [{k: v for k, v in x.items() if k != "input_analysis"} for x in want]
    assert read("text", "sessions") == report.as_text(plain[:1]).splitlines() + report.as_text(plain[1:]).splitlines()
    assert "\n".join(report.printed(a, report.told(a, with_inputs=False).orderBy("session_id"), "text")) == report.as_text(plain)


def test_snapshot_changes(spark):
    t = lambda rows: spark.createDataFrame(rows, "path string, modificationTime long")
    got = {r.path: r.event for r in transcripts.changes(t([("a", 1), ("b", 1)]), t([("a", 2), ("b", 1), ("c", 1)])).collect()}
    assert got == {"a": "modified_session", "c": "new_session"}


def test_file_hash(spark, tmp_path):
    import hashlib

    path = write(tmp_path / "x.jsonl", SESSION)
    assert transcripts.hashes(spark, path).first().sha256 == hashlib.sha256(open(path, "rb").read()).hexdigest()


def test_history_keeps_the_latest_version(spark, tmp_path):
    path, at = str(tmp_path / "h"), lambda d: datetime.datetime(2026, 3, d)
    assert history.history(spark, path).count() == 0
    results = lambda *rows: spark.createDataFrame(rows, "session_id string, ter double, ts timestamp")
    day = lambda m: datetime.datetime(2026, m, 3)
    first = results(("a", 0.5, day(1)), ("b", 0.6, day(2)), (None, 0.1, None))
    history.append(first, path, "001", at(1))
    history.append(first, path, "001", at(1))  # the same run twice
    history.append(results(("a", 0.9, day(1))), path, "other", at(1))
    history.append(results(("a", 0.7, day(1))).withColumn("more", F.lit(1)), path, "001", at(2))
    rows = lambda **k: sorted(((r.project, r.session_id, r.ter, r.more) for r in history.history(spark, path, **k).collect()), key=repr)
    want = sorted([("001", "a", 0.7, 1), ("001", "b", 0.6, None), ("001", None, 0.1, None), ("other", "a", 0.9, None)], key=repr)
    assert rows() == want
    assert rows(project="001", since="2026-02") == [x for x in want if x[0] == "001" and x[1] != "a"]
    plan = history.history(spark, path, "001")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(in_project" in plan
    history.compact(spark, path)
    assert history._files(spark, path) == [] and rows() == want
    history.append(results(("b", 0.8, day(2))), path, "001", at(3))
    history.append(results(("b", 0.2, day(2))), path, "001", at(1))  # late, and older
    want[want.index(("001", "b", 0.6, None))] = ("001", "b", 0.8, None)
    assert rows() == want
    history.compact(spark, path)
    history.compact(spark, path)
    assert rows() == want


def test_changes_are_told_once(spark, tmp_path):
    folder, held, got = tmp_path / "t", str(tmp_path / "held"), []
    write(folder / "a.jsonl", SESSION[:1])
    tell = lambda settle=0.0: transcripts.tell_changes(spark, str(folder), held, lambda c: got.append((c["path"].rsplit("/", 1)[-1], c["event"])), settle)
    tell()
    tell()
    assert got == []
    write(folder / "b.jsonl", SESSION[:1])
    os.utime(folder / "a.jsonl", (time.time() + 5, time.time() + 5))
    tell(600.0)  # both may still be written
    assert got == []

    def fails(change):
        raise RuntimeError("no one listens")

    with pytest.raises(RuntimeError):
        transcripts.tell_changes(spark, str(folder), held, fails)
    tell()
    assert sorted(got) == [("a.jsonl", "modified_session"), ("b.jsonl", "new_session")]
    tell()
    assert len(got) == 2
    assert sorted(os.listdir(held))[-1] != "staged" and len(os.listdir(held)) == 2  # older listings are gone


def test_watching_changes(spark, tmp_path):
    folder, got = tmp_path / "t", []
    write(folder / "a.jsonl", SESSION[:1])
    query = transcripts.watch_changes(spark, str(folder), str(tmp_path / "held"), got.append, "1 second", 0.0)
    try:
        until = time.time() + 90
        while not os.path.isdir(tmp_path / "held" / "listings" / "0") and time.time() < until:
            time.sleep(0.5)
        write(folder / "b.jsonl", SESSION[:1])
        while not got and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert [(c["path"].rsplit("/", 1)[-1], c["event"]) for c in got] == [("b.jsonl", "new_session")]


def test_strategies_quick_and_validate(spark, tmp_path, capsys):
    lines = [entry("user", "fix the parser", "m1"), entry("assistant", [{"type": "text", "text": "the parser is fixed"}], "m2", "r1"), entry("user", "write documentation for the reader", "m3"), entry("assistant", [{"type": "text", "text": "documentation for the reader"}], "m4", "r2")]
    path = write(tmp_path / "s.jsonl", lines)
    near = {}
    for name in ("whole", "sliding", "hierarchical"):
        a = analyze.transcripts_at(spark, path, strategy=name)
        near[name] = {r.text: r.similarity for r in a.labelled.collect()}
    s = lambda x, y: round(float(brute(x) @ brute(y)), 4)
    said, first, second = "documentation for the reader", "fix the parser", "write documentation for the reader"
    assert near["hierarchical"][said] == pytest.approx(0.7 * s(said, second) + 0.3 * s(said, first), abs=1e-4)
    assert near["sliding"][said] == pytest.approx(max(s(said, first), s(said, second)), abs=1e-4)
    assert near["sliding"][said] > near["whole"][said]
    write(tmp_path / "q.jsonl", [*lines, "{broken"])
    assert cli.main(["analyze", "--quick", str(tmp_path / "q.jsonl")]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["method"] == "quick" and told["session_id"] == "s1" and told["total_tokens"] > 0
    assert cli.main(["analyze", str(tmp_path / "q.jsonl")]) == 1
    assert cli.main(["validate", path]) == 0 and "4 of 4 lines valid" in capsys.readouterr().out
    assert cli.main(["validate", str(tmp_path / "q.jsonl")]) == 1
    out = capsys.readouterr().out
    assert "4 of 5 lines valid" in out and ":5: invalid JSON" in out


def brute(text):
    import hashlib

    import numpy as np

    out, low = np.zeros(384), text.lower()
    for i in range(len(low) - 2):
        out[int(hashlib.md5(low[i : i + 3].encode()).hexdigest(), 16) % 384] += 1
    return out / np.sqrt(out @ out)

