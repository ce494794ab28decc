"""Growing transcripts as a stream: only new bytes, no line lost or repeated, stream = one fold over the whole file."""

from __future__ import annotations

import io
import json
import random

import pytest

from spanforge.streaming import live, tail


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def message(role, content, request=None, **more):
    return json.dumps({"type": role, "sessionId": "s", "message": {"role": role, "content": content, **({"requestId": request} if request else {})}, **more}, ensure_ascii=False)


def story(seed, n=40):
    r = random.Random(seed)
    words = "fix the parser and add tests for broken input lines in the reader ünï".split()
    lines = []
    for k in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 25)))
        lines.append(r.choice([
            message("user", text), message("assistant", [{"type": "text", "text": text}], f"r{k}"), message("assistant", [{"type": "thinking", "text": text}, {"type": "tool_use", "name": "Read", "input": {"z": 1, "file_path": text}}], f"r{k - r.randint(0, 2)}"),
            message("user", [{"type": "tool_result", "tool_use_id": "t", "content": text}]), message("assistant", [{"type": "tool_result", "content": [{"text": text}]}, "bare", 5], f"q{k}"), "{broken", "", json.dumps({"type": "summary"}), json.dumps(["no", "entry"]), message("assistant", ""),
        ]))
    return lines


def fold(lines):
    """(place, total, aligned, ter) by one pass over a whole file."""
    place, intent, seen, out = 0, "", set(), []
    n, good = dict.fromkeys(live.PHASES, 0), dict.fromkeys(live.PHASES, 0)
    for line in lines:
        at, place = place, place + len(line.encode()) + 1
        try:
            entry = json.loads(line)
        except ValueError:
            continue
        if not isinstance(entry, dict) or "message" not in entry:
            continue
        m, tokens = entry["message"], 0
        request = m.get("requestId")
        if request and request in seen and m["content"]:
            continue
        if request and m["role"] == "assistant" and m["content"]:
            seen.add(request)
        content = m["content"] if isinstance(m["content"], list) else [{"type": "text", "text": m["content"]}]
        for b in content:
            if not isinstance(b, dict):
                continue
            text = b.get("text", "")
            if b["type"] == "tool_use":
                text = b["name"] + " " + json.dumps(b["input"], sort_keys=True)
            if b["type"] == "tool_result":
                text = b["content"] if isinstance(b["content"], str) else json.dumps(b["content"])
            if not text:
                continue
            if m["role"] == "user":
                intent = (intent + " " + text if intent else text) if b["type"] == "text" else intent
                continue
            phase = live.PHASE_OF.get(b["type"], "generation")
            k = max(1, len(text) // 4)
            tokens += k
            n[phase] += k
            if not intent or live.similarity(live.counts_of(text), live.counts_of(intent)) >= live.THRESHOLD:
                good[phase] += k
        if tokens:
            out.append((at, sum(n.values()), sum(good.values()), round(sum(live.PHASE_WEIGHTS[p] * (good[p] / n[p] if n[p] else 1.0) for p in live.PHASES), 4)))
    return out


def told(signals, session):
    return [(s["msg_seq"], s["total_tokens"], s["aligned_tokens"], s["ter"]) for s in signals if s["session_id"] == session]


def run(spark, folder, checkpoint, on_signal):
    query = live.watch(spark, str(folder), str(checkpoint), on_signal, None)
    assert query.awaitTermination(180)


def test_watch_follows_growing_files(spark, tmp_path):
    folder = tmp_path / "project"
    (folder / "one" / "subagents").mkdir(parents=True)
    files = {"a": folder / "a.jsonl", "one/subagents/agent": folder / "one" / "subagents" / "agent.jsonl"}
    lines = {s: story(k) for k, s in enumerate(files)}
    got = []
    data = {s: "".join(x + "\n" for x in lines[s]).encode() for s in files}
    cuts = {s: sorted(random.Random(s).sample(range(len(d)), 2)) for s, d in data.items()}
    (folder / "notes.txt").write_text("no transcript")
    for step in range(3):  # each step is a query of its own: it was stopped between two batches
        for s, f in files.items():
            begin, end = [0, *cuts[s], len(data[s])][step : step + 2]
            with f.open("ab") as out:
                out.write(data[s][begin:end])  # mostly in the middle of a line
        run(spark, folder, tmp_path / "cp", got.append)
    run(spark, folder, tmp_path / "cp", got.append)
    for s in files:
        assert told(got, s) == fold(lines[s])
    whole = []
    run(spark, folder, tmp_path / "cp2", whole.append)
    strip = lambda x: sorted((tuple(sorted(r.items())) for r in x), key=repr)
    assert strip(whole) == strip(got)


def test_a_failed_batch_is_told_again(spark, tmp_path):
    folder = tmp_path / "project"
    folder.mkdir()
    first, more = story(7, 15), story(8, 15)
    (folder / "a.jsonl").write_text("".join(x + "\n" for x in first))
    got = []
    run(spark, folder, tmp_path / "cp", got.append)
    with (folder / "a.jsonl").open("a") as f:
        f.write("".join(x + "\n" for x in more))

    def fails(signal):
        raise RuntimeError("the sink is gone")

    with pytest.raises(Exception, match="the sink is gone"):
        live.watch(spark, str(folder), str(tmp_path / "cp"), fails, None).awaitTermination(180)
    run(spark, folder, tmp_path / "cp", got.append)
    assert told(got, "a") == fold(first + more)


def test_offsets_and_splits(tmp_path):
    reader = tail.TailReader({"path": str(tmp_path), "splitBytes": "7"})
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    assert reader.latestOffset() == {} == reader.initialOffset()
    a.write_bytes(b"one\ntwo\nhalf")
    assert reader.latestOffset() == {str(a): 8}
    b.write_bytes(b"")
    lines = lambda start, end: [(r["file"][-7], r["offset"], r["raw"]) for p in reader.partitions(start, end) for x in reader.read(p) for r in x.to_pylist()]
    assert lines({}, reader.latestOffset()) == [("a", 0, "one"), ("a", 4, "two")]
    before = reader.latestOffset()
    with a.open("ab") as f:
        f.write(b" done\n\n" + "é".encode()[:1] + b"\n")
    after = reader.latestOffset()
    assert lines(before, after) == [("a", 8, "half done"), ("a", 18, ""), ("a", 19, "�")]
    assert reader.partitions(after, after) == []
    a.write_bytes(b"new\n")
    assert lines(after, reader.latestOffset()) == [("a", 0, "new")]
    a.unlink()
    assert reader.latestOffset() == {str(b): 0}
    assert tail.TailReader({"path": str(b)}).latestOffset() == {str(b): 0}


@pytest.mark.parametrize("split", [1, 2, 5, 64, 1000])
def test_lines_begin_in_one_split(split, monkeypatch):
    monkeypatch.setattr(tail, "CHUNK", 3)
    r = random.Random(split)
    lines = [bytes(r.choices(b"abc", k=r.choice([0, 1, 5, 20]))) for _ in range(30)]
    data = b"".join(x + b"\n" for x in lines)
    found = [x for at in range(0, len(data), split) for x in tail.lines_in(io.BytesIO(data), at, min(len(data), at + split), at == 0)]
    assert [x for _, x in found] == lines
    assert tail.whole_lines_end(io.BytesIO(data + b"rest of a line"), len(data) + 14) == len(data)


def batch_totals(spark, lines):
    """The dashboard of whole files."""
    rows = [(s, at, total, aligned, ter) for s, x in lines.items() for at, total, aligned, ter in fold(x)]
    return live.dashboard(spark.createDataFrame(rows, "session_id string, msg_seq long, total_tokens long, aligned_tokens long, ter double")).first().asDict()


def test_dashboard_follows_all_sessions(spark, tmp_path):
    folder, lines, got = tmp_path / "project", {}, []
    folder.mkdir()

    def step(idle_ms=None, **more):
        for s, x in more.items():
            lines[s] = lines.get(s, []) + x
            with (folder / f"{s}.jsonl").open("a") as f:
                f.write("".join(line + "\n" for line in x))
        assert live.watch_dashboard(spark, str(folder), str(tmp_path / "cp"), got.append, None, idle_ms=idle_ms).awaitTermination(180)

    step(a=story(1, 20), b=story(2, 20))
    assert got[-1] == batch_totals(spark, lines)
    step(a=story(3, 20), c=story(4, 30))
    assert got[-1] == batch_totals(spark, lines)
    told = len(got)
    step()
    assert len(got) == told  # nothing new


def test_idle_sessions_leave_the_dashboard(spark, tmp_path):
    folder, got = tmp_path / "project", []
    folder.mkdir()
    first, second = story(1, 20), story(2, 20)

    def step(name, lines):
        with (folder / f"{name}.jsonl").open("a") as f:
            f.write("".join(line + "\n" for line in lines))
        assert live.watch_dashboard(spark, str(folder), str(tmp_path / "cp"), got.append, None, idle_ms=1).awaitTermination(180)

    step("a", first)
    step("b", second)
    assert got[-1] == batch_totals(spark, {"b": second})
    step("a", story(3, 20))
    assert got[-1] == batch_totals(spark, {"a": first + story(3, 20)})
