"""Rendering of reports: JSON, text and Markdown. What is put together and summed up is Spark's (plans/assemble.py); here
reports become text, by tasks where they are written, one after the other where they are printed."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import history, spans
from spanforge.plans import assemble
from spanforge.plans.analyze import Analysis
from spanforge.plugins import REGISTRY, Config, Registry

#: Patterns that a report in Markdown lists; pairs and exchanges that are shown.
MOST_PATTERNS, MOST_PAIRS = assemble.MOST_PATTERNS, 5
COLOURS = {"green": "\x1b[32m", "yellow": "\x1b[33m", "red": "\x1b[31m"}


def as_dict(report: dict[str, Any] | Row) -> dict[str, Any]:
    """A report as a dict, without the parts that its session lacks."""
    own = report.asDict(recursive=True) if isinstance(report, Row) else report
    return {k: v for k, v in own.items() if v is not None or k not in assemble.PARTS}


def told(a: Analysis, config: Config = Config(), with_inputs: bool = True, most: int | None = None) -> DataFrame:
    """Reports; what several parts read is computed once."""
    if not a.labelled.is_cached:
        a.persist()
    return assemble.reports(a, config, with_inputs, most)


def each(reports: DataFrame) -> Iterator[dict[str, Any]]:
    """Reports in their order, a partition at a time."""
    return map(as_dict, reports.toLocalIterator())


def collect(a: Analysis, config: Config = Config(), with_inputs: bool = True) -> list[dict[str, Any]]:
    """One dict for each session, by session; for a few sessions."""
    return list(each(told(a, config, with_inputs).orderBy("session_id")))


def write(a: Analysis, path: str, form: str = "json", config: Config = Config(), with_inputs: bool = True, registry: Registry = REGISTRY) -> None:
    """Under path: sessions (a report each, in order of sessions, as JSON lines, or as text of a form), totals, and all
    similar pairs, drift steps and exchanges, of which a report has the first ones. Nothing passes through the driver."""
    if form not in ("json", "text", "markdown") and not registry.formatter(form):
        raise ValueError(f"no output format {form!r}")
    reports = told(a, config, with_inputs, MOST_PAIRS)
    ordered = reports.orderBy("session_id")
    if form == "json":
        ordered.write.json(f"{path}/sessions")
    else:
        lines = lambda batches: (pd.DataFrame({"value": [rendered([as_dict(json.loads(x))], form, registry=registry) for x in b["x"]]}) for b in batches)
        ordered.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("x")).mapInPandas(lines, "value string").write.text(f"{path}/sessions")
    assemble.totals(assemble.brief(a)).write.json(f"{path}/totals")
    if with_inputs:
        for name, (rows, order) in assemble.details(a, config).items():
            rows.repartition("session_id", *(c for c in ("i", "prompt_index", "pair_index") if c in rows.columns)).sortWithinPartitions("session_id", *order).write.json(f"{path}/{name}")


def waste_usd(r: dict) -> float:
    return r.get("waste_breakdown", {}).get("total_cost_usd", 0.0)


def cost_usd(r: dict) -> float:
    return (r.get("economics") or {}).get("cost_usd") or 0.0


def totals(results: list[dict]) -> dict[str, Any]:
    """Of sessions side by side; the efficiency is weighted by tokens for a group, plain for a comparison."""
    tokens, waste = sum(r["total_tokens"] for r in results), sum(r["waste_tokens"] for r in results)
    return {
        "average_ter": round(sum(r["aggregate_ter"] for r in results) / len(results), 4) if results else 0.0, "total_tokens": tokens, "waste_tokens": waste, "waste_percent": round(waste * 100 / tokens, 1) if tokens else 0.0,
        "total_cost_usd": round(sum(map(cost_usd, results)), 6), "total_waste_cost_usd": round(sum(map(waste_usd, results)), 6),
    }


def as_json(results: list[dict], comparison: bool = False) -> str:
    if comparison:
        return json.dumps({"sessions": results} | totals(results), indent=2, default=str)
    return json.dumps(results[0] if len(results) == 1 else results, indent=2, default=str)


def _short(session_id: str) -> str:
    return session_id if len(session_id) <= 11 else session_id[:8] + "..."


def _ter(value: float, colour: bool) -> str:
    return f"{COLOURS[T.band_of(value)]}{value:.2f}\x1b[0m" if colour else f"{value:.2f}"


def _waste_table(r: dict) -> list[str]:
    table = r.get("waste_breakdown")
    if not table:
        return []
    out = ["  Waste by source:", f"    {'source':<24}{'tokens':>10}{'%':>7}{'cost':>11}{'count':>7}"]
    out += [f"    {x['source'].replace('_', ' '):<24}{x['tokens']:>10,}{x['percentage']:>7.1f}{'$' + format(x['cost_usd'], '.4f'):>11}{x['n']:>7}" for x in table["sources"]]
    return [*out, f"    {'all':<24}{table['total_tokens']:>10,}{100:>7.1f}{'$' + format(table['total_cost_usd'], '.4f'):>11}"]


def _input_lines(r: dict) -> list[str]:
    i = r.get("input_analysis")
    if not i:
        return []
    out = []
    if b := i.get("token_breakdown"):
        out += [f"    user tokens: {b['user_prompt'] + b['user_tool_result']:,} (prompts {b['user_prompt']:,}, tool results {b['user_tool_result']:,}), {b['user_ratio']:.1%} of all", f"    model tokens: reasoning {b['model_reasoning']:,}, tools {b['model_tool']:,}, text {b['model_generation']:,}"]
    if (p := i.get("prompt_similarity")) and p.get("prompts", 0) >= 2:
        near = p.get("similar_pairs", [])
        out.append(f"    prompt redundancy: {p['redundancy']:.0%} of {p['prompts']} prompts, {p.get('n_similar', len(near))} alike")
        out += [f"      #{x['i'] + 1} \"{x['text_i']}\" ~ #{x['j'] + 1} \"{x['text_j']}\" ({x['similarity']:.2f})" for x in near[:MOST_PAIRS]]
    if (d := i.get("intent_drift")) and d.get("steps"):
        out.append(f"    intent: {d['trajectory']}, average similarity {d['avg_similarity']:.2f}")
        out += [f"      #{x['prompt_index']} to #{x['prompt_index'] + 1}: {x['direction']} ({x['similarity']:.2f})" for x in d.get("drift_steps", [])]
    if (q := i.get("prompt_response_alignment")) and q.get("pairs"):
        out.append(f"    alignment of answers: {q['avg_alignment']:.2f} of {q['pairs']}, {q['low_pairs']} low")
        out += [f"      #{x['pair_index'] + 1} \"{x['prompt']}\": {x['similarity']:.2f}" for x in q.get("exchanges", [])[:MOST_PAIRS]]
    return ["  Input:", *out] if out else []


def as_text(results: list[dict], colour: bool = False) -> str:
    lines = []
    for r in results:
        e, waste = r.get("economics") or {}, r["waste_tokens"] * 100 / r["total_tokens"] if r["total_tokens"] else 0.0
        head = f"  TER {_ter(r['aggregate_ter'], colour)} (raw {r['raw_ratio']:.2f}), waste {waste:.1f} %"
        lines += [f"Session {_short(r['session_id'])}", head + (f", cost ${cost_usd(r):.4f}, of it waste ${waste_usd(r):.4f}" if e else "")]
        lines += [f"  Tokens {r['total_tokens']:,}, aligned {r['aligned_tokens']:,}, waste {r['waste_tokens']:,}"]
        lines.append("  Phases: " + ", ".join(f"{p.replace('_', ' ')} {_ter(r[f'{p}_score'], colour)}" for p in spans.PHASES))
        if e:
            state = "bloat" if e.get("bloat") else "accelerating" if e.get("super_linear") else "steady"
            lines.append(f"  Input {e['input_tokens']:,}, cache reads {e['cache_read_tokens']:,}, cache hits {e['cache_hit_rate']:.1%}")
            if e.get("growth_rate") is not None:
                lines.append(f"  Context grew {e['growth_rate']:.2f} times over {e['turns']} turns: {state}")
            if e.get("early_ter") is not None:
                lines.append(f"  TER by thirds: {e['early_ter']:.2f}, {e['mid_ter']:.2f}, {e['late_ter']:.2f}")
        lines += _waste_table(r)
        lines += [f"  - {p['pattern_type'].replace('_', ' ')}: {p['tokens_wasted']:,} tokens" + (f" ({T.short(p['detail'])})" if p.get("detail") else "") for p in r.get("waste_patterns", [])]
        if s := r.get("waste_summary"):
            lines.append(f"  {s['explanation']}")
        lines += _input_lines(r)
    if len(results) > 1:
        lines.append(_sums_line(totals(results)))
    return "\n".join(lines)


def _sums_line(t: dict, comparison: bool = False) -> str:
    waste = "" if comparison else f"waste {t['waste_tokens']:,} tokens, "
    return f"Average TER {t['average_ter']:.2f}, {waste}cost ${t['total_cost_usd']:.4f}, of it waste ${t['total_waste_cost_usd']:.4f}"


def _table(results: list[dict], roles: list[str], colour: bool) -> list[str]:
    out = [f"  {'':<10}{'session':<13}{'TER':>6}{'waste %':>9}{'tokens':>12}{'cost':>10}{'waste $':>10}{'patterns':>10}"]
    for role, r in zip(roles, results, strict=True):
        waste = r["waste_tokens"] * 100 / r["total_tokens"] if r["total_tokens"] else 0.0
        pad = " " * (6 - len(f"{r['aggregate_ter']:.2f}"))
        out.append(f"  {role:<10}{_short(r['session_id']):<13}{pad}{_ter(r['aggregate_ter'], colour)}{waste:>9.1f}{r['total_tokens']:>12,}{cost_usd(r):>10.4f}{waste_usd(r):>10.4f}{len(r.get('waste_patterns', [])):>10}")
    return out


def comparison_text(results: list[dict], colour: bool = False) -> str:
    return "\n".join([*_table(results, [str(i) for i in range(1, len(results) + 1)], colour), _sums_line(totals(results), True)])


def as_markdown(r: dict) -> str:
    e = r.get("economics") or {}
    out = [f"# Session {r['session_id']}", "", "| Measure | Value |", "| --- | --- |", f"| TER | {r['aggregate_ter']:.4f} |", f"| Tokens | {r['total_tokens']:,} |", f"| Waste | {r['waste_tokens']:,} |"]
    if e:
        out += [f"| Cost | ${e['cost_usd']:.4f} |", f"| Waste cost | ${waste_usd(r):.4f} |", f"| Cache hits | {e['cache_hit_rate']:.2%} |"]
        if e.get("growth_rate") is not None:
            out.append(f"| Context growth | {'bloat' if e['bloat'] else format(e['growth_rate'], '.2f')} |")
        if e.get("early_ter") is not None:
            out.append(f"| TER by thirds | {e['early_ter']:.2f}, {e['mid_ter']:.2f}, {e['late_ter']:.2f} |")
    out += ["", "## Phases", ""] + [f"- {p}: {r[f'{p}_score']:.3f}" for p in spans.PHASES]
    found = r.get("waste_patterns", [])
    if found:
        out += ["", "## Waste", ""] + [f"- {p['pattern_type']}: {p['tokens_wasted']:,} tokens" for p in found[:MOST_PATTERNS]]
    advice = [f"The weakest phase is {min(spans.PHASES, key=lambda p: r[f'{p}_score'])}: say more plainly what is wanted there."]
    if e and e["cache_hit_rate"] < 0.5:
        advice.append("Few tokens come from the cache: keep the start of prompts stable.")
    if found:
        advice.append(f"Begin with {found[0]['pattern_type']}: it wastes most.")
    if r.get("input_analysis", {}).get("prompt_similarity", {}).get("redundancy", 0) > 0.2:
        advice.append("Many prompts repeat earlier ones: join them.")
    return "\n".join([*out, "", "## Next", "", *(f"- {x}" for x in advice), "", "Tokens are estimated as a quarter of the characters; waste dollars are scaled to billed output where it is known."]) + "\n"


def baseline_markdown(before: dict, after: dict) -> str:
    out = ["# Baseline", "", "| Measure | Before | After | Delta |", "| --- | --- | --- | --- |"]
    for k in ("aggregate_ter", "raw_ratio", "total_tokens", "waste_tokens"):
        out.append(f"| {k} | {before[k]} | {after[k]} | {round(after[k] - before[k], 4)} |")
    for k, of in (("cost_usd", cost_usd), ("waste_cost_usd", waste_usd)):
        out.append(f"| {k} | {of(before):.4f} | {of(after):.4f} | {of(after) - of(before):.4f} |")
    return "\n".join(out) + "\n"


def groups(a: Analysis, config: Config = Config()) -> Iterator[dict[str, Any]]:
    """Each group, one after the other: its measures, its parent and its agents."""
    sums, members = assemble.grouped(a, told(a, config, with_inputs=False))
    measures = F.struct(F.col("group_id").alias("parent_session_id"), *(c for c in sums.columns if c != "group_id"))
    rows = members.join(sums.select("group_id", measures.alias("group")), "group_id").orderBy("group_id", F.desc("is_parent"), "session_id")
    for _, own in groupby(each(rows), lambda r: r["group_id"]):
        found = [(r.pop("group"), r.pop("is_parent"), {k: v for k, v in r.items() if k != "group_id"}) for r in own]
        yield {"group": found[0][0], "parent": next((r for _, first, r in found if first), None), "subagents": [r for _, first, r in found if not first]}


def grouped(a: Analysis, config: Config = Config()) -> list[dict[str, Any]]:
    return list(groups(a, config))


def grouped_json(a: Analysis, config: Config = Config()) -> str:
    return "\n".join(json_lines(groups(a, config)))


def grouped_lines(a: Analysis, config: Config = Config(), colour: bool = False) -> Iterator[str]:
    for g in groups(a, config):
        x = g["group"]
        own = ([g["parent"]] if g["parent"] else []) + g["subagents"]
        yield f"Group {_short(x['parent_session_id'])}: TER {_ter(x['weighted_ter'], colour)}, waste {x['waste_percent']:.1f} %, cost ${x['total_cost_usd']:.4f}, of it waste ${x['total_waste_cost_usd']:.4f}, tokens {x['total_tokens']:,}, agents {x['subagent_count']}"
        yield from _table(own, (["parent"] if g["parent"] else []) + ["agent"] * len(g["subagents"]), colour)


def grouped_text(a: Analysis, config: Config = Config(), colour: bool = False) -> str:
    return "\n".join(grouped_lines(a, config, colour))


def json_lines(items: Iterator[dict]) -> Iterator[str]:
    """Pieces of one JSON text, the item itself if there is only one, else a list."""
    pending, n = None, 0
    for x in items:
        if pending is not None:
            yield ("[\n" if n == 1 else "") + pending + ","
        pending, n = json.dumps(x, indent=2, default=str), n + 1
    yield "[]" if pending is None else pending + ("\n]" if n > 1 else "")


def printed(a: Analysis, reports: DataFrame, form: str, comparison: bool = False, colour: bool = False, registry: Registry = REGISTRY) -> Iterator[str]:
    """What rendered() gives, in pieces: sessions come a partition at a time, sums from Spark."""
    if registry.formatter(form):
        yield rendered(list(each(reports)), form, comparison, colour, registry)
        return
    if form not in ("json", "text", "rich"):
        raise ValueError(f"no output format {form!r}")
    colour = colour or form == "rich"
    if form == "json" and not comparison:
        yield from json_lines(each(reports))
        return
    sums = lambda: assemble.totals(assemble.brief(a)).first().asDict()
    n = 0
    if form == "json":
        yield '{"sessions": ['
    for n, r in enumerate(each(reports), 1):
        if form == "json":
            yield ("," if n > 1 else "") + json.dumps(r, indent=2, default=str)
        elif comparison:
            yield from _table([r], [str(n)], colour)[n > 1 :]
        else:
            yield as_text([r], colour)
    if form == "json":
        yield "], " + json.dumps({k: v for k, v in sums().items() if k != "sessions"}, indent=2)[1:]
    elif comparison or n > 1:
        yield _sums_line(sums(), comparison)


def compared(a: Analysis, by: str, config: Config = Config()) -> DataFrame:
    """Reports in the order of a comparison."""
    return history.compare(told(a, config, with_inputs=False), by)


def rendered(results: list[dict], form: str, comparison: bool = False, colour: bool = False, registry: Registry = REGISTRY) -> str:
    """By a registered formatter of that name, else as json, rich (coloured text) or text."""
    if own := registry.formatter(form):
        return own.format_comparison(results) if comparison else "\n".join(own.format_result(r) for r in results)
    if form == "json":
        return as_json(results, comparison)
    if form == "markdown":
        return "\n".join(map(as_markdown, results))
    if form not in ("text", "rich"):
        raise ValueError(f"no output format {form!r}")
    colour = colour or form == "rich"
    return comparison_text(results, colour) if comparison else as_text(results, colour)
