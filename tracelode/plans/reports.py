"""Reports as text from small results: the rows that a reader looks at, not tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.regress import SURFACE


def size_text(n: int) -> str:
    """Bytes with a unit."""
    return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KiB" if n < 1 << 20 else f"{n / (1 << 20):.2f} MiB"


def bars(rows: list[tuple[str, int]], width: int = 24) -> list[str]:
    """A line with a bar for each (name, value), the largest as wide as given."""
    most, longest = max((v for _, v in rows), default=0), max((len(n) for n, _ in rows), default=0)
    return [f"{n:<{longest}}  {'█' * (round(width * v / most) if most else 0):<{width}}  {v}" for n, v in rows]


def diff_text(row: dict, left_tools: list[str] = (), right_tools: list[str] = ()) -> str:
    """A row of compare.positional_diff, with the first call in which the tools differ."""
    head = f"{row['l']} and {row['r']}"
    if row["reason"] == "identical":
        return f"{head}: identical over {row['common_prefix']} turns"
    lines = [f"{head}: {row['common_prefix']} turns in common, then {row['reason']}"]
    at = next((k for k, (a, b) in enumerate(zip(left_tools, right_tools, strict=False)) if a != b), min(len(left_tools), len(right_tools)))
    if at < max(len(left_tools), len(right_tools)):
        one = lambda tools: tools[at] if at < len(tools) else "(end)"
        lines.append(f"  tools differ at call {at}: {one(left_tools)} | {one(right_tools)}")
    return "\n".join(lines)


def regression_text(compared: DataFrame, label: str, shown: int = 50) -> str:
    """Counts of compare(), then the requests that differ in what is done; as many as are to be shown, with how many more there are."""
    from ..operators.regress import summarise

    s = summarise(compared, []).first()
    lines = [f"{s.requests} requests: {s.identical} identical, {s.structural} structurally different, {s.surface} reworded or inspected differently"]
    rows = compared.where(f"exists(kinds, k -> k NOT IN ({', '.join(repr(k) for k in SURFACE)}))").orderBy(label).limit(shown).collect()
    for r in rows:
        lines.append(f"  {r[label]}: {', '.join(r.kinds)}")
        if "toolCalls" in r.kinds:
            lines += [f"    recorded: {r.recorded.calls}", f"    new:      {r.live.calls}"]
    if s.structural > len(rows):
        lines.append(f"  and {s.structural - len(rows)} more")
    return "\n".join(lines)


def procedure_text(p: dict) -> str:
    """A procedure for a reader or a prompt."""
    lines = [f"{p['name']}: {p['status']}, from {p['observations']} runs ({p['failures']} failed), orthogonality {p['orthogonality']:.2f}"]
    lines += [f"  {k + 1}. {s['template']}" + (f"  (in {s['support']:.0%} of runs)" if s["support"] < 1 else "") for k, s in enumerate(p["steps"])]
    for q in p["parameters"]:
        many = f" ({len(q['members'])} slots move together)" if q["enumerated"] else ""
        lines.append(f"  {q['name']} [{q['kind']}]{many}: {', '.join(v['label'] for v in q['variants'])}")
    for o in p["optional"]:
        when = ", ".join(f"{c['name']}={c['value']}" for c in o["conditions"]) or "no pattern"
        where = "" if o["before"] is None else f", before step {o['before'] + 1}"
        lines.append(f"  sometimes: {o['template']}  (in {o['observed_in']} of {o['of']} runs{where}; {when})")
    lines += [f"  {c['side']} {c['kind']} {c['target']}" for c in p["contracts"]]
    return "\n".join(lines)


def context_text(procs: DataFrame, query: list[str], budget: int = 1800, listed: int = 12) -> str:
    """What a prompt is told of stored procedures: the best match in full if it has two terms of the query and fits, else a list.

    The list names so many, says how many more there are, and is cut at the budget (characters).
    """
    from ..operators.procedures import documents
    from ..operators.search import search

    best = search(documents(procs), "name", "text", query, 1).first() if query else None
    if best is not None and best.matched >= 2:
        text = procedure_text(procs.where(procs.name == best.doc).first().asDict(recursive=True))
        if len(text) <= budget:
            return text
    rows = procs.orderBy("name").limit(listed).collect()
    if not rows:
        return ""
    more = procs.count() - len(rows)
    lines = [f"- {p.name} ({p.observations} runs{f', {p.failures} failed' if p.failures else ''}): " + ", ".join(f"{q.name}={'|'.join(v.label for v in q.variants[:4])}" for q in p.parameters) for p in rows]
    text = "\n".join(lines + ([f"- and {more} more"] if more else []))
    return text if len(text) <= budget else text[:budget] + "\n[cut]"


def recording_text(header: dict, entries: int, pooled: int, size: int) -> str:
    """A recording's header for a reader."""
    s = header.get("stats") or {}
    lines = [f"{header.get('name') or 'recording'} (profile {header.get('profile')}{', lossy' if header.get('lossy') else ''}), {size_text(size)}, {entries} entries, {pooled} pooled strings"]
    lines.append(f"  turns: {s.get('userTurns', 0)} user, {s.get('assistantTurns', 0)} assistant; {s.get('toolCalls', 0)} calls, {s.get('toolErrors', 0)} errors")
    lines.append(f"  tokens: {s.get('totalTokens', 0)} ({s.get('inputTokens', 0)} in, {s.get('outputTokens', 0)} out), ${s.get('costUsd', 0):.4f}")
    lines += [f"  {what}: {', '.join(s[key])}" for what, key in (("tools", "tools"), ("models", "models")) if s.get(key)]
    return "\n".join(lines + [f"  dropped: {d}" for d in header.get("dropped") or []])
