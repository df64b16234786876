"""Names, ids and small texts of recordings and procedures."""

from __future__ import annotations

import hashlib
import os
import re

from .canonical import canonical

# Words that a variable which holds a credential has in its name.
SECRET_VARIABLE_WORDS = ("TOKEN", "SECRET", "PASSWORD", "PASSWD", "CREDENTIAL", "API_KEY", "APIKEY", "ACCESS_KEY", "ACCESSKEY", "PRIVATE_KEY", "PRIVATEKEY", "AUTH")


def recording_id(entries: list) -> str:
    """Digest of a recording's entries in canonical form."""
    return "sha256:" + hashlib.sha256(canonical(entries).encode("utf-8", "surrogatepass")).hexdigest()[:32]


def procedure_id(procedure: dict, scope: str) -> str:
    """Digest of what a procedure does: name, scope, steps, slots and parameters."""
    own = {"name": procedure["name"], "scope": scope, **{k: procedure.get(k) or [] for k in ("steps", "slots", "parameters")}}
    return "procedure:" + hashlib.sha256(canonical(own).encode("utf-8", "surrogatepass")).hexdigest()[:32]


def is_secret_variable(name: str) -> bool:
    """Whether a variable's name says that it holds a credential."""
    return any(word in name.upper() for word in SECRET_VARIABLE_WORDS)


def common_name(names: list[str]) -> str:
    """What names begin with, without a separator at its end, if that is three characters or more; else their number."""
    shared = os.path.commonprefix(names).rstrip("-_ ./") if names else ""
    return shared if len(shared) >= 3 else f"family of {len(names)}"


def recording_name(described: str | None, ident: str) -> str:
    """The first quoted part of a description, else its first line, else the id."""
    quoted = re.search(r"[\"“']([^\"”']+)[\"”']", described or "")
    first = (described or "").strip().split("\n")[0].strip()
    return quoted[1] if quoted else first or ident


def parse_range(text: str) -> tuple[int, int]:
    """Steps '3-7' or '5', counted from 1, as begin and end from 0, both inside."""
    m = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", text, re.A)
    begin = int(m[1]) if m else 0
    end = int(m[2] or m[1]) if m else 0
    if begin < 1 or end < begin:
        raise ValueError(f"not a range of steps: {text}")
    return begin - 1, end - 1


def describe_cut(begin: int, end: int, intent: str = "") -> str:
    """A cut for a reader; steps from 0."""
    steps = f"{begin + 1}" if begin == end else f"{begin + 1}-{end + 1}"
    return f"steps {steps}" + (f" ({intent})" if intent else "")


def renamed(template: str, names: dict[str, str]) -> str:
    """template with its slots renamed, all at once."""
    return re.sub(r"\{\{(\w+)\}\}", lambda m: "{{" + names.get(m[1], m[1]) + "}}", template)


def summarised(names: list[str], shown: int = 6) -> str:
    """Names in a line; of more than shown, the first and how many there are."""
    return ", ".join(names) if len(names) <= shown else f"{len(names)}: {', '.join(names[:shown])}, ..."


def touched_kinds(steps: list[dict]) -> list[str]:
    """Verbs of steps that read or change files, each once, sorted."""
    return sorted({s["verb"] for s in steps if s["kind"] in ("read", "write", "edit")})


def merged_constraints(groups: list[list[str]]) -> list[str]:
    """Constraints of several procedures, each once, in the order in which they come."""
    return list(dict.fromkeys(c for own in groups for c in own))


def evidence_text(procedure: dict, cuts: list[tuple[int, int, str]] = ()) -> str:
    """A procedure's steps, numbered, with what speaks for them, for someone who is to cut it; and the cuts so far."""
    lines = [f"{procedure['name']}: {len(procedure['steps'])} steps from {procedure['observations']} runs"]
    needs: dict[str, list[str]] = {}
    for c in procedure.get("contracts") or []:
        needs.setdefault(c["note"], []).append(f"{c['side']} {c['kind']} {c['target']}")
    for k, s in enumerate(procedure["steps"]):
        lines.append(f"  {k + 1}. {s['template']}  [{s['verb']}, in {s['support']:.0%}]")
        lines += [f"       {x}" for note, own in needs.items() if note in s["template"] for x in own]
    lines += [f"  cut: {describe_cut(*c)}" for c in cuts]
    return "\n".join(lines)


def inline_text(procedure: dict) -> str:
    """A procedure as a block of a prompt."""
    lines = [f"Procedure {procedure['name']} ({procedure['status']}, seen {procedure['observations']} times):"]
    lines += [f"{k + 1}. {s['template']}" for k, s in enumerate(procedure["steps"])]
    lines += [f"{p['name']}: one of {', '.join(v['label'] for v in p['variants'])}" if p["enumerated"] else f"{p['name']}: give a value" for p in procedure["parameters"]]
    return "\n".join(lines)


def store_paths(home: str, folder: str | None = None) -> dict[str, str]:
    """Where procedures and their index are: of everyone (global), and of the folder that one works in (project)."""
    out = {"global": f"{home.rstrip('/')}/procedures"} | ({"project": f"{folder.rstrip('/')}/.procedures"} if folder else {})
    return out | {"index": f"{home.rstrip('/')}/procedures-index"}
