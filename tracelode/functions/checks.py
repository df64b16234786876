"""Commands that check what was done before them, and outcomes of runs told by them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commands that check, by their first, second and third word; nothing: any word, or none.
CHECKS = [
    ("npm pnpm yarn bun", "test", ""),
    ("npm pnpm yarn bun", "run", "test tests build lint typecheck check verify"),
    ("pytest jest vitest rspec ctest gotestsum", "", ""),
    ("cargo go", "test build check vet", ""),
    ("make tsc", "", ""),
    ("mvn gradle ./gradlew", "test verify build", ""),
    ("dotnet", "test", ""),
]
#: Evidence of an outcome that quotes a command: its first line, of so many characters at most.
EVIDENCE_CHARS = 140


def is_check(command: str) -> bool:
    """Whether a command is a check: a test run, a build."""
    words = command.split()
    return any(all(not allowed or words[k : k + 1] and words[k] in allowed.split() for k, allowed in enumerate(rule)) for rule in CHECKS)


def checks(command: Column) -> Column:
    """is_check() of a column; null is no check."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(command, F.lit("")), r"\s+", " ")), " ")
    fits = F.lit(False)
    for rule in CHECKS:
        own = F.lit(True)
        for k, allowed in enumerate(rule):
            if allowed:
                own &= F.coalesce(F.get(words, F.lit(k)).isin(*allowed.split()), F.lit(False))
        fits |= own
    return fits


def outcome_of(results: list[tuple[str | None, bool]]) -> dict:
    """How a run ended, from its tool results in order, each as (command or None, whether it is an error): status and evidence.

    The last check decides. Without one, errors that the last result got over leave it unknown, others make it failed.
    """
    errors = sum(bad for _, bad in results)
    told = lambda command: line[: EVIDENCE_CHARS - 1] + "…" if len(line := command.strip().split("\n")[0]) > EVIDENCE_CHARS else line
    checked = next(((c, bad) for c, bad in reversed(results) if c and is_check(c)), None)
    if checked:
        earlier = [f"{errors} errors in the run"] if errors else []
        return {"status": "failed" if checked[1] else "success", "evidence": [f"check {'failed' if checked[1] else 'passed'}: {told(checked[0])}", *earlier], "declared": False}
    if not errors:
        return {"status": "unknown", "evidence": [], "declared": False}
    last, bad = results[-1]
    if bad:
        return {"status": "failed", "evidence": [f"{errors} errors, the last result is one"], "declared": False}
    return {"status": "unknown", "evidence": [f"{errors} errors, got over but not checked", *([f"last: {told(last)}"] if last else [])], "declared": False}
