"""Shell commands to shapes: split, tokenised, and with what is particular to a run replaced by a wildcard."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from .text import SECRET_RULES

WILDCARD = "<*>"
_SCAN = re.compile(r"(?P<quoted>\"[^\"]*\"?|'[^']*'?)|(?P<op>&&|\|\||[;|])|(?P<space>\s+)|(?P<char>.)", re.S)
_SECRETS = [(label, re.compile(rule.replace(r"\z", r"\Z"))) for label, rule in SECRET_RULES]
# Commands that only look around, with any arguments; with one of these words next; and if they have arguments at all.
LOOKING = frozenset("date df du echo env file head ls printenv pwd stat tail tree uname wc which whoami".split())
LOOKING_AT = {"git": "branch diff log remote status", "node": "--version -v", "npm": "--version -v list ls view"}
LOOKING_INTO = frozenset("cat find grep rg".split())
READ_ONLY_TOOLS = ("read", "grep", "find", "ls")
# Suffixes of files that are written by hand.
SOURCES = "ts tsx js jsx mjs cjs vue svelte json md py go rs java kt rb sh yml yaml toml".split()
SHAPE = StructType([StructField("key", StringType()), StructField("verb", StringType()), StructField("noise", BooleanType()), StructField("values", ArrayType(StringType()))])
#: An output redirection of the shell's grammar: a number or & for both streams, the operator, and its word, which may be the next token.
_REDIRECTION = re.compile(r"(?:\d+|&)?(?:>>|>\||>&|>)(?P<word>.*)", re.S)
#: Names of packages as registries have them, after the sign of a scope; what may stand behind a name's @: a version, a tag, or a range with its operators.
_PACKAGE, _RANGE = r"@?[\w.-]+", r"[\w.^~<>=*-]+"
#: Semantic versions, shortened to two numbers too: numbers, then what is before the release or of the build.
_VERSION = r"v?\d+(?:\.\d+){1,2}(?:[-+.][\w.]+)?"
#: What a token may be, as a whole, and what stays of it; the first that fits. Anything else stays as it is.
_TOKENS = [
    (re.compile(pattern, re.S | re.A), stays)
    for pattern, stays in (
        (r".*\$(?:[A-Za-z_]|\{[A-Za-z_]).*", ()),  # a variable in it
        (r"/.*", ()),  # a path from the root
        (r"(?P<folder>.*/)(?:\.*[^/.][^/]*(?P<suffix>\.[^/.]*)|[^/]*)", ("folder", "", "suffix")),  # a path
        (rf"(?P<name>{_PACKAGE}@){_RANGE}", ("name", "")),  # a package and its version
        (rf"{_VERSION}|\d{{4,}}", ()),  # a version or a long number
        (rf"\.*[^.].*(?P<suffix>\.(?:{'|'.join(SOURCES)}))", ("", "suffix")),  # a source file
    )
]


def segments(command: str) -> tuple[list[list[str]], list[str]]:
    """Tokens (without their quotes) of each simple command, and the operators between them. Quotes hide operators and spaces."""
    out: list[list[str]] = [[]]
    operators: list[str] = []
    word: str | None = None
    for m in _SCAN.finditer(command):
        if m["quoted"] or m["char"]:
            plain = m[0] if m["char"] else m[0][1:-1] if len(m[0]) > 1 and m[0][-1] == m[0][0] else m[0][1:]
            word = (word or "") + plain
            continue
        if word is not None:
            out[-1].append(word)
            word = None
        if m["op"]:
            operators.append(m["op"])
            out.append([])
    if word is not None:
        out[-1].append(word)
    return [s for s in out if s], operators


def redirection(token: str) -> str | None:
    """The word of an output redirection ('': it is the next token), or null for any other token."""
    m = _REDIRECTION.fullmatch(token)
    return m["word"] if m else None


def without_redirections(tokens: list[str]) -> list[str]:
    """Tokens without output redirections; one whose word is not part of it takes the next token along."""
    out, words = [], iter(tokens)
    for t in words:
        word = redirection(t)
        if word is None:
            out.append(t)
        elif not word:
            next(words, None)
    return out


def normalised(token: str) -> str:
    """A token with a wildcard for the part that is particular to one run: a credential, or what its kind tells."""
    secret = next((m for _, rule in _SECRETS if (m := rule.search(token))), None)
    if secret:
        return token[: secret.start(2)] + WILDCARD + token[secret.end(2) :]
    for kind, stays in _TOKENS:
        if m := kind.fullmatch(token):
            return "".join((m[part] or "") if part else WILDCARD for part in stays) or WILDCARD
    return token


def looks_around(words: list[str]) -> bool:
    """Whether a simple command changes nothing and is no step of a procedure."""
    if not words:
        return False
    verb, after = words[0], words[1:]
    return verb in LOOKING or (bool(after) and (verb in LOOKING_INTO or after[0] in LOOKING_AT.get(verb, "").split()))


def shape(command: str) -> dict:
    """key (simple commands joined by &&), verb, noise, and the values that the wildcards stand for."""
    values, parts = [], []
    for tokens in segments(command)[0]:
        own = []
        for t in without_redirections(tokens):
            n = normalised(t)
            own.append(n)
            if n != t:
                values.append(t)
        if own:
            parts.append(" ".join(own))
    key = " && ".join(parts)
    first = parts[0].split(" ") if parts else []
    verb = " ".join([w for w in first if not w.startswith("-")][:2])
    return {"key": key, "verb": verb, "noise": looks_around(first), "values": values}


@F.pandas_udf(SHAPE)
def shell_shape(commands: pd.Series) -> pd.DataFrame:
    """shape() of each command of a column; null is the empty command."""
    return pd.DataFrame([shape(c or "") for c in commands], columns=["key", "verb", "noise", "values"])
