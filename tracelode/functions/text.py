"""Text functions as columns: normalising, credentials, file kinds, search terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What issuers put before their keys, the characters that follow, and how many at least.
ISSUERS = [
    ("sk-", "A-Za-z0-9_-", 16),
    ("sk_live_", "A-Za-z0-9", 16),
    ("sk_test_", "A-Za-z0-9", 16),
    ("ghp_", "A-Za-z0-9", 20),
    ("gho_", "A-Za-z0-9", 20),
    ("ghu_", "A-Za-z0-9", 20),
    ("ghs_", "A-Za-z0-9", 20),
    ("ghr_", "A-Za-z0-9", 20),
    ("github_pat_", "A-Za-z0-9_", 20),
    ("glpat-", "A-Za-z0-9_-", 16),
    ("AKIA", "A-Z0-9", 16),
    ("ASIA", "A-Z0-9", 16),
    ("xoxa-", "A-Za-z0-9-", 10),
    ("xoxb-", "A-Za-z0-9-", 10),
    ("xoxp-", "A-Za-z0-9-", 10),
    ("xoxr-", "A-Za-z0-9-", 10),
    ("xoxs-", "A-Za-z0-9-", 10),
]
# Credentials that a name tells. Each is a name, made of one of the words, a separator and a value; of these what may stand
# before and after the word within the name, the separators, the value's signs, and how many of them at least.
NAMED = {
    "flag_value": {
        "words": "password passwd token apikey api-key secret auth credential",
        "before": "--", "after": "s?", "separator": r"(?:=|\s+)[\"']?", "value": r"[^\s\"']", "least": 6, "any_case": True,
    },
    "assignment": {
        "words": "API_KEY APIKEY ACCESS_KEY ACCESSKEY SECRET_KEY SECRETKEY PRIVATE_KEY PRIVATEKEY PASSWORD PASSWD TOKEN SECRET CREDENTIAL",
        "before": r"\b[A-Z0-9_]*", "after": "[A-Z0-9_]*", "separator": r"\s*=\s*[\"']?", "first": r"[^\s\"'$]", "value": r"[^\s\"']", "least": 4, "any_case": False,
    },
    "prose_credential": {
        "words": "token key secret password passwd apikey api_key api-key credential bearer auth",
        "before": r"\b", "after": r"\b", "separator": "[^A-Za-z0-9]{0,6}", "value": "[A-Za-z0-9_./+=-]", "least": 12, "any_case": True,
    },
}
_BASE64URL = "[A-Za-z0-9_-]"
#: What a bearer header carries (token68 of RFC 7235), twelve characters at least.
_TOKEN68 = "([A-Za-z0-9._~+/-]{12,}=*)"


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _named(label: str) -> tuple[str, str]:
    """Label and pattern of a credential that a name tells: the name with its separator, then the value."""
    n = NAMED[label]
    value = f"{n['first']}{n['value']}{{{n['least'] - 1},}}" if "first" in n else f"{n['value']}{{{n['least']},}}"
    return label, f"{'(?i)' if n['any_case'] else ''}({n['before']}{_any(n['words'].split())}{n['after']}{n['separator']})({value})"


def _issued(prefix: str, signs: str, least: int) -> str:
    return f"{prefix}[{signs}]{{{least},}}"


#: Name and pattern of each kind of credential, in the order in which they are tried. What the first group holds stays, the second goes.
#: No look-around, so that other engines take them as they are.
SECRET_RULES = [
    # RFC 7468: from the line that opens a private key to the one that closes it, or to the end of a text that was cut off.
    ("private_key", r"()(-----BEGIN(?: [A-Z]+)* PRIVATE KEY-----[\s\S]*?(?:-----END(?: [A-Z]+)* PRIVATE KEY-----|\z))"),
    # RFC 3986: a scheme, and user and password before the host.
    ("url_credentials", r"(?i)(\b[a-z][a-z0-9+.-]*://)([^\s:/?#@]+:[^\s/?#@]+)@"),
    # RFC 6750: the header's name and scheme, or the scheme alone.
    ("bearer_header", rf"(?i)(\bauthorization[ \t]*:\s*bearer\s+){_TOKEN68}"),
    ("bearer_header", rf"(?i)(\bbearer\s+){_TOKEN68}"),
    ("provider_key", r"()\b(" + "|".join(_issued(*issuer) for issuer in ISSUERS) + ")"),
    # RFC 7519: three parts in base64url; a JSON object's first two characters encode to eyJ.
    ("jwt", rf"()\b(eyJ{_BASE64URL}{{8,}}\.{_BASE64URL}{{8,}}\.{_BASE64URL}{{4,}})"),
    _named("flag_value"),
    _named("assignment"),
]
PROSE_RULE = _named("prose_credential")
MARK = "[redacted]"

# Kinds of files, in the order in which they are tried, by base name, by beginning or end of the base name, or by folder.
_FILES = [
    ("manifest", "name", "package.json pyproject.toml cargo.toml go.mod"),
    ("lockfile", "name", "package-lock.json pnpm-lock.yaml yarn.lock bun.lock bun.lockb cargo.lock poetry.lock"),
    ("tsconfig", "between", "tsconfig .json"),
    ("tsconfig", "between", "jsconfig .json"),
    ("build-config", "begins", " ".join(f"{tool}.config." for tool in "vite webpack rollup esbuild next nuxt astro svelte tailwind postcss babel jest vitest".split())),
    ("ci", "folder", ".github/workflows .gitlab-ci .circleci"),
    ("ci", "name", ".travis.yml azure-pipelines.yml"),
    ("container", "name", "dockerfile docker-compose.yml docker-compose.yaml .dockerignore"),
    ("test", "marked", "test spec"),
    ("test", "inside", "test tests __tests__"),
    ("docs", "ends", ".md .mdx .txt .rst"),
    ("docs", "inside", "doc docs"),
    ("config", "begins", ".env .editorconfig .eslintrc .prettierrc .gitignore .npmrc"),
    ("config", "ends", ".yml .yaml .toml .ini"),
    ("asset", "ends", ".png .jpg .jpeg .svg .gif .webp .ico .woff .woff2 .ttf"),
    ("source", "ends", ".ts .tsx .js .jsx .mjs .cjs .vue .svelte .py .go .rs .java .kt .rb .sh .css .scss .html"),
]


def _file_rule(how: str, values: str) -> tuple[str, str]:
    """Where to look, and the pattern that says that one of the values is there."""
    escaped = [v.replace(".", r"\.") for v in values.split()]
    one = _any(escaped)
    return {
        "name": ("base", f"^{one}$"),
        "begins": ("base", f"^{one}"),
        "ends": ("base", f"{one}$"),
        "between": ("base", f"^{escaped[0]}.*{escaped[-1]}$"),
        "marked": ("base", rf"\.{one}\.[a-z]+$"),
        "folder": ("path", f"(?:^|/){one}(?:/|$)"),
        "inside": ("path", f"(?:^|/){one}/"),
    }[how]


FILE_KINDS = [(kind, *_file_rule(how, values)) for kind, how, values in _FILES]
ABSOLUTE = r"^(\.\./|/|~/|[A-Za-z]:[\\/])"


def redacted(text: Column, aggressive: bool = False) -> Column:
    """text with every credential masked. Rules are applied one after the other to the whole text, so none survives a mask before it."""
    for label, rule in SECRET_RULES + ([PROSE_RULE] if aggressive else []):
        text = F.regexp_replace(text, rule, "$1" + MARK.replace("[", r"\[") + ("@" if label == "url_credentials" else ""))
    return text


def secret_label(text: Column, aggressive: bool = False) -> Column:
    """Name of the first rule that finds a credential, or null."""
    return F.coalesce(*[F.when(text.rlike(rule), F.lit(label)) for label, rule in SECRET_RULES + ([PROSE_RULE] if aggressive else [])])


def file_kind(path: Column) -> Column:
    lower = F.lower(path)
    of = {"path": lower, "base": F.regexp_extract(lower, r"([^/]*)$", 1)}
    return F.coalesce(*[F.when(of[where].rlike(rule), F.lit(kind)) for kind, where, rule in FILE_KINDS], F.lit("other"))


def is_portable_path(value: Column) -> Column:
    return ~value.rlike(ABSOLUTE)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def camel_split(text: Column) -> Column:
    """text with a blank where camel case and acronyms are split."""
    return F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def words(split: Column) -> Column:
    """Words of what camel_split() gives, of any length and in their own case. The class is that of ASCII letters and digits, which Java tells by a table."""
    return F.split(split, r"\P{Alnum}+")


def terms(text: Column) -> Column:
    """Lower-case search terms of two characters or more; camel case and acronyms are split."""
    return F.transform(F.filter(words(camel_split(text)), lambda w: F.length(w) > 1), lambda w: F.lower(w))


def slug(name: Column, longest: int = 64) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(body, 1, longest)


def one_line(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def excerpt(text: Column, width: int = 120) -> Column:
    line = one_line(text)
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 1), F.lit("…"))).otherwise(line)
