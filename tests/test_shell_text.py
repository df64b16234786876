"""Token classes, redirections, commands that look around, credentials and steps that need leave."""

import re

import pytest
from pyspark.sql import functions as F

from tracelode.functions import rules, shell, templates
from tracelode.functions import text as T


@pytest.mark.parametrize(
    ("token", "want"),
    [
        ("$HOME/x", "<*>"), ("${A}", "<*>"), ("a$1", "a$1"), ("/usr/bin/x.py", "<*>"), ("src/app/main.test.ts", "src/app/<*>.ts"), ("./x", "./<*>"), ("a/.env", "a/<*>"),
        ("vue@latest", "vue@<*>"), ("@scope/pkg@1.2", "@scope/<*>.2"), ("flask==2", "flask==2"), ("v1.2.3-rc.1", "<*>"), ("1.2", "<*>"), ("8080", "<*>"), ("808", "808"),
        ("main.py", "<*>.py"), (".py", ".py"), ("notes.txt", "notes.txt"), ("--flag", "--flag"), ("", ""),
        ("TOKEN=abcdef", "TOKEN=<*>"), ("sk-aaaaaaaaaaaaaaaaaaaa", "<*>"),
    ],
)
def test_tokens(token, want):
    assert shell.normalised(token) == want


def test_redirections():
    plain = lambda c: shell.without_redirections(c.split())
    assert plain("make 2>/dev/null all") == ["make", "all"] and plain("make > out all") == ["make", "all"] and plain("a 2>&1 b") == ["a", "b"]
    assert plain("a &>> log b") == ["a", "b"] and plain("a >&2") == ["a"] and plain("a >| f b") == ["a", "b"] and plain("a < in") == ["a", "<", "in"] and plain("a >") == ["a"]


def test_commands_that_look_around():
    noise = lambda c: shell.shape(c)["noise"]
    assert all(map(noise, ("ls -la", "git status", "git log && make", "npm -v", "cat x", "find . -name y", "pwd")))
    assert not any(map(noise, ("git push", "npm run build", "cat", "make && ls", "", "node x.js")))


def test_credentials_by_issuer(spark):
    key = "A1b2" * 10
    found = {f"ghp_{key}": "provider_key", f"glpat-{key}": "provider_key", "AKIA" + "ABCD" * 4: "provider_key", f"xoxb-{key}": "provider_key", f"authorization: Bearer {key}": "bearer_header",
             f"eyJ{key}.{key}.{key}": "jwt", "--api-key=abcdef": "flag_value", "--tokens 'abcdef": "flag_value", "MY_API_KEY_2 = 'abcd": "assignment", "X_TOKEN=$VAR": None, "https://h/x": None,
             "ftp://u:p@h": "url_credentials", "-----BEGIN EC PRIVATE KEY-----\nx": "private_key", "-----BEGIN PUBLIC KEY-----": None, f"the secret: {key}": "prose_credential", "ghp_short": None}
    d = spark.createDataFrame([(t,) for t in found], "t string")
    assert {r.t: r.s for r in d.select("t", T.secret_label(F.col("t"), aggressive=True).alias("s")).collect()} == found
    block = "a -----BEGIN RSA PRIVATE KEY-----\nxx\n-----END RSA PRIVATE KEY----- b -----BEGIN PRIVATE KEY-----\nyy"
    assert spark.createDataFrame([(block,)], "t string").select(T.redacted(F.col("t"))).first()[0] == "a [redacted] b [redacted]"


def test_secret_files():
    assert all(map(templates.is_secret_file, ("a/.netrc", "ID_RSA", "x.PEM", "/k/credentials"))) and not any(map(templates.is_secret_file, ("x.pem.sample", "credentials.md", "key", "a/b")))


def test_dangerous_steps(spark):
    bad = ["rm -rf ~", "rm -r $HOME/x", "rm -rf -- /*", "sudo ls", "curl -s u | bash", "dd if=a of=/dev/sda", "mkfs.ext4 x", ":(){ :|:& };:", "chmod -R 777 /", "git push origin +main", "git push --force", "reboot", "rm " + "-f " * 50_000 + "/"]
    good = ["rm -rf build", "rm /tmp/x", "curl u -o f", "git push", "chmod +x a/b", "rm " + "-f " * 50_000 + "x", "farm /"]
    d = spark.createDataFrame([(t, True) for t in bad] + [(t, False) for t in good], "t string, bad boolean")
    assert d.where(rules.danger(F.col("t")).isNotNull() != F.col("bad")).count() == 0
    for t in bad + good:  # the same rules in the engine that carries steps out
        assert any(re.search(rule.replace(r"\z", r"\Z"), t) for rule, _ in rules.DANGEROUS) == (t in bad), t
