import fnmatch
import random
import re

import pytest

from scanloom.llm import url_filter as U
from scanloom.llm.queries import URL_RULES


def plain(glob: str) -> re.Pattern:
    return re.compile("".join(".*" if p == "**" else "[^/]*" if p == "*" else "." if p == "?" else re.escape(p) for p in re.findall(r"\*\*|\*|\?|[^*?]", glob)), re.S)


def test_automaton_against_regex():
    rng = random.Random(4)
    globs = ["".join(rng.choice(["a", "b", "/", "?", "*", "**"]) for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["a" * 150 + "**"]
    globs = [g for g in globs if "***" not in g]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["a" * 150, "a" * 149, "a" * 5000]
    got = U.ShiftAnd(globs).run([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert got[i, j] == bool(plain(g).fullmatch(t)), (t[:20], g)
    assert fnmatch.fnmatch("ab", "a?")


CASES = [
    ("http://example.com/en/1", "example.com/en/", "block"),
    ("https://WWW.Example.COM/en/1?x#y", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/", "com/", "allow"),
    ("http://example.com", None, "allow"),
    ("http://example.com?/en/", None, "allow"),
    ("http://x.net/es/1", "net/es/", "block"),
    ("http://x.net/ES/1", None, "allow"),
    ("http://x.org/a.net/es/", None, "allow"),
    ("example.com/en/", None, "allow"),
    ("", None, "allow"),
    (None, None, "allow"),
]


def test_rules(spark):
    df = spark.createDataFrame([(k, u, "mine") for k, (u, _, _) in enumerate(CASES)], "page_id long, url string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(df, URL_RULES).collect()}
    assert got == {k: (rule, verdict) for k, (_, rule, verdict) in enumerate(CASES)}
    assert U.judge(df.limit(0), URL_RULES).collect() == []


def test_no_rules(spark):
    with pytest.raises(ValueError):
        U.judge(spark.createDataFrame([("x",)], "url string"), [])


def test_very_long_urls(spark):
    df = spark.createDataFrame([("http://example.com/en/" + "a" * 300_000,), ("http://" + "a." * 100_000 + "net/fr/",)], "url string")
    assert sorted(r.rule for r in U.judge(df, URL_RULES).collect()) == ["example.com/en/", "net/fr/"]


def test_clashing_columns(spark):
    df = spark.createDataFrame([("http://x.net/es/", 1, 2, 3)], "url string, number int, `a.b` int, __rule int")
    out = U.judge(df, URL_RULES)
    assert out.columns == [*df.columns, "host", "path", "rule", "verdict"] and tuple(out.first())[1:4] == (1, 2, 3)
