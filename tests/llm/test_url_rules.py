"""The automaton against regular expressions, and verdicts of odd URLs."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexalign.llm import url_rules


def as_pattern(glob):
    parts = {"**": ".*", "*": "[^/]*", "?": "."}
    return re.compile("".join(parts.get(p, re.escape(p)) for p in re.findall(r"\*\*|.", glob)).encode(), re.S)


@settings(max_examples=200, deadline=None)
@given(globs=st.lists(st.text("ab/*?.", max_size=40), min_size=1, max_size=8), urls=st.lists(st.text("ab/.", max_size=30), max_size=10))
def test_all_globs_match_as_regular_expressions(globs, urls):
    raw = [u.encode() for u in urls]
    got = url_rules.GlobAutomaton(globs).matches(raw)
    want = [[bool(as_pattern(g).fullmatch(u)) for g in globs] for u in raw]
    assert got.tolist() == want


def test_long_urls_and_many_words():
    globs = ["a" * 70 + "*", "**" + "b" * 130, "x?z"] * 3
    urls = [b"a" * 200_000, b"/" * 90_000 + b"b" * 130, b"", b"xyz"]
    got = url_rules.GlobAutomaton(globs).matches(urls)
    assert got.tolist() == [[True, False, False] * 3, [False, True, False] * 3, [False] * 9, [False, False, True] * 3]
    assert np.array_equal(url_rules.GlobAutomaton(["**"]).matches([b""]), [[True]])


def test_verdicts(spark):
    cases = [
        ("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("https://a.example.com/EN/", "a.example.com", "/EN/", "com/", "allow"),
        ("https://a.com", "a.com", "", None, "allow"), ("https://a.com?x=/en/", "a.com", "", None, "allow"),
        ("ftp://b.net/fr/1", "b.net", "/fr/1", "net/fr/", "block"), ("b.net/fr/1", "", "", None, "allow"),
        ("https://xnet/fr/", "xnet", "/fr/", None, "allow"), ("https://evil.org/x.com/y", "evil.org", "/x.com/y", None, "allow"),
        ("https://a.org/x/wp-admin/y", "a.org", "/x/wp-admin/y", None, "block"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("https://big-casino.org/", "big-casino.org", "/", None, "block"), ("x://é.com/ü", "é.com", "/ü", "com/", "allow"),
        ("http://a://b.com/c", "a:", "//b.com/c", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], "x", "y") for i, c in enumerate(cases)] + [(None, None, "x", "y")],
                               "page_id long, url string, host string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)} | {None: ("", "", None, "allow")}
    assert url_rules.judge_urls(df.where("false")).collect() == []
