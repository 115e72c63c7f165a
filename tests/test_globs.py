import pytest
from hypothesis import given
from hypothesis import strategies as st

from glintsieve.functions.globs import matches
from glintsieve.sources import gitignore


@pytest.mark.parametrize(
    ("pattern", "value", "hit"),
    [("**/cache", "a/b/cache", True), ("**/cache", "cache", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("*.py[cod]", "x.pyc", True), ("*.py[cod]", "x.py", False), ("[!a-c]", "d", True), ("[!a-c]", "b", False), ("*.py", "a/b.py", False), ("a/**", "a/b/c", True), ("a?c", "a/c", False), ("x.y", "xzy", False)],
)
def test_globs(pattern, value, hit):
    assert matches(pattern, value) is hit


@given(st.text(alphabet="abc./", max_size=12))
def test_plain_patterns_match_themselves(value):
    assert matches(value, value)


def test_last_rule_wins_and_exceptions():
    rules, notes = gitignore.parse("", "*.py\n!keep.py\nbuild/\na\\b\n")
    assert len(notes) == 1
    assert gitignore.is_ignored(rules, "x/a.py", False) and not gitignore.is_ignored(rules, "x/keep.py", False)
    assert gitignore.is_ignored(rules, "build", True) and not gitignore.is_ignored(rules, "build", False)
    nested, _ = gitignore.parse("x", "!nested.py\n")
    assert not gitignore.is_ignored(rules + nested, "x/nested.py", False)
    with pytest.raises(ValueError):
        gitignore.parse("", "!a\\b")


def test_pattern_sets_equal_single_patterns():
    import random

    from glintsieve.functions import patterns as sets
    from glintsieve.functions.globs import matches
    from glintsieve.sources.gitignore import Rule, is_ignored

    rng = random.Random(3)
    part = lambda: rng.choice(["a", "b", "src", "x.py", "test_a.py", "*", "*.py", "t*", "[ab]", "[!a]*", "?", "**"])
    globs = ["/".join(part() for _ in range(rng.randint(1, 4))) for _ in range(300)]
    paths = ["/".join(rng.choice(["a", "b", "src", "x.py", "test_a.py", "c", "tt"]) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    known = sets.PatternSet(globs)
    for path in paths:
        assert known.hits(path) == tuple(k for k, g in enumerate(globs) if matches(g, path)), path
    rules = [Rule(rng.choice(["", "a", "src/b"]), g, rng.random() < 0.4, rng.random() < 0.3, rng.random() < 0.3) for g in globs[:80]]
    ordered = sets.ignore_set(rules)
    for path in paths:
        for folder in (True, False):
            last = next((k for k in reversed(ordered.hits(path)) if folder or not rules[k].directory), None)
            assert (last is not None and not rules[last].negate) == is_ignored(rules, path, folder), path
