"""Readers go on behind errors; what cannot be read is uncertain and judged by its text."""

import pytest

from glintsieve.operators import analyze
from glintsieve.queries.flows import SAMPLES


@pytest.mark.parametrize("sample", SAMPLES, ids=lambda x: x.extension)
def test_labels_of_every_language(sample):
    _, _, facts, _, _ = analyze.analyse_file(f"a.{sample.extension}", sample.language, sample.text.replace("@", "7"), False)
    assert facts.parsed and facts.uncertain == list(sample.uncertain)
    assert sorted((f.name, " ".join(f.params), f.start, f.end) for f in facts.functions) == sorted((n.replace("@", "7"), *rest) for n, *rest in sample.functions)
    assert sorted((c.qualified, c.line) for c in facts.calls) == sorted(sample.calls)


def facts_of(name, language, text):
    return analyze.analyse_file(name, language, text, False)[2]


def test_errors_stay_where_they_are():
    assert facts_of("a.js", "javascript", "f(1);\n]\ng(2);\n").uncertain == [(2, 2)]
    assert facts_of("a.js", "javascript", "f(1);\nif (a {\n  b();\n}\ng(2);\n").uncertain == [(2, 5)]
    assert not facts_of("a.js", "javascript", "((((((\n").parsed
    assert facts_of("a.py", "python", "def (:\n").parsed is False
    x = facts_of("a.py", "python", "try:\n    a()\nexcept E:\n    b(\nfinally:\n    c()\nd()\nif x:\n    e()\nelse:\n    f()\n")
    assert x.uncertain == [(1, 6)] and [c.name for c in x.calls] == ["d", "e", "f"]
    deep = facts_of("a.c", "c", "int f(int a) {\n" + "(" * 3000 + "\n}\nint g(int b) {\n  h(b);\n}\n")
    assert "h" in [c.name for c in deep.calls]


def test_ruby_blocks():
    text = "def a(x)\n  y = x if x\n  z = if y then 1 else 2 end\n  while y do\n    b y\n  end\n  [1].each { |i| c(i) }\nend\nd = ->(q) { e(q) }\ndef f = g(1)\nh? 1, k: 2\n"
    x = facts_of("a.rb", "ruby", text)
    assert x.uncertain == [] and [(f.name, f.start, f.end) for f in x.functions] == [("a", 1, 8), ("f", 10, 10)]
    assert {"b", "c", "e", "h?"} <= {c.name for c in x.calls}
    assert {a.name for a in x.assignments} >= {"y", "z", "d"}


def test_flows_in_ruby():
    text = "name = req.query[:a]\nother = 1\neval(name)\neval(other)\ndef go(name)\n  eval(name)\nend\n"
    _, _, _, found, _ = analyze.analyse_file("a.rb", "ruby", text, False)
    assert set(found) == {(3, "SR004")}


def test_long_files_are_linear():
    import time

    seconds = []
    for n in (2000, 8000):
        text = "".join(f"function f{k}(a) {{\n  if (a) {{ b(a); }}\n  c = a + {k};\n}}\n" for k in range(n))
        start = time.time()
        facts = facts_of("a.js", "javascript", text)
        seconds.append(time.time() - start)
        assert len(facts.functions) == n
    assert seconds[1] < 10 * seconds[0]


def test_only_what_is_asked_for_is_worked_out(monkeypatch):
    """Columns of the lexer do not parse, columns of facts look for no flows, and each is what it is in the whole row."""
    text = "x = request.args['a']\nif x:\n    open(x)  # y\neval(x)\n"
    whole = analyze.Columns()
    whole.add("a.py", "python", text, False, False)
    assert [len(v) for v in whole.values["flows"]] == [0, 0, 1, 1]

    def not_asked(*_):
        raise AssertionError("not asked for")

    monkeypatch.setattr(analyze.taint, "flows", not_asked)
    for names in (sorted(set(analyze.KINDS) - analyze.FLOWING), ["path", "path_call"], ["line", "classes"], sorted(analyze.LEXED), ["complete"]):
        if analyze.LEXED.issuperset(names):
            monkeypatch.setattr(analyze, "read_facts", not_asked)
        part = analyze.Columns(names)
        part.add("a.py", "python", text, False, False)
        assert part.values == {n: whole.values[n] for n in names} and part.batch().num_rows == 4


def test_one_rule_by_itself(monkeypatch):
    """A rule that is looked for alone fires where it does among all; a file without one of its lines is not parsed."""
    text = "x = request.args['a']\neval(x)\nopen(x)\nos.system(x)\ncursor.execute('SELECT ' + x)\n"
    whole = analyze.matches_of("a.py", "python", text)
    for rule in {r[9] for r in whole}:
        own = analyze.matches_of("a.py", "python", text, only=frozenset([rule]))
        assert [r[:8] + r[9:] for r in own] == [r[:8] + r[9:] for r in whole if r[9] == rule]
    assert len({r[9] for r in whole}) >= 4

    def not_asked(*_):
        raise AssertionError("not asked for")

    monkeypatch.setattr(analyze, "read_facts", not_asked)
    assert analyze.matches_of("a.py", "python", text, only=frozenset(["SR002"])) == []
