import pytest
from hypothesis import given
from hypothesis import strategies as st

from glintsieve.operators import parts
from glintsieve.operators.lexer import ends, lex, lex_part, split_lines


def one(text, language):
    return lex(text, language)[0][0]


@pytest.mark.parametrize(
    ("language", "text", "code", "literals"),
    [
        ("python", "x = 'a' # c", "x =     ", ["'a'"]),
        ("javascript", "var r = /a[/]b/g; x = a / b;", "var r =  ; x = a / b;", []),
        ("rust", "fn f<'a>(x: &'a str) { r#\"q\"# }", "fn f<'a>(x: &'a str) {    }", ['r#"q"#']),
        ("csharp", 's = @"a""b";', "s = @    ;", ['"a""b"']),
        ("go", "a := `x\\`; b", "a :=    ; b", ["`x\\`"]),
    ],
)
def test_views(language, text, code, literals):
    line = one(text, language)
    assert (line.code.split(), line.literals) == (code.split(), literals)


def test_state_crosses_lines():
    lines, complete = lex("a = '''x\neval(y)\n''' + f()", "python")
    assert [x.masked.strip() for x in lines] == ["a =", "", "+ f()"] and complete
    assert not lex("/* open", "c")[1] and not lex("x = 'open", "python")[1]


def test_nested_comments_only_where_they_nest():
    assert "eval" not in "".join(x.masked for x in lex("/* /* */ eval */", "rust")[0])
    assert "eval" in lex("/* /* */ eval", "c")[0][0].masked


def test_lines():
    assert split_lines("a\r\nb\n") == ["a", "b"] and split_lines("") == [] and split_lines("\n") == [""]


@given(st.text(alphabet="ab'\"`/*#\\\n ré{}(r)", max_size=60), st.sampled_from(["python", "javascript", "c", "rust", "csharp", "go", "ruby", "php"]))
def test_views_keep_the_width(text, language):
    lines, _ = lex(text, language)
    assert [x.text for x in lines] == split_lines(text)
    for x in lines:
        assert len(x.visible.encode()) == len(x.text.encode()) == len(x.masked.encode())


def test_an_escaped_quote_does_not_close_a_triple_quote():
    assert not lex("a = '''b\\'''", "python")[1] and lex("a = '''b\\\\'''", "python")[1]


def test_cut():
    assert list(parts.cut("ab\nc\n\nlonger\nx", 3)) == ["ab\n", "c\n\n", "longer\n", "x"]
    assert list(parts.cut("", 3)) == [] and list(parts.cut("long", 1)) == ["long"] and list(parts.cut("a\r\nb", 1)) == ["a\r\n", "b"]


TOKENS = ["a", "'", '"', "`", "/*", "*/", "#", "\\", "\n", "\r\n", " ", "é", 'r#"', '"#', '"""', "'''", '@"', "//", "/x/", "= /"]
LANGUAGES = ["python", "javascript", "c", "rust", "csharp", "go", "ruby", "php", "swift", "config"]


def views(lines):
    return [(x.text, x.code, x.visible, x.masked, x.literals, x.comments) for x in lines]


@given(st.lists(st.sampled_from(TOKENS), max_size=40), st.sampled_from(LANGUAGES))
def test_parts_have_the_views_of_the_whole(tokens, language):
    text, lines, closed, before = "".join(tokens), [], True, None
    for part in parts.cut(text, 1):
        own, ok, after = lex_part(part, language, before)
        assert ends(part, language, before) == (ok, after)
        lines, closed, before = lines + own, closed and ok, after
    whole, complete = lex(text, language)
    assert views(lines) == views(whole) and (closed and before is None) == complete


def test_lexed_by_parts_on_spark(spark):
    import random

    rng = random.Random(3)
    rows = [(f"f{k}", language, "".join(rng.choice(TOKENS) for _ in range(300)), k) for k, language in enumerate(LANGUAGES * 3)]
    rows += [("deep", "rust", "/*\n" * 6 + "*/\n" * 6 + "let a = 1;", 0), ("empty", "c", "", 0), ("null", "c", None, 0), ("other", None, "x", 0), (None, "c", "x", 0), ("open", "c", "a\n/* b\nc\n", 0), ("v.vue", "javascript", "<p>\n<script>\nlet a = `x\ny`\n</script>", 0)]
    files = spark.createDataFrame(rows, "path string, language string, content string, line int")
    found, complete = parts.lexed(files, 20)
    got = {}
    for r in found.orderBy("path", "line").collect():
        got.setdefault(r.path, []).append((r.line, (r.text, r.code, r.visible, r.masked, r.literals, r.comments)))
    ended = {r.path: r.complete for r in complete.collect()}
    for path, language, content, _ in rows:
        if path and language and path != "v.vue":
            lines, done = lex(content or "", language)
            assert got.get(path, []) == list(enumerate(views(lines), 1)) and ended[path] == done, path
    assert [x[1][3].strip() for x in got["v.vue"]] == ["", "", "let a =", "", ""] and ended["v.vue"]
    assert len(ended) == len(rows) - 2
    none, all_none = parts.lexed(files.limit(0))
    assert none.count() == all_none.count() == 0


def test_a_large_file_is_the_work_of_many_tasks(spark):
    from pyspark.sql import functions as F

    text = "".join(f"a{k} = '''open\nend''' + b\n" for k in range(4000))
    files = spark.createDataFrame([("large.py", "python", text)], "path string, language string, content string")
    cut = parts.parts_of(files, 1000)
    told = parts.steps(cut)
    assert cut.count() > 50 and parts.starts_of(told).count() == cut.count()
    spread = cut.join(parts.starts_of(told), ["path", "part"]).repartition(4, "path", "part").groupBy(F.spark_partition_id()).count()
    assert spread.count() == 4
