from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_scan import same
from wardlake.operators import advanced as a
from wardlake.operators import tokens
from wardlake.sources import derived as d
from wardlake.sources.files import api_source_files


def sites(files, name):
    return sorted((r.file, r.line, r.column) for r in
                  a.call_sites(files, a.CALL_SITES[name]).collect())


def test_call_sites(make_files):
    files = make_files(
        ("a.js", '// eval(1)\nx = "eval(2)";\nécole; eval(f(g(3)) + ")")\nwindow.eval(4); eval (5)\n'
                 'el.innerHTML = "a;" + b;\nel.innerHTML += c;\nz = `eval(6)`\nel.innerHTML = d;\n'),
        ("a.py", '"""\neval(1)\n"""\ndef eval(x):\n  exec(  "a" )\n  o.exec(2)\n'),
        ("a.rs", "fn f<'a>() { unsafe { *p } }\nunsafe fn g() {}\n"
                 'let a = x.y(1).unwrap().z().expect("no");\n// b.unwrap()\n'),
        ("a.go", 'db.Query(fmt.Sprintf("a"))\ndb.Query( fmt.Sprintf("a"))\ntx.Exec("x" + "y")\n'
                 'rows.QueryRow("a" + b)\nlog("db.Query(a + b)")\n'),
        ("a.java", "eval(1)"))
    assert sites(files, "js_eval") == [("r/a.js", 3, 9)]
    assert sites(files, "js_innerhtml_concat") == [("r/a.js", 5, 1)]
    assert sites(files, "py_dynamic_exec") == [("r/a.py", 5, 3)]
    assert sites(files, "rust_unsafe_blocks") == [("r/a.rs", 1, 14)]
    assert sites(files, "rust_unwrap") == [("r/a.rs", 3, 9)]
    assert sites(files, "go_sql_concat") == [("r/a.go", 2, 1), ("r/a.go", 3, 1)]


def test_long_literals_do_not_overflow(make_files):
    files = make_files(("a.js", 's = "' + "x\\n" * 200_000 + '";\n' + "a " * 100_000 + "\neval(s)"))
    assert sites(files, "js_eval") == [("r/a.js", 3, 1)]


def test_one_pass_equals_the_separate_analyses(spark):
    files = d.code_files(spark, SF)
    sources = api_source_files(files)
    lines = a.analyzed_lines(sources)
    apart = a.adv_patterns(lines).unionByName(a.tainted_flow(lines)).unionByName(
        a.weak_crypto(lines))
    for site in a.CALL_SITES.values():
        apart = apart.unionByName(a.call_sites(sources, site))
    assert same(a.advanced_findings(files), apart)


def test_tokens_keep_strings_and_comments_whole(make_files):
    files = make_files(("a.py", 'é = "a b"  # c d\nf(1)'))
    got = sorted((r.line, r.column, r.token) for r in tokens.source_tokens(files).collect())
    assert got == [(1, 1, "é"), (1, 4, "="), (1, 6, '"a b"'), (1, 13, "# c d"),
                   (2, 1, "f("), (2, 3, "1"), (2, 4, ")")]


def test_metrics(make_files):
    files = make_files(("a.py", "x\ny\n"), ("b.py", ""), ("c.rs", "x\n\nz"))
    row = a.scan_metrics(files).first()
    assert (row.files_processed, row.total_lines) == (3, 5)
    assert a.language_stats_map(a.language_stats(files)).first().language_stats == {"py": 2, "rs": 1}


def nested(depth, inner="a + b"):
    return "f(" * (depth - 1) + inner + ")" * (depth - 1)


def test_call_sites_at_any_depth(make_files):
    go = "\n".join(f"db.Query({nested(d)})" for d in range(1, 11))
    rs = "\n".join(f"let v = x.y({nested(d, '1')}).unwrap();" for d in range(1, 11))
    js = "\n".join(f"g({nested(d, 'eval(' + nested(d) + ')')});" for d in range(1, 11))
    py = "\n".join("exec(" + nested(d, "'(' + s") + ")" for d in range(1, 11))
    rs_block = "fn f() { unsafe { " + "{ " * 12 + "*p" + " }" * 12 + " } }\n"
    files = make_files(("a.go", go), ("a.rs", rs), ("a.js", js), ("a.py", py), ("b.rs", rs_block))
    got = {}
    for name in ("go_sql_concat", "rust_unwrap", "js_eval", "py_dynamic_exec",
                 "rust_unsafe_blocks"):
        rows = sorted(a.call_sites(files, a.CALL_SITES[name]).collect(),
                      key=lambda r: (r.file, r.line))
        got[name] = rows
    assert [r.line for r in got["go_sql_concat"]] == list(range(1, 11))
    assert [r.line for r in got["rust_unwrap"]] == list(range(1, 11))
    assert [r.line for r in got["js_eval"]] == list(range(1, 11))
    assert [r.line for r in got["py_dynamic_exec"]] == list(range(1, 11))
    assert [(r.file, r.line) for r in got["rust_unsafe_blocks"]] == [("r/b.rs", 1)]
    deepest = got["go_sql_concat"][-1].code_context
    assert f"db.Query({nested(10)})" in deepest
    assert "x.y(" + nested(10, "1") + ").unwrap()" in got["rust_unwrap"][-1].code_context
    assert got["js_eval"][-1].column == len("g(" + "f(" * 9) + 1


def test_scan_is_linear_in_the_file():
    import time

    site = [a.CALL_SITES["rust_unwrap"]]

    def took(n):
        text = "".join(f"let v{i} = x.y(f(g(h(k({i}))))).unwrap(); // z.unwrap()\n"
                       for i in range(n))
        begin = time.perf_counter()
        found = a.scan_file(text, "rs", site)
        assert len(found) == n and found[-1]["line"] == n
        return time.perf_counter() - begin

    took(500)
    assert took(4000) < 2.5 * 2 * took(2000) + 0.05


def test_tokens_by_language_forms(make_files):
    files = make_files(
        ("a.js", "x /* eval(x)\n still */ eval(y) `a\nb` 'c'"),
        ("a.py", "s = '''a\n\"b\" ''' + \"\"\"c\"\"\"\n"),
        ("a.rs", "let c = '('; let s = \"a\nb\"; fn f<'a>()"),
        ("a.go", "r := `x(\ny` + 'a' /* c */"))
    got = {}
    for r in tokens.source_tokens(files).collect():
        got.setdefault(r.path, []).append((r.line, r.column, r.token))
    js = sorted(got["r/a.js"])
    assert (1, 3, "/* eval(x)\n still */") in js and (2, 11, "eval(") in js
    assert (2, 19, "`a\nb`") in js and (3, 4, "'c'") in js
    assert (1, 5, "'''a\n\"b\" '''") in got["r/a.py"] and (2, 11, '"""c"""') in got["r/a.py"]
    assert (1, 9, "'('") in got["r/a.rs"] and (1, 22, '"a\nb"') in got["r/a.rs"]
    assert (2, 6, "'a'") in got["r/a.go"] and (2, 10, "/* c */") in got["r/a.go"]


def test_tokens_on_one_long_line(make_files):
    import time

    def took(n):
        files = make_files(("a.js", "f(a, 'b') + g; " * n))
        begin = time.perf_counter()
        rows = tokens.source_tokens(files).agg(F.count("*"), F.max("column")).first()
        assert rows[0] == 8 * n and rows[1] == 15 * (n - 1) + 14
        return time.perf_counter() - begin

    took(2_000)
    assert took(21_000) < 2.5 * took(10_500)
