"""The lexer and scopes of code by hand, and the cases that a line-wise reader gets wrong."""

import pytest

from tessera.operators import code as C
from tessera.operators import scanners as S
from tessera.plans import snippets


def test_comments_and_strings():
    code, bare = C.lex('a("/* x"); // y\nb(\'"\'); /* c\n d */ e("\\"}");', "c")
    assert code == 'a("/* x");\nb(\'"\'); \n e("\\"}");' and bare == 'a("");\nb(""); \n e("");'
    assert C.lex('x = "# no" # yes\n"""doc # {\n"""\ny = \'\'\'a\'\'\'', "python")[0] == 'x = "# no"\n\n\ny = \'\'\'a\'\'\''
    assert C.lex("q := `// {\n` // end", "c") == ("q := `// {\n`", 'q := ""\n')
    assert C.lex("/* never closed\n{", "c")[0] == "\n" and C.lex("s = \'open\nb()", "c")[0] == "s = \'open\nb()"


@pytest.mark.parametrize("ext, text, want", [
    ("java", "class A\n{\n  @Get(\"/x{y}\")\n  public void go(int a,\n     int b)\n     throws X\n  {\n    while (a)\n    {\n      x();\n    }\n  }\n  static {\n    y();\n  }\n}", {10: ("go", 4, 12, 8), 14: ("", 0, 0, 0)}),
    ("ts", "const f = async (a: string) => {\n  xs.forEach((x) => {\n    y(x);\n  });\n};\nclass B {\n  m(a) {\n    z();\n  }\n}", {3: ("f", 1, 5, 2), 8: ("m", 7, 9, 0)}),
    ("go", "func (s *S) Load(id string) error {\n\tgo run()\n\tfor _, x := range xs {\n\t\tx()\n\t}\n}\n", {2: ("Load", 1, 6, 0), 4: ("Load", 1, 6, 3)}),
    ("py", "class A:\n    def a(self,\n          b):\n        if b:\n            for x in b:\n                y(x)\n        def inner():\n            pass\n        return 1\n\nz()\n", {6: ("a", 2, 9, 5), 8: ("inner", 7, 8, 0), 9: ("a", 2, 9, 0), 11: ("", 0, 0, 0)}),
])
def test_scopes(ext, text, want):
    rows = {r[0]: (r[6], r[4], r[5], r[7]) for r in C.file_lines(text, C.family(f"f.{ext}"))}
    assert {k: rows[k] for k in want} == want


def test_mixed_files_by_hand(spark):
    rows = [(f, c.replace("@", str(n)), n) for f, (c, _, _) in snippets.MIXED.items() for n in (0, 5)]
    for n in (0, 5):
        df = spark.createDataFrame([(f, c) for f, c, k in rows if k == n], "path string, text string")
        got = sorted((r.path, r.line_no, r.kind) for r in S.scan(df, S.DETERMINISTIC, "path", "text").collect())
        assert got == sorted((f, line, kind) for f, (_, hits, fixed) in snippets.MIXED.items() for line, kind in hits if n == 0 or line not in fixed)


def test_constants_by_scope(spark):
    code = "class A {\n  static final int T = 0;\n  void a() {\n    final int T = 5;\n    c.setTimeout(T);\n  }\n  void b() {\n    c.setTimeout(T);\n    c.setTimeout(B.T);\n  }\n}"
    df = spark.createDataFrame([("A.java", code), ("B.java", "class B {\n  static final long T = Long.MAX_VALUE;\n}"), ("x/C.java", "class C {\n  void c() {\n    c.setTimeout(A.T);\n    c.setTimeout(D.T);\n  }\n}")], "path string, text string")
    hits = S.scan(df, [r for r in S.DETERMINISTIC if r.kind == "disabled_bound"], "path", "text").collect()
    assert sorted((r.path, r.line_no) for r in hits) == [("A.java", 8), ("A.java", 9), ("x/C.java", 3)]


def test_a_loop_holds_its_io(spark):
    code = "void f() {\n  for (Id id : ids) {\n" + "    a();\n" * 9 + "    repo.findOne(id);\n  }\n  repo.findOne(id);\n}"
    df = spark.createDataFrame([("A.java", code), ("b.py", "for i in ids:\n    pass\nrepo.find_one(i)\n"), ("C.java", "for (Id id : ids) {\n  repo.findOne(batch);\n}")], "path string, text string")
    hits = S.scan(df, [r for r in S.SIGNALS if r.kind == "io_in_loop"], "path", "text").collect()
    assert [(r.path, r.line_no) for r in hits] == [("A.java", 12)]
