"""Places of tokens: sums across blocks, odd contents, and the number of passes over the tokens."""

import pytest
from pyspark.sql import functions as F

from wardlake.operators import tokens


@pytest.mark.parametrize("levels", [1, 2, tokens.LEVELS])
def test_places_add_up_across_blocks(spark, levels):
    block = tokens.BLOCK
    texts = ["a", "\n", "é b", "x\ny\n", "\n\nlong", " "]
    pieces = {n: [texts[(i * i + i // 7) % len(texts)] for i in range(n)]
              for n in (0, 1, block - 1, block, block + 1, block ** 2, block ** 3 + 5)}
    rows = spark.createDataFrame(list(pieces.items()), "n int, pieces array<string>")
    places = tokens.places_before(F.transform("pieces", tokens.reach), levels)
    for r in rows.select("n", places.alias("at")).collect():
        line, column, want = 0, 0, []
        for piece in pieces[r.n]:
            want.append(line * tokens.LINE + column)
            *before, tail = piece.split("\n")
            line += len(before)
            column = len(tail.encode()) + (0 if before else column)
        assert r.at == want


def test_token_places_in_odd_contents(make_files):
    files = make_files(("a.py", " \r\n\t\x0b\x0cé\u00a0x \n"), ("b.py", ""), ("c.py", None),
                       ("d.py", " \n "), ("e.go", "`\n\né` y\n\n  z\n"))
    rows = [(r.path, r.line, r.column, r.token) for r in tokens.source_tokens(files).collect()]
    assert sorted(r[0] for r in rows if r[3] is None) == ["r/b.py", "r/d.py"]
    got = sorted(r for r in rows if r[3] is not None)
    assert got == [("r/a.py", 2, 4, "é"), ("r/a.py", 2, 6, "\u00a0"), ("r/a.py", 2, 8, "x"),
                   ("r/e.go", 1, 1, "`\n\né`"), ("r/e.go", 3, 5, "y"), ("r/e.go", 5, 3, "z")]


def test_few_passes_over_the_tokens(make_files):
    rows = tokens.source_tokens(make_files(("a.py", "x")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # A file is lexed once, by its own language's pattern.
    assert plan.count("regexp_extract_all(") == len(tokens.TOKEN_REGEX)
    # 193 with a round for each doubling of a file's tokens; now most are over totals of blocks.
    assert plan.count("transform(") < 32
