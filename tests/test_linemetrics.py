"""Line counts of each language against hand-made tables: b(lank), c(omment) and . (code) for each line."""

import random

import pytest
from pyspark.sql import functions as F

from commitlens.operators import linemetrics

CASES = {
    "C": ['.int a; // see /* here', ".b = 1;", "c// only /* this", ".c = 2;", "c/* one", "b", ".two // */ three */", ".d = '\"'; /* x", "cx */", '.e = "/* no"; // "', ".f /* a */ + /* b */ g;", "c  /* a */ // b", "c/* a */ /* b", ".*/ g();", ".h = '\\''; // '", ".don't /* stop", "cnow */"],
    "C++": [".x = 1; /* a", "c */", ".y();"],
    "C/C++ Header": ["c/*", "c * Title", "c */", ".#pragma once"],
    "C#": ['.s = @"c:\\";', ".t = 1;", '.s = @"a // b', ".still ' text /*", 'b', '.he said ""no"" /* ";', ".t = 2; // x", '.u = @""; /* v', "c*/", '.w = @"""";', "c// end", '.z = $@"{a}', '.";', ".end();"],
    "Java": ['.s = """', ".  // text /*", '.  """; // done', ".char c = '/'; /* a", "c*/"],
    "JavaScript": [".a = `", ".// text ${b} \\` /*", ".`; // done", ".b = '/*' + \"//\";", "c/* x", "c*/", ".c = '\\\\'; // '"],
    "CSS": ["c/* a", "cb */", ".p { content: '/*'; }", ".q { } /* c", "c*/", ".// no comment here"],
    "Python": ['c"""One', "b", 'ctwo"""', "c# three", '.x = """four', ".# text", '."""', ".y = '#' # five", "c'''six'''", ".z = 'it\\'s' # \"\"\"", ".w = 1", '.v = ""', ".u = 2", "c  '''", "cseven", "c'''  # eight"],
    "XML": [".<a> <!-- one", "c two", "c--> <!-- three -->", ".</a>", "b", ".<b x='<!-'/> <!-- four -->"],
    "XAML": ["c<!-- one -->", ".<Grid/>"],
    "HTML": ["c<!--", "c// two", "c-->", ".<p>\"<!-- x", "c--></p>".replace("c--></p>", ".--></p>")],
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, lang string, content string")


def counts(df):
    return {r["id"]: (r["blanks"], r["comments"], r["code"]) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_languages(spark, monkeypatch, block):
    monkeypatch.setattr(linemetrics, "BLOCK_LINES", block)
    # each table in one piece, and cut after each of its lines, so that a wrong line shows
    rows, want = [], {}
    for lang, table in CASES.items():
        for n in range(1, len(table) + 1):
            text = "\n".join("" if x == "b" else x[1:] for x in table[:n])
            rows.append((len(rows), lang, text))
            kinds = [x[0] for x in table[:n]]
            if text.endswith("\n"):  # a last line without an end of its own, which is blank, is none
                kinds = kinds[:-1]
            want[len(rows) - 1] = tuple(kinds.count(k) for k in "bc.")
    got = counts(linemetrics.count_lines(frame(spark, rows), ["id"], F.col("lang"), spread=block == 2))
    assert [(rows[i][1], rows[i][2], got[i]) for i in want if got[i] != want[i]] == []


def test_edges(spark):
    rows = [(0, "C", None), (1, "C", ""), (2, "C", "\n"), (3, "C", "a\r\n\r\nb\r\n"), (4, "C", "a\rb"), (5, "C", "/*\n" + "x\n" * 5000 + "*/ a\n"), (6, None, "// a\n\nb"), (7, "Cobol", "/*\na"), (8, "C", '"' + "\\x00" * 50_000 + '"; // a\n/*'), (9, "C", "a" * 200_000 + " /* b\n*/")]
    got = counts(linemetrics.count_lines(frame(spark, rows), ["id"], F.col("lang")))
    assert got == {0: (0, 0, 0), 1: (0, 0, 0), 2: (1, 0, 0), 3: (1, 0, 2), 4: (0, 0, 2), 5: (0, 5001, 1), 6: (1, 0, 2), 7: (0, 0, 2), 8: (0, 1, 1), 9: (0, 1, 1)}


def plain_c(text):
    """A character at a time."""
    lines, state, out = text.removesuffix("\n").split("\n"), "", []
    for line in lines:
        i, code, comment = 0, False, state == "/*" and bool(line)
        while i < len(line):
            if state == "/*":
                comment = True
                if line.startswith("*/", i):
                    state, i = "", i + 2
                    continue
            elif line.startswith("/*", i):
                state, comment, i = "/*", True, i + 2
                continue
            elif line.startswith("//", i):
                comment = True
                break
            elif line[i] == '"' and '"' in line[i + 1 :]:
                code, i = True, line.index('"', i + 1)
            elif not line[i].isspace():
                code = True
            i += 1
        out.append("b" if not line.strip() else "." if code else "c")
    return tuple(out.count(k) for k in "bc.")


def test_random_texts(spark):
    rng = random.Random(8)
    rows = [(i, "C", "".join(rng.choice(["/*", "*/", "//", '"', " ", "a", "\n", "\n"]) for _ in range(60)) + "x") for i in range(400)]
    got = counts(linemetrics.count_lines(frame(spark, rows), ["id"], F.col("lang")))
    assert [(t, got[i], plain_c(t)) for i, _, t in rows if got[i] != plain_c(t)] == []
