"""Metrics of source lines: blank, comment and code lines, and indentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import indentation, is_blank

# What a line of a language is made of, as patterns. ``text``: string literals of one line; ``line``: what begins a comment to the
# line's end; ``over``: what may go on over lines: how it opens, what follows up to its close, and whether it is a comment.
_TEXT = r'".*?(?<!\\)(?:\\\\)*+"'
_LETTER = r"'(?:\\[^']+|[^'\\])'"
_QUOTED = r"'.*?(?<!\\)(?:\\\\)*+'"
_BLOCK = (r"/\*", r".*?\*/", True)
_C = {"text": [_TEXT, _LETTER], "line": "//", "over": [_BLOCK]}
_MARKUP = {"text": [], "line": None, "over": [("<!--", ".*?-->", True)]}
SYNTAX = {
    "C": _C, "C++": _C, "C/C++ Header": _C,
    "C#": {"text": [_TEXT, _LETTER], "line": "//", "over": [_BLOCK, (r'(?:@\$?|\$@)"', r'(?:(?:"")*+"(?!")|.*?[^"](?:"")*+"(?!"))', False)]},
    "Java": {"text": [_TEXT, _LETTER], "line": "//", "over": [_BLOCK, (r'"""', r'.*?(?<!\\)"""', False)]},
    "JavaScript": {"text": [_TEXT, _QUOTED], "line": "//", "over": [_BLOCK, ("`", r".*?(?<!\\)(?:\\\\)*+`", False)]},
    "CSS": {"text": [_TEXT, _QUOTED], "line": None, "over": [_BLOCK]},
    "Python": {"text": [_TEXT, _QUOTED], "line": "#", "over": [(r'^\s*"""', r'.*?"""', True), (r"^\s*'''", r".*?'''", True), (r'"""', r'.*?(?<!\\)"""', False), (r"'''", r".*?(?<!\\)'''", False)]},
    "XML": _MARKUP, "XAML": _MARKUP, "HTML": _MARKUP,
}
#: Lines that are taken together: what a block makes of a file is worked out for each way it can begin.
BLOCK_LINES = 1000
STATES = 1 + max(len(x["over"]) for x in SYNTAX.values())


def lines(revisions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per line: keys, line_no, line."""
    return revisions.select(*keys, F.posexplode(split_lines(F.col("content"))).alias("line_no", "line"))


def split_lines(content: Column) -> Column:
    """The lines of a text; a line end at the very end begins no further line."""
    return F.split(F.regexp_replace(F.regexp_replace(content, "\r\n?", "\n"), r"\n\z", ""), "\n")


def _tokens(syntax: dict) -> list[tuple[str, bool]]:
    """(pattern, whether it is a comment), by precedence at the same place: a whole construct, one that stays open, a string, a comment."""
    over = syntax["over"]
    out = [(o + through, comment) for o, through, comment in over] + [(o + ".*", comment) for o, _, comment in over]
    out += [(t, False) for t in syntax["text"]] + ([(syntax["line"] + ".*", True)] if syntax["line"] else [])
    return out


def _plain(rest: Column, syntax: dict) -> Column:
    """(code, comment, to) of a line, or the end of one, that begins outside of everything: whether it holds either, and in which state it ends."""
    tokens = _tokens(syntax)
    found = F.regexp_extract_all(rest, F.lit("(?s)" + "|".join(t for t, _ in tokens)), F.lit(0))
    last = F.coalesce(F.get(found, F.size(found) - 1), F.lit(""))
    to = F.lit(0)
    for i, (opens, through, _) in reversed(list(enumerate(syntax["over"]))):
        is_open = last.rlike(rf"(?s)\A{opens}") & ~last.rlike(rf"(?s)\A{opens}{through}\z")
        to = F.when(is_open & (rest == last) if opens.startswith("^") else is_open, i + 1).otherwise(to)
    kept = [not comment for _, comment in tokens]
    pattern = "|".join(f"({t})" if k else f"(?:{t})" for (t, _), k in zip(tokens, kept, strict=True))
    left = F.regexp_replace(rest, "(?s)" + pattern, "".join(f"${i + 1}" for i in range(sum(kept))))
    return F.struct((~is_blank(left)).alias("code"), (F.length(left) < F.length(rest)).alias("comment"), to.alias("to"))


def _within(line: Column, syntax: dict, state: int) -> Column:
    """As ``_plain``, of a line that begins in what ``over`` number ``state`` - 1 has opened."""
    _, through, comment = syntax["over"][state - 1]
    tail = _plain(F.regexp_replace(line, rf"(?s)\A{through}", ""), syntax)
    code, note = (tail["code"], F.lit(True)) if comment else (F.lit(True), tail["comment"])
    stays = F.struct(F.lit(not comment).alias("code"), F.lit(comment).alias("comment"), F.lit(state).alias("to"))
    return F.when(line.rlike(rf"(?s)\A{through}"), F.struct(code.alias("code"), note.alias("comment"), tail["to"].alias("to"))).otherwise(stays)


def _steps(line: Column, language: Column) -> Column:
    """For each state in which the line can begin: whether it holds code or a comment, and the state in which it ends."""
    none = F.struct(F.lit(True).alias("code"), F.lit(False).alias("comment"), F.lit(0).alias("to"))
    out = F.array(*[none] * STATES)
    families: list[tuple[list[str], dict]] = []
    for name, syntax in SYNTAX.items():
        same = next((names for names, x in families if x is syntax), None)
        same.append(name) if same is not None else families.append(([name], syntax))
    for names, syntax in families:
        states = [_plain(line, syntax), *[_within(line, syntax, s) for s in range(1, len(syntax["over"]) + 1)]]
        out = F.when(language.isin(names), F.array(*states, *[none] * (STATES - len(states)))).otherwise(out)
    return out


def count_lines(revisions: DataFrame, keys: list[str], language: Column, spread: bool = False) -> DataFrame:
    """blanks, comments, code per file. A line with both is code; texts of an unknown language have no comments; a null text has no lines.

    A line is a step of a machine whose states are: outside, and within each of what the language lets go on over lines. Which comment or string
    begins first on a line decides about the others. Steps compose, so a file is cut into blocks of lines that are worked out for
    each state they may begin in, and a file is a fold over its blocks' few numbers. With ``spread`` the blocks of a file
    go to different tasks, for files that are large by themselves.
    """
    all_lines = F.when(F.length("content") > 0, split_lines(F.col("content"))).otherwise(F.expr("cast(array() as array<string>)"))
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / BLOCK_LINES).cast("int")), lambda i: F.slice(x, (i * BLOCK_LINES + 1).cast("int"), BLOCK_LINES))
    rows = revisions.select(*keys, language.alias("_lang"), all_lines.alias("_lines"))
    rows = rows.select(*keys, "_lang", F.posexplode(cut(F.col("_lines"))).alias("_block", "_part"))
    if spread:
        rows = rows.repartition(*keys, "_block")
    step = F.transform("_part", lambda x: F.struct(is_blank(x).alias("blank"), _steps(x, F.col("_lang")).alias("at")))

    def block(state: int) -> Column:
        start = F.struct(F.lit(state).alias("to"), *[F.lit(0).alias(c) for c in ("blanks", "comments", "code")])

        def merge(acc: Column, x: Column) -> Column:
            at = F.element_at(x["at"], acc["to"] + 1)
            kind = F.when(x["blank"], 0).when(at["code"], 2).when(at["comment"], 1).otherwise(2)
            add = lambda c, k: (acc[c] + F.when(kind == k, 1).otherwise(0)).alias(c)
            return F.struct(at["to"].alias("to"), add("blanks", 0), add("comments", 1), add("code", 2))

        return F.aggregate("_steps", start, merge)

    rows = rows.withColumn("_steps", step).select(*keys, "_block", F.array(*[block(s) for s in range(STATES)]).alias("_sums"))
    files = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_sums"))).alias("_blocks"))
    zero = F.struct(F.lit(0).alias("to"), *[F.lit(0).alias(c) for c in ("blanks", "comments", "code")])

    def follow(acc: Column, x: Column) -> Column:
        at = F.element_at(x["_sums"], acc["to"] + 1)
        return F.struct(at["to"].alias("to"), *[(acc[c] + at[c]).alias(c) for c in ("blanks", "comments", "code")])

    return files.withColumn("_all", F.aggregate("_blocks", zero, follow)).select(*keys, *[F.col(f"_all.{c}").alias(c) for c in ("blanks", "comments", "code")])


def inverted_space(revisions: DataFrame, keys: list[str], tab_size: int = 4) -> DataFrame:
    """Of the non-blank lines' indentation: min, max, mean, population standard deviation and total; nulls for files without such lines."""
    depth = F.when(~is_blank(F.col("line")), indentation(F.col("line"), tab_size))
    rows = lines(revisions, keys).withColumn("d", depth)
    return rows.groupBy(*keys).agg(F.min("d").alias("space_min"), F.max("d").alias("space_max"), F.avg("d").alias("space_mean"), F.stddev_pop("d").alias("space_stddev"), F.sum("d").alias("space_total"))
