"""Personal data and the terms that give it away, with SQL functions only.

Base spans. Each kind's pattern is matched leftmost and without overlaps over the whole text: splitting at the matches gives the
gaps, and the running lengths of gaps and matches are the spans' code points. Texts without the character a kind needs skip its pattern.
Matches that fail the kind's test (number range, digits, Luhn) are dropped.

Sanitisation after Sanchez and Batet: a protected entity is one value of a kind. For each term of the documents that hold it, the
corpus tells in how many documents both occur, anywhere in the text, and how many hold the entity and the term at all.
disclosure = PMI(term, entity) / information content of the entity: 1 if the term occurs only in documents with the entity, so whoever
reads the term knows the entity; 0 if it tells nothing. Terms are removed from ``remove_at`` on (kind ``term``) and generalised from
``generalise_at`` on (kind ``broad``), at all their places outside base spans in the documents that hold the entity. A pair counts
from ``min_support`` common documents on: of an entity found in fewer, each word that is found once would tell all. So entities in
fewer documents have no terms, and documents without the entity keep theirs.

Counts are taken over all documents by aggregations that combine before they shuffle; a hot entity or term is one row of a
partial sum per task. What a pair discloses follows from the sets of documents that hold each, so entities of one set are one group, told by their
number and 128 bits of hashes of the documents, and so are terms: a directory that stands in four documents is one group of
entities and one of terms, however long. Pairs of groups are formed only where the counts of both alone do not yet rule a
disclosure out: PMI is at most the term's information content. Joins are by term, by group and by document; nothing is collected.

Defined results: null texts are empty; a null id is kept and never joins another; rows that repeat an id with another text are
told apart; repeated rows count as one document and get the same spans; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("term", "broad")
#: Equal in matches to the contract's patterns. Possessive repeats and the look at the character before only save the regex engine
#: from trying each place of a long run again: a run that fails from its start fails from all its later places.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match passes.
NEEDS = {"email": "instr(text, '@') > 0", "ip": r"instr(text, '.') > 0 and text rlike '[0-9]\\.[0-9]'", "card": r"text rlike '[0-9][ -]?[0-9]'", "phone": "instr(text, '+') > 0"}
#: A group of entities, or of terms, that the same documents hold: how many, and two sums of the documents' hashes.
ENTITY, TERMS = ["n_entity", "e1", "e2"], ["n_term", "t1", "t2"]
TERM = r"(?<!\p{L})\p{L}{4,}+"
WORD, WORDS = "named_struct('start', s.b, 'end', s.e, 'value', s.m)", "array<struct<start:int,end:int,value:string>>"
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"
MARK = "array<struct<start:int,rank:int,end:int>>"
#: Code points of the pieces that a long text is cut into, so that a substring does not count from its start.
PIECE = 1024


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for the value, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(items: str, first: str, merge: str, one: str, out: str, kind: str) -> str:
    """SQL for an array built from an array in one pass, with a running value: linear in all but the number of blocks.

    Arrays that grow item by item are copied each time, so items are taken in blocks of the root of their number: the running value at each
    block's start comes from a pass over the blocks, and only a block's own results grow. ``first`` is the value before all items,
    ``merge`` gives the value ``acc.at`` after item ``x``, ``one`` the same for a whole block ``b`` (from ``at``), and ``out`` the results (an array) of
    item ``x`` at ``acc.at``.
    """
    blocks = "transform(sequence(0, (size(items) - 1) div width), i -> slice(items, i * width + 1, width))"
    starts = f"""aggregate(blocks, named_struct('at', {first}, 'out', cast(array() as array<int>)), (acc, b) -> named_struct('at', {one}, 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"""
    block = f"""aggregate(z['blocks'], named_struct('at', z['1'], 'out', cast(array() as {kind})), (acc, x) -> named_struct('at', {merge}, 'out', concat(acc.out, {out})), acc -> acc.out)"""
    whole = let("blocks", blocks, f"flatten(transform(arrays_zip(blocks, {starts}), z -> {block}))")
    whole = let("width", "cast(ceil(sqrt(size(items))) as int)", whole)
    return let("items", items, f"if(size(items) = 0, cast(array() as {kind}), {whole})")


def placed(text: str, pattern: str, element: str, kind: str) -> str:
    """SQL for an array built from all matches: ``element`` may use s.m (match), s.b and s.e (its code points)."""
    p = quoted(pattern)
    items = f"filter(arrays_zip(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1)), z -> z['0'] is not null)"
    after = "length(x['1']) + length(x['0'])"
    one = f"aggregate(b, acc.at, (n, x) -> n + {after})"
    s = f"transform(array(named_struct('m', x['0'], 'b', acc.at + length(x['1']), 'e', acc.at + {after})), s -> {element})"
    return running(items, "0", f"acc.at + {after}", one, s, kind)


def luhn(digits: str) -> str:
    d = f"cast(substring({digits}, i, 1) as int)"
    return f"""aggregate(sequence(1, length({digits})), 0, (t, i) -> t + if((length({digits}) - i) % 2 = 1, 2 * {d} - if({d} > 4, 9, 0), {d})) % 10 = 0"""


def valid(kind: str) -> str:
    digits = "regexp_replace(s.value, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": r"s.value rlike '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\\.0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$'",
        "card": f"case when length({digits}) between 12 and 19 then {luhn(digits)} else false end",
        "phone": f"length({digits}) between 9 and 15",
    }[kind]


def base_spans() -> Column:
    """Spans of all kinds in column ``text``, by start and kind."""
    found = []
    for rank, kind in enumerate(KINDS):
        element = f"named_struct('start', s.b, 'rank', {rank}, 'end', s.e, 'value', s.m)"
        spans = placed("text", PATTERNS[kind], element, SPAN)
        found.append(f"case when {NEEDS[kind]} then filter({spans}, s -> {valid(kind)}) else cast(array() as {SPAN}) end")
    return F.expr(f"array_sort(concat({', '.join(found)}))")


def terms_of(text: str) -> str:
    """SQL: the distinct terms of a text."""
    return f"array_distinct(transform(regexp_extract_all({text}, {quoted(TERM)}, 0), m -> lower(m)))"


def joined(spans: str, names: tuple[str, ...] = KINDS + EXTRA) -> str:
    """SQL: kind:start:end of an array of spans, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in names)
    return f"array_join(transform({spans}, s -> concat(element_at(array({kinds}), s.rank + 1), ':', s.start, ':', s.end)), ',')"


def find(df: DataFrame, min_support: int = 3, generalise_at: float = 0.7, remove_at: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, text_key and spans, an array of (start, rank, end); ranks index KINDS + EXTRA."""
    scratch = Scratch(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    # the text stays with its spans where there are any
    base = scratch.save(docs.withColumn("spans", base_spans()).withColumn("held", F.expr("if(size(spans) > 0, text, null)")).drop("text"), "spans")
    once = ["doc_id", "text_key"]
    doc = F.struct(*once).alias("doc")
    n = base.select(*once).distinct().count()
    log_n = F.ln(F.lit(float(max(n, 1))))

    holding = base.where("held is not null").dropDuplicates(once).select(doc, "spans", "held")
    entities = scratch.save(holding.select("doc", F.explode("spans").alias("x")).select("doc", "x.rank", F.lower("x.value").alias("value")).distinct(), "entities")
    seen_in = lambda c, name: [F.bit_xor(F.xxhash64(c, F.lit(seed))).alias(f"{name}{seed}") for seed in (1, 2)]
    with_entity = entities.groupBy("rank", "value").agg(F.count(F.lit(1)).alias("n_entity"), *seen_in("doc", "e")).where(F.col("n_entity").between(min_support, n - 1))
    groups = scratch.save(entities.join(with_entity, ["rank", "value"]).select("doc", *ENTITY).distinct(), "groups")
    with_term = docs.dropDuplicates(once).select(doc, F.explode(F.expr(terms_of("text"))).alias("term")).groupBy("term")
    with_term = with_term.agg(F.count(F.lit(1)).alias("n_term"), *seen_in("doc", "t")).where(F.col("n_term") >= min_support)

    # distinct pairs of each document, but for those whose own counts rule them out (with room for rounding)
    open_to = lambda n_entity: log_n - F.ln("n_term") >= generalise_at * (log_n - F.ln(n_entity)) - 1e-9
    most = groups.groupBy("doc").agg(F.max("n_entity").alias("most"))
    words = holding.join(most, "doc").select("doc", "most", F.explode(F.expr(terms_of("held"))).alias("term"))
    words = scratch.save(words.join(with_term, "term").where(open_to("most")).select("doc", "term", *TERMS), "words")
    pairs = scratch.save(words.select("doc", *TERMS).distinct().join(groups, "doc").where(open_to("n_entity")), "pairs")

    together = pairs.groupBy(*ENTITY, *TERMS).agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= min_support)
    pmi = F.ln(F.col("n_both") * F.lit(float(max(n, 1))) / (F.col("n_entity") * F.col("n_term")))
    content = F.ln(F.lit(float(max(n, 1))) / F.col("n_entity"))
    telling = (
        together.withColumn("disclosure", pmi / content)
        .where(F.col("disclosure") >= generalise_at)
        .select(*ENTITY, *TERMS, F.when(F.col("disclosure") >= remove_at, len(KINDS)).otherwise(len(KINDS) + 1).alias("action"))
    )
    told = pairs.join(scratch.save(telling, "telling"), [*ENTITY, *TERMS]).groupBy("doc", *TERMS).agg(F.min("action").alias("action"))
    marks = scratch.save(words.join(told, ["doc", *TERMS]).select("doc", "term", "action"), "marks")
    # all places of the telling terms in the documents that hold the entity, outside base spans
    marked = holding.join(marks.select("doc").distinct(), "doc")
    found = marked.select("doc", F.explode(F.expr(placed("held", TERM, WORD, WORDS))).alias("w"))
    found = found.select("doc", "w.start", "w.end", F.lower("w.value").alias("term")).join(marks, ["doc", "term"]).select("doc", "start", "end", F.col("action").cast("int").alias("action"))
    spans = marked.select("doc", F.explode("spans").alias("s")).select("doc", "s.start", "s.end", F.lit(None).cast("int").alias("action"))
    # a word is outside if all spans that begin no later have ended, and none begins before its end
    no_span, upto = F.col("action").isNotNull(), (W.unboundedPreceding, W.currentRow)
    ended = F.max(F.when(~no_span, F.col("end"))).over(W.partitionBy("doc").orderBy("start", no_span).rowsBetween(*upto))
    begins = F.min(F.when(~no_span, F.col("start"))).over(W.partitionBy("doc").orderBy(F.desc("start"), no_span).rowsBetween(*upto))
    outside = found.union(spans).select("*", ended.alias("ended"), begins.alias("begins")).where(no_span & (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.coalesce("begins", F.col("end")) >= F.col("end")))
    extra = outside.groupBy("doc").agg(F.collect_list(F.struct("start", F.col("action").alias("rank"), "end")).alias("extra"))  # bounded by the text's length
    extra = extra.select(F.col("doc.doc_id").alias("id"), F.col("doc.text_key").alias("key"), "extra")
    plain = F.expr("transform(spans, s -> named_struct('start', s.start, 'rank', s.rank, 'end', s.end))")
    both = base.drop("held").join(scratch.save(extra, "extra").hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    return both.select("doc_id", "text_key", F.array_sort(F.concat(plain, F.coalesce("extra", F.expr(f"cast(array() as {MARK})")))).alias("spans"))


def between(pieces: str, a: str, b: str) -> str:
    """SQL: the code points [a, b) of a text that is cut into pieces of PIECE code points; a < b."""
    p, q = f"cast(({a}) div {PIECE} as int)", f"cast((({b}) - 1) div {PIECE} as int)"
    one = f"substring(element_at({pieces}, p + 1), ({a}) % {PIECE} + 1, ({b}) - ({a}))"
    head, tail = f"substring(element_at({pieces}, p + 1), ({a}) % {PIECE} + 1, {PIECE})", f"substring(element_at({pieces}, q + 1), 1, ({b}) - q * {PIECE})"
    more = f"concat({head}, array_join(slice({pieces}, p + 2, q - p - 1), ''), {tail})"
    return let("p", p, let("q", q, f"if(p = q, {one}, {more})"))


def sanitise(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with the spans of ``find`` replaced in the text: kinds by their name in brackets, ``term`` by nothing, ``broad`` by [WORD].

    A span within the one before it goes with it; one that ends later is cut on to its own end.
    """
    marks = found.where("size(spans) > 0").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.col("spans").alias("_spans")).dropDuplicates(["id", "key"])
    names = ", ".join(f"'{x}'" for x in [*(f"[{k.upper()}]" for k in KINDS), "", "[WORD]"])
    # the row's own columns, of whatever names, travel as one
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    rows = rows.join(marks, F.col("row_id").eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("key")), "left")
    part = let("k", "acc.at", f"if(x.start > k, {between('_pieces', 'k', 'x.start')}, '')")
    out = f"if(x.end <= acc.at, cast(array() as array<string>), array({part}, element_at(array({names}), x.rank + 1)))"
    cut = running("_spans", "0", "greatest(acc.at, x.end)", "greatest(acc.at, array_max(transform(b, x -> x.end)))", out, "array<string>")
    last = let("k", "array_max(transform(_spans, x -> x.end))", f"if(k < length(text), {between('_pieces', 'k', 'length(text)')}, '')")
    rows = rows.withColumn("_pieces", F.when(F.size("_spans") > 0, F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    new = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.expr(f"concat(array_join({cut}, ''), {last})"))
    return rows.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])
