"""Personal data: identifiers by pattern, and terms that give protected entities away.

Everything runs on built-in SQL functions.  Base kinds (email, ip, card, phone) are found by pattern
and checks.  For the rest the corpus decides: a term near an entity discloses it to the degree

    D(t, e) = pmi(t, e) / ic(e),  pmi = ln(N c(t, e) / (n(t) n(e))),  ic = ln(N / n(e)),

where e is one identifier value and all four counts are of distinct whole texts, so copies change nothing.  Terms with
D of at least ``threshold``, c of at least ``support`` and at most ``open_bits`` bits of the entity left open
(ic - pmi; with one bit, half of a term's texts hold the entity) are disclosing: they get spans of kind "term"
wherever they occur, in every document, and sanitising generalises those with digits to [NUMBER] and removes the
others as [TERM].  Words of texts with an identifier are counted first; as they bound a term's count from below, only
the few terms that may disclose are looked for in all texts.

Positions are code points, ends exclusive.  They come from the lengths of the pieces between matches
and of the matches, so no character is visited one by one.  Patterns use possessive loops: same matches,
but no backtracking and no recursion on long runs.

Defined cases: a null text is empty and has no spans (sanitising keeps the null); null ids are processed
like others; repeated rows are processed each; further columns are kept by ``sanitise``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .rows import packed, text_hash

#: Base kinds in their listed order: pattern, then which matches stay (m is the match, d its digits).
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": (r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
           "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(right(p, 3) as int) <= 255)"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++",
             "length(d) between 16 and 19 and aggregate(sequence(1, length(d)), 0, (a, i) -> a + "
             "(case when i % 2 = 1 then cast(substr(d, -i, 1) as int) when substr(d, -i, 1) >= '5' "
             "then 2 * cast(substr(d, -i, 1) as int) - 9 else 2 * cast(substr(d, -i, 1) as int) end)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) between 8 and 15"),
}
#: A text without this holds no match of the kind.
NEEDS = {"email": "contains(text, '@')", "ip": r"text rlike '[0-9][.][0-9]'",
         "card": r"text rlike '[0-9](?:[ -]?[0-9]){15}'", "phone": "contains(text, '+')"}
WORD = r"[\p{L}\p{N}]++"
#: Stands for an identifier where a text's words are listed; a word that touches it is part of the identifier.
_MARK = r"\x{FFFF}"
_FREE = rf"(?<![\p{{L}}\p{{N}}{_MARK}])[\p{{L}}\p{{N}}]++(?!{_MARK})"
THRESHOLD, SUPPORT, OPEN_BITS = 0.8, 2, 1.0
_SPAN = "array<struct<start:int,end:int,m:string>>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _spans(text: str, pattern: str, stays: str = "true", needs: str = "true") -> str:
    """SQL for the array of (start, end, m) of the matches that stay, in order."""
    p = _quoted(pattern)
    d = "regexp_replace(y.m, '[^0-9]', '')"
    test = f"exists(array(named_struct('m', y.m, 'd', {d})), z -> {_scoped(stays)})" if stays != "true" else "true"
    return f"""
      case when {needs} then aggregate(
        zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (a, b) -> named_struct('gap', length(a), 'm', b)),
        named_struct('at', 0, 'out', cast(array() as {_SPAN})),
        (s, y) -> case when y.m is null then s else named_struct('at', s.at + y.gap + length(y.m), 'out',
          case when {test} then array_append(s.out, named_struct('start', s.at + y.gap, 'end', s.at + y.gap + length(y.m), 'm', y.m))
               else s.out end) end,
        s -> s.out) else cast(array() as {_SPAN}) end"""


def _scoped(stays: str) -> str:
    """The check with m and d read from the lambda's variable."""
    import re

    return re.sub(r"\b([md])\b(?!')", r"z.\1", stays)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with one array column of spans for each base kind, from the column ``text``."""
    for kind, (pattern, stays) in KINDS.items():
        docs = docs.withColumn(kind, F.expr(_spans("text", pattern, stays, NEEDS[kind])))
    return docs


def _words(text: str, pattern: str = WORD) -> Column:
    return F.expr(f"array_distinct(regexp_extract_all(lower({text}), {_quoted(pattern)}, 0))")


_MASKED = """aggregate(array_sort(transform(all_spans, x -> named_struct('start', x.start, 'end', x.end))),
    named_struct('at', 0, 'out', cast(array() as array<string>)),
    (s, x) -> case when x.start < s.at then named_struct('at', greatest(s.at, x.end), 'out', s.out)
      else named_struct('at', x.end, 'out', concat(s.out, array(substr(text, s.at + 1, x.start - s.at)))) end,
    s -> array_join(concat(s.out, array(substr(text, s.at + 1))), '\uffff'))"""


def _tagged() -> Column:
    parts = ", ".join(f"transform({k}, x -> named_struct('kind', '{k}', 'start', x.start, 'end', x.end, 'm', x.m))" for k in KINDS)
    return F.expr(f"concat({parts})")


def find(docs: DataFrame, *, threshold: float = THRESHOLD, support: int = SUPPORT, open_bits: float = OPEN_BITS) -> DataFrame:
    """(doc_id, text_hash, email, ip, card, phone, term): arrays of spans of each row of ``docs``."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Texts are not written; of those with an identifier the distinct words are.
    based = base_spans(text).withColumn("all_spans", _tagged())
    based = based.withColumn("masked", F.expr(f"case when size(all_spans) > 0 then {_MASKED} end"))
    based = stage(based.select("doc_id", "text_hash", *KINDS, _words("masked", _FREE).alias("words")), "identifiers")
    named = based.where("words is not null")
    n = F.lit(float(max(1, based.select("text_hash").distinct().count())))
    near = named.select("text_hash", F.explode(_tagged()).alias("x")).select(
        "text_hash", F.concat("x.kind", F.lit(":"), F.lower("x.m")).alias("entity")).distinct()
    near = stage(near, "entities-of-texts")
    entities = near.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support)
    entities = stage(entities.where(F.log(n / F.col("n_entity")) > 0), "entities")
    ic = F.log(n / F.col("n_entity"))

    def tells(n_term: str) -> Column:
        pmi = F.log(n * F.col("c") / (F.col(n_term) * F.col("n_entity")))
        return (pmi >= threshold * ic) & (ic - pmi <= open_bits * math.log(2) + 1e-9)

    # Words of texts with an identifier, each text once.  A term of more texts than this can't reach the threshold.
    top = entities.agg(F.max(F.col("n_entity") * F.exp((1 - threshold) * ic) * (1 + 1e-9))).first()[0] or 0.0
    lists = stage(named.select("text_hash", "words").dropDuplicates(["text_hash"]), "words")
    held = lists.select("text_hash", F.explode("words").alias("term")).where(F.length("term") > 2)
    least = held.groupBy("term").agg(F.count("*").alias("n_held")).where((F.col("n_held") >= support) & (F.col("n_held") <= top))
    least = stage(least, "held-terms")
    both = near.join(entities, "entity").join(held.join(least, "term"), "text_hash").groupBy("entity", "term").agg(
        F.count("*").alias("c"), F.first("n_entity").alias("n_entity"), F.first("n_held").alias("n_held"))
    may = stage(both.where((F.col("c") >= support) & tells("n_held")).select("entity", "term", "c", "n_entity"), "candidates")
    # Every text with such a term, whether it holds the identifier or not.
    wanted = stage(may.select("term").distinct(), "candidate-terms")
    seen = stage(text.select("text_hash", F.explode(_words("text")).alias("term")).join(wanted, "term").distinct(), "seen")
    terms = seen.groupBy("term").agg(F.count("*").alias("n_term"))
    disclosing = stage(may.join(terms, "term").where(tells("n_term")).select("term").distinct(), "disclosing")
    added = stage(seen.join(disclosing, "term").groupBy("text_hash").agg(F.collect_set("term").alias("terms")), "told")
    inside = "exists(all_spans, x -> x.start < z.end and z.start < x.end)"
    told = F.expr(f"filter({_spans('text', WORD, 'array_contains(terms, lower(m))')}, z -> not {inside})")
    term = F.expr("transform(told, z -> named_struct('start', z.start, 'end', z.end, 'm', lower(z.m)))")
    told = base_spans(text.join(added, "text_hash")).withColumn("all_spans", _tagged()).withColumn("told", told)
    told = stage(told.select("text_hash", term.alias("term")).dropDuplicates(["text_hash"]), "term-spans")
    return based.join(told, "text_hash", "left").select(
        "doc_id", "text_hash", *KINDS, F.coalesce("term", F.expr(f"cast(array() as {_SPAN})")).alias("term"))


def _listed(*kinds: str) -> Column:
    parts = [F.expr(f"transform({k}, x -> concat('{k}:', x.start, ':', x.end))") for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: counts of base kinds, digest of base spans, all spans."""
    return find(docs, **options).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(*KINDS), 256).alias("base_sha256"), _listed(*KINDS, "term").alias("spans"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with identifiers replaced by their kind and disclosing terms generalised or removed; n_chars follows, if there is one."""
    label = {k: f"'[{k.upper()}]'" for k in KINDS}
    marks = ", ".join(f"transform({k}, x -> named_struct('start', x.start, 'end', x.end, 'label', {label[k]}))" for k in KINDS)
    marks += ", transform(term, x -> named_struct('start', x.start, 'end', x.end, 'label', case when x.m rlike '[0-9]' then '[NUMBER]' else '[TERM]' end))"
    found = find(docs, **options).select(
        F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), F.expr(f"array_sort(concat({marks}))").alias("marks"))
    found = found.where("size(marks) > 0").dropDuplicates(["of", "of_hash"])
    joined = packed(docs).join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left")
    text = F.expr("""case when marks is null then row.text else aggregate(marks,
        named_struct('at', 0, 'out', cast(array() as array<string>)),
        (s, x) -> case when x.start < s.at then named_struct('at', greatest(s.at, x.end), 'out', s.out)
          else named_struct('at', x.end, 'out', concat(s.out, array(substr(row.text, s.at + 1, x.start - s.at), x.label))) end,
        s -> concat(array_join(s.out, ''), substr(row.text, s.at + 1))) end""")
    done = joined.withColumn("clean", text)
    own = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return done.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
