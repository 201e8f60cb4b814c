"""Secret scan through a trigram inverted index, in DataFrame functions only.

Each rule's regex is turned into a Boolean trigram query: an OR of alternatives,
each an AND of the trigrams that every match must hold. Postings (trigram,
doc_id) are kept for the trigrams that any query names, on lower-cased text.
Intersecting them gives each rule's candidates, on which alone its regex runs;
rules with an alternative that lacks trigrams run on every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import fresh, materialize, quoted

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    kind: str
    #: Valid for Python and Java alike.
    regex: str
    #: A match counts if this group has at least ``least`` characters.
    group: int = 0
    least: int = 0


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (Rule("assign", ASSIGN, 2, 6), Rule("access", r"AKIA[A-Z0-9]+", 0, 20), Rule("hex", r"[0-9a-f]{24,}"))
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
#: Alternatives that a query may have before its remaining parts count as gaps.
MOST = 64
GAP = "\0"


def _alternatives(tree) -> set[str]:
    """Strings of the letters that matches must hold in order; GAP stands for anything."""
    out = {""}
    for op, arg in tree:
        if op is sre.LITERAL:
            more = {chr(arg)}
        elif op is sre.SUBPATTERN:
            more = _alternatives(arg[3])
        elif op is sre.BRANCH:
            more = set().union(*map(_alternatives, arg[1]))
        elif op is sre.IN and len(arg) <= 5 and all(o is sre.LITERAL for o, _ in arg):
            more = {chr(c) for _, c in arg}
        elif op is sre.MAX_REPEAT and arg[:2] == (0, 1):
            more = {""} | _alternatives(arg[2])
        elif op is sre.MAX_REPEAT and 1 <= arg[0] and len(arg[2]) == 1 and arg[2][0][0] is sre.LITERAL:
            more = {chr(arg[2][0][1]) * arg[0] + ("" if arg[0] == arg[1] else GAP)}
        elif op is sre.AT:
            more = {""}
        else:
            more = {GAP}
        if len(out) * len(more) > MOST:
            more = {GAP}
        out = {a + b for a in out for b in more}
    return out


def trigram_query(regex: str) -> list[frozenset[str]]:
    """OR of ANDs of lower-case trigrams; empty if the regex must scan fully."""
    found = set()
    for text in _alternatives(parser.parse(regex)):
        runs = text.lower().split(GAP)
        found.add(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    if frozenset() in found:
        return []
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


def build_index(docs: DataFrame, trigrams: list[str], text_col: str = "text") -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams; null ids and texts have none."""
    low = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.lower(text_col).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, kinds) of documents whose postings satisfy a query of these kinds."""
    terms = [(t, kind, i, len(alt)) for kind, alts in queries.items() for i, alt in enumerate(alts) for t in sorted(alt)]
    asked = index.sparkSession.createDataFrame(terms, "trigram string, kind string, alternative int, wanted int")
    # The rules' terms are bounded by the rules, not by the data.
    met = index.distinct().join(F.broadcast(asked), "trigram").groupBy("doc_id", "kind", "alternative", "wanted").agg(F.count("*").alias("n"))
    return met.filter("n = wanted").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


#: Matches of a text that are folded at a time; a fold copies what it has found so far.
STEP = 128
_NONE = "cast(array() as array<struct<start:bigint,order:int,kind:string,end:bigint>>)"


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of a rule's leftmost non-overlapping matches.

    Starts follow from the lengths of matches and of the pieces between them; all
    count code points. Matches are folded in steps of STEP, each from the total
    length of the steps before it, so the cost grows in proportion to their number.
    """
    pieces = F.split(text, rule.regex, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    both = F.arrays_zip(pieces.alias("p"), matches.alias("m"))
    none, zero = F.expr(_NONE), F.lit(0).cast("long")
    length = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        held = F.regexp_extract(x["m"], rule.regex, rule.group) if rule.group else x["m"]
        one = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        good = x["m"].isNotNull() & (F.length(held) >= rule.least)
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(good, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    def step(x: Column) -> Column:
        start = F.struct(x["at"].alias("at"), none.alias("found"))
        return F.aggregate(x["part"], start, add, lambda acc: acc["found"])

    def place(acc: Column, part: Column) -> Column:
        size = F.aggregate(part, zero, lambda n, x: n + length(x))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["parts"], F.array(F.struct(acc["at"].alias("at"), part.alias("part")))).alias("parts"))

    kind = "cast(array() as array<struct<at:bigint,part:array<struct<p:string,m:string>>>>)"
    cut = F.transform(F.sequence(F.lit(1), F.size(both), F.lit(STEP)), lambda i: F.slice(both, i, F.lit(STEP)))
    placed = F.aggregate(cut, F.struct(zero.alias("at"), F.expr(kind).alias("parts")), place, lambda acc: acc["parts"])
    return F.when(F.rlike(text, F.lit(rule.regex)), F.flatten(F.transform(placed, step))).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """Add ``into``, the sorted spans of all rules, to every row of ``docs`` (doc_id, text, ...).

    A null or empty text has no spans. Rows with a null doc_id can't be named by
    postings and are scanned by every rule; rows that repeat a doc_id are each
    scanned if any of them is a candidate. Spans that start together are in order
    of rule. An own column of the name ``into`` is replaced, other columns stay,
    whatever their names; an empty table gives no rows.
    """
    columns = [c for c in docs.columns if c.lower() != into.lower()]
    doc, kinds = fresh("doc", columns), fresh("kinds", columns)
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    trigrams = sorted({t for q in queries.values() for alt in q for t in alt})
    rows = docs.select(*map(quoted, columns))
    if queries:
        found = materialize(candidates(build_index(rows, trigrams), queries), "candidates")
        rows = rows.join(found.select(F.col("doc_id").alias(doc), F.col("kinds").alias(kinds)), F.col("doc_id") == F.col(doc), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    for order, rule in enumerate(rules):
        own = spans(text, rule, order)
        if rule.kind in queries:
            own = F.when(F.col("doc_id").isNull() | F.coalesce(F.array_contains(kinds, F.lit(rule.kind)), F.lit(False)), own).otherwise(F.expr(_NONE))
        parts.append(own)
    return rows.select(*map(quoted, columns), F.array_sort(F.concat(*parts)).alias(into))


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """doc_id, a count for each base rule, the hash of base spans and all spans as text."""
    kinds = [r.kind for r in rules]
    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    n = [F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in kinds]
    return scanned.select("doc_id", *n, F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("secrets")).alias("spans"))


def redact(scanned: DataFrame, mask: str = "[SECRET]", column: str = "secrets") -> DataFrame:
    """Replace the spans of ``column`` in ``text`` by ``mask``; overlapping spans become one mask."""
    text, found = F.col("text"), F.col(quoted(column))

    def put(acc: Column, s: Column) -> Column:
        at = F.greatest(acc["at"], s["start"])
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (at - acc["at"]).cast("int")), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(found, start, put, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return scanned.withColumn("text", F.when(F.size(found) > 0, done).otherwise(text))


def _sql_rule(order: int, rule: Rule) -> str:
    regex = rule.regex.replace("'", "''")
    held = f"length(regexp_extract(m, '{regex}', {rule.group}))" if rule.group else "length(m)"
    return f"""select r, {order} as o, '{rule.kind}' as kind, s, e from (
        select r, m, upto - length(m) as s, upto as e from (
          select r, i, m, sum(length(p) + length(m)) over (partition by r order by i) as upto from (
            select r, unnest(string_split_regex(t, '{regex}')) as p, unnest(regexp_extract_all(t, '{regex}')) as m,
                   generate_subscripts(string_split_regex(t, '{regex}'), 1) as i
            from docs where regexp_matches(t, '{regex}')) where m is not null))
      where {held} >= {rule.least}"""


def oracle(rules: tuple[Rule, ...] = RULES, base: int = len(BASE_RULES)) -> str:
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in rules[:base])
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}" for r in rules[:base])
    joined = "string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, o)"
    return f"""with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    found as ({" union all ".join(_sql_rule(i, r) for i, r in enumerate(rules))}),
    told as (select r, {counts}, {joined} filter (where o < {base}) as b, {joined} as spans from found group by r)
    select doc_id, {zeros}, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans
    from docs left join told using (r)"""
