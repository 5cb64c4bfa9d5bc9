"""Secret scans with a trigram inverted index. DataFrame functions only on the main path.

Every rule's regex is taken apart once into a Boolean trigram query: an OR of clauses, each an AND of
trigrams that any match must hold. Postings (trigram, row key) list the trigrams that the rules ask for; they are
intersected per clause, and only the candidate rows of a rule meet its regex. A rule without mandatory
trigrams is tried on every text. The index is a filter: every span is decided by the regex on the whole text.

Spans are in code points, end exclusive, leftmost and non-overlapping per rule; a match failing the rule's
length check is dropped after it took its place. Null texts count as empty. Repeated rows, null ids and other
columns are fine (rows meet the index by a hash of the text; equal keys only add candidates). An empty
table gives an empty result. The texts of one hash may hold a third of all rows; they need no grouping, as
postings are distinct per text before they are intersected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicegrid.llm.common import SMALL_ROWS, free_name
from voicegrid.session import materialize

MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """`pattern` in the syntax shared by Java and Python; `least` characters of `group` are needed."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


# The first three are the base rules, in their order.
ASSIGN = "({})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)".format(
    "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
)
BASE_RULES = (
    Rule("assign", ASSIGN, 2, 6),
    # Of these two, a run too short can't hide another match, so the length is part of the pattern.
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str, most: int = MAX_STRINGS) -> frozenset[frozenset[str]] | None:
    """OR of ANDs of lower-case trigrams that any match of `pattern` holds; None if there is no such query.

    The parse tree is walked from left to right. Each open alternative is the trigrams seen and the
    literal text that ends it; what can't be listed as a few strings closes that text.
    """
    done = _walk(list(parser.parse(pattern)), {(frozenset(), "")}, most)
    clauses = {grams for grams, _ in done}
    if not all(clauses):
        return None
    return frozenset(c for c in clauses if not any(other < c for other in clauses))


def _extend(open_: set, strings: Sequence[str]) -> set:
    out = set()
    for grams, tail in open_:
        for s in strings:
            whole = tail + s
            out.add((grams | {whole[i:i + 3] for i in range(len(whole) - 2)}, whole[-2:]))
    return out


def _walk(nodes: list, open_: set, most: int) -> set:
    for kind, value in nodes:
        if len(open_) > most:
            open_ = {(grams, "") for grams, _ in open_}
        if kind is op.LITERAL:
            open_ = _extend(open_, [chr(value).lower()])
        elif kind is op.IN and (members := _members(value)) is not None:
            open_ = _extend(open_, members)
        elif kind is op.SUBPATTERN:
            open_ = _walk(list(value[3]), open_, most)
        elif kind is op.BRANCH:
            open_ = set().union(*(_walk(list(branch), open_, most) for branch in value[1]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, largest, body = value
            for _ in range(min(least, 3)):
                open_ = _walk(list(body), open_, most)
            if (least, largest) == (0, 1):
                open_ = open_ | _walk(list(body), open_, most)
            elif largest != least or least > 3:
                open_ = {(grams, "") for grams, _ in open_}
        elif kind is not op.AT:
            open_ = {(grams, "") for grams, _ in open_}
    return open_


def _members(items: list) -> list[str] | None:
    """Characters of a small class, in lower case."""
    if any(kind is not op.LITERAL for kind, _ in items):
        return None
    return sorted({chr(value).lower() for _, value in items})


def row_key(text: Column) -> Column:
    return F.xxhash64(text)


def postings(texts: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """(trigram, row_key) of the asked trigrams, once per text; `texts` has (row_key, lowered)."""
    held = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in trigrams]))
    return texts.select("row_key", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """(row_key, kinds): the rules with a clause of which the text has every trigram."""
    spark = index.sparkSession
    clauses = sorted((kind, sorted(c)) for kind, clauses in queries.items() for c in clauses)
    asked = [(g, n, kind, len(grams)) for n, (kind, grams) in enumerate(clauses) for g in grams]
    wanted = spark.createDataFrame(asked, "trigram string, clause int, kind string, size int")
    # One row per trigram of the rules: its size doesn't depend on the texts.
    return (
        index.join(F.broadcast(wanted), "trigram")
        .groupBy("row_key", "clause", "kind", "size").agg(F.count("*").alias("held"))
        .filter("held = size")
        .groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))
    )


NO_SPANS = "cast(array() as array<struct<start:bigint,rank:int,end:bigint>>)"


def _placed(gaps: Column, matches: Column, checked: Column, rule: Rule, number: int) -> Column:
    """Array of (start, rank, end): the texts between the matches and the matches give the positions."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(NO_SPANS).alias("spans"))

    def step(state: Column, i: Column) -> Column:
        begin = state["at"] + F.length(F.get(gaps, i))
        end = begin + F.length(F.get(matches, i))
        span = F.struct(begin.alias("start"), F.lit(number).alias("rank"), end.alias("end"))
        good = F.get(checked, i).isNotNull() & (F.length(F.get(checked, i)) >= rule.least)
        return F.struct(
            end.alias("at"),
            F.when(good, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    indexes = F.when(F.size(matches) > 0, F.sequence(F.lit(0), F.size(matches) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(indexes, start, step)["spans"]


def secret_spans(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, small: int = SMALL_ROWS, name: str = "spans"
) -> DataFrame:
    """`docs` with an array column `name` of (start, kind, end), by start, then by the order of the rules."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name} already")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key, kinds = free_name(docs, "_key"), free_name(docs, "_kinds")
    trigrams = sorted({g for q in queries.values() for clause in q for g in clause})
    marked = docs.withColumn(key, row_key(body))
    if trigrams:
        texts = docs.select(row_key(body).alias("row_key"), F.lower(body).alias("lowered"))
        index = materialize(postings(texts, trigrams), "trigram-postings")
        listed = materialize(candidates(index, queries), "secret-candidates").select(
            F.col("row_key").alias(key), F.col("kinds").alias(kinds)
        )
        marked = marked.join(F.broadcast(listed) if listed.count() <= small else listed, key, "left")
    else:
        marked = marked.withColumn(kinds, F.lit(None).cast("array<string>"))
    # Columns of their own, so that a text is searched once for each of them.
    parts, placed = [], []
    for number, rule in enumerate(rules):
        asked = F.array_contains(kinds, rule.kind) if rule.kind in queries else F.lit(True)
        own = [free_name(docs, f"_{part}_{rule.kind}") for part in ("gaps", "matches", "checked")]
        marked = marked.withColumns({
            own[0]: F.when(asked, F.split(body, rule.pattern, -1)),
            own[1]: F.when(asked, F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(0))),
        })
        if rule.group:
            marked = marked.withColumn(own[2], F.when(asked, F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(rule.group))))
        gaps, matches, checked = F.col(own[0]), F.col(own[1]), F.col(own[2 if rule.group else 1])
        placed.append(F.coalesce(_placed(gaps, matches, checked, rule, number), F.expr(NO_SPANS)))
        parts += own
    names = F.array(*[F.lit(r.kind) for r in rules])
    every = F.array_sort(F.flatten(F.array(*placed)))
    spans = F.transform(every, lambda s: F.struct(s["start"], F.get(names, s["rank"]).alias("kind"), s["end"]))
    return marked.withColumn(name, spans).drop(key, kinds, *parts)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with every span replaced by `mark`; spans that overlap or touch become one mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = (s["start"] > state["at"]) | (s["start"] == 0) & (state["at"] == 0)
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)
