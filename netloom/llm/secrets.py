"""Secret scans with a trigram inverted index, by DataFrame operations only.

``trigram_query`` derives from a rule's regular expression which trigrams (of the lower-cased text) any match must hold,
as alternatives of trigram sets. The index has postings (trigram, row) for the trigrams that some rule asks for; a
rule's candidates are the rows found in all postings of one of its alternatives, and only those are searched with the
expression. Rules without mandatory trigrams, such as runs of hexadecimal digits, search every row.

Postings carry a hash of the text as the row's key. Colliding texts only make needless candidates: the search decides.
Keys of candidates that are few, by count, are broadcast, so no text is shuffled; more of them are joined by a shuffle.

Lists are folded in blocks of ``BLOCK`` entries, since a fold copies the list it builds with every entry.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre  # the parser's operation codes
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.tables import col, cols, fresh
from netloom.plans.durable import durable

#: Strings that one run of literals and small classes may expand to before it is closed.
MOST_STRINGS = 32
MOST_CHOICES = 6
SPAN = "array<struct<start: bigint, nth: int, stop: bigint>>"
#: Entries of a list that one fold goes through.
BLOCK = 64
#: Candidates of at most some 100 bytes that are sent to every task.
SENT_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds the spans; where ``group`` is set, spans whose group is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


#: The base rules. A run of at least 20 or 24 characters is just the run that the shorter pattern finds and its length
#: keeps, since a run ends only before a character of another kind.
BASE = (
    Rule("assign", "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further public token formats.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of lower-case trigrams; every match holds all trigrams of one. [empty set]: nothing is mandatory."""
    alternatives, open_strings = _walk(sre_parser.parse(pattern))
    return _simplify(_both(alternatives, _closed(open_strings)))


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _closed(strings: set[str]) -> list[frozenset[str]]:
    return [_trigrams(s) for s in sorted(strings)]


def _simplify(alternatives: list[frozenset[str]]) -> list[frozenset[str]]:
    """Without alternatives that hold all of another one."""
    distinct = sorted(set(alternatives), key=lambda x: (len(x), sorted(x)))
    return [a for k, a in enumerate(distinct) if not any(b <= a for b in distinct[:k])]


def _both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    found = _simplify([x | y for x in a for y in b])
    return found if len(found) <= MOST_STRINGS else a


def _choices(items: list) -> set[str] | None:
    """The lower-case characters of a class, or None if it is negated or has many."""
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 2 * MOST_CHOICES:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHOICES else None


def _walk(nodes) -> tuple[list[frozenset[str]], set[str]]:
    """(alternatives that hold so far, strings with which the part read last must end)."""
    must: list[frozenset[str]] = [frozenset()]
    tail = {""}

    def close() -> None:
        nonlocal must, tail
        must, tail = _both(must, _closed(tail)), {""}

    def extend(more: set[str]) -> None:
        nonlocal tail
        if len(tail) * len(more) > MOST_STRINGS:
            close()
        tail = {a + b for a in tail for b in more}

    for op, value in nodes:
        if op is sre.LITERAL:
            extend({chr(value).lower()})
        elif op is sre.IN and (few := _choices(value)):
            extend(few)
        elif op is sre.SUBPATTERN:
            inner, strings = _walk(value[3])
            if inner == [frozenset()]:
                extend(strings)
            else:
                close()
                must = _both(must, _both(inner, _closed(strings)))
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in value[1]]
            if all(a == [frozenset()] for a, _ in parts) and sum(len(s) for _, s in parts) <= MOST_STRINGS:
                extend(set().union(*(s for _, s in parts)))
            else:
                close()
                must = _both(must, _simplify([x for a, s in parts for x in _both(a, _closed(s))]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[:2] == (0, 1) and (part := _walk(value[2]))[0] == [frozenset()] and len(part[1]) <= MOST_CHOICES and max(map(len, part[1])) <= 1:
            extend({"", *part[1]})
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            inner, strings = _walk(value[2])
            close()
            must = _both(must, _both(inner, _closed(strings)))
        elif op is not sre.AT:
            close()
    return must, tail


def _lower(text: Column) -> Column:
    return F.lower(text)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(row, trigram) of the given trigrams from (row, text)."""
    low = docs.select("row", _lower(F.col("text")).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("row", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, kinds): which rules with mandatory trigrams may match in the row; rows without any are not listed."""
    wanted = [(rule.kind, k, t, len(one)) for rule in rules if frozenset() not in (query := trigram_query(rule.pattern)) for k, one in enumerate(query) for t in sorted(one)]
    spark = docs.sparkSession
    if not wanted:
        return spark.createDataFrame([], "row bigint, kinds array<string>")
    # a few hundred rows, as many as the rules have trigrams
    asked = F.broadcast(spark.createDataFrame(wanted, "kind string, part int, trigram string, need int"))
    found = postings(docs, sorted({t for _, _, t, _ in wanted})).join(asked, "trigram")
    met = found.groupBy("row", "kind", "part").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need")
    return met.groupBy("row").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    count = F.ceil(F.size(items) / F.lit(BLOCK)).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.slice(F.array(items), 1, 0))


def _folded(items: Column, start: Column, merge, step, out_type: str, out, context=None) -> Column:
    """What a fold with ``step`` over a long list gives out, in blocks.

    A state is a number; ``merge`` gives that behind a whole block from that before it, ``step`` that behind one item,
    and ``out`` the list of what the item gives, from the state before it. With ``context`` (state before the block,
    block), which is computed once a block, ``out`` gets its value and the state before the block too.
    """

    def before(blocks: Column) -> Column:
        first = F.struct(start.alias("at"), F.expr("cast(array() as array<bigint>)").alias("all"))
        return F.aggregate(blocks, first, lambda acc, b: F.struct(merge(acc["at"], b).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    def within(z: Column) -> Column:
        first = F.struct(z["at"].alias("at"), F.expr(f"cast(array() as {out_type})").alias("out"))

        def gathered(*more: Column) -> Column:
            return F.aggregate(z["block"], first, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], out(acc["at"], x, *more)).alias("out")), lambda acc: acc["out"])

        return gathered() if context is None else _let(context(z["at"], z["block"]), lambda c: gathered(c, z["at"]))

    return _let(_blocks(items), lambda blocks: F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), before(blocks).alias("at")), within)))


def spans(text: Column, rule: Rule, nth: int) -> Column:
    """Spans (start, nth, stop) in code points of the leftmost matches that don't overlap.

    Matches and the pieces between them alternate, so running sums of their lengths give the places.
    """
    pattern = F.lit(rule.pattern)
    pieces = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    size = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    each = F.arrays_zip(F.transform(pieces, F.length).alias("before"), F.transform(found, F.length).alias("long"), F.transform(size, F.length).alias("kept"))

    def after(at: Column, x: Column) -> Column:
        return at + x["before"] + F.coalesce(x["long"], F.lit(0))

    def whole(at: Column, block: Column) -> Column:
        return F.aggregate(block, at, after)

    def one(at: Column, x: Column) -> Column:
        span = F.array(F.struct((at + x["before"]).alias("start"), F.lit(nth).alias("nth"), after(at, x).alias("stop"))).cast(SPAN)
        return F.when(x["long"].isNotNull() & (x["kept"] >= rule.least), span).otherwise(F.expr(f"cast(array() as {SPAN})"))

    matched = _let(each, lambda e: _folded(e, F.lit(0).cast("long"), whole, after, SPAN, one))
    return F.when(F.regexp_like(text, pattern), matched).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _named(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["nth"] + 1), s["start"], s["stop"])), ",")


def with_spans(docs: DataFrame, text_col: str, name: str, rules: tuple[Rule, ...] = RULES, sent_rows: int = SENT_ROWS) -> DataFrame:
    """``docs`` with the column ``name``: all spans by start, then in the order of the rules. ``name`` is a new column."""
    row, kinds, other = fresh(docs, "row", "kinds", "other_row")
    keyed = docs.withColumn(row, F.xxhash64(col(text_col)))
    may = durable(candidates(keyed.select(F.col(row).alias("row"), col(text_col).alias("text")), rules).select(F.col("row").alias(other), F.col("kinds").alias(kinds)))
    few = may.limit(sent_rows + 1).count() <= sent_rows
    joined = keyed.join(F.broadcast(may) if few else may, F.col(row) == F.col(other), "left")
    text = F.coalesce(col(text_col), F.lit(""))
    none = F.expr(f"cast(array() as {SPAN})")
    parts = []
    for nth, rule in enumerate(rules):
        found = spans(text, rule, nth)
        scanned = frozenset() in trigram_query(rule.pattern)
        parts.append(found if scanned else F.when(F.array_contains(F.col(kinds), rule.kind), found).otherwise(none))
    return joined.select(*cols(docs.columns), F.array_sort(reduce(F.concat, parts)).alias(name))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    A null text is empty and has no spans; repeated rows are scanned each; no rows give no rows.
    """
    found = with_spans(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), "text", "found")
    base = F.filter("found", lambda s: s["nth"] < len(BASE))

    def count(k: int) -> Column:
        return F.size(F.filter("found", lambda s: s["nth"] == k)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(_named(base, RULES), 256).alias("base_sha256"), _named(F.col("found"), RULES).alias("spans"))


MASK = "[SECRET]"


def redact(docs: DataFrame, text_col: str = "text", sent_rows: int = SENT_ROWS) -> DataFrame:
    """``docs`` with every span replaced by ``MASK``; overlapping spans become one. Other columns and clean texts stay.

    A null text stays null; repeated rows are masked each; no rows give no rows.
    """
    (name,) = fresh(docs, "spans")
    found = with_spans(docs, text_col, name, sent_rows=sent_rows)
    text = col(text_col)
    # the text is cut at every span's start, and each piece loses what the spans before and at its start cover
    pieces = _folded(
        F.concat(F.col(name), F.array(F.struct(F.length(text).cast("long").alias("start"), F.lit(-1).alias("nth"), F.length(text).cast("long").alias("stop")))),
        F.lit(0).cast("long"),
        lambda at, block: F.greatest(at, F.array_max(F.transform(block, lambda s: s["stop"]))),
        lambda at, s: F.greatest(at, s["stop"]),
        "array<string>",
        lambda at, s, part, first: F.when(s["start"] >= at, F.array(F.substring(part, (at - first + 1).cast("int"), (s["start"] - at).cast("int")))).otherwise(F.expr("cast(array() as array<string>)")),
        # the text that a block's pieces lie in: to find a place, all text before it is gone through
        lambda at, block: F.substring(text, (at + 1).cast("int"), F.greatest(F.lit(0), F.element_at(block, -1)["start"] - at).cast("int")),
    )
    masked = F.when(F.size(F.col(name)) > 0, F.array_join(pieces, MASK)).otherwise(text)
    return found.select(*[masked.alias(text_col) if c == text_col else col(c) for c in docs.columns])


def _duck_spans(rule: Rule, nth: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    kept = f"regexp_extract_all(t, '{pattern}', {rule.group})"
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}', 0)) + 1), lambda i: {{
  'a': CAST(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}', 0)[1:i-1], lambda x: length(x))), 0) AS BIGINT),
  'n': {nth}, 'z': CAST(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x))) + list_sum(list_transform(regexp_extract_all(t, '{pattern}', 0)[1:i], lambda x: length(x))) AS BIGINT),
  'k': '{rule.kind}', 'l': length({kept}[i])}}), lambda x: x['l'] >= {rule.least})"""


def oracle() -> str:
    every = " || ".join(_duck_spans(r, k) for k, r in enumerate(RULES))
    name = "list_transform({}, lambda x: x['k'] || ':' || x['a'] || ':' || x['z'])"
    counts = ", ".join(f"CAST(len(list_filter(found, lambda x: x['n'] = {k})) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(BASE))
    base = name.format(f"list_filter(found, lambda x: x['n'] < {len(BASE)})")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, list_sort({every}) AS found FROM d)
SELECT doc_id, {counts}, sha256(coalesce(array_to_string({base}, ','), '')) AS base_sha256, coalesce(array_to_string({name.format('found')}, ','), '') AS spans FROM f"""
