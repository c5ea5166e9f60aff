"""Secret scan with a trigram inverted index, DataFrame functions only.

1. ``trigrams.mandatory`` derives a Boolean trigram query from each rule's regex.
2. ``postings`` builds the inverted index (trigram -> document) of all trigrams
   that any rule demands, over every whole text.
3. ``candidates`` intersects postings: a clause holds where a document is in the
   postings of all its trigrams.
4. ``secret_scan`` verifies candidates with the regex and computes spans. Rules
   without a mandatory trigram scan every document.

The terms of the rules are the one broadcast; their number is fixed by RULES, not
by the data. A document contributes one posting per demanded trigram at most, so
no key of a shuffle is hot: postings meet by document.

Defined cases: null text counts as empty and has no spans; a null id can't be
looked up in the index, so its row is a candidate of every rule; rows that repeat
an id share candidates (a superset) and are verified one by one; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamframe.llm.trigrams import mandatory


class Rule(NamedTuple):
    """A kind of secret: its matches have ``least`` characters in ``group`` or are dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")

#: Runs of {n,} begin and end where the runs of + of n or more characters do, so short runs needn't be listed.
RULES = [
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, True),
    Rule("access", "AKIA[A-Z0-9]{14,}", 0, 18, True),
    Rule("hex", "[0-9a-f]{16,}", 0, 16, True),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    Rule("github", "gh[opsu]_[A-Za-z0-9]{36,}", 0, 40, False),
    Rule("slack", "xox[abpr]-[A-Za-z0-9-]{10,}", 0, 15, False),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}", 0, 40, False),
]


def terms(rules: list[Rule]) -> list[tuple[str, str, str, int]]:
    """(trigram, kind, clause, trigrams of the clause)."""
    return [(t, r.kind, f"{r.kind}{i}", len(c)) for r in rules for i, c in enumerate(mandatory(r.pattern) or []) for t in sorted(c)]


def postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index (trigram, doc_id) of the lower-cased texts, restricted to ``grams``."""
    low = docs.select(docs[id_col].alias("doc_id"), F.lower(docs[text_col]).alias("low")).where("doc_id is not null")
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("doc_id", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query a document satisfies."""
    table = index.sparkSession.createDataFrame(terms(rules), "trigram string, kind string, clause string, need int")
    return (
        index.join(F.broadcast(table), "trigram")
        .groupBy("doc_id", "kind", "clause", "need")
        .agg(F.countDistinct("trigram").alias("have"))
        .where("have = need")
        .groupBy("doc_id")
        .agg(F.collect_set("kind").alias("kinds"))
    )


_SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _spans(text: Column, rule: Rule, rank: int, wanted: Column) -> Column:
    """Matches of one rule, leftmost and non-overlapping, as (start, rank, kind, end) in code points."""
    whole = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.transform(F.split(text, rule.pattern), F.length)
    lengths = F.transform(whole, F.length)
    pieces = F.arrays_zip(between.alias("gap"), lengths.alias("size"), F.transform(value, F.length).alias("inner"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + F.coalesce(p["size"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        found = F.when(p["inner"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), found.alias("out"))

    spans = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return F.when(wanted & F.rlike(text, F.lit(rule.pattern)), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_<base kind>, base_sha256, spans (kind:start:end by start)."""
    grams = sorted({t for t, *_ in terms(rules)})
    found = candidates(postings(docs, grams, id_col, text_col), rules)
    texts = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    by_kind = {
        r.kind: _spans(F.col("text"), r, i, F.lit(True) if mandatory(r.pattern) is None else F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)))
        for i, r in enumerate(rules)
    }
    base = [r.kind for r in rules if r.base]
    held = texts.join(found, "doc_id", "left").select("doc_id", *[c.alias(k) for k, c in by_kind.items()])
    both = lambda kinds: reduce(lambda a, b: F.concat(a, b), [F.col(k) for k in kinds])
    return held.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(_written(both(base)), 256).alias("base_sha256"),
        _written(both(list(by_kind))).alias("spans"),
    )


def _oracle() -> str:
    def spans(i: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        return f"""SELECT rid, doc_id, {i} AS rank, '{r.kind}' AS kind, regexp_extract_all(text, '{p}') AS whole,
            regexp_extract_all(text, '{p}', {r.group}) AS value, string_split_regex(text, '{p}') AS gaps FROM t WHERE regexp_matches(text, '{p}')"""

    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(spans(i, r) for i, r in enumerate(RULES))}),
e AS (SELECT rid, rank, kind, value, whole, gaps, unnest(range(1, len(whole) + 1)) AS i FROM m),
s AS (SELECT rid, rank, kind, length(value[i]) AS inner_size, length(whole[i]) AS size,
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start FROM e),
k AS (SELECT rid, rank, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS span FROM s
      WHERE inner_size >= CASE kind {" ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)} END),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (rid)
"""


ORACLE = _oracle()
