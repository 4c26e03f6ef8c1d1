"""Quality rules: exact per-document statistics and a short-circuit cascade.

Everything is a column expression; no rows leave the JVM but the bounded sample
that orders the rules.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import packed, replaced, unpacked

SPACES = "[\\x20\\x09-\\x0D]+"
#: Symbols that rule-based filters count.
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words of a text in order; of null, an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Low bits of a packed window that hold its position; the rest is its hash.
PLACE_BITS = 21


def packed_windows(w: Column, n: int = 3) -> Column:
    """Sorted longs, one per n-word window of the array ``w``: the high bits are of
    the window's hash, the low ``PLACE_BITS`` its position."""
    place = (1 << PLACE_BITS) - 1
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - F.lit(n)),
        lambda i: F.xxhash64(*[F.get(w, i + F.lit(j)) for j in range(n)]).bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("bigint")),
    )
    return F.when(F.size(w) >= n, F.sort_array(windows)).otherwise(F.array().cast("array<bigint>"))


def twins(p: Column) -> Column:
    """Windows that share their hash bits with a neighbour in sort order, the
    neighbours' order kept."""
    top = lambda x: F.shiftright(x, PLACE_BITS)
    return F.filter(p, lambda x, i: (top(x) == F.coalesce(top(F.get(p, i - 1)), F.lit(-1) - top(x)))
                    | (top(x) == F.coalesce(top(F.get(p, i + 1)), F.lit(-1) - top(x))))


def covered(starts: Column, n: int) -> Column:
    """How many words the windows at the sorted ``starts`` cover."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-n).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(n), i - acc["last"])).cast("bigint").alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )


def _repeated(w: Column, t: Column, n: int) -> Column:
    """Words under the windows ``t``, the twins. Neighbours with equal hash bits are
    compared word by word; where two differ, or the text outgrows ``PLACE_BITS``, the
    text's windows are compared as whole word sequences instead."""
    place = F.lit((1 << PLACE_BITS) - 1)
    at = lambda x: x.bitwiseAND(place).cast("int")
    top = lambda x: F.shiftright(x, PLACE_BITS)
    window = lambda i: F.slice(w, i + 1, n)
    clash = F.exists(
        F.sequence(F.lit(1), F.size(t) - 1),
        lambda k: (top(F.get(t, k)) == top(F.get(t, k - 1))) & (window(at(F.get(t, k))) != window(at(F.get(t, k - 1)))),
    )
    whole = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(n)), lambda i: F.struct(window(i).alias("g"), i.alias("i"))))

    def by_sequence(whole: Column) -> Column:
        pairs = F.filter(F.sequence(F.lit(1), F.size(w) - F.lit(n)), lambda k: F.get(whole, k)["g"] == F.get(whole, k - 1)["g"])
        ends = F.flatten(F.transform(pairs, lambda k: F.array(F.get(whole, k)["i"], F.get(whole, k - 1)["i"])))
        return covered(F.sort_array(F.array_distinct(ends)), n)

    fast = covered(F.sort_array(F.transform(t, at)), n)
    return F.when(F.size(t) == 0, F.lit(0).cast("bigint")).when((F.size(w) > place) | clash, let(whole, by_sequence)).otherwise(fast)


def repeated_words(w: Column, n: int = 3) -> Column:
    """Words covered by an n-word window that occurs twice or more, counted once each."""
    return let(packed_windows(w, n), lambda p: let(twins(p), lambda t: _repeated(w, t, n)))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def _count(text: Column, of: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{of}]+", "")).cast("bigint")


#: Statistics of a text and its words. Those of lines come together.
STATISTICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("bigint"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("bigint"),
    "n_symbols": lambda t, w: _count(t, SYMBOLS),
    "lines": lambda t, w: let(_lines(t), lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("again"))),
    "n_repeat_words": lambda t, w: repeated_words(w),
}


def text_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the struct column ``stats``.

    Fields: n_words, word_chars (code points in words), n_symbols, n_dup_lines
    (lines with a word that equal an earlier line), n_lines (lines with a word),
    n_repeat_words. A null text counts as an empty one; every statistic is then 0.
    A column ``stats`` of ``documents`` gives way.
    """
    return _with_statistics(documents, text).select(*unpacked(documents.columns, "stats"))


def _with_words(documents: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return documents.select(packed(documents), t.alias("text"), words_of(F.col(f"`{text}`")).alias("words"))


def _with_statistics(documents: DataFrame, text: str) -> DataFrame:
    """(row, text, stats)"""
    t, w = F.col("text"), F.col("words")
    found = _with_words(documents, text).select("row", "text", *[f(t, w).alias(k) for k, f in STATISTICS.items()])
    named = F.struct("n_words", "word_chars", "n_symbols", F.col("lines.again").alias("n_dup_lines"), F.col("lines.n").alias("n_lines"), "n_repeat_words").alias("stats")
    # a generator, because a later filter on the statistics would else be pushed
    # through the projections and compute them again for each of its terms
    return found.select("row", "text", named).select("row", "text", F.explode(F.array("stats")).alias("stats"))


@dataclass(frozen=True)
class Rule:
    """A document is rejected where ``reject`` holds; given are a function that
    yields a statistic by name and the text."""

    name: str
    reject: Callable[[Callable[[str], Column], Column], Column]


#: A document that one of these rejects fails the base.
BASE = [
    Rule("few_words", lambda f, t: f("n_words") < 50),
    Rule("repeated_words", lambda f, t: F.lit(100) * f("n_repeat_words") > F.lit(50) * f("n_words")),
]


def base_failed(f: Callable[[str], Column]) -> Column:
    out = F.lit(False)
    for r in BASE:
        out = out | r.reject(f, F.lit(""))
    return out


def default_rules() -> list[Rule]:
    """Heuristics on symbols, duplicate lines, word lengths, shouting and
    capitals. All bounds are parameters of the rules, fixed here."""
    return [
        Rule("symbols", lambda f, t: F.lit(100) * f("n_symbols") > F.lit(10) * f("n_words")),
        Rule("duplicate_lines", lambda f, t: let(f("lines"), lambda x: F.lit(100) * x["again"] > F.lit(50) * x["n"])),
        Rule("word_length", lambda f, t: let(f("word_chars"), lambda c: (c < F.lit(2) * f("n_words")) | (c > F.lit(15) * f("n_words")))),
        Rule("exclamations", lambda f, t: F.lit(100) * _count(t, "!") > F.lit(30) * f("n_words")),
        Rule("capitals", lambda f, t: F.lit(100) * _count(t, "A-Z") > F.lit(50) * _count(t, "A-Za-z")),
    ]


def _from_words(name: str) -> Column:
    """A statistic computed where a rule needs it."""
    return STATISTICS[name](F.col("text"), F.col("words"))


def _from_stats(name: str) -> Column:
    if name == "lines":
        return F.struct(F.col("stats.n_lines").alias("n"), F.col("stats.n_dup_lines").alias("again"))
    return F.col(f"stats.{name}")


def order_rules(sample: DataFrame, rules: list[Rule], given: Callable[[str], Column], rounds: int = 2) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected of what the rules before it keep, seconds), by falling
    rejection per second on ``sample``.

    A rule's seconds are those of all it computes, without what any job takes. The
    order changes only the time a verdict takes, never the verdict.
    """
    text = F.col("text")

    def seconds(c: Column) -> float:
        best = float("inf")
        for _ in range(rounds):
            began = time.perf_counter()
            sample.agg(F.count_if(c)).head()
            best = min(best, time.perf_counter() - began)
        return best

    idle = seconds(F.length("text") < 0)
    cost = {r.name: max(seconds(r.reject(given, text)) - idle, 1e-4) for r in rules}
    left = sample.select(*[r.reject(given, text).alias(f"r{i}") for i, r in enumerate(rules)]).collect()  # the sample's rows
    hits = {r.name: [bool(row[i]) for row in left] for i, r in enumerate(rules)}
    open_, out, rest = list(range(len(left))), [], list(rules)
    while rest:
        share = {r.name: sum(hits[r.name][i] for i in open_) / max(1, len(open_)) for r in rest}
        best = min(rest, key=lambda r: (-share[r.name] / cost[r.name], cost[r.name], r.name))
        out.append((best, share[best.name], cost[best.name]))
        open_ = [i for i in open_ if not hits[best.name][i]]
        rest.remove(best)
    return out


def cascade(rules: list[Rule], given: Callable[[str], Column]) -> Column:
    """First rule that rejects, else null; later rules are not evaluated."""
    chain = None
    for rule in rules:
        reject = rule.reject(given, F.col("text"))
        chain = F.when(reject, rule.name) if chain is None else chain.when(reject, rule.name)
    return F.lit(None).cast("string") if chain is None else chain


#: Rows of the sample that orders the rules, and bytes of its longest text.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 65_536


def _sample(documents: DataFrame, text: str, rows: int) -> DataFrame:
    """Up to ``rows`` texts of bounded size, taken partition by partition until there
    are enough; they serve the order of evaluation and nothing else."""
    t = documents.select(F.col(f"`{text}`").alias("text"))
    few = t.filter((F.octet_length("text") <= SAMPLE_BYTES) | F.col("text").isNull()).take(rows)
    return documents.sparkSession.createDataFrame([(r[0],) for r in few], "text string")


def _ordered(sample: DataFrame, rules: list[Rule], given: Callable[[str], Column]) -> list[Rule]:
    few = sample.cache()
    try:
        return [r for r, _, _ in order_rules(few, rules, given)]
    finally:
        few.unpersist()


def quality_rules(documents: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``documents`` with ``stats``, ``base_failed``, ``rejected_by`` and ``kept``.

    All statistics are results here, so the cascade saves only what rules compute
    beyond them; ``stage_quality`` computes each where a rule needs it. The cascade
    is ordered on ``sample_rows`` rows at most, none with a text over 64 KB; that only
    serves the order of evaluation. Null text: statistics of an empty text, so it
    fails the base rule. Rows are judged one by one: repeated rows get the same
    verdict, an empty table gives an empty result. Other columns stay as they are;
    one with the name of an added column gives way to it.
    """
    ordered = _ordered(_with_statistics(_sample(documents, text, sample_rows), "text"), default_rules(), _from_stats)
    judged = _with_statistics(documents, text).select("row", "text", "stats", base_failed(_from_stats).alias("base_failed"))
    judged = judged.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(cascade(ordered, _from_stats)))
    judged = judged.withColumn("kept", F.col("rejected_by").isNull())
    return judged.select(*unpacked(documents.columns, "stats", "base_failed", "rejected_by", "kept"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = quality_rules(docs)
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[F.col(f"stats.{f}").alias(f) for f in fields], "base_failed", "kept")


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that no rule rejects, in the columns of ``docs``.

    One cascade of the base and the other rules; each statistic is computed when a
    rule is reached that needs it, so a document pays up to its rejection."""
    rules = [*BASE, *default_rules()]
    ordered = _ordered(_with_words(_sample(docs, "text", SAMPLE_ROWS), "text"), rules, _from_words)
    # the generator keeps the filter from computing the cascade twice
    verdict = F.explode(F.array(cascade(ordered, _from_words))).alias("rejected_by")
    judged = _with_words(docs, "text").select("row", verdict)
    return judged.filter("rejected_by IS NULL").select(*replaced(docs.columns))


SQL_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {SQL_WORDS} AS words FROM documents),
p AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM t),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM p),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
s AS (
  SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclaim, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS n_letters
  FROM t JOIN l USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words
    OR word_chars > 15 * n_words OR 100 * n_exclaim > 30 * n_words OR 100 * n_upper > 50 * n_letters) AS kept
FROM b"""
