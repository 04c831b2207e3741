"""Quality rules of documents, judged together with the host they come from (built-in expressions only).

Each document is measured once and the measures are stored. Rule failures are then added up by host; per rule an
empirical Beta prior is fitted to the hosts' failure rates (method of moments), which draws the rate of a small host
to the common rate. A host whose drawn rate of a rule stands out from the corpus rate of that rule is flagged for it, and
the verdict is joined back: a document goes if it fails the base rule, if it fails a rule that its host is flagged for, or
if it fails a rule by far (``CLEAR``, twice its bound), so junk that is spread over many hosts goes too. A narrow failure
on an ordinary host stays, and so does a document that fails no rule, whatever its host does.

Defined results: a null or empty text has no words and fails the base rule; a null host is a host of its own; rows with
the same or with no id are judged one by one; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from opsloom.llm.common import WHITE, documents, let, text_of, words_of
from opsloom.session import written

Q, S = {}, {}

RATIO, LEAST_RATE = 1.5, 0.01  # a host is bad at a rule from so many times the corpus rate, and not below so small a rate
SPAN = 8
# rule -> failed? Each is a whole-number comparison of a document's measures.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)",
}
BASE = ("short", "repeats")
# rule -> failed by far?
CLEAR = {
    "symbols": "5 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 6 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < n_words OR word_chars > 24 * n_words)",
}


def repeat_words(words: Column) -> Column:
    """Words inside runs of ``SPAN`` words that occur twice or more, the first occurrence included.

    Runs are compared by 64-bit hash within one text. Only texts in which a hash repeats are sorted; the cost is
    n log n in the words of the text.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    runs = let(hashes, lambda h: F.when(F.size(h) < SPAN + 1, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(h) - SPAN), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SPAN)]))))

    def covered(run: Column) -> Column:
        order = F.sort_array(F.transform(run, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(order, lambda s: F.filter(s, lambda x, j: (x.h == F.get(s, j - 1).h) | F.coalesce(x.h == F.get(s, j + 1).h, F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda x: x.i))
        gaps = let(starts, lambda p: F.transform(p, lambda v, j: F.least(F.lit(SPAN), F.coalesce(F.get(p, j + 1) - v, F.lit(SPAN)))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return let(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(covered(r))).cast("bigint")


def measures(docs: DataFrame, host: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``host`` and the counts the rules are made of; with ``keep`` those columns as the struct ``row``."""
    text = text_of()
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(WHITE)) != "")
    row = [F.struct(*keep).alias("row")] if keep else []
    split = docs.select(*row, "doc_id", F.col(host).alias("host"), text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))
    return split.select(
        *(["row"] if keep else []),
        "doc_id",
        "host",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Per rule the two parameters of the Beta prior, from mean and variance of the hosts' rates; one row reaches the driver."""
    rate = {r: F.col(f"f_{r}") / F.col("n") for r in RULES}
    row = hosts.agg(*[F.avg(rate[r]).alias(f"m_{r}") for r in RULES], *[F.var_pop(rate[r]).alias(f"v_{r}") for r in RULES]).first()
    priors = {}
    for r in RULES:
        mean, var = row[f"m_{r}"] or 0.0, row[f"v_{r}"] or 0.0
        strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1e6) if var > 1e-12 else 1e6
        priors[r] = (mean * strength, (1 - mean) * strength)
    return priors


def quality_verdicts(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: float = LEAST_RATE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its measures, ``base_failed``, ``host_flagged`` (for any rule) and ``kept``.

    A host is flagged for a rule if its drawn rate is above ``ratio`` times the corpus rate of the rule and above
    ``least``; then its documents that fail the rule go. A document that fails a rule by far goes whatever its host.
    With ``keep`` those columns of the document come along as the struct ``row``, so nothing has to be joined to it later.
    """
    measured = written(measures(docs, host, keep), "quality")
    failed = {r: F.expr(cond) for r, cond in RULES.items()}
    hosts = written(measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(failed[r]).alias(f"f_{r}") for r in RULES]), "hosts")
    priors = beta_priors(hosts)
    corpus = hosts.agg(*[(F.sum(f"f_{r}") / F.sum("n")).alias(r) for r in RULES]).first()
    drawn = {r: (F.col(f"f_{r}") + a) / (F.col("n") + a + b) for r, (a, b) in priors.items()}
    bad = {r: (drawn[r] > ratio * (corpus[r] or 0.0)) & (drawn[r] > least) for r in RULES}
    verdict = hosts.select(F.col("host").alias("__host"), *[bad[r].alias(f"bad_{r}") for r in RULES])
    any_of = lambda conds: reduce(lambda x, y: x | y, conds)
    joined = measured.join(verdict, F.col("host").eqNullSafe(F.col("__host")), "left").drop("__host")
    base = any_of([failed[r] for r in BASE])
    soft = any_of([failed[r] & F.col(f"bad_{r}") for r in RULES] + [F.expr(cond) for cond in CLEAR.values()])
    return joined.select(
        *measured.columns,
        base.alias("base_failed"),
        any_of([F.col(f"bad_{r}") for r in RULES]).alias("host_flagged"),
        (~base & ~soft).alias("kept"),
    )


def op1_quality_rules(spark, sf_dir):
    return quality_verdicts(documents(spark, sf_dir)).drop("host", "n_lines")


Q["op1_quality_rules"] = op1_quality_rules


def _sql() -> str:
    fails = ", ".join(f"coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS f_{r}" for r, cond in RULES.items())
    prior = ", ".join(
        f"avg(f_{r} / n) AS m_{r}, CASE WHEN var_pop(f_{r} / n) > 1e-12 THEN least(greatest(avg(f_{r} / n) * (1 - avg(f_{r} / n)) / var_pop(f_{r} / n) - 1, 1.0), 1e6) ELSE 1e6 END AS s_{r}"
        for r in RULES)
    drawn = {r: f"(f_{r} + m_{r} * s_{r}) / (n + m_{r} * s_{r} + (1 - m_{r}) * s_{r})" for r in RULES}
    bad = ", ".join(f"({drawn[r]} > {RATIO} * c_{r} AND {drawn[r]} > {LEAST_RATE}) AS bad_{r}" for r in RULES)
    corpus = ", ".join(f"sum(f_{r}) / sum(n) AS c_{r}" for r in RULES)
    base = " OR ".join(f"({RULES[r]})" for r in BASE)
    soft = " OR ".join([f"(({cond}) AND bad_{r})" for r, cond in RULES.items()] + [f"({cond})" for cond in CLEAR.values()])
    return rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + {SPAN - 1}], ' ') AS run
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {SPAN - 2})) AS i FROM w WHERE len(ws) > {SPAN})),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS c FROM runs) WHERE c > 1),
rep AS (SELECT doc_id, sum(least({SPAN}, coalesce(nxt - i, {SPAN}))) AS n
        FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint AS n_symbols, len(ls)::bigint AS n_lines,
             (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
h AS (SELECT host, count(*) AS n, {fails} FROM m GROUP BY host),
p AS (SELECT {prior} FROM h),
c AS (SELECT {corpus} FROM h),
v AS (SELECT host, {bad} FROM h, p, c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed,
       ({' OR '.join(f'bad_{r}' for r in RULES)}) AS host_flagged, NOT ({base}) AND NOT ({soft}) AS kept
FROM m JOIN v ON m.host IS NOT DISTINCT FROM v.host"""


S["op1_quality_rules"] = _sql()
