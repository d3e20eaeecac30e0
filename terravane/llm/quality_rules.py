"""Quality rules, native: per-document rule counts, host-level verdicts with an empirical beta prior.

Every count is a DataFrame expression over the whole text of one row, O(n log n) in its words. Rule failures are summed by
host (map-side combine), each host's failure rate is shrunk towards the rate of all documents by a beta prior, and hosts whose shrunk rate
stands far above the prior are joined back; their documents go. The prior is fitted by moments that take each host's number of documents into account, so the noise
of small hosts does not count as spread between hosts.

Defined cases: null text has no words and fails; a null host is a host of its own, apart from the empty one; a table of one host, or hosts of equal
rates, uses the fallback prior strength; an empty table gives an empty result; rows of one id are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import spread
from .common import let, small, table, text_of, written

#: The white space of the word rule, and the symbols counted.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Extra rules that only count towards the host: symbols over words, repeated lines over lines with words.
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINES = 0.3
#: A host goes when its shrunk failure rate is above the prior's mean by so many of its standard deviations, but never below the first of these rates and always above the second.
MAX_DEVIATIONS, LEAST_HOST_RATE, MOST_HOST_RATE = 3.0, 0.25, 0.6
#: Pseudo-documents of the prior where moments cannot be fitted, and the bounds of what is fitted.
FALLBACK_STRENGTH, LEAST_STRENGTH, MOST_STRENGTH = 20.0, 2.0, 1000.0
#: Hosts up to this number are broadcast (their names and rates); beyond it the join shuffles.
BROADCAST_HOSTS = 100_000


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def window_hashes(hashes: str) -> Column:
    """A hash for each three-word window of a column of word hashes."""
    h = F.col(hashes)
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))


def repeat_words(windows: str) -> Column:
    """Words inside three-word windows that occur twice or more, from the hashes of a text's windows.

    Most texts repeat no window, which a hash set tells. Else windows are sorted by hash, equal neighbours give the repeated positions, and each position adds the words up
    to the next one, three at most: sorting instead of nested lookups, so a text of a million words stays feasible.
    """
    w = F.col(windows)
    ordered = F.sort_array(F.transform(w, lambda g, i: F.struct(g.alias("g"), i.alias("p"))))

    def repeated(s):
        same = lambda p, i: F.coalesce(F.get(s, i)["g"] == p["g"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda p, i: same(p, i - 1) | same(p, i + 1)), lambda p: p["p"]))

    def covered(at):
        return F.aggregate(
            F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3)).cast("bigint")),
            F.lit(0).cast("bigint"),
            lambda total, x: total + x,
        )

    return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(let(let(ordered, repeated), covered))


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), base_failed."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    # one projection a step: each array is built once, inside generated code, and read by the next step
    split = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))
    hashed = split.select("doc_id", "host", "text", F.size("words").cast("bigint").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.size("lines").cast("bigint").alias("n"), F.size(F.array_distinct("lines")).cast("bigint").alias("d"))
    windowed = hashed.withColumn("windows", window_hashes("hashes")).drop("hashes")
    counted = windowed.select(
        "doc_id",
        "host",
        "n_words",
        F.length(F.translate("text", SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.struct("n", "d").alias("lines"),
        repeat_words("windows").alias("n_repeat_words"),
    )
    return counted.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("lines.n") - F.col("lines.d")).alias("n_dup_lines"),
        "n_repeat_words",
        F.col("lines.n").alias("n_lines"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def host_rates(counts: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, rate, shrunk, rejected: failures of any rule by host, with the rate shrunk by the fitted beta prior."""
    failed = (
        F.col("base_failed")
        | (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"))
        | (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
    )
    hosts = counts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("bigint")).alias("n_failed"))
    hosts = written(hosts.withColumn("rate", F.col("n_failed") / F.col("n_docs")), "hosts")
    n, x, squares, k = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")), F.count(F.lit(1))).first()  # one row of numbers
    m = x / n if n else 0.0
    s = hosts.agg(F.sum(F.col("n_docs") * (F.col("rate") - m) ** 2)).first()[0] or 0.0
    strength = prior_strength(m, s, n or 0, squares or 0.0, k)
    limit = min(MOST_HOST_RATE, max(LEAST_HOST_RATE, m + MAX_DEVIATIONS * (m * (1 - m) / (strength + 1)) ** 0.5))
    return hosts.withColumn("shrunk", (F.col("n_failed") + m * strength) / (F.col("n_docs") + strength)).withColumn("rejected", F.col("shrunk") > limit)


def prior_strength(m: float, s: float, n: int, squares: float, k: int) -> float:
    """Pseudo-documents of the beta prior by moments: of s, the weighted squares of rates around m, k - 1 times m (1 - m) is the sampling noise of k hosts; the rest is the spread between them."""
    room = n - squares / n - (k - 1) if n else 0.0
    if not 0 < m < 1 or room <= 0:
        return FALLBACK_STRENGTH
    share = (s - m * (1 - m) * (k - 1)) / (m * (1 - m) * room)
    return MOST_STRENGTH if share <= 0 else min(max(1 / share - 1, LEAST_STRENGTH), MOST_STRENGTH)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The counts of rule_counts with host_rate, host_shrunk and kept: false if the document fails the base rules or its host is rejected."""
    counts = written(rule_counts(docs, id_col, text_col, host_col), "rule-counts")
    rates = written(host_rates(counts).select(F.col("host").alias("_of"), F.col("rate").alias("host_rate"), F.col("shrunk").alias("host_shrunk"), "rejected"), "rates")
    judged = counts.join(small(rates, BROADCAST_HOSTS), counts.host.eqNullSafe(F.col("_of")), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("rejected")).drop("_of", "rejected")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spread(table(spark, sf_dir, "documents"), "doc_id")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.floor(F.col("host_rate") * 1e6 + 0.5).alias("host_rate_e6"), F.floor(F.col("host_shrunk") * 1e6 + 0.5).alias("host_shrunk_e6")
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source AS host FROM documents),
w AS (
  SELECT doc_id, host, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3
),
k AS (SELECT doc_id, p, ws[p] AS a, ws[p + 1] AS b, ws[p + 2] AS c FROM g),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM k) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id
),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.3 * n_lines) AS x
  FROM f GROUP BY host
),
t AS (SELECT sum(n)::DOUBLE AS n, sum(x) / sum(n) AS m, sum(n::DOUBLE * n) AS q, count(*) AS k FROM h),
p AS (SELECT any_value(t.n) AS n, any_value(m) AS m, any_value(q) AS q, any_value(k) AS k, sum(h.n * (h.x / h.n - m) ** 2) AS s FROM h, t),
u AS (SELECT m, n - q / n - (k - 1) AS room, (s - m * (1 - m) * (k - 1)) / nullif(m * (1 - m) * (n - q / n - (k - 1)), 0) AS share FROM p),
s AS (SELECT m, CASE WHEN NOT (m > 0 AND m < 1) OR room <= 0 THEN 20.0 WHEN share <= 0 THEN 1000.0 ELSE least(greatest(1 / share - 1, 2.0), 1000.0) END AS k FROM u),
r AS (SELECT host, x / n AS rate, (x + m * k) / (n + k) AS shrunk, least(0.6, greatest(0.25, m + 3 * sqrt(m * (1 - m) / (k + 1)))) AS most FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND shrunk <= most AS kept,
       CAST(floor(rate * 1e6 + 0.5) AS BIGINT) AS host_rate_e6, CAST(floor(shrunk * 1e6 + 0.5) AS BIGINT) AS host_shrunk_e6
FROM f LEFT JOIN r ON r.host IS NOT DISTINCT FROM f.host
"""
