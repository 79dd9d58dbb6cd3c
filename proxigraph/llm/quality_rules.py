"""Quality rules: a threshold table compiled into one Spark projection.

Everything is built-in column functions, so the plan is a scan and projections: no shuffle,
no Python and nothing that grows with the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.llm.arrow import free_name
from proxigraph.plans.session import table

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\f\r"

#: Lower-case function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = (
    "the of and to in that is was are for on with be by at from this or an it as "
    "der die das und ist ein eine nicht mit von zu den auf für im sich "
    "le la les de des et un une est que dans pour par en du au qui "
    "el los las y se del por con para una su no es"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes when ``low <= metric <= high``; a bound that is None does not apply."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are per word or per line with a word.
RULES = (
    Rule("mean_word_chars", 1.5, 25.0),
    Rule("symbol_ratio", None, 0.35),
    Rule("stop_word_ratio", 0.03, None),
    Rule("duplicate_line_ratio", None, 0.6),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words covered by a 3-word window that occurs at least twice: windows are hashed and sorted
    with their position, and neighbours with the same three words are repeats. O(n log n) a text."""
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    return F.sort_array(windows)


def _same(words: Column, a: Column, b: Column) -> Column:
    return (a["h"] == b["h"]) & (F.get(words, a["i"]) == F.get(words, b["i"])) & (F.get(words, a["i"] + 1) == F.get(words, b["i"] + 1)) & (F.get(words, a["i"] + 2) == F.get(words, b["i"] + 2))


def measure(docs: DataFrame, text: str = "text", into: str = "rule_metrics") -> DataFrame:
    """``docs`` with the struct column ``into``: counts and ratios of the whole text.

    A null text counts as one without words. Windows are compared by a 64-bit hash and then
    by their words. Rows are neither merged nor dropped; other columns stay as they are, but
    one that is named like ``into`` gives way to it.
    """
    kept, t = [c for c in docs.columns if c.lower() != into.lower()], F.coalesce(docs[text], F.lit(""))
    w, ls, squeezed, win, pos = (free_name(f"rule_{x}", docs.columns) for x in ("words", "lines", "squeezed", "windows", "repeats"))
    # Each step is a column of its own, read more than once by the next: the optimiser then computes it once a row.
    work = docs.withColumns({w: _words(t), ls: F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0), squeezed: F.translate(t, _BLANKS, "")})
    work = work.withColumn(win, _repeated(F.col(w)))
    win = F.col(win)
    work = work.withColumn(pos, F.sort_array(F.transform(
        F.filter(win, lambda x, k: ((k > 0) & _same(F.col(w), x, F.get(win, k - 1))) | ((k + 1 < F.size(win)) & _same(F.col(w), x, F.get(win, k + 1)))),
        lambda x: x["i"],
    )))
    covered = F.aggregate(F.col(pos), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    n_stop, n_symbols, dup = (free_name(f"rule_{x}", docs.columns) for x in ("stop", "symbols", "dup"))
    work = work.withColumns({
        n_stop: F.size(F.filter(w, lambda x: (F.length(x) <= 5) & x.isin(STOP_WORDS))),
        n_symbols: F.length(squeezed) - F.length(F.translate(squeezed, SYMBOLS, "")),
        dup: F.size(ls) - F.size(F.array_distinct(ls)),
    })
    n_dup = F.col(dup)
    n = F.size(w).cast("long")
    per_word = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    n_lines, n_chars = F.size(ls), F.length(squeezed)
    # A filter on the metrics must not be pushed below the steps: it would compute them for every array
    # element. The condition always holds, but is not deterministic, so no filter passes it.
    barrier = F.monotonically_increasing_id() >= 0
    return work.select(*[F.col(f"`{c}`") for c in kept], F.when(barrier, F.struct(
        n.alias("n_words"), n_chars.cast("long").alias("word_chars"), F.col(n_symbols).cast("long").alias("n_symbols"),
        n_dup.cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), n_lines.cast("long").alias("n_lines"), F.col(n_stop).cast("long").alias("n_stop_words"),
        per_word(n_chars).alias("mean_word_chars"), per_word(F.col(n_symbols)).alias("symbol_ratio"), per_word(F.col(n_stop)).alias("stop_word_ratio"),
        F.when(n_lines > 0, n_dup / n_lines).otherwise(F.lit(0.0)).alias("duplicate_line_ratio"),
    )).alias(into))


def compile_rules(rules=RULES, of: str = "rule_metrics") -> Column:
    """The table as one boolean expression."""
    out = F.lit(True)
    for r in rules:
        c = F.col(f"`{of}`.{r.metric}")
        out = out & (F.lit(True) if r.low is None else c >= r.low) & (F.lit(True) if r.high is None else c <= r.high)
    return out


def base_failed(of: str = "rule_metrics") -> Column:
    """Fewer than 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col(f"`{of}`.n_words") < 50) | (100 * F.col(f"`{of}`.n_repeat_words") > 50 * F.col(f"`{of}`.n_words"))


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with ``rule_metrics``, ``base_failed`` and ``kept`` (never null; empty texts fail).

    Input columns of these three names give way to the results; ``keep`` leaves all as they are.
    """
    out = measure(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, repeated ones too, with just their own columns, whatever their names."""
    of = free_name("rule_metrics", docs.columns)
    passed = measure(docs, text, of).filter(~base_failed(of) & compile_rules(rules, of))
    return passed.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every row of documents; null and empty texts have no words and fail.
    Repeated rows each give one row; an empty table gives none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = [F.col(f"rule_metrics.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words")]
    return quality_rules(docs).select("doc_id", *m, "base_failed", "kept")


OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s
        FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
             len(list_filter(ws, lambda x: list_contains([STOP], x)))::BIGINT AS n_stop_words
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 25.0 AND n_symbols / n_words <= 0.35
       AND n_stop_words / n_words >= 0.03 AND n_dup_lines / greatest(n_lines, 1) <= 0.6 AS kept
FROM b
""".replace("[STOP]", "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)) + "]")

QUERIES = {"op5_quality_rules": op5_quality_rules}
SQL = {"op5_quality_rules": OP5_SQL}
