"""Operator 10 [native]: quality rules with host-level verdicts.

Rules are checked per document inside one projection (no shuffle, no Python). Failures
are aggregated by host, a host's failure rate is shrunk towards an empirical beta prior,
and the host's verdict is joined back: a document with a minor failure stays if its host
is sound and goes if its host is not. A document that fails a base or a major rule goes anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace, free

#: Fixed patterns: words, white space and symbols.
WORD, SPACE, SYMBOL = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Major rule: a document with more symbols per word goes.
MAX_SYMBOLS_PER_WORD = 0.1
#: Minor rules: a document may fail one of them if its host is sound.
MEAN_WORD_CHARS = (2.0, 14.0)
MAX_DUP_LINES = 0.3
MAX_REPEAT_PERCENT_MINOR = 30
#: A host is unsound if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5


def with_metrics(docs: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``docs`` with the metrics of ``text`` (and ``n_lines``) appended under ``prefix``.

    ``n_repeat_words`` counts words inside 3-word windows that occur twice or more in the text:
    equal windows meet by sorting (hash, position) pairs within the row, so a text of n
    words costs n log n, and texts without a repeated window skip the sort."""
    t, w, g, p, q, ln = (f"{prefix}__{x}" for x in ("t", "w", "g", "p", "q", "ln"))
    out = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({w: F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)), ln: F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))})
    grams = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.expr("array()").cast("array<long>"))
    out = out.withColumns({
        g: grams,
        f"{prefix}n_words": F.size(w).cast("long"),
        f"{prefix}word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        f"{prefix}n_symbols": F.regexp_count(t, F.lit(SYMBOL)).cast("long"),
        f"{prefix}n_lines": F.size(ln).cast("long"),
        f"{prefix}n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
    }).drop(t, w, ln)
    pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    out = out.withColumn(p, F.when(F.size(F.array_distinct(g)) < F.size(g), pairs).otherwise(F.expr("array()").cast("array<struct<g:long,i:int>>")))
    again = lambda x, j: F.coalesce(F.get(p, j - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(p, j + 1)["g"] == x["g"], F.lit(False))
    out = out.withColumn(q, F.sort_array(F.transform(F.filter(p, again), lambda x: x["i"]))).drop(g, p)
    covered = F.aggregate(F.transform(q, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(q, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return out.withColumn(f"{prefix}n_repeat_words", covered.cast("long")).drop(q)


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > MAX_REPEAT_PERCENT * n)


def major_failed(prefix: str = "") -> Column:
    return F.col(f"{prefix}n_symbols") > MAX_SYMBOLS_PER_WORD * F.col(f"{prefix}n_words")


def minor_failures(prefix: str = "") -> Column:
    """How many of the minor rules a row fails."""
    m = {x: F.col(f"{prefix}{x}") for x in (*METRICS, "n_lines")}
    mean = F.try_divide(m["word_chars"], m["n_words"])
    rules = [
        (mean < MEAN_WORD_CHARS[0]) | (mean > MEAN_WORD_CHARS[1]),
        m["n_dup_lines"] > MAX_DUP_LINES * m["n_lines"],
        100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT_MINOR * m["n_words"],
    ]
    return sum((F.coalesce(r, F.lit(False)).cast("int") for r in rules[1:]), F.coalesce(rules[0], F.lit(False)).cast("int"))


def host_verdicts(rows: DataFrame, host: str, failed: Column, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host``, ``n_docs``, ``n_failed``, ``rate`` (shrunk) and ``host_bad``.

    The prior Beta(a, b) has the hosts' mean failure rate and, by the method of moments,
    their spread beyond what chance gives a host of its size; the prior's weight is kept
    between 1 and 10,000 documents. A null host is a host of its own."""
    hosts = rows.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.count_if(failed).alias("n_failed"))
    n, f = F.col("n_docs"), F.col("n_failed")
    total = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.count("*").alias("k"), F.sum(n * n).alias("n2")).first()
    mean = min(max((total["f"] or 0) / total["n"], 1e-6), 1 - 1e-6) if total["n"] else 0.5
    spread = hosts.agg(F.sum(n * F.pow(f / n - F.lit(mean), 2)).alias("s")).first()["s"] or 0.0
    weight = 1e4
    if total["n"] and total["k"] > 1 and total["n"] > total["n2"] / total["n"]:
        within = mean * (1 - mean)
        between = (spread - (total["k"] - 1) * within) / (total["n"] - total["n2"] / total["n"])
        weight = min(max(within / between - 1, 1.0), 1e4) if between > 0 else 1e4
    rate = (f + F.lit(mean * weight)) / (n + F.lit(weight))
    return hosts.withColumn("rate", rate).withColumn("host_bad", F.col("rate") > max_rate)


def prefix(columns: list[str]) -> str:
    """What the names of ``judge``'s own columns begin with: ``_q_``, or with more underscores where a column of the input does."""
    return free("_q_", columns)


def judge(docs: DataFrame, host: str = "source", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (all by default) of every row of ``docs``, with columns ``_q_*``: the
    metrics, ``_q_base_failed``, ``_q_major_failed``, ``_q_minor``, ``_q_host_rate``, ``_q_host_bad`` and ``_q_kept``.

    Whole texts are read; null or empty texts have no words and fail. Repeated rows and rows with
    null keys are judged each for itself; an empty table gives an empty one. Where columns of ``docs`` begin with ``_q_``
    the prefix is another, that of ``prefix(docs.columns)``."""
    p = prefix(docs.columns)
    ws = Workspace(docs.sparkSession, "quality")
    measured = with_metrics(docs, text, p).withColumns({f"{p}host": F.col(host), f"{p}base_failed": base_failed(p), f"{p}major_failed": major_failed(p), f"{p}minor": minor_failures(p)})
    names = [f"{p}{x}" for x in (*METRICS, "n_lines", "host", "base_failed", "major_failed", "minor")]
    measured = ws.save(measured.select(*(docs.columns if carry is None else carry), *names), "measured")
    hosts = host_verdicts(measured, f"{p}host", F.col(f"{p}base_failed") | F.col(f"{p}major_failed") | (F.col(f"{p}minor") > 0))
    # written, so that the planner knows its size: documents stay where they are if it may be broadcast
    hosts = ws.save(hosts.select(F.col("host").alias(f"{p}h"), F.col("rate").alias(f"{p}host_rate"), F.col("host_bad").alias(f"{p}host_bad")), "hosts")
    out = measured.join(hosts, F.col(f"{p}host").eqNullSafe(F.col(f"{p}h")), "left").drop(f"{p}h")
    tolerated = F.when(F.col(f"{p}host_bad"), 0).otherwise(1)
    return out.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & ~F.col(f"{p}major_failed") & (F.col(f"{p}minor") <= tolerated))
