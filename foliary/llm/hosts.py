"""Host-level quality rules: failures by host, shrunk towards an empirical beta prior.

Every document is measured alone first. The failures of each rule are then counted by host (the host
of `source` where it is an address, else `source` itself). A host's raw rate says little when it has
few documents, so it is shrunk: hosts' rates are taken as draws of one beta distribution, fitted to
all hosts by its moments, and a host's rate becomes the posterior mean (failed + a) / (documents +
a + b). Hosts whose shrunk rate of any rule is above the limit lose all their documents.

Cases: a null text has no words and fails; a null or empty `source` is one host of its own; repeated
rows count as often as they stand; an empty table gives an empty result; further columns pass through
`kept_documents` and names used inside are kept apart from them by the prefix `_hq_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.columns import let, squeezed, whole, word_list
from foliary.operators.sizing import settled

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A host is rejected when the shrunk rate of one rule is above this.
HOST_LIMIT = 0.9
RULES = ("few_words", "repeats", "symbols", "dup_lines")


def host(source: Column) -> Column:
    """Host of an address in lower case, any other value as it is; null and empty are one host."""
    found = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.when(found != "", F.lower(found)).otherwise(source), F.lit(""))


def repeated_words(words: Column) -> Column:
    """Number of words inside 3-word windows that stand twice or more in the text.

    Windows are sorted with their place; equal neighbours are the repeated ones. Their places in
    order cover three words each, less what the place before already covered.
    """
    def place(p: Column, k: Column, places: Column) -> Column:
        return F.least(F.lit(3), F.coalesce(p - F.get(places, k - 1), F.lit(3)))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
    )
    twice = let(F.sort_array(windows), lambda s: F.transform(
        F.filter(s, lambda x, j: (x["w"] == F.get(s, j - 1)["w"]) | (x["w"] == F.get(s, j + 1)["w"])), lambda x: x["i"]
    ))
    covered = let(F.sort_array(twice), lambda p: F.aggregate(
        F.transform(p, lambda x, k: place(x, k, p)), F.lit(0).cast("int"), lambda a, b: a + b
    ))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(covered).cast("long")


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of one whole text."""
    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    return let(whole(text), lambda t: let(word_list(t), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.char_length(squeezed(t)).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(F.filter(F.split(t, "\n", -1), lambda line: squeezed(line) != ""), of_lines).alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
    )))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])


def failures(m: Column) -> dict[str, Column]:
    """Whether a document fails each rule that hosts are judged by."""
    return {
        "few_words": m["n_words"] < MIN_WORDS,
        "repeats": 100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["word_chars"],
        "dup_lines": 5 * m["n_dup_lines"] > m["n_words"],
    }


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, documents, shrunk rate of each rule) from rows with `_hq_host` and `_hq_m`.

    The counts are pre-aggregated before their shuffle, so a host of any size is one row a task. They
    are written once: the prior of all hosts is one row of sums over that table.
    """
    counts = settled(measured.groupBy(F.col("_hq_host").alias("host")).agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.count_if(failed).alias(rule) for rule, failed in failures(F.col("_hq_m")).items()],
    ))
    totals = counts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("documents").alias("documents"), *[F.sum(r).alias(r) for r in RULES]
    ).first()
    if not totals["hosts"]:
        return counts.select("host", "documents", *[F.lit(0.0).alias(r) for r in RULES])
    mean = {r: totals[r] / totals["documents"] for r in RULES}
    spread = counts.agg(*[
        F.sum(F.col("documents") * (F.col(r) / F.col("documents") - mean[r]) ** 2).alias(r) for r in RULES
    ]).first()
    shrunk = []
    for rule in RULES:
        size = prior_size(mean[rule], spread[rule] / totals["documents"], totals["hosts"] / totals["documents"])
        shrunk.append(((F.col(rule) + mean[rule] * size) / (F.col("documents") + size)).alias(rule))
    return counts.select("host", "documents", *shrunk)


def prior_size(mean: float, variance: float, per_document: float) -> float:
    """a + b of the beta prior with this mean, from the weighted variance of the hosts' rates.

    The variance is that of the prior plus what drawing few documents adds, mean * (1 - mean) a
    document. Where hosts differ no more than that, the prior is as firm as a million documents.
    """
    alone = mean * (1 - mean)
    between = variance - alone * per_document
    if alone <= 0 or between <= alone * 1e-6:
        return 1e6
    return min(1e6, max(1.0, (alone - between) / between))


def rejected_hosts(rates: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Hosts (column `host`) with a shrunk rate above the limit."""
    return rates.filter(F.greatest(*[F.col(r) for r in RULES]) > limit).select("host")


def judged(documents: DataFrame, key: str = "doc_id", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: key, measures, base_failed, kept.

    The measures are written once, as they feed both the host counts and the result.
    """
    rows = settled(documents.select(
        F.col(key), host(F.col("source")).alias("_hq_host"), measures(F.col("text")).alias("_hq_m")
    ))
    bad = settled(rejected_hosts(host_rates(rows), limit)).withColumn("_hq_bad", F.lit(True))
    return rows.join(bad, rows["_hq_host"] == bad["host"], "left").select(
        key, "_hq_m.*", base_failed(F.col("_hq_m")).alias("base_failed"),
        (~base_failed(F.col("_hq_m")) & F.col("_hq_bad").isNull()).alias("kept"),
    )


def kept_documents(documents: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that pass, with their columns unchanged.

    The rows are written once with their measures, which feed the host counts and then the filter, so that
    no text is measured twice or shuffled; only the short list of rejected hosts is joined.
    """
    rows = settled(documents.withColumns({"_hq_host": host(F.col("source")), "_hq_m": measures(F.col("text"))}))
    bad = settled(rejected_hosts(host_rates(rows.select("_hq_host", "_hq_m")), limit))
    return (
        rows.filter(~base_failed(F.col("_hq_m")))
        .join(bad, rows["_hq_host"] == bad["host"], "left_anti")
        .drop("_hq_host", "_hq_m")
    )
