"""Quality rules with host verdicts, in DataFrame functions only.

Every text gets counts of words, symbols, repeated lines and words in repeated three-word windows, and a base
verdict. Failures are added up per host; a beta prior, fitted to the failure rates of all hosts by their mean and
spread, shrinks the rate of each host towards the corpus; a host whose shrunk rate is over ``HOST_LIMIT`` loses
all its documents.

A text is read once and never exploded: its windows are an array of hashes, sorted within the row. Per host only
two sums are shuffled, added up before the shuffle, so a host with a third of all rows costs as much as any other.

Defined results: a null or empty text has no words and fails. A row without a host (null) has no host verdict and
is judged by its own counts. Repeated rows count as often as they come. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylog.session import materialise

SPACES = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Verdicts up to about this size are broadcast.
BROADCAST_BYTES = 32 << 20
MIN_WORDS = 50
REPEAT_PERCENT = 50
HOST_LIMIT = 0.5


def counted(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id, host`` and the five counts of every row.

    Each step is a projection of its own, so that no array is computed twice.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.col(host).alias("host"),
        F.char_length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("_lines"),
        F.array_remove(F.split(text, SPLIT), "").alias("_words"),
    )
    rows = rows.select(
        "doc_id", "host", "word_chars", "n_symbols",
        F.size("_words").cast("bigint").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(WINDOWS).alias("_windows"),
    )
    rows = rows.withColumn("_some", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    rows = rows.withColumn("_sorted", F.expr(SORTED)).withColumn("_places", F.expr(PLACES))
    return rows.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.expr(COVERED).cast("bigint").alias("n_repeat_words"),
    )


# A hash of every window of three words.
WINDOWS = """
    if(size(_words) < 3, cast(array() as array<bigint>),
       transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))
"""
# Hashes with their places, in the order of the hashes; nothing where all windows differ.
SORTED = """
    if(_some, sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'i', i))),
       cast(array() as array<struct<h: bigint, i: int>>))
"""
# Places of the windows that have an equal one: equal ones are neighbours now.
PLACES = """
    sort_array(filter(
        transform(_sorted, (x, k) -> if(_sorted[k].h <=> get(_sorted, k - 1).h or _sorted[k].h <=> get(_sorted, k + 1).h, x.i, null)),
        i -> i is not null))
"""
# Each place covers three words, less those that the place before covers.
COVERED = """
    aggregate(_places, named_struct('last', -3, 'n', 0),
        (s, i) -> named_struct('last', i, 'n', s.n + least(3, i - s.last)), s -> s.n)
"""


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def host_rates(rows: DataFrame) -> DataFrame:
    """``host, n, failed``: documents and base failures of every host."""
    return (
        rows.filter(F.col("host").isNotNull()).groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    )


def beta_prior(rates: DataFrame) -> tuple[float, float]:
    """Prior failures and passes, from the mean and the variance of the rates of all hosts.

    The strength of the prior stays between 1 and a million documents; one host, or hosts with equal rates, get
    the strongest.
    """
    rate = F.col("failed") / F.col("n")
    row = rates.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var")).first()
    mean, var = row["mean"] or 0.0, row["var"] or 0.0
    strength = mean * (1 - mean) / var - 1 if var > 0 else 1e6
    strength = min(max(strength, 1.0), 1e6)
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The counts, ``base_failed``, the host's shrunk failure rate and ``kept`` of every row.

    The counts are written once, as the host rates and the join read them.
    """
    rows = materialise(counted(docs, host).withColumn("base_failed", base_failed()), "host-rules")
    rates = materialise(host_rates(rows), "host-rates")
    failed, passed = beta_prior(rates)
    shrunk = (F.col("failed") + F.lit(failed)) / (F.col("n") + F.lit(failed + passed))
    verdicts = rates.select("host", shrunk.alias("host_rate"))
    if (rates.agg(F.sum(F.octet_length("host") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        # Beyond it the hosts are joined by shuffle, where adaptive execution splits a large one.
        verdicts = F.broadcast(verdicts)
    return rows.join(verdicts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate",
        (~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= host_limit)).alias("kept"),
    )
