"""Quality rules of documents, and verdicts on whole hosts from how often their documents fail.

Every document is measured once. Failures of each rule are summed per host; the rates are shrunk towards the rate
of all hosts with a beta prior that is fitted to the hosts themselves, so that a host with few documents is judged by
little more than the prior. A host whose shrunken rate of any rule exceeds ``max_rate`` is rejected, and the verdicts
are joined back to the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import settle
from .common import WORD, keep_rows, row_key, slices, small_batches, texts_of

_WORD = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rules as conditions on the measures of a document; the first two reject the document itself.
BASE_RULES = {"few_words": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words"}
HOST_RULES = BASE_RULES | {
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}
#: A prior as strong as so many documents at most and at least.
STRENGTH = (2.0, 1e6)
#: The documents of a rejected host are spread over so many join keys.
SALTS = 16
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    code, top = ids[:n], len(number)
    for k in range(1, window):
        if top * len(number) >= 1 << 62:  # numbers of longer windows would not fit: number those found afresh
            code = np.unique(code, return_inverse=True)[1]
            top = int(code.max()) + 1
        code = code * len(number) + ids[k : k + n]
        top *= len(number)
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words), dtype=bool)
    again = counts[inverse] > 1
    for k in range(window):
        covered[k : k + n] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The counts named in ``_COUNTS``."""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), len(lines), repeated_words(words))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts = list(zip(*map(measure, texts_of(batch, "text"))))
        kept = [batch[c] for c in ("id", "host", "row_key")]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in counts)], ["id", "host", "row_key", *_COUNTS])


def measured(docs: DataFrame, row_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``id, host, row_key`` and the counts of every row; null text has no words."""
    rows = small_batches(docs).select(
        F.col(row_id).cast("long").alias("id"), F.col(host).cast("string").alias("host"),
        row_key(F.col(row_id).cast("long"), F.col(text)).alias("row_key"), F.col(text).alias("text"),
    )
    return rows.mapInArrow(_measured, "id long, host string, row_key string, " + ", ".join(f"{c} long" for c in _COUNTS))


def base_failed() -> Column:
    return F.expr(" OR ".join(f"({rule})" for rule in BASE_RULES.values()))


def host_rates(measures: DataFrame) -> DataFrame:
    """Per host and rule: ``n`` documents, failures ``f_<rule>`` and the shrunken rate ``rate_<rule>``.

    The prior comes from the moments of the hosts' rates: their mean over all documents, and their variance less the part
    that chance alone would give. One row of sums goes to the driver. Rows without a host belong to none.
    """
    hosts = measures.filter("host IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.expr(rule).cast("long")).alias(f"f_{name}") for name, rule in HOST_RULES.items())
    )
    sums = hosts.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"),
        *(F.sum(f"f_{name}").alias(f"f_{name}") for name in HOST_RULES),
        *(F.sum(F.col(f"f_{name}").cast("double") * F.col(f"f_{name}") / F.col("n")).alias(f"q_{name}") for name in HOST_RULES),
    ).first()
    if not sums["hosts"]:
        return hosts.withColumns({f"rate_{name}": F.lit(0.0) for name in HOST_RULES})
    rates = {}
    for name in HOST_RULES:
        mean = sums[f"f_{name}"] / sums["n"]
        chance = mean * (1 - mean)
        between = sums[f"q_{name}"] / sums["n"] - mean * mean - chance * sums["hosts"] / sums["n"]
        strength = min(max(chance / between - 1, STRENGTH[0]), STRENGTH[1]) if between > 0 else STRENGTH[1]
        rates[f"rate_{name}"] = (F.lit(mean * strength) + F.col(f"f_{name}")) / (F.lit(strength) + F.col("n"))
    return hosts.withColumns(rates)


def exceeds(max_rate: float) -> Column:
    return F.greatest(*(F.col(f"rate_{name}") for name in HOST_RULES)) > max_rate


def rejected_hosts(measures: DataFrame, max_rate: float = 0.5) -> DataFrame:
    return host_rates(measures).filter(exceeds(max_rate)).select("host")


def judged(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.5, rates: bool = False
) -> DataFrame:
    """One row per input row: ``doc_id``, the counts, ``base_failed, host_failed, kept`` and ``row_key``.

    A document stays if it passes the base rules and its host is not rejected; a document without a host is judged by the
    base rules alone. With ``rates`` come the shrunken failure rates of its host, ``rate_<rule>`` to six places, null
    without a host. Null and empty texts have no words and fail; a long text is measured whole, by one task. Rows that repeat
    each count. Other columns are ignored; an empty table gives none.
    """
    measures = settle(measured(docs, row_id, text, host))
    of_host = [f"rate_{name}" for name in HOST_RULES] if rates else []
    hosts = host_rates(measures).withColumn("bad", exceeds(max_rate)) if rates else rejected_hosts(measures, max_rate).withColumn("bad", F.lit(True))
    rounded = [F.round(c, 6).alias(c) for c in of_host]
    salted = hosts.select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "bad", *rounded)
    spread = measures.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int"))
    joined = spread.join(salted, ["host", "salt"], "left").withColumns(
        {"base_failed": base_failed(), "host_failed": F.coalesce("bad", F.lit(False))}
    )
    return joined.select(
        F.col("id").alias("doc_id"), *_COUNTS, "base_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), *of_host, "row_key"
    )


def passing(docs: DataFrame, row_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that stay, repeated rows included, with their columns unchanged.

    Nulls, long texts and hosts as in ``judged``. Rows that repeat id and text under several hosts stay together if one of them stays.
    """
    found = judged(docs, row_id, text, host, max_rate)
    return keep_rows(docs, row_id, text, found.filter("kept").select(F.col("row_key").alias("_key")), single=False)
