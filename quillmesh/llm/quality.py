"""Quality rules at host level: failures of document rules by host, rates shrunk by a beta prior, verdicts joined back.

Several rules on a document feed its host's failures; only the base rules reject a document by itself. A host is rejected,
with all its documents, where its posterior rate surely stands out from the rate of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_value, chunks, small_batches
from .store import maybe_broadcast, materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rules that only feed the host's failures, with the limits that published filters of web text use: more than one symbol for
#: so many words, words shorter or longer than this on average, and a repeated line for fewer words than this.
WORDS_A_SYMBOL = 10
SHORT_WORD, LONG_WORD = 3, 10
WORDS_A_DUP_LINE = 20
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: A host is rejected if its rate is over that of all documents by more than MARGIN with a probability of 0.999: SURE
#: standard deviations of its posterior lie above.
MARGIN, SURE = 0.2, 3.09
#: Strength, in documents, of the prior where hosts do not differ or there are too few to tell.
DEFAULT_STRENGTH = 20.0

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text; null has no words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # splits bytes at the six ASCII spaces only
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(SPACE):
                seen.add(line)
    repeat = 0
    if n > 3:
        index = {}
        k = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
        m = len(index)
        pair = k[:-1] * m + k[1:]
        if m >= 2_000_000:  # three numbers no longer fit in 63 bits
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        windows = pair[:-1] * m + k[2:]
        order = np.argsort(windows)
        s = windows[order]
        same = s[1:] == s[:-1]
        if same.any():
            again = np.zeros(n - 2, bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            hit = np.zeros(n, bool)
            for j in range(3):
                hit[j : n - 2 + j] |= again
            repeat = int(hit.sum())
    return n, chars, symbols, dup, repeat


def count_batches(batches):
    for batch in batches:
        for part in chunks(batch, "text"):
            got = np.array([counts(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()], dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "text"], *[pa.array(got[:, j]) for j in range(5)]], names=[*[n for n in part.schema.names if n != "text"], *[c.split()[0] for c in COUNTS.split(", ")]])


def base_failed():
    """The rules that reject a document by itself."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_failed():
    """Whether any rule that feeds the host's failures is broken."""
    n, chars = F.col("n_words"), F.col("word_chars")
    length = (chars < SHORT_WORD * n) | (chars > LONG_WORD * n)
    return base_failed() | (WORDS_A_SYMBOL * F.col("n_symbols") > n) | length | (WORDS_A_DUP_LINE * F.col("n_dup_lines") > n)


def host_rates(docs: DataFrame, host: str = "host", failed: str = "failed") -> DataFrame:
    """host, n, n_failed, rate (the failure rate shrunk towards the mean of hosts by a beta prior fitted to their moments),
    its posterior's standard deviation (spread), the mean, and whether the host stands out.

    The prior's mean is the overall rate, its strength follows from how much host rates vary beyond binomial noise. The
    posterior's tail is taken as a normal one.
    Rows without a host belong to none. No rows give no rows.
    """
    by = docs.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    p = F.sum("n_failed") / F.sum("n")
    m = by.agg(
        p.alias("mean"),
        F.count("*").alias("hosts"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n")).alias("second"),
    )
    # between-host variance by the method of moments: weighted sum of squares less what binomial noise explains
    q = F.col("second") - F.col("mean") * F.col("mean") * F.col("total")
    noise = F.col("mean") * (1 - F.col("mean"))
    weight = F.col("total") - F.col("squares") / F.col("total")
    between = F.when(weight > 0, (q - (F.col("hosts") - 1) * noise) / weight)
    strength = F.when((between > 0) & (noise > between), noise / between - 1).otherwise(F.lit(DEFAULT_STRENGTH))
    prior = m.select(F.coalesce("mean", F.lit(0.0)).alias("_mean"), F.greatest(strength, F.lit(1.0)).alias("_strength"))
    # the prior is one row, so each host meets one row
    weight = F.col("n") + F.col("_strength")
    rate = (F.col("n_failed") + F.col("_mean") * F.col("_strength")) / weight
    rated = by.join(F.broadcast(prior)).select(host, "n", "n_failed", rate.alias("rate"), F.sqrt(rate * (1 - rate) / (weight + 1)).alias("spread"), F.col("_mean").alias("mean"))
    return rated.withColumn("stands_out", F.col("rate") - SURE * F.col("spread") > F.col("mean") + MARGIN)


def judge_documents(docs: DataFrame) -> DataFrame:
    """Counts, rule failures, the host's rate and the verdict for each document; `source` is the host.

    rule_failed feeds the hosts' rates; a document goes by base_failed or with its host. A document without a host is judged
    by itself only. Empty and null texts have no words and fail. Repeated rows are judged each; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = f"doc_id long, host string, {COUNTS}"
    got = docs.select("doc_id", F.col("source").alias("host"), "text").mapInArrow(count_batches, schema)
    got = materialise(got.withColumn("base_failed", base_failed()).withColumn("rule_failed", rule_failed()), "quality")  # a few numbers a document, used twice
    bad = host_rates(got, failed="rule_failed").where("stands_out").select(F.col("host").alias("_bad"), F.col("rate").alias("host_rate"))
    out = got.join(maybe_broadcast(bad), F.col("host") == F.col("_bad"), "left")
    return out.withColumn("host_failed", F.col("_bad").isNotNull()).withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("_bad")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns.

    The text stays where it is: rules run where documents are read, and rejected hosts are a small table.
    """
    small_batches(docs.sparkSession)
    got = docs.select("doc_id", F.col("source").alias("host"), "text").mapInArrow(count_batches, f"doc_id long, host string, {COUNTS}")
    bad = host_rates(got.withColumn("failed", rule_failed())).where("stands_out").select(F.col("host").alias("_qm_bad"))
    passed = docs.withColumn("_qm_keep", passes(F.col("text"))).where("_qm_keep").drop("_qm_keep")
    return passed.join(maybe_broadcast(materialise(bad, "hosts")), F.col("source") == F.col("_qm_bad"), "left_anti")


def passes(text):
    """The rules that reject a document by itself, as a vectorised column."""

    @F.arrow_udf("boolean")
    def run(t: pa.Array) -> pa.Array:
        got = [counts(x) for x in t.to_pylist()]
        return pa.array([not (g[0] < MIN_WORDS or 100 * g[4] > MAX_REPEAT_PERCENT * g[0]) for g in got], pa.bool_())

    return run(text)


by_value(__name__)
