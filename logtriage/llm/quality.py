"""Quality rules: plain counts of a text, and a log-likelihood ratio of hashed n-grams.

Features of a text are its words and the pairs of neighbouring word shapes (a shape writes runs of small
letters as a, of capitals as A, digits as 0), hashed into a fixed number of buckets. Two multinomials over
the buckets are counted: one from trusted texts, one from the whole raw corpus. A text's score is the mean
logarithm of their ratio over its features, so it does not depend on its length; texts below a fixed
threshold are rejected. Everything is built from DataFrame functions; scoring needs no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtriage.llm.common import bounded_sample

BUCKETS = 1 << 14
# Mean log ratio (natural logarithm) that a text must reach.
THRESHOLD = -0.1
# Bound of the trusted sample: ids are broadcast, 8 bytes each.
MAX_TRUSTED = 100_000
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def shape_text(text: Column) -> Column:
    """The text with runs of capitals as A, of other letters as a, and digits as 0."""
    capitals = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Lu}+", "A")
    return F.translate(F.regexp_replace(capitals, r"[\p{L}&&[^\p{Lu}]]+", "a"), "123456789", "000000000")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def features(hashes: Column, shapes: Column) -> Column:
    """Hashes of a text's words, as given, and of pairs of shapes; the last shape pairs with the end."""
    return F.concat(hashes, F.zip_with(shapes, F.slice(shapes, F.lit(2), F.greatest(F.size(shapes), F.lit(1))), lambda a, b: F.xxhash64(a, b, F.lit(1))))


def bucket_of(feature: Column) -> Column:
    return F.pmod(feature, F.lit(BUCKETS)).cast("int")


def trusted_ids(labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """Ids that all their labels call good, at most about so many."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_trusted")).agg(F.min("quality").alias("_q"))
    return bounded_sample(known.where("_q = 1").select("_trusted"), most)


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """Log of trusted over raw share by bucket, each count raised by one; all zero without trusted texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), hashes_of(words_of(F.col("text"))).alias("_hashes"), words_of(shape_text(F.col("text"))).alias("_shapes"))
    rows = rows.join(F.broadcast(trusted), F.col("_id") == F.col("_trusted"), "left")
    rows = rows.select(F.explode(features(F.col("_hashes"), F.col("_shapes"))).alias("_feature"), F.col("_trusted").isNotNull().cast("long").alias("_good"))
    buckets = rows.select(bucket_of(F.col("_feature")).alias("_bucket"), "_good")
    counts = {r[0]: (r[1], r[2]) for r in buckets.groupBy("_bucket").agg(F.sum("_good"), F.count("*")).collect()}
    good, raw = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not good:
        return [0.0] * BUCKETS
    share = math.log((raw + BUCKETS) / (good + BUCKETS))
    return [math.log((counts.get(b, (0, 0))[0] + 1) / (counts.get(b, (0, 0))[1] + 1)) + share for b in range(BUCKETS)]


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once: an optimizer may copy a column into the function that reads it element by element, but not this."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeated(hashes: Column) -> Column:
    """Words inside windows that are found twice or more, from the words' hashes; only texts with such windows are sorted by window hash.

    A window's hash is made from those of its halves, so that no word is read once for each window it stands in.
    """

    def marked(ordered: Column, hashes: Column) -> Column:
        again = F.filter(ordered, lambda x, i: (x["h"] == F.get(hashes, i - 1)) | (x["h"] == F.get(hashes, i + 1)))
        return _covered(F.sort_array(F.transform(again, lambda x: x["i"])))

    def counted(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = _let(placed, lambda ordered: _let(F.transform(ordered, lambda x: x["h"]), lambda hashes: marked(ordered, hashes)))
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), found).otherwise(F.lit(0).cast("long"))

    def doubled(grams: Column, half: int) -> Column:
        """Hashes of runs of twice `half` words from those of `half`."""
        if half == REPEAT_WINDOW:
            return counted(grams)
        longer = F.transform(F.slice(grams, F.lit(1), F.size(grams) - half), lambda h, i: F.xxhash64(h, F.get(grams, i + half)))
        return _let(longer, lambda found: doubled(found, 2 * half))

    return F.when(F.size(hashes) < REPEAT_WINDOW, F.lit(0).cast("long")).otherwise(doubled(hashes, 1))


def _covered(positions: Column) -> Column:
    """Words inside windows that begin at these ascending positions."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("int").alias("reach"))
    step = lambda acc, p: F.struct((acc["n"] + p + REPEAT_WINDOW - F.greatest(p, acc["reach"])).cast("long").alias("n"), (p + REPEAT_WINDOW).cast("int").alias("reach"))
    return F.aggregate(positions, start, step, lambda acc: acc["n"])


def judged(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, name: str = "_quality") -> DataFrame:
    """docs with a struct column `name`: the counts, score, base_failed and kept.

    Null texts count as empty: no words, score 0, failed by the base rule. Every row is judged by itself,
    so repeated rows and ids do not matter, and other columns of docs stay as they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    table = F.split(F.lit(",".join(f"{r:.6f}" for r in ratios)), ",").cast("array<double>")
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(_WORD)))

    def counted(words: Column, hashes: Column, shapes: Column, lines: Column) -> Column:
        total = F.aggregate(features(hashes, shapes), F.lit(0.0), lambda acc, f: acc + F.get(table, bucket_of(f)))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated(hashes).alias("n_repeat_words"),
            (total / F.greatest(F.size(words) + F.size(shapes), F.lit(1))).alias("score"),
        )

    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEAT_PERCENT)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")
        return F.struct(*(c[name].alias(name) for name in names), failed.alias("base_failed"), (~failed & (c["score"] >= threshold)).alias("kept"))

    found = _let(words_of(text), lambda w: _let(words_of(shape_text(text)), lambda s: _let(lines, lambda t: _let(hashes_of(w), lambda h: _let(counted(w, h, s, t), verdict)))))
    return docs.withColumn(name, found)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, name: str = "_quality") -> DataFrame:
    """Count both multinomials over the whole table, then judge every document; see `judged`."""
    return judged(docs, log_ratios(docs, trusted_ids(labels)), threshold, name)
