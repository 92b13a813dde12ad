"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within its source the keys are ordered: their leading hex digits split the key range
into fixed buckets, so that a hot source is spread over many tasks. Bucket totals give each bucket its distributed prefix
sum, a window inside the bucket gives each document its own, and the source is cut at its exact budget of words.
Budgets above the source's size repeat whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuetime.llm.common import SPACE, WORD, met, own_rows, stored


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _name(source: Column) -> Column:
    """A key that keeps a null source apart from every text."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def source_targets(totals: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target of each source: ``share`` of all words by weight, at most ``cap`` times the source, the excess reshared.

    ``totals``: one row per source (source, source_size). Weights repeat over the sources by code point, null last.
    The sources are ordered in one task: they are names, a few million of them at most, never documents.
    Filling by weight with caps ends where every uncapped source has the same words per weight. In ascending order of
    cap / weight the capped sources come first, so that one pass of running sums finds them. Returns source, source_size, target.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    weighed = totals.withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    levels = (
        weighed.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_weights", F.sum("_weight").over(whole))
        .withColumn("_caps_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights_before", F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_full", (F.col("_all") - F.col("_caps_before")) / (F.col("_weights") - F.col("_weights_before")) > F.col("_ratio"))
    )
    left = F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(whole)
    open_weight = F.col("_weights") - F.sum(F.when(F.col("_full"), F.col("_weight")).otherwise(0.0)).over(whole)
    return levels.withColumn("_level", F.try_divide(left, open_weight)).select(
        "source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_level") * F.col("_weight")).alias("target")
    )


def mix_sources(
    docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", digits: int = 3
) -> DataFrame:
    """Words that the mix takes of each document: one row per row of ``docs``.

    Columns read: doc_id, text, source; others are ignored. Returns doc_id, source, size, source_size, target, taken.
    The document at a source's cut gives part of its words, so that the source's sum is floor(target).
    ``digits`` sets 16**digits key buckets per source. Null or blank texts have size 0 and give nothing; a null source is a
    source of its own; repeated rows are separate documents; ties of the key fall to doc_id, then size and a hash of the text, so that
    reruns cut the same document; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"))
    return _placed(stored(rows, "sizes"), weights, share, cap, seed, digits).select("doc_id", "source", "size", "source_size", "target", "taken")


def _placed(sized: DataFrame, weights, share: float, cap: float, seed: str, digits: int) -> DataFrame:
    """``sized`` (stored: doc_id, source, size, _tie) with source_size, target and taken."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = sized.withColumn("_source", _name(F.col("source"))).withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    buckets = sized.groupBy("_source", "_bucket").agg(F.first("source").alias("source"), F.sum("size").alias("_words"))
    targets = source_targets(buckets.groupBy("_source").agg(F.first("source").alias("source"), F.sum("_words").alias("source_size")), weights, share, cap)
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = buckets.select("_source", "_bucket", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_bucket_start")).join(
        targets.select(_name(F.col("source")).alias("_source"), "source_size", "target"), "_source"
    )
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = F.floor("target").cast("long") - F.col("_epochs") * F.col("source_size") - F.col("_bucket_start") - F.col("_within")
    return (
        met(sized.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0))), cuts.withColumn("_epochs", epochs), ["_source", "_bucket"])
        .withColumn("target", F.col("target").cast("double"))
        .withColumn("taken", (F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long"))
    )


def mixed_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", digits: int = 3) -> DataFrame:
    """The mix itself, with the columns of ``docs``: every document as often as it is taken.

    A document with taken = q * size + r comes q times whole and, if r > 0, once more with its first r words (their spacing
    kept; n_chars, if there, counts what is left). At most one document of a source is cut. Documents without words have
    nothing to give and are left out; an empty table gives no rows. Rows are decided one by one, also without doc_id, under a
    shared doc_id or repeated, and columns of any name are carried.
    """
    own = own_rows(docs, "mix-rows", _size=word_count(F.col("text")), _hash=F.xxhash64("text"))
    doc_id, source, text = (F.col(own.names[c]) for c in ("doc_id", "source", "text"))
    sized = own.table.select(doc_id.alias("doc_id"), source.alias("source"), F.col("_size").alias("size"), F.col("_hash").alias("_tie"), F.col("_row").alias("_number"))
    taken = _placed(sized, weights, share, cap, seed, digits).where("taken > 0").select(F.col("_number").alias("_row"), F.col("taken").alias("_taken"))
    whole, rest = F.expr("_taken div _size"), F.col("_taken") % F.col("_size")
    pieces = F.split(text, f"(?<=[^\\x20\\x09-\\x0D])(?={SPACE})")
    cut = (F.col("_copy") > whole) & (rest > 0)
    out = (
        own.table.join(taken.hint("shuffle_hash"), "_row")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), (whole + (rest > 0).cast("int")).cast("int"))))
        .withColumn(own.names["text"], F.when(cut, F.array_join(F.slice(pieces, F.lit(1), rest.cast("int")), "")).otherwise(text))
    )
    if "n_chars" in own.names:
        n = own.names["n_chars"]
        out = out.withColumn(n, F.when(cut, F.length(own.names["text"]).cast(dict(own.table.dtypes)[n])).otherwise(F.col(n)))
    return own.named(out)
