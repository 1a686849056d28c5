"""Filter interaction audit: what each of five filters removes in every order in which they can be applied.

What a text fails on its own account (length, variety, capitals, symbols) is known in the scan. Whether
it repeats a text of a smaller id takes all texts, but most of them needn't move: a counting Bloom sketch
comes first. Each text adds one to a few counters of a block that its hash names; partial counts merge by
addition. A text that finds a counter at one is the only one that ever touched it, so it is unique for
certain. Only the others, the possible repeats, are shuffled by their full text for the exact smallest id.

A document's failures are then a mask of five bits, and counts of masks are additive: 32 masks a part say
everything about all 120 orders.
"""

from __future__ import annotations

import re
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WORD, cut, text_of

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
SYMBOLS = "#$%&*|"
#: Counters a block: those of one bitmap of Spark's bitmap functions.
BLOCK = 32_768
COUNTERS_A_TEXT, TOUCHED = 16, 4
#: A merged sketch of up to so many bytes (32 million texts) is broadcast; a larger one is joined by its blocks.
BROADCAST = 64 << 20


def fails_alone(text: Column) -> Column:
    """The bits of A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    tests = [n < 200, different * 100 < n * 50, capitals.cast("long") * 100 > F.length(text).cast("long") * 3, text.rlike(f"[{re.escape(SYMBOLS)}]")]
    return sum((F.when(failed, 1 << bit).otherwise(0) for bit, failed in enumerate(tests)), F.lit(0))


def _touched(text: Column, blocks: int) -> tuple[Column, Column]:
    """(block, places in it) of a text: two independent hashes."""
    spread = F.xxhash64(F.lit(1), text)
    places = F.array_distinct(F.array(*(F.shiftrightunsigned(spread, 15 * i).bitwiseAND(F.lit(BLOCK - 1)) for i in range(TOUCHED))))
    return F.pmod(F.xxhash64(text), F.lit(blocks)), places


def merged_sketch(texts: DataFrame, blocks: int) -> DataFrame:
    """(block, shared): the merged counters as a bitmap a block, with a bit for each counter above one. Bounded by 4096 bytes a block."""
    block, places = _touched(F.col("text"), blocks)
    counters = texts.select(block.alias("block"), F.explode(places).alias("place")).groupBy("block", "place").agg(F.count(F.lit(1)).alias("n"))
    return counters.filter("n > 1").groupBy("block").agg(F.bitmap_construct_agg("place").alias("shared"))


def _set(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1


def with_suspicion(texts: DataFrame, sketch: DataFrame, blocks: int, most: int = BROADCAST) -> DataFrame:
    """Adds `suspect`: false for texts that the sketch shows to be unique."""
    block, places = _touched(F.col("text"), blocks)
    # No bitmap: none of the block's counters is above one.
    suspect = F.coalesce(F.forall(places, lambda p: _set(F.col("shared"), p)), F.lit(False))
    if blocks * (BLOCK // 8) <= most:
        return texts.withColumn("block", block).join(F.broadcast(sketch), "block", "left").withColumn("suspect", suspect).drop("block", "shared")
    # Too large to broadcast: only hashes meet the blocks, and the texts then meet the hashes of suspects, of which there are few.
    hashes = texts.select(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("spread"), places.alias("places"), block.alias("block")).distinct()
    found = hashes.join(sketch, "block").filter(F.forall("places", lambda p: _set(F.col("shared"), p))).select("h", "spread", F.lit(True).alias("hit"))
    keyed = texts.withColumns({"h": F.xxhash64("text"), "spread": F.xxhash64(F.lit(1), F.col("text"))})
    return keyed.join(found, ["h", "spread"], "left").withColumn("suspect", F.coalesce("hit", F.lit(False))).drop("h", "spread", "hit")


def with_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = BROADCAST) -> DataFrame:
    """(doc_id, part, mask) of every row: bit 0 for A to bit 4 for E."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    blocks = max(1, -(-docs.count() * COUNTERS_A_TEXT // BLOCK))
    told = with_suspicion(texts, cut(merged_sketch(texts, blocks)), blocks, most)
    unique = told.filter(~F.col("suspect")).select("doc_id", "part", fails_alone(F.col("text")).alias("mask"))
    # Partial minima first, so a text that a third of all rows share is a row a task. The digest gives the smallest ids an
    # exchange of their own: only then does adaptive execution split such a text's rows in the join.
    repeats = told.filter("suspect").select("doc_id", "part", "text")
    smallest = repeats.groupBy("text").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    digest = F.xxhash64("text").alias("digest")
    later = F.when(F.col("doc_id") > F.col("smallest"), 16).otherwise(0)
    found = repeats.select("*", digest).join(smallest.select("text", "smallest", digest), ["text", "digest"], "left")
    return unique.unionByName(found.select("doc_id", "part", (fails_alone(F.col("text")) + later).alias("mask")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = BROADCAST) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    A part is a value of `lang_col`; null is the empty string, and so is an empty value. A null text is
    empty, so it fails A, and E where another empty one has a smaller id. Rows with a null id and rows
    repeated with one id have no smaller one among themselves, so none of them fails E for the others.
    A document is good (toxic) if any row of `labels` with its id says so; ids that are null have none.
    Other columns are ignored, so their names can't clash. Without documents there is no part.
    """
    masks = with_masks(docs, id_col, text_col, lang_col, most)
    says = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    one = masks.join(says, "doc_id", "left")
    sums = one.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return in_every_order(cut(sums))


def in_every_order(sums: DataFrame) -> DataFrame:
    """The 600 rows a part from (part, mask, n, good, toxic), at most 32 rows a part."""
    order = F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")
    steps = sums.select("*", order).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    bit = F.expr(f"shiftleft(1, ascii(substr(filter_order, step, 1)) - {ord('A')})")
    earlier = F.expr(f"aggregate(sequence(1, 5), 0, (s, i) -> s + if(i < step, shiftleft(1, ascii(substr(filter_order, i, 1)) - {ord('A')}), 0))")
    fails, before = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    # A document with s failures is removed by each of them in 120 / s of the orders.
    share = F.when(fails, F.col("n") * (F.lit(len(ORDERS)) / F.bit_count("mask")).cast("int")).otherwise(0)
    return (
        steps.withColumns({"bit": bit, "earlier": earlier})
        .groupBy("part", "filter_order", "step")
        .agg(
            count(~fails & ~before).alias("kept"), count(fails & ~before).alias("removed"), count(fails & before).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails"),
            count(fails & ~before, "good").alias("good_lost"), count(fails & ~before, "toxic").alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"),
        )
    )
