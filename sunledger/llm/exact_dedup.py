"""Exact deduplication by content-defined chunk recipes, with built-in functions only.

A text is cut where its own letters say so (never at fixed offsets), so passages that documents
share mostly become the same chunks. Each distinct chunk moves through one shuffle, once per task
that holds it; after that a document is represented by its recipe, the ordered list of its chunk
identifiers, and only recipes are compared. Long documents are never moved or compared again.

An identifier is a 128-bit digest (two XXH64 values of different seeds). The chunk store verifies
it: identifiers that stand for more than one chunk are found by comparing the chunks themselves,
and in recipes such a chunk is spelled out, so a clash can never merge two documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import as_row, cut, lower_ascii, quoted, row_again, text_of


def _some(low: int, high: int, step: int, width: int) -> str:
    """A character class: the first `width` code points of every `step` from low to high."""
    return "".join(f"\\u{a:04x}-\\u{a + width - 1:04x}" for a in range(low, high, step))


#: Where a chunk may end. In Latin prose after vowel + one of "ndrst" + separator; in codes and numbers after some digits before a letter; in
#: other alphabets after an eighth of the letters before a separator; in scripts without spaces after a 32nd of the characters.
CUTS = rf"[aeiou][ndrst][ ,.\n]|[048][A-Za-z]|(?=[^\x00-\x7f])(?:[{_some(0x370, 0x1100, 64, 8)}][\s\p{{P}}]|[{_some(0x3040, 0xD7A0, 1024, 32)}])"
#: At least 400 characters, then up to the next place to cut; at most 4096.
CHUNK = rf"(?s).{{400,4096}}?(?:{CUTS}|\z)|.{{1,4096}}"


def chunks_of(text: Column, pattern: str = CHUNK) -> Column:
    """The content-defined chunks of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(1), chunk).alias("b"))


def chunk_store(texts: DataFrame, pattern: str = CHUNK) -> DataFrame:
    """(a, b, chunk, copies): every distinct chunk of the column `text`, once."""
    pieces = texts.select(F.explode(chunks_of(F.col("text"), pattern)).alias("chunk"))
    keyed = pieces.select(identifier(F.col("chunk")).alias("id"), "chunk")
    return keyed.groupBy("id.a", "id.b", "chunk").agg(F.count(F.lit(1)).alias("copies"))


def clashes(store: DataFrame) -> DataFrame:
    """Identifiers that stand for several different chunks: none, for practical purposes."""
    return store.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b")


def spelled_recipes(texts: DataFrame, bad: DataFrame, pattern: str = CHUNK) -> DataFrame:
    """(doc_id, text_sha256, recipe) where chunks whose identifiers clash are spelled out. Only texts that hold such a chunk move."""
    pieces = texts.select("text", F.posexplode(chunks_of(F.col("text"), pattern)).alias("at", "chunk")).withColumn("id", identifier(F.col("chunk")))
    hits = pieces.join(bad.select(F.struct("a", "b").alias("id")), "id", "left_semi").distinct()
    spelled = hits.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("at", "chunk"))).alias("spelled"))
    entry = F.transform(chunks_of(F.col("text"), pattern), lambda chunk, i: F.struct(identifier(chunk).alias("id"), F.try_element_at("spelled", i).alias("chunk")))
    return texts.join(spelled, "text", "left").select("doc_id", F.sha2("text", 256).alias("text_sha256"), entry.alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = CHUNK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for every row of `docs`.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id stays.
    Null texts count as empty; empty texts equal each other (their recipe is the empty list). Rows
    with a null id take part, and their id counts as smallest. Of rows repeated with the same id
    exactly one is kept. Columns other than the id and the text are ignored, so their names can't
    clash. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(text_of(text_col)).alias("text"))
    sha = F.sha2("text", 256).alias("text_sha256")
    # Stored, some 16 bytes a chunk: what follows reads recipes, not texts.
    recipes = cut(texts.select("doc_id", sha, F.transform(chunks_of(F.col("text"), pattern), identifier).alias("recipe")))
    bad = cut(clashes(chunk_store(texts, pattern)))
    if not bad.isEmpty():
        recipes = spelled_recipes(texts, bad, pattern)
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # The second join key gives the groups an exchange of their own: only then does adaptive execution split a recipe that a third of all rows share.
    digest = F.xxhash64("recipe").alias("digest")
    rows = recipes.select("*", digest).join(groups.select("*", digest), ["recipe", "digest"])
    turn = F.row_number().over(W.partitionBy("doc_id", "keep_id", "text_sha256").orderBy("group_size"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (turn == 1)).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Of rows with one id and text, the one whose columns come first as JSON stays."""
    # Plain equality, not that of nulls, so that the join's partitioning serves the window too and texts move once.
    found = exact_dedup(docs, id_col, text_col).filter("kept").select(name_of("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    own = docs.select(as_row(docs).alias("row"), name_of(id_col).alias("id"), F.sha2(lower_ascii(text_of(text_col)), 256).alias("sha"))
    return first_of(own.join(found, ["sha", "id"], "left_semi"), docs, text_col)


def name_of(id_col: str) -> Column:
    """An id as text that is never null; that of a null id differs from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))


def first_of(rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Of rows (row, id, sha) one an id and sha, with the columns of `docs`: that whose other columns, then whose text, come first. Ties are equal rows."""
    others = F.to_json(F.struct(*(x for c, x in zip(docs.columns, row_again(docs)) if c != text_col)))
    turn = F.row_number().over(W.partitionBy("sha", "id").orderBy(others, F.sha2(text_of(F.col(f"row.{quoted(text_col)}")), 256)))
    return rows.withColumn("turn", turn).filter("turn = 1").select(*row_again(docs))
