"""Entity names as word graphs and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bracketed(name: Column) -> tuple[Column, Column, Column]:
    """(has both brackets, text before the first, text up to the first closing one)."""
    has = F.contains(name, F.lit("(")) & F.contains(name, F.lit(")"))
    start, end = F.instr(name, "("), F.instr(name, ")")
    return has, F.trim(F.substr(name, F.lit(1), start - 1)), F.substr(name, start + 1, F.greatest(end - start - 1, F.lit(0)))


def word_edges(entities: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """(id, role, word): ``A (B)`` gives A in role 0 and B in role 1; a plain name itself in role 2."""
    has, outer, inner = _bracketed(F.col(name_col))
    one = lambda role, word: F.struct(F.lit(role).alias("role"), word.alias("word"))
    both = F.when(has, F.array(one(0, outer), one(1, inner))).otherwise(F.array(one(2, F.col(name_col))))
    return entities.select(F.col(id_col).alias("id"), F.explode(both).alias("e")).select("id", "e.role", "e.word")


def typed_word_edges(entities: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """(id, role, word) of ``Name (place@type)``: words of the place in role 0, of the type in role 1, the name in role 2."""
    has, outer, inner = _bracketed(F.col(name_col))
    words = lambda role, text: F.transform(F.filter(F.split(F.trim(text), " "), lambda w: w != ""), lambda w: F.struct(F.lit(role).alias("role"), w.alias("word")))
    place, kind = F.split_part(inner, F.lit("@"), F.lit(1)), F.split_part(inner, F.lit("@"), F.lit(2))
    name = lambda c: F.array(F.struct(F.lit(2).alias("role"), c.alias("word")))
    edges = F.when(has, F.concat(words(0, place), words(1, kind), name(outer))).otherwise(name(F.col(name_col)))
    return entities.select(F.col(id_col).alias("id"), F.explode(edges).alias("e")).select("id", "e.role", "e.word")


def word_ids(edges: DataFrame) -> DataFrame:
    """(word, word_id): dense ids by the words' order; words are counted in blocks of their first letters, then ids are offset."""
    words = edges.select("word").distinct().withColumn("block_", F.substring("word", 1, 2))
    ahead = words.groupBy("block_").agg(F.count("*").alias("n")).withColumn("ahead_", F.coalesce(F.sum("n").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("block_").orderBy("word"))
    return words.withColumn("in_", own).join(ahead, "block_").select("word", (F.col("ahead_") + F.col("in_") - 1).alias("word_id"))


def word_graph(edges: DataFrame) -> DataFrame:
    """(id, role, word_id)."""
    return edges.join(word_ids(edges), "word").select("id", "role", "word_id")


def word_statistics(entities: DataFrame, name_col: str = "name") -> DataFrame:
    """Words, entities, share of names with brackets, and of those the share whose inner part is no name itself."""
    has, _, inner = _bracketed(F.col(name_col))
    named = entities.select(F.col(name_col).alias("name"), has.alias("has"), F.when(has, inner).alias("inner"))
    known = named.select(F.col("name").alias("inner"), F.lit(1).alias("known")).distinct()
    stats = named.join(known, "inner", "left").agg(F.count("*").alias("entities"), F.count_if("has").alias("n"), F.count_if(F.col("has") & F.col("known").isNull()).alias("missing"))
    words = word_edges(entities.withColumn("id_", F.lit(0)), "id_", name_col).agg(F.countDistinct("word").alias("words"))
    return stats.crossJoin(words).select(  # one row each
        "words", "entities", F.coalesce(F.try_divide("n", "entities"), F.lit(0.0)).alias("bracketed"), F.coalesce(F.try_divide("missing", "n"), F.lit(0.0)).alias("missing")
    )


def with_names(rows: DataFrame, dictionary: DataFrame, id_col: str, name_col: str = "name") -> DataFrame:
    """``rows`` with the dictionary's name of an id, null where it has none; Spark broadcasts the dictionary while it is small."""
    names = dictionary.select(F.col("id").cast("long").alias("id_"), F.col("name").alias(name_col))
    return rows.join(names, F.col(id_col) == F.col("id_"), "left").drop("id_")
