"""Query refinement: spelling and synonyms from supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_WORDS, MIN_LETTERS = 64, 3


def refine_tokens(text: Column) -> Column:
    """The first 64 letter words of a query; digits and other signs are lost, a curly apostrophe becomes straight."""
    return F.slice(F.coalesce(F.regexp_extract_all(F.translate(text, "’", "'"), F.lit("([A-Za-z']+)"), F.lit(1)), F.array().cast("array<string>")), 1, MAX_WORDS)


def is_entity(word: Column, position: Column) -> Column:
    """Words left alone: with an apostrophe, all capitals, a capital inside, or a capital not at the start of the query."""
    return (
        F.contains(word, F.lit("'"))
        | word.rlike("^[A-Z]{2,}$")
        | F.substring(word, 2, 1000).rlike("[A-Z]")
        | (word.rlike("^[A-Z]") & (position > 0))
    )


def near_distance(a: Column, b: Column) -> Column:
    """Edit distance in which exchanging two neighbours is one step, if it is at most 2, else null; in the JVM.

    An exchange is two ordinary edits, so only pairs at an ordinary distance of up to 4 can be near. Where words of one length differ in two places, an exchange shows as
    the same two letters in turn; two steps of which one is an exchange are tried on each word with two neighbours exchanged.
    """
    far = F.levenshtein(a, b, 4)
    swaps = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.lit(1 << 20))),
    )
    swapped = F.array_min(F.transform(swaps, lambda x: F.levenshtein(x, b))) + 1
    best = F.when((far >= 0) & (far <= 1), far).when(far >= 0, F.least(F.when(far <= 2, far), F.when(swapped <= 2, swapped), F.when(_two_swaps(a, b), 2)))
    return best.cast("int")


def _two_swaps(a: Column, b: Column) -> Column:
    """Words of one length that become equal by two separate exchanges of neighbours."""
    at = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    pair = lambda x, y: (F.get(at, F.lit(y)) == F.get(at, F.lit(x)) + 1) & (F.substring(a, F.get(at, F.lit(x)), F.lit(1)) == F.substring(b, F.get(at, F.lit(y)), F.lit(1))) & (F.substring(a, F.get(at, F.lit(y)), F.lit(1)) == F.substring(b, F.get(at, F.lit(x)), F.lit(1)))
    return (F.length(a) == F.length(b)) & (F.size(at) == 4) & pair(0, 1) & pair(2, 3)


def _deletes(word: str, edits: int) -> str:
    """SQL for the word with up to ``edits`` letters left out."""
    once = f"transform(sequence(1, length({{w}})), i -> concat(substring({{w}}, 1, i - 1), substring({{w}}, i + 1)))"
    one = f"concat(array({word}), if(length({word}) > 0, {once.format(w=word)}, array()))"
    if edits == 1:
        return f"array_distinct({one})"
    inner = once.format(w="x").replace("i ->", "j ->").replace("i - 1", "j - 1").replace("i + 1", "j + 1")
    return f"array_distinct(flatten(transform({one}, x -> concat(array(x), if(length(x) > 0, {inner}, array())))))"


def suggestions(words: DataFrame, dictionary: DataFrame, edits: int = 2) -> DataFrame:
    """(word, suggestion, distance) for distinct lower-case words: the nearest dictionary term, then the most frequent.

    ``dictionary`` is (term, cf). Words and terms meet on what is left after dropping up to ``edits`` letters of each, which
    finds every term within that distance; a word of the dictionary suggests itself. Words without a near term have no row.
    """
    if edits not in (1, 2):
        raise ValueError("edits is 1 or 2")
    want = words.select("word").distinct().withColumn("key", F.explode(F.expr(_deletes("word", edits))))
    have = dictionary.select("term", "cf").withColumn("key", F.explode(F.expr(_deletes("term", edits))))
    met = want.join(have, "key").select("word", "term", "cf").distinct().where(F.abs(F.length("word") - F.length("term")) <= edits)
    near = met.withColumn("distance", near_distance(F.col("word"), F.col("term"))).where(F.col("distance") <= edits)
    order = Window.partitionBy("word").orderBy("distance", F.desc("cf"), "term")
    return near.withColumn("r", F.row_number().over(order)).where("r = 1").select("word", F.col("term").alias("suggestion"), "distance")


def correct(queries: DataFrame, dictionary: DataFrame, edits: int = 2, protect: bool = True) -> DataFrame:
    """(query_id, pos, word, corrected): each word of each query, corrected unless short or a name; the first letter's case is kept."""
    words = queries.select("query_id", F.posexplode(refine_tokens(F.col("text"))).alias("pos", "word"))
    fixable = F.length("word") >= MIN_LETTERS
    if protect:
        fixable = fixable & ~is_entity(F.col("word"), F.col("pos"))
    words = words.withColumn("lower", F.when(fixable, F.lower("word")))
    best = suggestions(words.where("lower is not null").select(F.col("lower").alias("word")), dictionary, edits)
    out = words.join(best.select(F.col("word").alias("lower"), "suggestion"), "lower", "left")
    fixed = F.when(F.col("suggestion").isNull() | (F.col("suggestion") == F.col("lower")), F.col("word")).when(
        F.col("word").rlike("^[A-Z]"), F.concat(F.upper(F.substring("suggestion", 1, 1)), F.substring("suggestion", 2, 1000))
    )
    return out.select("query_id", "pos", "word", F.coalesce(fixed, "suggestion", "word").alias("corrected"))


def synonyms(corrected: DataFrame, thesaurus: DataFrame, stop_words, most: int = 2, protect: bool = True) -> DataFrame:
    """(query_id, pos, place, term, synonym): new words for each content word, in the thesaurus's order.

    ``thesaurus`` is (term, ord, synonym). The first ``most`` single words that differ from the word itself and from one another are taken, and of
    these the ones that the query holds or an earlier word has added are then dropped: no further ones step in.
    Short words, stop words and, with ``protect``, names have no synonyms.
    """
    if not 0 <= most <= 10:
        raise ValueError("between 0 and 10 synonyms")
    words = corrected.select("query_id", "pos", "corrected", F.lower("corrected").alias("term"))
    content = words.where((F.length("term") >= MIN_LETTERS) & ~F.col("term").isin(list(stop_words)))
    if protect:
        content = content.where(~is_entity(F.col("corrected"), F.col("pos")))
    s = thesaurus.select("term", "ord", F.lower(F.translate("synonym", "_", " ")).alias("synonym")).where(~F.contains("synonym", F.lit(" ")) & (F.col("synonym") != F.col("term")))
    s = s.groupBy("term", "synonym").agg(F.min("ord").alias("ord"))
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy("ord", "synonym"))).where(F.col("place") <= most)
    found = content.join(s, "term").join(words.select("query_id", F.col("term").alias("synonym")), ["query_id", "synonym"], "left_anti")
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "synonym").orderBy("pos", "place"))).where("r = 1")
    return first.select("query_id", "pos", "place", "term", "synonym")


def refine(queries: DataFrame, dictionary: DataFrame, thesaurus: DataFrame | None = None, stop_words=(), edits: int = 2, protect: bool = True, most: int = 2) -> DataFrame:
    """(query_id, original, corrected, refined, suggestion, applied): the corrected text, with synonyms added in the order of their words and
    of the thesaurus; the corrected text as suggestion if it differs from the trimmed original but for case; the stages that changed something."""
    words = correct(queries, dictionary, edits, protect)
    line = words.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "corrected"))).alias("w"))
    line = line.select("query_id", F.array_join(F.transform("w", lambda x: x["corrected"]), " ").alias("corrected"), F.exists("w", lambda x: x["word"] != x["corrected"]).alias("spelled"))
    out = queries.select("query_id", F.col("text").alias("original")).join(line, "query_id", "left")
    if thesaurus is None:
        out = out.withColumn("added", F.lit(""))
    else:
        more = synonyms(words, thesaurus, stop_words, most, protect).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "place", "synonym"))), lambda x: x["synonym"]), " ").alias("added"))
        out = out.join(more, "query_id", "left").withColumn("added", F.coalesce("added", F.lit("")))
    corrected, spelled = F.coalesce("corrected", F.lit("")), F.coalesce("spelled", F.lit(False))
    refined = F.trim(F.concat_ws(" ", corrected, F.col("added")))
    changed = F.lower(corrected) != F.lower(F.trim(F.coalesce("original", F.lit(""))))
    applied = F.array_join(F.filter(F.array(F.when(spelled, "spell_correction"), F.when(F.col("added") != "", "synonym_expansion")), lambda x: x.isNotNull()), ",")
    return out.select("query_id", "original", corrected.alias("corrected"), refined.alias("refined"), F.when(changed & (corrected != ""), corrected).alias("suggestion"), applied.alias("applied"))
