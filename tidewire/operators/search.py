"""Full-text search: a positional inverted index in segments, and a trigram index that narrows the search for any substring."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as tx
from tidewire.session import cut_lineage

#: Words of phrases that are sent to all tasks; more of them are joined by a shuffle.
FEW = 20_000
#: Needles that are looked for in every text; more of them go through the index.
FEW_NEEDLES = 64
FIELDS = ("title", "summary", "content", "keywords")


def _stacked(articles: DataFrame, fields: Sequence[str]) -> DataFrame:
    return articles.select("id", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("said")) for f in fields))))


def segment(articles: DataFrame, number: int = 0, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(segment, token, id, field, positions): where each word of an article stands. A null field has no words.

    Words are sorted with their places inside the row, nothing is shuffled; an article that comes twice has its postings twice.
    """
    flat = _stacked(articles, fields).select("id", "field", F.inline(postings(tx.tokens(F.col("said"), 1))))
    return flat.select(F.lit(number).alias("segment"), "token", "id", "field", "positions")


def postings(words: Column) -> Column:
    """Array of (token, positions) of the distinct words."""
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("token"), i.alias("pos"))))

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda p, i: F.when((i == 0) | (p["token"] != F.get(s, i - 1)["token"]), i)), lambda i: i.isNotNull())
        return tx.let(starts, lambda st: F.transform(st, lambda i, j: F.struct(
            F.get(s, i)["token"].alias("token"),
            F.transform(F.slice(s, i + 1, F.coalesce(F.get(st, j + 1), F.size(s)) - i), lambda p: p["pos"]).alias("positions"))))

    return tx.let(placed, runs)


def merged(*segments: DataFrame) -> DataFrame:
    """One index from several: of an article that was indexed again, only its highest segment counts."""
    every = reduce(DataFrame.unionByName, segments)
    last = every.groupBy("id").agg(F.max("segment").alias("segment"))
    return every.join(last, ["id", "segment"], "left_semi").select(*every.columns)


def phrase_hits(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, id) of articles that hold the words of a phrase next to each other, in order, in one field.

    All ``phrases`` (column phrase) are looked up at once: each posting of a word says where the phrase would begin, and
    a beginning that all words agree on is a hit. One row per posting is shuffled, not one per place; a phrase of one
    word needs only the posting. A phrase without words has no hits.
    """
    words = phrases.select("phrase").distinct().select("phrase", tx.tokens(F.col("phrase"), 1).alias("w"))
    asked = cut_lineage(words.select("phrase", F.size("w").alias("n"), F.posexplode("w").alias("offset", "token")))
    if asked.count() <= FEW:
        asked = F.broadcast(asked)
    met = index.join(asked, "token").select(
        "phrase", "n", "id", "field", "offset", F.when(F.col("n") > 1, F.transform("positions", lambda p: p - F.col("offset"))).alias("starts"))
    by_word = met.groupBy("phrase", "n", "id", "field").agg(F.collect_list(F.struct("offset", "starts")).alias("held"))

    def of(offset: Column) -> Column:
        return F.flatten(F.transform(F.filter("held", lambda h: h["offset"] == offset), lambda h: h["starts"]))

    agreed = F.aggregate(F.sequence(F.lit(1), F.col("n") - 1), of(F.lit(0)), lambda left, offset: F.array_intersect(left, of(offset)))
    return by_word.filter(F.when(F.col("n") > 1, F.size(agreed) > 0).otherwise(True)).select("phrase", "id").distinct()


def grams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text."""
    # the characters are split off once: a substring by position would count from the start of the text each time
    chars = F.split(F.lower(text), "")
    return tx.let(chars, lambda cs: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(cs) - 2, F.lit(1))), lambda i: F.concat(
        F.get(cs, i - 1), F.coalesce(F.get(cs, i), F.lit("")), F.coalesce(F.get(cs, i + 1), F.lit(""))))))


def gram_index(articles: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(gram, id, field) of every run of three characters."""
    return _stacked(articles, fields).filter(F.col("said").isNotNull()).select("id", "field", F.explode(grams(F.col("said"))).alias("gram"))


def substring_hits(index: DataFrame, articles: DataFrame, needles: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(needle, id) of articles with the needle (column needle) in a field, without regard to case.

    A few needles are looked for while the texts are read once; the index is then not built. For more of them the index
    leaves only fields that hold all runs of three characters of a needle; these alone are read. Needles of one or two
    characters are looked for inside the runs, which hold every character of a longer field and all of a shorter one. An
    empty needle has no hits.
    """
    asked = needles.select("needle").filter("needle <> ''").distinct()
    few = [r.needle for r in asked.limit(FEW_NEEDLES + 1).collect()]
    if len(few) <= FEW_NEEDLES:
        return _scanned(articles, few, fields)
    asked = asked.withColumn("runs", grams(F.col("needle")))
    long = asked.filter(F.char_length("needle") >= 3).select("needle", F.size("runs").alias("n"), F.explode("runs").alias("gram"))
    found = index.join(long, "gram").groupBy("needle", "n", "id", "field").agg(F.count("*").alias("held")).filter(F.col("held") >= F.col("n"))  # an id may come twice
    texts = _stacked(articles, fields)
    sure = found.select("needle", "id", "field").join(texts, ["id", "field"]).filter(F.lower("said").contains(F.lower("needle")))
    short = asked.filter(F.char_length("needle") < 3).select(F.lower("needle").alias("low"), "needle")
    parts = F.array_distinct(F.array(*(F.substring("gram", at, n) for at, n in ((1, 1), (2, 1), (3, 1), (1, 2), (2, 2)))))
    ends = index.select("gram").distinct().select("gram", F.explode(parts).alias("low")).join(short, "low").select("needle", "gram").distinct()
    return sure.select("needle", "id").unionByName(index.join(ends, "gram").select("needle", "id")).distinct()


def _scanned(articles: DataFrame, needles: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``substring_hits`` without an index: the fields of an article are lowered once and looked through for each needle."""
    asked = F.array(*(F.struct(F.lit(n).alias("needle"), F.lower(F.lit(n)).alias("low")) for n in needles))
    said = F.filter(F.array(*(F.lower(F.col(f)) for f in fields)), lambda s: s.isNotNull())
    held = tx.let(said, lambda ss: F.filter(asked, lambda n: F.exists(ss, lambda s: s.contains(n["low"]))))
    if not needles:
        return articles.select(F.lit("").alias("needle"), "id").limit(0)
    # not an inner explode: its filter would be moved below the shuffle that spreads the articles
    return articles.select("id", F.explode_outer(held).alias("hit")).filter("hit is not null").select("hit.needle", "id").distinct()
