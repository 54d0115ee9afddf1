"""Licence scans: stretches of a text compared with licence notices by the Dice coefficient over word bigrams.

A text and the notices are normalised to lower-case words. A word pair of the text that is also in a notice proposes
the stretch, as long as the notice, that puts the pair at its place; sizes bound which notices such a stretch can reach,
and the Dice coefficient of the distinct bigrams decides. DataFrame operations only; nothing is shuffled but results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import KEY, text_key, whole
from tidewire.llm.decontamination import words

THRESHOLD = 0.8
BLOCK = 1024  # words scanned at once; no result depends on it

# Names and customary notices of common licences.
NOTICES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES), "licence string, notice string")


def bigrams(w: Column) -> Column:
    """Distinct word pairs; ``w`` must be a plain column or a lambda variable."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", w[i], w[i + 1]))
    return F.when(F.size(w) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def entries(templates: DataFrame) -> DataFrame:
    """(pair, licence, place, length, wanted): each word pair of each notice; notices under two words are left out."""
    w = templates.select("licence", words(whole("notice")).alias("w")).filter(F.size("w") >= 2)
    places = w.select("licence", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("place"))
    return places.select(F.concat_ws(" ", F.col("w")[F.col("place")], F.col("w")[F.col("place") + 1]).alias("pair"), "licence",
                         "place", F.size("w").alias("length"), bigrams(F.col("w")).alias("wanted"))


def blocks(docs: DataFrame, reach: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, kn, kd, kh, at, base, w): each text cut into ``block`` words, with ``reach`` words of context on both sides.

    The block begins at word ``at`` and ``w`` at word ``base``. A text without words is one empty block.
    """
    texts = docs.select("doc_id", *text_key(), words(whole()).alias("w"))
    begins = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(block))
    cut = F.transform(begins, lambda at: F.struct(
        at.alias("at"), F.greatest(at - reach, F.lit(0)).alias("base"),
        F.slice("w", F.greatest(at - reach, F.lit(0)) + 1, F.lit(block + 2 * reach)).alias("w")))
    # outer: an inner generator would make the optimizer test the array's size on the text first
    return texts.select("doc_id", *KEY, F.explode_outer(cut).alias("b")).select("doc_id", *KEY, "b.*")


def licence_regions(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, kn, kd, kh, licence, start, dice): stretches that reach ``threshold``, and one row without licence per document.

    ``start`` counts words. Null and empty texts and texts of one word hold no licence. Repeated rows each get the same
    result; a licence named twice in ``templates`` is found by either notice, a notice without licence is left out. Extra
    columns are ignored. Texts are scanned in blocks, so that the matches held at once are bounded.
    """
    known = entries(templates.filter(F.col("licence").isNotNull())).withColumnRenamed("pair", "known")
    reach = known.agg(F.max("length")).first()[0] or 0
    texts = blocks(docs, reach, block)
    first = F.col("at") - F.col("base")
    last = F.least(first + block - 1, F.size("w") - 2)
    pairs = F.transform(F.sequence(first, last), lambda i: F.concat_ws(" ", F.col("w")[i], F.col("w")[i + 1]))
    pairs = F.when(last >= first, pairs).otherwise(F.array().cast("array<string>"))
    lead = F.when(F.col("at") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))  # for the document
    spread = texts.withColumn("pairs", F.concat(lead, pairs))
    spread = spread.select("doc_id", *KEY, "base", "w", "at", F.posexplode_outer("pairs").alias("nth", "pair"))
    # a block after the first may hold no pair: its one row is dropped here and not taken for the document
    met = spread.join(F.broadcast(known), F.col("pair") == F.col("known"), "left")  # one row per word of a fixed list
    start = F.col("at") + F.col("nth") - F.when(F.col("at") == 0, 1).otherwise(0) - F.col("place")
    length = F.least(F.col("length"), F.size("w") + F.col("base") - start)
    low = F.size("wanted") * (threshold / (2 - threshold))  # a smaller stretch cannot reach the threshold
    document = F.col("pair").isNull() & (F.col("at") == 0)
    met = met.filter(document | (F.col("known").isNotNull() & (start >= 0) & (length - 1 >= low)))
    # Behind a generator the comparison is not merged into the filter above, which would copy the block for every match.
    match = F.struct("licence", start.alias("start"), "wanted", F.slice("w", start - F.col("base") + 1, length).alias("found"))
    met = met.select("doc_id", *KEY, F.explode_outer(F.array(F.when(F.col("pair").isNotNull(), match))).alias("m"))
    met = met.select("doc_id", *KEY, "m.*").withColumn("got", bigrams(F.col("found")))
    shared = F.size(F.array_intersect("got", "wanted"))
    dice = (2 * shared).cast("double") / (F.size("got") + F.size("wanted"))
    met = met.select("doc_id", *KEY, "licence", "start", dice.alias("dice"))
    return met.filter(F.col("licence").isNull() | (F.col("dice") >= threshold))


def licences(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, licences (sorted names), n_regions (distinct stretches), best_dice (0 without any)."""
    found = licence_regions(docs, templates, threshold)
    found = found.withColumns({"copy": F.col("licence").isNull().cast("int")})
    per = found.groupBy("doc_id", *KEY).agg(
        F.sum("copy").cast("int").alias("copies"), F.array_sort(F.collect_set("licence")).alias("licences"),
        F.size(F.collect_set(F.when(F.col("licence").isNotNull(), F.struct("licence", "start")))).cast("long").alias("n_regions"),
        F.coalesce(F.max(F.when(F.col("licence").isNotNull(), F.col("dice"))), F.lit(0.0)).alias("best_dice"))
    # a document that occurs in several equal rows has a row for each
    return per.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc_id", "licences", "n_regions", "best_dice")


def op2_license_scans(docs: DataFrame) -> DataFrame:
    return licences(docs, notices(docs.sparkSession)).select(
        "doc_id", F.array_join("licences", ",").alias("licences"), F.size("licences").cast("long").alias("n_licences"), "n_regions", "best_dice")


_WORDS = ("coalesce(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])")
OP2_SQL = f"""
with n(licence, notice) as (values {", ".join(f"('{name}', '{text}')" for name, text in NOTICES)}),
t as (select licence, {_WORDS.format("notice")} as w from n),
tb as (select licence, len(w) as m, s - 1 as place, w[s] || ' ' || w[s + 1] as pair from t, unnest(range(1, len(w))) as u(s)),
tw as (select licence, list_distinct(list(pair)) as wanted from tb group by licence),
d as (select doc_id, {_WORDS.format("text")} as w from documents),
db as (select doc_id, w, s - 1 as pos, w[s] || ' ' || w[s + 1] as pair from d, unnest(range(1, len(w))) as u(s)),
c as (select distinct doc_id, licence, pos - place as start, w[pos - place + 1:pos - place + m] as f
  from db join tb using (pair) where pos >= place),
g as (select c.*, list_distinct([f[i] || ' ' || f[i + 1] for i in range(1, len(f))]) as got, wanted from c join tw using (licence)),
r as (select doc_id, licence, start, 2.0::double * len(list_intersect(got, wanted)) / (len(got) + len(wanted)) as dice from g),
h as (select doc_id, string_agg(distinct licence, ',' order by licence) as licences, count(distinct licence) as n_licences,
  count(*) as n_regions, max(dice) as best_dice from r where dice >= {THRESHOLD} group by doc_id)
select doc_id, coalesce(licences, '') as licences, coalesce(n_licences, 0) as n_licences, coalesce(n_regions, 0) as n_regions,
  coalesce(best_dice, 0.0::double) as best_dice
from d left join h using (doc_id)
"""
