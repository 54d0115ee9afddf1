"""Duplicates, similarity, story groups, blending, trends and ranking over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import bags, dates
from tidewire.functions import scores as sc
from tidewire.functions import text as tx
from tidewire.functions import url as ux
from tidewire.operators import corpus as cp
from tidewire.operators import extraction as ex
from tidewire.operators import feed as fd
from tidewire.operators import graph, search, simjoin
from tidewire.operators.keyed import ranked_per_key, top_per_key
from tidewire.plans import sqltext as sq
from tidewire.plans.extraction import _KW
from tidewire.plans.texts import _PARTS, _PRIORITY, _WORDSET, _BAD_URL
from tidewire.plans.views import ART, AS_OF, EV, NOW, article_events, articles as thin_articles, reader_events, sql_bridge, sql_stamp, stamp
from tidewire.plans.views import wide_articles as articles
from tidewire.registry import query
from tidewire.session import cut_lineage, drop_shuffles, let_go, settled

C = F.col


# --- exact duplicates -------------------------------------------------------------------


@query("exact_dedup_newest", f"""WITH {ART}, k AS (SELECT *, md5({sq.fingerprint_form('content')}) AS fp FROM art)
SELECT id, fp FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY published_at DESC NULLS LAST, id) AS r FROM k) WHERE r = 1""")
def _(t):
    df = articles(t).select("id", "published_at", tx.content_fingerprint(C("content")).alias("fp"))
    return cp.first_per_key(df, ["fp"], [F.desc_nulls_last("published_at"), F.asc("id")]).select("id", "fp")


@query("duplicate_groups", f"""WITH {ART}, k AS (SELECT id, md5({sq.fingerprint_form('content')}) AS fp FROM art)
SELECT id, fp, n AS group_size, f AS first_id FROM k JOIN (SELECT fp, count(*) AS n, min(id) AS f FROM k GROUP BY 1 HAVING count(*) > 1) USING (fp)""")
def _(t):
    df = articles(t).select("id", tx.content_fingerprint(C("content")).alias("fp"))
    return cp.duplicate_members(df, "fp", "id")


@query("repeated_in_batch", f"""WITH {ART}, k AS (SELECT id, md5({sq.fingerprint_form('title')}) AS t, md5({sq.fingerprint_form('content')}) AS c,
  md5({sq.host('url')} || lower({sq.path('url')})) AS u FROM art)
SELECT id, CASE WHEN id > min(id) OVER (PARTITION BY t, c) THEN 'Duplicate: identical title and content already seen'
  WHEN id > min(id) OVER (PARTITION BY u) THEN 'Duplicate: URL already processed' END AS duplicate_reason FROM k""")
def _(t):
    u = C("url")
    df = articles(t).select("id", tx.title_fingerprint(C("title")).alias("t"), tx.content_fingerprint(C("content")).alias("c"),
                            tx.url_fingerprint(ux.host(u), ux.path(u)).alias("u"))
    return cp.reject_repeats(df, "t", "c", "u", [C("id")]).select("id", "duplicate_reason")


# --- set similarity ---------------------------------------------------------------------


def _pairs_sql(tokens, t, source="art"):
    return f"""st AS (SELECT w, min(id) AS id, count(*) AS n FROM (SELECT id, {tokens} AS w FROM {source}) WHERE len(w) > 0 GROUP BY w),
c AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS copies_a, b.n AS copies_b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS u
  FROM st a JOIN st b ON a.id < b.id AND len(a.w) >= len(b.w) * {t} AND len(b.w) >= len(a.w) * {t})
SELECT id_a, id_b, copies_a, copies_b, round(CAST(i AS DOUBLE) / (u - i), 6) AS similarity FROM c WHERE CAST(i AS DOUBLE) / (u - i) >= {t}"""


def _rounded(df, col="similarity"):
    return df.withColumn(col, F.round(col, 6))


@query("title_similarity_pairs", f"WITH {ART}, {_pairs_sql(sq.significant('title'), 0.55)}")
def _(t):
    df = articles(t).select("id", tx.significant_words(C("title")).alias("w"))
    return _rounded(simjoin.jaccard_pairs(df, "id", "w", 0.55, pairs=True))


@query("text_similarity_pairs")
def _(t):
    df = articles(t).select("id", tx.word_set(C("content")).alias("w"))
    return _rounded(simjoin.jaccard_pairs(df, "id", "w", 0.85))


@query("slug_similarity_pairs", f"""WITH {ART}, urls AS (SELECT 'a' AS kind, id, url FROM art), {_PARTS},
{_pairs_sql('list_sort(list_distinct(slug))', 0.55, 'parts')}""")
def _(t):
    df = articles(t).select("id", F.array_distinct(ux.slug_words(C("url"))).alias("w"))
    return _rounded(simjoin.jaccard_pairs(df, "id", "w", 0.55, pairs=True))


@query("near_duplicate_texts")
def _(t):
    df = articles(t).select("id", "url", tx.word_set(C("content")).alias("w"))
    return _rounded(cp.near_duplicates(df, "id", "w", 0.85))


def _quality(t):
    none = F.lit(None).cast("string")
    return articles(t).select("id", "url", "title", tx.significant_words(C("title")).alias("w"), sc.group_quality(
        C("content"), C("summary"), none, C("source_name"), cp.source_priority(C("url"))).alias("q"))


@query("near_duplicate_titles")
def _(t):
    order = F.struct((-C("q")).alias("q"), C("id").alias("i"))
    led = cp.near_duplicates(_quality(t), "id", "w", 0.55, order, pairs=True)
    return _rounded(led)


@query("best_of_similar_titles")
def _(t):
    df = _quality(t)
    led = graph.set_leaders(df, "id", "w", 0.52, pairs=True)
    return cp.best_per_group(df, led, "id", [F.desc("q"), F.asc("id")]).select("id", "leader", "q")


@query("accepted_titles")
def _(t):
    df = articles(t).select("id", F.array_distinct(tx.tokens(C("title"))).alias("w"))
    led = cp.near_duplicates(df, "id", "w", 0.5 + 1e-6, pairs=True)
    return led.filter(~C("is_duplicate")).select("id")


@query("url_groups")
def _(t):
    art = articles(t).select("id", "url", F.concat(F.lit("https://img.example.com/"), C("id") % 40, F.lit(".jpg")).alias("image"))
    best = cp.url_groups(art, "id", "url").join(art.select("id", "image"), "id")
    order = [F.desc("priority"), F.asc("id")]
    return cp.one_per_image(best, "image", order).select("id", "url", "priority", "image")


@query("distinct_sentences")
def _(t):
    return articles(t).select("id", F.size(tx.sentences(C("content"))).alias("n"),
                              F.size(cp.distinct_sentences(C("content"))).alias("n_exact"),
                              F.size(cp.distinct_sentences(C("summary"), 0.45)).alias("n_summary"))


@query("fact_check_annotation", f"""WITH {ART}, a AS (SELECT id, list_sort(list_distinct({sq.tokens('title', 4)})) AS w FROM art),
r AS (SELECT item_id, list_distinct({sq.tokens('text', 4)}) AS w FROM benchmark)
SELECT DISTINCT a.id FROM a JOIN r ON len(list_intersect(a.w, r.w)) >= 3""")
def _(t):
    art = articles(t).select("id", F.array_distinct(tx.tokens(C("title"), 4)).alias("w"))
    reviews = t.benchmark.select("item_id", F.array_distinct(tx.tokens(C("text"), 4)).alias("w"))
    pairs = simjoin.shared_term_pairs(art, reviews, 3, "id", "item_id", "w")
    return pairs.select(C("left").cast("bigint").alias("id")).distinct()


# --- full-text search -------------------------------------------------------------------


_SEARCHED = ("title", "summary", "content", "keywords")
_PHRASES = ("of the", "to the and", "de la", "Of, THE!", "in", "no such words")
_NEEDLES = ("tion of", "ing th", "Ça", "é", "xq", "economy", "nowhere to be found")


def _searched(t):
    return articles(t).select("id", "published_at", "title", "summary", "content", C("category").alias("keywords"))


def _holds(phrase):
    return " OR ".join(f"contains(' ' || array_to_string({sq.tokens('category' if f == 'keywords' else f, 1)}, ' ') || ' ', {phrase})" for f in _SEARCHED)


@query("phrase_search", f"""WITH {ART} SELECT id FROM art WHERE {_holds("' of the '")} ORDER BY published_at DESC NULLS LAST, id LIMIT 100""")
def _(t):
    art = _searched(t)
    hits = search.phrase_hits(search.segment(art), t.spark.createDataFrame([("of the",)], "phrase string"))
    return art.join(hits, "id", "left_semi").orderBy(F.desc_nulls_last("published_at"), "id").limit(100).select("id")


@query("phrase_hits", f"""WITH {ART}, asked AS (SELECT unnest([{", ".join(f"'{p}'" for p in _PHRASES)}]) AS phrase),
w AS (SELECT phrase, ' ' || array_to_string({sq.tokens('phrase', 1)}, ' ') || ' ' AS words FROM asked)
SELECT phrase, id FROM art JOIN w ON {_holds('words')}""")
def _(t):
    """Two segments: the first half of the articles indexed twice."""
    art = _searched(t)
    index = search.merged(search.segment(art.filter("id % 2 = 0"), 0), search.segment(art, 1))
    return search.phrase_hits(index, t.spark.createDataFrame([(p,) for p in _PHRASES], "phrase string"))


@query("substring_hits", f"""WITH {ART}, asked AS (SELECT unnest([{", ".join(f"'{n}'" for n in _NEEDLES)}]) AS needle)
SELECT needle, id FROM art JOIN asked ON {" OR ".join(f"contains(lower({'category' if f == 'keywords' else f}), lower(needle))" for f in _SEARCHED)}""")
def _(t):
    art = _searched(t)
    return search.substring_hits(search.gram_index(art), art, t.spark.createDataFrame([(n,) for n in _NEEDLES], "needle string"))


# --- vectors ----------------------------------------------------------------------------


def _signals(t):
    art = articles(t).withColumn("keywords", ex.keywords(C("content"), 7))
    return art.select(
        "id", cp.entity_set(C("title"), C("content"), C("keywords"), C("category")).alias("entities"), "keywords",
        "published_at", tx.significant_words(C("title")).alias("title_words"), "category")


def _vectors(t):
    # the vectors are read many times; written once they are not computed again
    v = cp.term_vector(C("title"), C("summary"), C("content"))
    return settled(articles(t).select("id", v.alias("terms")), "terms")


def _features(t):
    vectors = _vectors(t)
    weighted = cp.idf_weighted(vectors).withColumnRenamed("terms", "vector")
    features = settled(_signals(t).join(weighted, "id"), "features")
    let_go(vectors)
    drop_shuffles(t.spark)
    return features


_VEC = f"""tok AS (SELECT id, unnest({sq.tokens(sq.normalize('title'))}) AS term, 3 AS w FROM art
  UNION ALL SELECT id, unnest({sq.tokens(sq.normalize('summary'))}), 2 FROM art UNION ALL SELECT id, unnest({sq.tokens(sq.normalize('content'))}), 1 FROM art),
tf AS (SELECT id, term, sum(w) AS n FROM tok GROUP BY 1, 2), nrm AS (SELECT id, sqrt(sum(n * n)) AS z FROM tf GROUP BY 1),
vec AS (SELECT id, term, n / z AS weight FROM tf JOIN nrm USING (id))"""


@query("term_vectors", f"WITH {ART}, {_VEC} SELECT id, term, round(weight, 6) AS weight FROM vec")
def _(t):
    v = cp.term_vector(C("title"), C("summary"), C("content"))
    return articles(t).select("id", F.inline(v)).select("id", "term", F.round("weight", 6).alias("weight"))


_IDF = f"""dfs AS (SELECT term, count(*) AS df FROM vec GROUP BY 1), iw AS (SELECT id, term, weight * ln(((SELECT count(*) FROM art) + 1) / (df + 1)) AS w FROM vec JOIN dfs USING (term)),
iz AS (SELECT id, sqrt(sum(w * w)) AS z FROM iw GROUP BY 1), ivec AS (SELECT id, term, w / z AS weight FROM iw JOIN iz USING (id) WHERE w > 0)"""


@query("idf_vectors", f"WITH {ART}, {_VEC}, {_IDF} SELECT id, count(*) AS terms, round(sum(weight), 5) AS total FROM ivec GROUP BY 1")
def _(t):
    v = cp.idf_weighted(_vectors(t)).select("id", F.inline("terms"))
    return v.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 5).alias("total"))


@query("cosine_pairs", f"""WITH {ART}, {_VEC}, {_IDF}, k AS (SELECT md5(title || '|' || summary || '|' || content) AS k, min(id) AS id FROM art GROUP BY 1),
v AS (SELECT ivec.* FROM ivec JOIN k USING (id)), p AS (SELECT a.id AS a, b.id AS b, sum(a.weight * b.weight) AS c FROM v a JOIN v b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2)
SELECT a AS id_a, b AS id_b, round(least(c, 1.0), 5) AS cosine FROM p WHERE c >= 0.55""")
def _(t):
    # texts that are the same to the letter count once
    key = F.md5(F.concat_ws("|", "title", "summary", "content"))
    first = articles(t).groupBy(key.alias("k")).agg(F.min("id").alias("id"))
    weighted = cp.idf_weighted(_vectors(t)).join(first, "id", "left_semi")
    return simjoin.sparse_cosine_pairs(weighted, 0.55, fold=False).select("id_a", "id_b", F.round("cosine", 5).alias("cosine"))


_ENTS = "CASE WHEN category = 'general' THEN kw ELSE list_append(kw, '_cat:' || category) END"
_FEAT = f"""kws AS (SELECT id, unnest({_KW}) AS w FROM art), kwc AS (SELECT id, w, count(*) AS n FROM kws GROUP BY 1, 2),
kwr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, w) AS r FROM kwc),
kwl AS (SELECT art.id, coalesce(list(w) FILTER (w IS NOT NULL), []) AS kw FROM art LEFT JOIN kwr ON art.id = kwr.id AND r <= 7 GROUP BY 1),
feat AS (SELECT art.id, kw, {_ENTS} AS ents, published_at, category, {sq.significant('title')} AS tw FROM art JOIN kwl ON art.id = kwl.id)"""
_TIME = """CASE WHEN h IS NULL THEN 0.0::DOUBLE WHEN h <= 4 THEN 1.0 WHEN h <= 12 THEN 0.9 WHEN h <= 24 THEN 0.75 WHEN h <= 48 THEN 0.5
  WHEN h <= 72 THEN 0.3 ELSE 0.1 END"""


def _overlap(a, b):
    j = sq.jaccard(a, b)
    return f"CASE WHEN len(list_intersect({a}, {b})) >= 2 THEN least(({j}) * 1.3, 1.0) ELSE {j} END"


_SIG = f"""dup AS (SELECT tw, min(id) AS id FROM feat WHERE len(tw) > 0 GROUP BY 1),
tp AS (SELECT a.id AS a, b.id AS b FROM dup a JOIN dup b ON a.id < b.id WHERE {sq.jaccard('a.tw', 'b.tw')} >= 0.55),
dots AS (SELECT a, b, least(sum(x.weight * y.weight), 1.0) AS cosine FROM tp JOIN ivec x ON x.id = a JOIN ivec y ON y.id = b AND y.term = x.term GROUP BY 1, 2),
sig AS (SELECT a, b, coalesce(cosine, 0.0) AS cosine, {_overlap('p.ents', 'q.ents')} AS entity_sim, {sq.jaccard('p.kw', 'q.kw')} AS keyword_sim,
  abs(trunc(date_diff('second', p.published_at, q.published_at) / 3600.0)) AS h FROM tp LEFT JOIN dots USING (a, b) JOIN feat p ON p.id = a JOIN feat q ON q.id = b)"""


@query("combined_similarity", f"""WITH {ART}, {_VEC}, {_IDF}, {_FEAT}, {_SIG}
SELECT a, b, round(cosine, 6) AS cosine, round(entity_sim, 6) AS entity_sim, round(keyword_sim, 6) AS keyword_sim, {_TIME} AS time_sim,
  round(cosine * 0.40 + entity_sim * 0.35 + keyword_sim * 0.15 + {_TIME} * 0.10, 6) AS combined FROM sig""")
def _(t):
    feats = _features(t)
    pairs = simjoin.jaccard_pairs(feats, "id", "title_words", 0.55, pairs=True).select(C("id_a").alias("a"), C("id_b").alias("b"))
    df = cp.pair_features(pairs, feats)
    return df.select("a", "b", *[F.round(c, 6).alias(c) for c in ("cosine", "entity_sim", "keyword_sim", "time_sim", "combined")])


@query("entity_sets", f"WITH {ART}, {_FEAT} SELECT id, array_to_string(list_sort(ents), ' ') AS entities FROM feat")
def _(t):
    return _signals(t).select("id", F.array_join(F.array_sort("entities"), " ").alias("entities"))


_COMBINED = f"""pd AS (SELECT a.id AS a, b.id AS b, sum(a.weight * b.weight) AS dot FROM ivec a JOIN ivec b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2),
sims AS (SELECT p.id AS a, q.id AS b, least(coalesce(dot, 0.0), 1.0) AS cosine, {_overlap('p.ents', 'q.ents')} AS entity_sim, {sq.jaccard('p.kw', 'q.kw')} AS keyword_sim,
  abs(trunc(date_diff('second', p.published_at, q.published_at) / 3600.0)) AS h FROM feat p JOIN feat q ON p.id < q.id LEFT JOIN pd ON pd.a = p.id AND pd.b = q.id),
links AS (SELECT a, b FROM sims WHERE cosine * 0.40 + entity_sim * 0.35 + keyword_sim * 0.15 + {_TIME} * 0.10 > 0.55),
early AS (SELECT b AS id, list(a) AS before FROM links GROUP BY 1),
queue AS (SELECT art.id, row_number() OVER (ORDER BY art.id) AS n, coalesce(before, []) AS before FROM art LEFT JOIN early USING (id)),
pass AS (SELECT n, id, id AS leader, [id] AS leaders FROM queue WHERE n = 1
  UNION ALL SELECT o.n, o.id, coalesce(list_min(list_intersect(p.leaders, o.before)), o.id),
    CASE WHEN len(list_intersect(p.leaders, o.before)) > 0 THEN p.leaders ELSE list_append(p.leaders, o.id) END FROM pass p JOIN queue o ON o.n = p.n + 1)"""


@query("similarity_dedup", f"""WITH RECURSIVE {ART}, {_VEC}, {_IDF}, {_FEAT}, {_COMBINED}
SELECT id, leader, id <> leader AS is_duplicate FROM pass""")
def _(t):
    led = cp.story_leaders(_features(t), 0.55)
    return led.select("id", "leader", (C("id") != C("leader")).alias("is_duplicate"))


@query("story_groups")
def _(t):
    """Every article with its story, and whether it stands for it."""
    members = cp.story_clusters(_features(t), 0.28).join(thin_articles(t).select("id", "url", "title", "content"), "id")
    members = cut_lineage(members)
    rep = cp.representatives(members, "cluster", [F.desc(F.length("content")), F.asc("id")])
    rep = rep.select("cluster", C("id").alias("representative"), "cluster_size", "source_count")
    return members.select("id", "cluster").join(rep, "cluster").select("id", C("cluster").alias("leader"), "representative", "cluster_size", "source_count")


@query("subject_pairs")
def _(t):
    df = cp.subject_pairs(_features(t), 0.45, 0.55)
    return df.select("a", "b", F.round("title_sim", 6).alias("title_sim"), F.round("cosine", 6).alias("cosine"))


@query("subject_groups")
def _(t):
    led = cp.subject_leaders(_features(t), 0.45, 0.55)
    members = led.join(thin_articles(t).select("id", "url", "title"), "id")
    rep = cp.representatives(members, "leader", [F.desc(cp.source_priority(C("url"))), F.asc("id")])
    return rep.select("leader", C("id").alias("representative"), "title", "cluster_size", "source_count")


@query("subject_groups_with_embeddings")
def _(t):
    dense = t.embeddings.select(C("vec_id").alias("id"), "embedding")
    led = cp.subject_leaders(_features(t), 0.45, 0.55, dense, 0.45)
    return led.groupBy("leader").agg(F.count("*").alias("cluster_size"))


# --- dense vectors ----------------------------------------------------------------------


def _dense_sql(t):
    return f"""SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_dot_product(a.u, b.u), 5) AS cosine
FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_dot_product(a.u, b.u) >= {t}"""


_UNIT = """e AS (SELECT vec_id, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS u FROM
  (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS d FROM embeddings))"""


@query("dense_pairs_high", f"WITH {_UNIT} {_dense_sql(0.85)}")
def _(t):
    df = simjoin.dense_row_pairs(t.embeddings, "vec_id", "embedding", 0.85)
    return df.select("id_a", "id_b", F.round("cosine", 5).alias("cosine"))


@query("dense_pairs_wide", f"WITH {_UNIT} {_dense_sql(0.35)}")
def _(t):
    df = simjoin.dense_row_pairs(t.embeddings, "vec_id", "embedding", 0.35)
    return df.select("id_a", "id_b", F.round("cosine", 5).alias("cosine"))


@query("dense_cosine_to_first", f"""WITH {_UNIT}, f AS (SELECT label, min(vec_id) AS f FROM embeddings GROUP BY 1)
SELECT e.vec_id, round(least(greatest(list_dot_product(e.u, g.u), 0), 1), 5) AS cosine FROM embeddings x JOIN f USING (label) JOIN e ON e.vec_id = x.vec_id JOIN e g ON g.vec_id = f.f""")
def _(t):
    e = t.embeddings
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(bags.cosine(C("embedding"), C("first")), 5).alias("cosine"))


EPS = 1.1  # distance of unit vectors; the same as cosine 0.395


@query("density_core_points", f"""WITH {_UNIT}, p AS (SELECT a.vec_id AS a FROM e a JOIN e b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.u, b.u) >= {1 - EPS * EPS / 2}) SELECT a AS id FROM p GROUP BY a HAVING count(*) + 1 >= 2""")
def _(t):
    units, members = cp.dense_core(t.embeddings, "vec_id", "embedding", 1 - EPS * EPS / 2, 2)
    return members.join(units.filter("core").select(C("id").alias("first")), "first").select("id")


@query("density_clusters")
def _(t):
    return cp.dense_dbscan(t.embeddings, "vec_id", "embedding", 1 - EPS * EPS / 2, 3)


@query("kmeans_clusters")
def _(t):
    out = cp.kmeans(cp.ann_features(t.embeddings, "vec_id", "embedding"))
    return cp.cluster_sizes(out, "kmeans")


@query("kmeans_members")
def _(t):
    return cp.kmeans(cp.ann_features(t.embeddings, "vec_id", "embedding"))


@query("hierarchy_clusters")
def _(t):
    points = t.embeddings.select(C("vec_id").alias("id"), C("embedding").cast("array<double>").alias("v"))
    return cp.cluster_sizes(cp.hierarchy(points, 10), "single link")


@query("principal_components")
def _(t):
    from pyspark.ml.functions import vector_to_array

    pca = cp.principal_components(cp.ann_features(t.embeddings, "vec_id", "embedding"), 50)
    arr = vector_to_array("reduced")
    return pca.select("id", F.size(arr).alias("dims"), F.round(bags.dot(arr, arr), 4).alias("energy"))


@query("tfidf_features")
def _(t):
    from pyspark.ml.functions import vector_to_array

    docs = articles(t).select("id", tx.tokens(C("content")).alias("tokens")).join(
        t.embeddings.select(C("vec_id").alias("id"), "embedding"), "id", "left")
    arr = vector_to_array("features")
    return cp.tfidf_matrix(docs, "id", "tokens", 200, "embedding").select("id", F.size(arr).alias("dims"), F.round(F.aggregate(
        arr, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# --- clusters by first title word (a given grouping) ------------------------------------


def _members(t):
    words = ex.keywords(C("content"), 7)
    return articles(t).select(
        "id", "cluster", "url", "title", "summary", "content", "category", "source_name", "published_at", words.alias("keywords"),
        sc.sentiment_multilingual(C("content")).alias("sentiment"),
        F.concat(F.lit("https://img.example.com/"), "id", F.lit(".jpg")).alias("image_url"))


@query("publishers_per_cluster", f"""WITH {ART} SELECT "cluster", count(DISTINCT {sq.host('url')}) AS publishers FROM art GROUP BY 1""")
def _(t):
    return cp.publishers_per_cluster(articles(t), "cluster")


@query("cluster_subject_titles", f"""WITH {ART}, {_FEAT}, e AS (SELECT "cluster", unnest(kw) AS e FROM art JOIN kwl USING (id)),
c AS (SELECT "cluster", e, count(*) AS n FROM e WHERE length(e) >= 3 GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "cluster" ORDER BY n DESC, e) AS r FROM c),
nm AS (SELECT "cluster", string_agg(e, ' • ' ORDER BY r) AS names FROM r WHERE r <= 2 GROUP BY 1),
b AS (SELECT "cluster", count(*) AS size, arg_min(title, id) AS ft, arg_min(category, id) AS fc,
  arg_min(category, id) FILTER (category NOT IN ('', 'general', 'general_news', 'local', 'world')) AS sp FROM art GROUP BY 1)
SELECT b."cluster", size, CASE WHEN size > 1 THEN coalesce(names, ft) ELSE ft END AS subject_title, coalesce(sp, nullif(fc, ''), 'general') AS category
FROM b LEFT JOIN nm ON b."cluster" = nm."cluster" """)
def _(t):
    return cp.subject_titles(_members(t), "cluster", "keywords", C("id"))


@query("category_groups", f"""WITH {ART}, n AS (SELECT count(DISTINCT category) AS n FROM art)
SELECT CASE WHEN n >= 6 THEN category ELSE 'general' END AS "group", count(*) AS articles, CAST(max(length(content)) AS INT) AS longest FROM art, n GROUP BY 1""")
def _(t):
    return cp.category_groups(articles(t)).groupBy("group").agg(
        F.count("*").alias("articles"), F.max(F.length("content")).alias("longest"))


@query("coherent_clusters", f"""WITH {ART}, {_VEC}, f AS (SELECT "cluster", min(id) AS f FROM art GROUP BY 1),
d AS (SELECT art."cluster", art.id, least(coalesce(sum(x.weight * y.weight), 0), 1.0) AS c FROM art JOIN f USING ("cluster") JOIN vec x ON x.id = art.id
  LEFT JOIN vec y ON y.id = f.f AND y.term = x.term WHERE art.id <> f.f GROUP BY 1, 2),
z AS (SELECT "cluster", round(avg(c), 6) AS mean_cosine FROM d GROUP BY 1) SELECT "cluster", mean_cosine, mean_cosine >= 0.35 AS coherent FROM z""")
def _(t):
    v = cp.term_vector(C("title"), C("summary"), C("content"))
    return cp.coherent_clusters(cut_lineage(articles(t).select("id", "cluster", v.alias("vector"))), "cluster", C("id"))


_TS = f"""(CASE WHEN len({sq.words(sq.squeeze('title'), 2)}) BETWEEN 6 AND 14 THEN 15.0 WHEN len({sq.words(sq.squeeze('title'), 2)}) >= 4 THEN 8.0 ELSE -10.0 END
  + CASE WHEN regexp_matches({sq.squeeze('title')}, '\\d+') THEN 5.0 ELSE 0.0 END)"""


@query("best_cluster_titles", f"""WITH {ART} SELECT "cluster", title FROM (SELECT "cluster", {sq.squeeze('title')} AS title,
  row_number() OVER (PARTITION BY "cluster" ORDER BY {_TS} DESC, id) AS r FROM art) WHERE r = 1""")
def _(t):
    return cp.best_titles(articles(t), "cluster", C("id"))


_SUMM = sq.squeeze("regexp_replace(summary, '\\s*#\\w+(?:\\s*#\\w+)*\\s*', ' ', 'g')")


@query("cluster_leads", f"""WITH {ART}, s AS (SELECT id, "cluster", {_SUMM} AS x FROM art),
n AS (SELECT *, len(string_split(x, ' ')) AS n, list_distinct(regexp_extract_all(x, '\\b\\d+\\b')) AS d FROM s WHERE x <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY "cluster" ORDER BY CASE WHEN n BETWEEN 15 AND 45 THEN n * 2 ELSE n END DESC, id) AS r FROM n),
l AS (SELECT "cluster", x AS lead, d FROM k WHERE r = 1),
a AS (SELECT k."cluster", arg_min(k.x, r) AS addition FROM k JOIN l USING ("cluster") WHERE r > 1 AND NOT contains(lead, substr(k.x, 1, 20))
  AND len(list_filter(k.d, lambda v: NOT list_contains(l.d, v))) > 0 GROUP BY 1)
SELECT l."cluster", lead, addition FROM l LEFT JOIN a ON l."cluster" = a."cluster" """)
def _(t):
    return cp.leads(articles(t), "cluster", C("id"))


@query("cluster_highlights")
def _(t):
    return cp.highlights(articles(t), "cluster", C("id"))


@query("blended_sections")
def _(t):
    return cp.sections(articles(t), "cluster", C("id"))


@query("cluster_attributions", f"""WITH {ART}, d AS (SELECT *, {sq.host('url')} AS domain FROM art)
SELECT "cluster", domain, domain AS publisher, arg_min(url, id) AS url, arg_min(title, id) AS title FROM d GROUP BY 1, 2""")
def _(t):
    return cp.attributions(articles(t), "cluster", C("id"))


@query("cluster_keywords", f"""WITH {ART}, {_FEAT}, e AS (SELECT "cluster", unnest(kw) AS term FROM art JOIN kwl USING (id))
SELECT "cluster", term, count(*) AS n FROM e WHERE length(term) >= 2 GROUP BY 1, 2""")
def _(t):
    return cp.merged_terms(_members(t), "cluster", "keywords")


@query("merged_representatives", f"""WITH {ART} SELECT "cluster", count(*) AS articles, {sql_stamp('max(published_at)')} AS latest,
  'https://img.example.com/' || min(id) || '.jpg' AS image_url FROM art GROUP BY 1""")
def _(t):
    return cp.merged_facts(_members(t), "cluster", C("id")).select("cluster", "articles", stamp("latest").alias("latest"), "image_url")


@query("similar_title_representatives")
def _(t):
    members = _members(t).withColumn("w", tx.significant_words(C("title")))
    led = graph.set_leaders(members, "id", "w", 0.52, pairs=True)
    grouped = members.drop("cluster").join(led.select("id", "leader"), "id")
    facts = cp.merged_facts(grouped, "leader", C("id"))
    terms = cp.merged_terms(grouped, "leader", "keywords").groupBy("leader").agg(F.count("*").alias("n_keywords"))
    return facts.join(terms, "leader", "left").select("leader", "articles", "max_sentiment", stamp("latest").alias("latest"), "n_keywords")


_PH = "regexp_split_to_array(lower(title || ' ' || content), '[^\\pL\\pN]+')"


@query("trending_phrases", f"""WITH {ART}, w AS (SELECT url, source_name, published_at, {_PH} AS w FROM art),
p AS (SELECT url, source_name, published_at, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)),
f AS (SELECT *, a || ' ' || b AS term FROM p WHERE length(a) > 2 AND length(b) > 2 AND a NOT IN {sq.inn(cp.TREND_STOP)} AND b NOT IN {sq.inn(cp.TREND_STOP)}),
t AS (SELECT term, count(*) AS mentions, count(DISTINCT url) AS articles, max(published_at) AS ls FROM f GROUP BY 1 HAVING count(*) >= 2),
top AS (SELECT *, mentions * 10 + articles * 5 AS score FROM t ORDER BY score DESC, term LIMIT 20),
s AS (SELECT term, source_name, count(*) AS n FROM f WHERE term IN (SELECT term FROM top) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, source_name) AS r FROM s),
g AS (SELECT term, string_agg(source_name, ',' ORDER BY r) AS top_sources FROM r WHERE r <= 5 GROUP BY 1)
SELECT top.term, mentions, articles, score, {sql_stamp('ls')} AS last_seen, top_sources FROM top JOIN g USING (term)""")
def _(t):
    return cp.trending_phrases(articles(t)).select(
        "term", "mentions", "articles", "score", stamp("last_seen").alias("last_seen"), "top_sources")


# --- ranking ----------------------------------------------------------------------------


@query("relevance_ranking", f"""WITH {ART}, s AS (SELECT id, date_diff('second', published_at, {NOW}) AS a, length(content) AS n, source_name FROM art)
SELECT id, round({sq.clamp("0.5::DOUBLE + CASE WHEN trunc(a / 3600.0) < 24 THEN 0.2 WHEN trunc(a / 3600.0) < 168 THEN 0.1 ELSE 0 END + " + sq.points(
    ("n > 500", 0.1), ("n > 2000", 0.05), ("true", 0.1), ("id % 5 = 0", 0.1), ("id % 6 = 0", -0.3), ("source_name IN ('src1', 'src2')", 0.15)))}, 6) AS score FROM s""")
def _(t):
    art = articles(t).withColumns({
        "cluster_id": F.lit(1), "ai_summary": F.lit(""), "translated": F.lit(False), "verified": C("id") % 5 == 0,
        "is_duplicate": C("id") % 6 == 0})
    return art.select("id", F.round(cp.relevance(AS_OF, ("src1", "src2")), 6).alias("score"))


_BASE = f"""0.5::DOUBLE + coalesce(CASE WHEN h < 1 THEN 0.2 WHEN h < 6 THEN 0.15 WHEN h < 24 THEN 0.1 WHEN h < 48 THEN 0.05 END, 0)
  + CASE WHEN regexp_matches(lower(source_name), 'src1|src2') THEN 0.1 ELSE 0 END"""


@query("personal_feed", f"""WITH {EV}, {ART}, {_FEAT}, i AS (SELECT user_id, art.category AS topic, count(*) / 100.0::DOUBLE AS weight FROM evn JOIN art ON CAST(article_id AS BIGINT) = art.id
  WHERE evn.event_type = 'view' AND user_id IS NOT NULL GROUP BY 1, 2),
x AS (SELECT user_id, CAST(article_id AS BIGINT) AS id, count(*) AS n FROM evn WHERE event_type = 'click' AND user_id IS NOT NULL GROUP BY 1, 2),
g AS (SELECT user_id, id, sum(weight * 0.15) AS gain FROM i JOIN (SELECT id, unnest(ents) AS topic FROM feat) USING (topic) GROUP BY 1, 2),
b AS (SELECT id, category, {_BASE} AS base FROM (SELECT *, trunc(date_diff('second', published_at, {NOW}) / 3600.0) AS h FROM art)),
us AS (SELECT DISTINCT user_id FROM evn WHERE user_id IS NOT NULL),
s AS (SELECT us.user_id, b.id, round(base + coalesce(gain, 0) + coalesce(weight, 0) * 0.1 + least(coalesce(n, 0) * 0.02, 0.2), 9) AS raw FROM us CROSS JOIN b
  LEFT JOIN g ON g.user_id = us.user_id AND g.id = b.id LEFT JOIN x ON x.user_id = us.user_id AND x.id = b.id
  LEFT JOIN i ON i.user_id = us.user_id AND i.topic = b.category)
SELECT user_id, id, least(greatest(raw, 0), 1) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY raw DESC, id) AS r FROM s) WHERE r <= 10""")
def _(t):
    ev = reader_events(t).filter((C("created_at") <= dates.now(AS_OF)) & C("user_id").isNotNull()).select(
        "user_id", "event_type", C("article_id").cast("bigint").alias("id"))
    art = _signals(t).join(thin_articles(t).select("id", "source_name"), "id").withColumn("ai_summary", F.lit(""))
    art = cut_lineage(art.select("id", "category", "entities", "published_at", "source_name", "ai_summary"))
    interests = ev.filter("event_type = 'view'").join(thin_articles(t).select("id", "category"), "id").groupBy(
        "user_id", C("category").alias("topic")).agg((F.count("*") / 100.0).alias("weight"))
    clicks = ev.filter("event_type = 'click'").groupBy("user_id", "id").agg(F.count("*").alias("n"))
    return cp.personal_feed(art, interests, clicks, ev.select("user_id").distinct(), AS_OF, 10, ("src1", "src2"))


@query("popular_feed", f"""WITH {EV}, {ART}, c AS (SELECT article_id, count(*) AS n FROM {sql_bridge('click')} GROUP BY 1)
SELECT id, coalesce(n, 0) AS reads FROM art LEFT JOIN c ON id = article_id ORDER BY reads DESC, published_at DESC NULLS LAST, id LIMIT 50""")
def _(t):
    reads = article_events(t, "click").groupBy("article_id").agg(F.count("*").alias("reads"))
    art = thin_articles(t).join(reads, C("id") == C("article_id"), "left").withColumn("reads", F.coalesce("reads", F.lit(0)))
    return art.orderBy(F.desc("reads"), F.desc_nulls_last("published_at"), "id").limit(50).select("id", "reads")


_DAYS = f"trunc(date_diff('second', coalesce(published_at, {NOW}), {NOW}) / 86400.0)"


@query("carousel", f"""WITH {EV}, {ART}, c AS (SELECT article_id, count(*) AS n FROM {sql_bridge('click')} GROUP BY 1),
s AS (SELECT id, round(coalesce(least(greatest(1.0::DOUBLE / nullif({_DAYS} + 1, 0), 0), 1), 0) * 0.6 + (1 + ln(coalesce(n, 0) + 1)) / (1 + ln(101.0)) * 0.4, 6) AS score
  FROM art LEFT JOIN c ON id = article_id) SELECT id, score FROM s ORDER BY score DESC, id LIMIT 9""")
def _(t):
    reads = article_events(t, "click").groupBy("article_id").agg(F.count("*").alias("reads"))
    art = thin_articles(t).join(reads, C("id") == C("article_id"), "left")
    score = cp.carousel_score(C("published_at"), F.coalesce("reads", F.lit(0)), AS_OF)
    return art.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(9)


@query("briefing_pool", f"""WITH {ART} SELECT id, url FROM art WHERE published_at > {NOW} - INTERVAL 7 DAY AND language = 'en'
ORDER BY published_at DESC NULLS LAST, id LIMIT 50""")
def _(t):
    return cp.briefing_pool(thin_articles(t), "en", AS_OF).select("id", "url")


@query("daily_briefing")
def _(t):
    art = thin_articles(t)
    pool = cp.briefing_pool(art, "en", AS_OF).select("id", "url", "title")
    latest = art.orderBy(F.desc_nulls_last("published_at"), "id").limit(20).select("id", "url", "title")
    merged = fd.merge_by_priority("url", latest, pool, order=[F.asc("id")])
    merged = merged.withColumn("w", tx.significant_words(C("title")))
    led = graph.set_leaders(merged, "id", "w", 0.52, pairs=True)
    rep = cp.representatives(merged.join(led.select("id", "leader"), "id"), "leader", [F.desc(cp.source_priority(C("url"))), F.asc("id")])
    return rep.orderBy(F.desc("cluster_size"), "id").limit(10).select("id", "title", "cluster_size", "source_count")
