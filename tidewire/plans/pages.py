"""Extraction from raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import predicates as pr
from tidewire.functions import text as tx
from tidewire.operators import pages as pg
from tidewire.plans import sqltext as sq
from tidewire.plans.views import AS_OF
from tidewire.registry import query
from tidewire.session import cut_lineage
from tidewire.sources.mart import widen

C = F.col


def _nodes(t):
    return pg.page_nodes(widen(t.pages))


def _marked(t):
    return cut_lineage(pg.with_furniture(pg.with_signals(cut_lineage(_nodes(t)))))


@query("page_nodes", "SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<h1[ >]')) AS BIGINT) AS h1, CAST(len(regexp_extract_all(html, '(?i)<article[ >]')) AS BIGINT) AS articles FROM pages")
def _(t):
    return _nodes(t).groupBy("page_id").agg(F.count_if(C("tag") == "h1").alias("h1"), F.count_if(C("tag") == "article").alias("articles"))


@query("page_metadata")
def _(t):
    return pg.page_metadata(_nodes(t)).select("page_id", "language", "title", "description", "author", "publish_date", "canonical_url")


@query("page_signals")
def _(t):
    return pg.with_signals(_nodes(t)).filter("tag = 'body'").select(
        "page_id", "text_length", "link_count", "image_count", F.round("link_density", 6).alias("link_density"))


@query("page_furniture")
def _(t):
    return _marked(t).groupBy("page_id", "furniture").agg(F.count("*").alias("n"))


@query("page_regions")
def _(t):
    best = pg.best_region(pg.article_regions(_marked(t)))
    return best.select("page_id", "node_id", "tag", F.round("score", 4).alias("score"), "live_paragraphs")


@query("page_roles")
def _(t):
    nodes = _marked(t)
    roles = pg.region_roles(nodes, pg.best_region(pg.article_regions(nodes)))
    return roles.groupBy("page_id", "node_role").agg(F.count("*").alias("n"))


@query("rebuilt_articles")
def _(t):
    nodes = _marked(t)
    roles = pg.region_roles(nodes, pg.best_region(pg.article_regions(nodes)))
    return pg.rebuilt_articles(roles, pg.page_metadata(nodes)).select(
        "page_id", "title", "author", "language", "words", "minutes", "images", F.md5("content").alias("content"))


@query("page_links")
def _(t):
    return pg.page_links(_nodes(t), t.pages).groupBy("page_id").agg(
        F.count("*").alias("links"), F.count_if("article_like").alias("article_links"))


@query("best_page_links")
def _(t):
    return pg.link_scores(pg.page_links(_nodes(t), t.pages), 3).select("page_id", "target", "score", "rank")


@query("page_images", "SELECT page_id, 'https://cdn.example.com/' || page_id || '.jpg' AS image, CAST(10 AS INT) AS score FROM pages")
def _(t):
    tags = F.concat(F.lit('<img src="/img/'), C("page_id") % 5, F.lit('.jpg" alt="'), F.lit("story"), F.lit('" width="900" height="600">'),
                    F.lit('<img src="https://cdn.example.com/small.jpg" width="10" height="10"><meta property="og:image" content="https://cdn.example.com/'),
                    "page_id", F.lit('.jpg">'))
    nodes = pg.page_nodes(widen(t.pages.withColumn("html", F.concat("html", tags))))
    titles = pg.page_metadata(nodes).select("page_id", "title")
    return pg.best_images(pg.image_candidates(nodes, t.pages), titles).select("page_id", "image", "score")


@query("publication_dates")
def _(t):
    stamped = t.pages.withColumn("html", F.concat("html", F.lit('<meta property="article:published_time" content="2024-01-'),
                                                   F.lpad((C("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit('T10:00:00Z">')))
    return pg.publication_dates(pg.page_nodes(widen(stamped)), AS_OF).select(
        "page_id", "origin", "confidence", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


_CLEAN = "html"
for _tag in pg.DROPPED_REGIONS.split("|"):
    _CLEAN = f"regexp_replace({_CLEAN}, '<{_tag}\\b[^>]*>.*?</{_tag}>', '', 'gis')"
_BOXES = "list_concat(" + ", ".join(f"regexp_extract_all(h, {sq.q(p)}, 1)" for p in pg.CONTAINERS) + ")"


@query("main_text", f"""WITH c AS (SELECT page_id, {_CLEAN} AS h FROM pages), b AS (SELECT page_id, h, {_BOXES} AS bs FROM c),
l AS (SELECT page_id, coalesce(nullif(list_filter(bs, lambda x: length(x) = list_max(list_transform(bs, lambda y: length(y))))[1], ''),
  nullif(regexp_extract(h, '(?is)<body[^>]*>(.*?)</body>', 1), ''), h) AS box FROM b),
p AS (SELECT page_id, box, array_to_string(list_filter(list_transform(regexp_extract_all(box, '(?is)<p[^>]*>(.*?)</p>', 1),
  lambda x: trim(regexp_replace(x, '<[^>]+>', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM l)
SELECT page_id, md5(CASE WHEN t <> '' THEN t ELSE trim(regexp_replace(regexp_replace(box, '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g')) END) AS content FROM p""")
def _(t):
    return widen(t.pages).select("page_id", F.md5(pg.main_text(C("html"))).alias("content"))


@query("relevant_paragraphs")
def _(t):
    docs = widen(t.documents)
    title = F.regexp_extract("text", r"^[^.!?\n]*", 0)
    out = pg.relevant_paragraphs(docs, "doc_id", tx.paragraphs(C("text")), F.concat_ws(". ", title, F.substring("text", 1, 200)))
    return out.select("doc_id", "pos", F.round("score", 6).alias("score"))


@query("image_relevance")
def _(t):
    docs = widen(t.documents)
    title = F.trim(F.regexp_extract("text", r"^[^.!?\n]*", 0))
    image = F.concat(F.lit("https://cdn.example.com/media/"), F.regexp_replace(F.lower(F.substring(title, 1, 40)), " ", "_"), F.lit(".jpg"))
    return docs.select("doc_id", pg.image_relevance(title, C("text"), image).alias("r")).select("doc_id", "r.score", "r.relevant")


@query("valid_images", f"""WITH i AS (SELECT page_id, 'https://cdn.example.com/' || CASE page_id % 5 WHEN 0 THEN 'logo' WHEN 1 THEN 'ads' WHEN 2 THEN 'media' ELSE 'story' END || '/' || page_id ||
  CASE page_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.php' END AS u FROM pages)
SELECT page_id, {sq.hits('u', pr.IMAGE_PARTS)} = 0 AND NOT suffix(u, '.php') AS ok, {sq.hits('u', pr.IMAGE_PARTS_STRICT)} = 0 AND NOT suffix(u, '.php') AS strict_ok FROM i""")
def _(t):
    k = C("page_id")
    part = F.when(k % 5 == 0, "logo").when(k % 5 == 1, "ads").when(k % 5 == 2, "media").otherwise("story")
    end = F.when(k % 3 == 0, ".jpg").when(k % 3 == 1, ".png").otherwise(".php")
    u = F.concat(F.lit("https://cdn.example.com/"), part, F.lit("/"), k, end)
    return t.pages.select("page_id", pr.valid_image(u).alias("ok"), pr.valid_image(u, strict=True).alias("strict_ok"))


@query("html_table_function")
def _(t):
    pg.register_html_udtf(t.spark)
    t.pages.createOrReplaceTempView("tidewire_pages")
    return t.spark.sql("SELECT p.page_id, n.tag, count(*) AS n FROM tidewire_pages p, LATERAL html_nodes(p.html) n GROUP BY 1, 2")
