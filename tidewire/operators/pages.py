"""Web pages to nodes, metadata, links, article regions and articles.

One Python step turns markup into node rows (Spark has no HTML reader); all
rules run as expressions and per-page aggregates over those rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import bags, dates
from tidewire.functions import lexicon as lx
from tidewire.functions import predicates as pr
from tidewire.functions import text as tx
from tidewire.functions import url as ux
from tidewire.operators import extraction as ex
from tidewire.operators.keyed import ranked_per_key, top_per_key

NODE_SCHEMA = (
    "page_id bigint, node_id int, parent_id int, depth int, path array<int>, tag string, class_name string, "
    "id_attr string, role string, text string, attrs map<string,string>"
)
# Elements without an end tag, and elements a new block closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset("p li dt dd option tr td th".split())
BLOCKS = frozenset("p div ul ol li table tr td th h1 h2 h3 h4 h5 h6 section article header footer nav aside main figure "
                   "blockquote form pre".split())


class _NodeRows(HTMLParser):
    """Collects one row per element, with its own text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and self.open and self.rows[self.open[-1]]["tag"] in CLOSED_BY_BLOCK:
            top = self.rows[self.open[-1]]["tag"]
            if top == "p" or top == tag:
                self.open.pop()
        values = {k: v or "" for k, v in attrs}
        me = len(self.rows)
        self.rows.append({
            "node_id": me, "parent_id": self.open[-1] if self.open else -1, "depth": len(self.open), "path": [*self.open, me],
            "tag": tag, "class_name": values.get("class", ""), "id_attr": values.get("id", ""), "role": values.get("role", ""),
            "parts": [], "attrs": list(values.items()),
        })
        if tag not in VOID:
            self.open.append(me)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[at]]["tag"] == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        if self.open:
            row = self.rows[self.open[-1]]
            if row["tag"] not in ("style",):
                row["parts"].append(data)


def html_rows(html: str) -> list[dict]:
    parser = _NodeRows()
    parser.feed(html or "")
    parser.close()
    for row in parser.rows:
        row["text"] = " ".join("".join(row.pop("parts")).split())
    return parser.rows


ARROW_NODES = pa.schema([
    ("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()),
    ("path", pa.list_(pa.int32())), ("tag", pa.string()), ("class_name", pa.string()), ("id_attr", pa.string()),
    ("role", pa.string()), ("text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
            rows = html_rows(html)
            for row in rows:
                row["page_id"] = page_id
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW_NODES)


def page_nodes(pages: DataFrame) -> DataFrame:
    """One row per element of every page."""
    return pages.select("page_id", "html").mapInArrow(_parse, NODE_SCHEMA)


def register_html_udtf(spark, name: str = "html_nodes") -> None:
    """``SELECT * FROM html_nodes(html)`` for SQL users."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="node_id int, parent_id int, depth int, tag string, class_name string, text string")
    class HtmlNodes:
        def eval(self, html: str):
            for r in html_rows(html):
                yield r["node_id"], r["parent_id"], r["depth"], r["tag"], r["class_name"], r["text"]

    spark.udtf.register(name, HtmlNodes)


def _attr(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.lit(""))


def page_metadata(nodes: DataFrame) -> DataFrame:
    """Language, title, description, author, date, Open Graph, canonical URL and JSON-LD of each page."""
    meta = F.col("tag") == "meta"
    name, prop = F.lower(_attr("name")), F.lower(_attr("property"))
    content = F.nullif(_attr("content"), F.lit(""))
    ld = (F.col("tag") == "script") & _attr("type").contains("ld+json")

    def first(cond: Column, value: Column) -> Column:
        return F.min_by(value, F.when(cond & value.isNotNull(), F.col("node_id")))

    wanted = nodes.filter(F.col("tag").isin("html", "title", "meta", "link", "script"))
    raw = wanted.groupBy("page_id").agg(
        first(F.col("tag") == "html", F.nullif(_attr("lang"), F.lit(""))).alias("language"),
        first(F.col("tag") == "title", F.nullif("text", F.lit(""))).alias("page_title"),
        first(meta & (name == "description"), content).alias("meta_description"),
        first(meta & (name == "author"), content).alias("meta_author"),
        first(meta & name.isin("publish-date", "pubdate", "date"), content).alias("meta_date"),
        first(meta & (prop == "og:title"), content).alias("og_title"),
        first(meta & (prop == "og:description"), content).alias("og_description"),
        first(meta & (prop == "og:image"), content).alias("og_image"),
        first(meta & (prop == "og:type"), content).alias("og_type"),
        first(meta & (prop == "og:site_name"), content).alias("site_name"),
        first(meta & prop.isin("article:published_time", "article:modified_time"), content).alias("article_time"),
        first(meta & (prop == "article:author"), content).alias("article_author"),
        first((F.col("tag") == "link") & (F.lower(_attr("rel")) == "canonical"), F.nullif(_attr("href"), F.lit(""))).alias("canonical_url"),
        first(ld, F.nullif("text", F.lit(""))).alias("json_ld"),
    )

    def from_ld(path: str) -> Column:
        return F.get_json_object("json_ld", path)

    return raw.select(
        "page_id", "language", F.coalesce("page_title", from_ld("$.headline"), "og_title").alias("title"),
        F.coalesce("meta_description", "og_description").alias("description"),
        F.coalesce("meta_author", "article_author", from_ld("$.author.name"), from_ld("$.author")).alias("author"),
        F.coalesce("meta_date", "article_time", from_ld("$.datePublished")).alias("publish_date"),
        F.coalesce("og_image", from_ld("$.image.url"), from_ld("$.image")).alias("image"), "og_title", "og_type", "site_name",
        "canonical_url", "json_ld", from_ld("$['@type']").alias("schema_type"))


def with_signals(nodes: DataFrame) -> DataFrame:
    """Adds sums over each subtree: text, links, link text, images, paragraphs; and the densities."""
    own = F.when(F.col("tag").isin("script", "style"), 0).otherwise(F.length("text"))
    link = F.col("tag") == "a"
    flat = nodes.select("page_id", F.explode("path").alias("root"), own.alias("n"), link.alias("link"),
                        (F.col("tag") == "img").alias("img"), ((F.col("tag") == "p") & (own >= 20)).alias("par"))
    sums = flat.groupBy("page_id", "root").agg(
        F.sum("n").alias("text_length"), F.count_if("link").alias("link_count"),
        F.sum(F.when(F.col("link"), F.col("n")).otherwise(0)).alias("link_text_length"), F.count_if("img").alias("image_count"),
        F.count_if("par").alias("paragraph_count"), F.count("*").alias("subtree_size"))
    kids = nodes.groupBy("page_id", F.col("parent_id").alias("root")).agg(F.count("*").alias("children"))
    df = nodes.join(sums.withColumnRenamed("root", "node_id"), ["page_id", "node_id"]).join(
        kids.withColumnRenamed("root", "node_id"), ["page_id", "node_id"], "left")
    children = F.coalesce("children", F.lit(0))
    density = F.when(F.col("text_length") > 0, F.col("link_text_length") / F.col("text_length")).otherwise(
        F.when(F.col("link_count") > 0, 1.0).otherwise(0.0))
    return df.withColumns({"children": children, "link_density": density,
                           "text_density": F.col("text_length") / F.greatest(F.lit(1), children + 1)})


# Class and id words of page furniture, in the order they are tried.
FURNITURE = (
    ("advertisement", "ad|ads|advert|sponsor|banner|popup|commercial|google-ad|taboola|outbrain"),
    ("navigation", "nav|menu|header|breadcrumb|topbar|navbar|navigation"),
    ("footer", "footer|copyright|bottom|legal|terms|policy"),
    ("social", "social|share|follow|twitter|facebook|whatsapp|telegram|sharer"),
    ("comments", "comment|comments|disqus|reply|feedback|discuss"),
    ("sidebar", "sidebar|aside|widget|related|more-news|trending|popular|recommended"),
)
ARTICLE_CLASSES = "article|story|post|body|content|entry|main-content|news-body|article-text"


def with_furniture(nodes: DataFrame) -> DataFrame:
    """Adds ``furniture``: why a node is not part of an article (null when it may be)."""
    label = F.lower(F.concat_ws(" ", "class_name", "id_attr", "role"))
    out = (
        F.when(F.col("tag") == "nav", "navigation").when(F.col("tag") == "footer", "footer").when(F.col("tag") == "aside", "sidebar")
        .when((F.col("link_density") > 0.65) & (F.col("text_length") < 400) & (F.col("children") > 2), "navigation")
    )
    for role, words in FURNITURE:
        out = out.when(label.rlike(words), role)
    return nodes.withColumn("furniture", out)


def article_regions(nodes: DataFrame) -> DataFrame:
    """Scored container candidates of each page. Text below furniture does not count towards paragraphs."""
    bad = nodes.filter(F.col("furniture").isNotNull()).groupBy("page_id").agg(F.collect_set("node_id").alias("bad"))
    live = nodes.join(bad, "page_id", "left").filter(~F.coalesce(F.arrays_overlap("path", "bad"), F.lit(False)))
    pars = live.filter((F.col("tag") == "p") & (F.length("text") >= 20)).select("page_id", F.explode("path").alias("node_id"))
    pars = pars.groupBy("page_id", "node_id").agg(F.count("*").alias("live_paragraphs"))
    box = nodes.filter(F.col("tag").isin("article", "main", "section", "div") & F.col("furniture").isNull() & (F.col("text_length") >= 150))
    box = box.join(pars, ["page_id", "node_id"], "left").withColumn("live_paragraphs", F.coalesce("live_paragraphs", F.lit(0)))
    box = box.filter((F.col("live_paragraphs") >= 1) | (F.col("text_length") >= 300))
    label = F.lower(F.concat_ws(" ", "class_name", "id_attr"))
    base = (
        F.greatest(F.col("text_length") - F.col("link_text_length"), F.lit(0)) / 50 + F.col("live_paragraphs") * 8
        + F.when(F.col("tag") == "article", 40).when(F.col("tag") == "main", 30).otherwise(0)
        + F.when(label.rlike(ARTICLE_CLASSES), 25).otherwise(0)
    )
    score = F.when(F.col("link_density") > 0.3, base * (1 - F.col("link_density"))).otherwise(base) + F.when(
        F.col("depth").between(2, 7), 10).otherwise(0)
    return box.withColumn("score", score).filter(F.col("score") > 15)


def best_region(regions: DataFrame) -> DataFrame:
    return top_per_key(regions, ["page_id"], [F.desc("score"), F.asc("node_id")], 1)


def region_roles(nodes: DataFrame, region: DataFrame) -> DataFrame:
    """Roles of the nodes inside each page's best region: title, byline, date, headings, quotes, images, body, lists."""
    inside = nodes.join(region.select("page_id", F.col("node_id").alias("root")), "page_id").filter(
        F.array_contains("path", F.col("root")) & F.col("furniture").isNull())
    label = F.lower(F.concat_ws(" ", "class_name", "id_attr"))
    n, text = F.length("text"), F.col("text")
    src = F.coalesce(F.nullif(_attr("src"), F.lit("")), F.nullif(_attr("data-src"), F.lit("")))
    heading = F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6")
    early = F.col("node_id") - F.col("root") <= 3
    role = (
        F.when(label.rlike("related|read-more"), "related")
        .when((F.col("tag") == "h1") | label.rlike("article-title|headline"), "title")
        .when(label.rlike("author|byline|writer") & n.between(1, 99), "author")
        .when(text.rlike("^(كتب:|بقلم:|متابعة:|By )") & (n < 80), "author")
        .when(((F.col("tag") == "time") | label.rlike("date|time|publish")) & n.between(1, 79), "date")
        .when(heading, "heading").when(((F.col("tag") == "blockquote") | label.contains("quote")) & (n > 0), "quote")
        .when((F.col("tag") == "img") & src.isNotNull() & ~src.startswith("data:"), "image")
        .when((F.col("tag") == "p") & (F.col("link_density") > 0.5), "related")
        .when((F.col("tag") == "p") & early & label.rlike("sub|lead|summary"), "subtitle")
        .when((F.col("tag") == "p") & (n >= 15), "body").when(F.col("tag").isin("ul", "ol"), "list")
    )
    ranked = inside.withColumn("node_role", role).filter(F.col("node_role").isNotNull())
    first = ranked.filter(F.col("node_role").isin("title", "image")).groupBy("page_id", "node_role").agg(F.min("node_id").alias("first"))
    ranked = ranked.join(first, ["page_id", "node_role"], "left")
    final = F.when((F.col("node_role") == "title") & (F.col("node_id") != F.col("first")), "heading").when(
        (F.col("node_role") == "image") & (F.col("node_id") == F.col("first")), "lead_image").otherwise(F.col("node_role"))
    return ranked.withColumn("node_role", final).drop("first").withColumn("src", src)


def rebuilt_articles(roles: DataFrame, metadata: DataFrame) -> DataFrame:
    """One article row per page: title, author, date, paragraphs in page order, images, word count, reading time."""
    def first(role: str) -> Column:
        return F.min_by("text", F.when(F.col("node_role") == role, F.col("node_id")))

    rows = F.when(F.col("node_role").isin("body", "quote", "heading", "subtitle") & (F.length("text") > 0), F.struct("node_id", "text"))
    df = roles.groupBy("page_id").agg(
        first("title").alias("h_title"), first("author").alias("h_author"), first("date").alias("h_date"),
        F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["text"]).alias("paragraphs"),
        F.min_by("src", F.when(F.col("node_role") == "lead_image", F.col("node_id"))).alias("lead_image"),
        F.count_if(F.col("node_role").isin("lead_image", "image")).alias("images"))
    body = F.array_join("paragraphs", "\n\n")
    return df.join(metadata, "page_id", "left").select(
        "page_id", F.coalesce("h_title", "title").alias("title"), F.coalesce("h_author", "author").alias("author"),
        F.coalesce("h_date", "publish_date").alias("published"), "paragraphs", body.alias("content"),
        F.coalesce("lead_image", "image").alias("image"), "images", "language", tx.word_count(body).alias("words"),
        tx.reading_minutes(body).alias("minutes"))


def page_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Outbound links with their anchor text, resolved against the page."""
    links = nodes.filter((F.col("tag") == "a") & (_attr("href") != "") & ~_attr("href").rlike("^(#|javascript:|mailto:)"))
    df = links.select("page_id", "node_id", _attr("href").alias("href"), F.col("text").alias("anchor")).join(
        pages.select("page_id", "url"), "page_id")
    target = ux.resolve_image(F.col("href"), F.col("url"))
    return df.withColumn("target", target).filter(F.col("target") != "").withColumn("article_like", ux.is_article_url(F.col("target")))


def link_scores(links: DataFrame, per_page: int) -> DataFrame:
    """Best links of each page by depth, anchor and path shape."""
    p = ux.path(F.col("target"))
    text = F.lower(F.trim("anchor"))
    last = F.coalesce(F.try_element_at(F.split(p, "/"), F.lit(-1)), F.lit(""))
    score = (
        F.greatest(F.lit(0), 10 - F.size(ux.segments(F.col("target"))) * 2)
        + F.when(F.length(text).between(21, 199), 5).otherwise(0) + F.when(text.rlike("news|article|report"), 3).otherwise(0)
        + F.when(p.contains("/202"), 5).otherwise(0) + F.when(p.contains("-"), 2).otherwise(0)
        + F.least(F.size(F.split(last, "-")), F.lit(5))
    )
    scored = links.withColumn("score", score).groupBy("page_id", "target").agg(F.max("score").alias("score"), F.min("node_id").alias("pos"))
    return ranked_per_key(scored, ["page_id"], [F.desc("score"), F.asc("pos")], per_page, "rank")


def image_candidates(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Images of each page with alt text and size; Open Graph and Twitter images come as candidates too."""
    meta = (F.col("tag") == "meta") & F.lower(F.concat(_attr("property"), _attr("name"))).rlike("^(og:image|twitter:image)$")
    is_img = F.col("tag") == "img"
    src = F.when(is_img, F.coalesce(F.nullif(_attr("src"), F.lit("")), _attr("data-src"))).otherwise(_attr("content"))
    df = nodes.filter(is_img | meta).select(
        "page_id", "node_id", src.alias("src"), F.when(is_img, "page").otherwise("og").alias("origin"), _attr("alt").alias("alt"),
        F.coalesce(_attr("width").try_cast("int"), F.lit(0)).alias("width"), F.coalesce(_attr("height").try_cast("int"), F.lit(0)).alias("height"))
    df = df.filter(F.col("src") != "").join(pages.select("page_id", "url"), "page_id")
    return df.withColumn("image", ux.resolve_image(F.col("src"), F.col("url"))).filter(F.col("image") != "")


def best_images(candidates: DataFrame, titles: DataFrame, entities: str | None = None) -> DataFrame:
    """The best usable image of each page; ``titles`` has page_id, title and optionally an entity array."""
    low = F.lower("image")
    ratio = F.col("width") / F.greatest(F.col("height"), F.lit(1))
    usable = (
        low.startswith("http") & ~low.rlike(r"\.(svg|gif)$") & ~tx.any_of(low, pr.IMAGE_PARTS[:16])
        & ~((F.col("width") > 0) & (F.col("width") < 300)) & ~((F.col("height") > 0) & (F.col("height") < 200))
        & ~((F.col("width") > 0) & (F.col("height") > 0) & ~ratio.between(0.33, 3.0))
    )
    df = candidates.filter(usable).join(titles, "page_id")
    alt, head = F.split(tx.normalize(F.col("alt")), " "), F.split(tx.normalize(F.col("title")), " ")
    named = F.lit(0)
    if entities is not None:
        named = F.size(F.filter(entities, lambda e: (F.length(e) > 3) & tx.normalize(F.col("alt")).contains(tx.normalize(e)))) * 25
    overlap = F.when(F.col("alt") != "", F.size(F.array_intersect(F.array_distinct(alt), F.array_distinct(head))) * 2 + named).otherwise(0)
    score = F.when(F.col("origin") == "og", 10).otherwise(0) + overlap + F.when(F.col("width") >= 800, 5).otherwise(0)
    return top_per_key(df.withColumn("score", score), ["page_id"], [F.desc("score"), F.asc("node_id")], 1)


# URL parts that mark an image as unrelated to a story.
UNRELATED_IMAGE = (
    "logo|banner|avatar|placeholder|icon|sprite|1x1|pixel|transparent|blank|spinner|loading|facebook|twitter|instagram|"
    "youtube|tiktok|social|share|rss|feed|radio|podcast|audio|video|barlamane|hespress|medi1|2m|snrt"
)


def image_relevance(title: Column, text: Column, image: Column) -> Column:
    """(score, relevant): overlap of the words in the image URL with the article, title words counting more."""
    def words(c: Column) -> Column:
        bare = F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"[!-/:-@\[-`{-~]", ""))
        return F.array_distinct(F.filter(bare, lambda w: F.length(w) >= 3))

    parts = F.filter(F.split(F.lower(image), r"[/._]"), lambda p: F.length(p) >= 3)

    def count(ws: Column) -> Column:
        return tx.let(parts, lambda ps: F.size(F.filter(ws, lambda w: F.exists(ps, lambda p: p.contains(w) | w.contains(p)))))

    heads = count(words(title))
    score = count(words(F.concat_ws(" ", title, text))) * 0.3 + heads * 0.5 - F.when(F.lower(image).rlike(UNRELATED_IMAGE), 2.0).otherwise(0.0)
    clipped = F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2)
    return F.struct(clipped.alias("score"), ((clipped >= 0.5) & (heads >= 1)).alias("relevant"))


# Trust in each place a date is found, best first.
DATE_TRUST = {"sitemap": 0.95, "feed": 0.95, "json_ld": 0.90, "og_published": 0.85, "time": 0.80, "meta": 0.75,
              "json_ld_modified": 0.60, "og_modified": 0.55, "time_text": 0.60}


def publication_dates(nodes: DataFrame, as_of: datetime) -> DataFrame:
    """(page_id, raw, published, confidence, origin): the most trusted date that can be read; none is invented."""
    prop, name = F.lower(_attr("property")), F.lower(_attr("name"))
    ld = (F.col("tag") == "script") & _attr("type").contains("ld+json")
    found = {
        "json_ld": F.when(ld, F.get_json_object("text", "$.datePublished")),
        "json_ld_modified": F.when(ld, F.get_json_object("text", "$.dateModified")),
        "og_published": F.when(prop == "article:published_time", _attr("content")),
        "og_modified": F.when(prop == "article:modified_time", _attr("content")),
        "time": F.when(F.col("tag") == "time", F.nullif(_attr("datetime"), F.lit(""))),
        "time_text": F.when(F.col("tag") == "time", F.nullif("text", F.lit(""))),
        "meta": F.when(name.isin("date", "pubdate", "publish-date", "publishdate", "dc.date"), _attr("content")),
    }
    rows = F.array(*[F.struct(F.lit(DATE_TRUST[k]).alias("confidence"), F.lit(k).alias("origin"), v.alias("raw")) for k, v in found.items()])
    flat = nodes.filter(F.col("tag").isin("script", "meta", "time")).select("page_id", "node_id", F.inline(rows)).filter(F.col("raw").isNotNull())
    flat = flat.withColumn("published", dates.parse_any_date(F.col("raw"), as_of)).filter(F.col("published").isNotNull())
    return top_per_key(flat, ["page_id"], [F.desc("confidence"), F.asc("node_id"), F.asc("origin")], 1).drop("node_id")


# Regions that never hold the main text, and lines that end it.
DROPPED_REGIONS = "script|style|nav|header|footer|aside|iframe"
TAIL_LINES = ("تابعنا على|اشترك في|حقوق النشر|جميع الحقوق|اضغط هنا|شارك المقال|للمزيد من الأخبار|"
              r"الرئيسية\s*/|الصفحه\s+الرئيسي|تطبيق")


def main_text(html: Column) -> Column:
    """Paragraphs of the longest article-like container, by pattern."""
    out = html
    for tag in DROPPED_REGIONS.split("|"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")

    def longest(h: Column) -> Column:
        boxes = F.concat(*[F.regexp_extract_all(h, F.lit(p), F.lit(1)) for p in CONTAINERS])
        rank = F.array_sort(F.transform(boxes, lambda b, i: F.struct((-F.length(b)).alias("n"), i.alias("i"), b.alias("b"))))
        body = F.nullif(F.regexp_extract(h, r"(?is)<body[^>]*>(.*?)</body>", 1), F.lit(""))
        return F.coalesce(F.nullif(F.get(rank, 0)["b"], F.lit("")), body, h)

    def text_of(box: Column) -> Column:
        pars = F.transform(F.regexp_extract_all(box, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)),
                           lambda p: F.trim(F.regexp_replace(p, "<[^>]+>", " ")))
        joined = F.array_join(F.filter(pars, lambda p: p != ""), "\n")
        loose = F.trim(F.regexp_replace(F.regexp_replace(box, "<[^>]+>", " "), r"[ \t]+", " "))
        return F.when(joined != "", joined).otherwise(loose)

    return F.regexp_replace(tx.let(tx.let(out, longest), text_of), rf"(?:{TAIL_LINES}).*", "")


CONTAINERS = (
    r"(?is)<article[^>]*>(.*?)</article>",
    r"""(?is)<div[^>]+class=["'][^"']*(?:article|content|post|entry|body)[^"']*["'][^>]*>(.*?)</div>""",
    r"""(?is)<div[^>]+id=["'][^"']*(?:article|content|post|entry|body)[^"']*["'][^>]*>(.*?)</div>""",
    r"(?is)<main[^>]*>(.*?)</main>",
)


def relevant_paragraphs(df: DataFrame, id_col: str, paragraphs: Column, query: Column, t: float = 0.07, most: int = 28, fallback: int = 5,
                        longest: int | None = None):
    """Paragraphs close to the title and description, in page order; the best few when none is close enough.

    Paragraphs over ``longest`` characters are left out if it is given.
    """
    q = F.lower(query)
    base = df.select(id_col, F.posexplode(paragraphs).alias("pos", "paragraph"), tx.char_ngrams(q).alias("qc"), tx.word_bigrams(q).alias("qw"))
    base = base.filter(~pr.noisy_paragraph(F.col("paragraph")) & (F.length("paragraph") >= 45))
    if longest is not None:
        base = base.filter(F.length("paragraph") <= longest)
    low = F.lower("paragraph")
    score = tx.jaccard(F.col("qc"), tx.char_ngrams(low)) * 0.35 + tx.jaccard(F.col("qw"), tx.word_bigrams(low)) * 0.65
    scored = base.select(id_col, "pos", "paragraph", F.round(score, 9).alias("score"))
    # each paragraph is scored once: those close enough come first in page order, or all by score if there are none
    of_page = Window.partitionBy(id_col)
    marked = scored.withColumn("any", F.max("score").over(of_page) >= t)
    near = F.col("score") >= t
    order = [F.when(F.col("any") & ~near, 1).otherwise(0), F.when(F.col("any"), 0.0).otherwise(-F.col("score")), F.asc("pos")]
    ranked = marked.withColumn("rank", F.row_number().over(of_page.orderBy(*order)))
    kept = F.when(F.col("any"), near & (F.col("rank") <= most)).otherwise(F.col("rank") <= fallback)
    return ranked.filter(kept).drop("any")
