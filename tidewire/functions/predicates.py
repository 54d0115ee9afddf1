"""Article predicates and validators over title, url, content and summary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import lexicon as lx
from tidewire.functions import text as tx
from tidewire.functions import url as ux

NOISE_TITLE = r"^\s*[.\-_,:;!?…]{2,}\s*$"
PLACEHOLDER_TITLE = r"^[\s.\-_,:;!?…«»()\[\]{}]{2,}$"
SCRIPTS = ("[؀-ۿ]", "[一-鿿㐀-䶿]", "[Ѐ-ӿ]")
GREEK = "[Ͱ-Ͽ]"
PAGING = r"/page/\d+|/p/\d+|[?&](page|paged|start|offset)=\d+"
SENTENCE_END = r"[.!?؟…]"
SECTION_URL_PATTERN = (
    "/(" + "|".join(lx.SECTION_URL_WORDS) + ")(/|$)|(" + "|".join(lx.SECTION_URL_WORDS) + ")="
)
NOISE_PATTERN = "(?i)" + "|".join(f"(?:{p})" for p in lx.PARAGRAPH_NOISE)


def filled(*cols: Column) -> Column:
    """First of the columns that is not empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def scripts_in(title: Column, *more: str) -> Column:
    return sum((title.rlike(p).cast("int") for p in (*SCRIPTS, *more)), F.lit(0))


def long_words(text: Column, min_len: int) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) >= min_len))


def valid_title(title: Column) -> Column:
    """5-200 characters, 3-30 words, one script, neither noise nor a bare site name."""
    t = F.trim(title)
    low = F.lower(t)
    return F.coalesce(
        F.length(t).between(5, 200) & ~t.rlike(NOISE_TITLE) & ~low.isin("test", "news")
        & tx.word_count(t).between(3, 30) & (scripts_in(t) <= 1) & ~low.isin(lx.SITE_TITLES),
        F.lit(False),
    )


def valid_crawled(title: Column, url: Column, content: Column, summary: Column) -> Column:
    """Light check of a crawled row."""
    t, u, c, s = (F.trim(x) for x in (title, url, content, summary))
    return (
        (F.length(u) >= 10) & ((c != "") | (s != "")) & F.length(t).between(5, 200) & ~t.rlike(NOISE_TITLE)
        & ~F.lower(t).isin("test", "news") & (scripts_in(t) <= 1) & ~F.lower(t).isin(lx.SITE_TITLES)
        & (long_words(filled(c, s), 3) >= 3)
    )


def _reason(*rules: tuple[Column, str]) -> Column:
    out = F.when(rules[0][0], rules[0][1])
    for cond, text in rules[1:]:
        out = out.when(cond, text)
    return out


def url_reason(url: Column) -> Column:
    """First failing URL rule, null when all pass."""
    u = F.trim(url)
    seg = ux.segments(u)
    n, first = F.size(seg), F.coalesce(F.try_element_at(seg, F.lit(1)), F.lit(""))
    return _reason(
        (u == "", "empty URL"), (F.length(u) < 10, "URL too short"), (ux.host(u) == "", "no scheme/host"),
        ((n == 0) | ((n == 1) & first.isin("home")), "homepage URL"),
        (F.lower(ux.path(u)).rlike(SECTION_URL_PATTERN), "category/section/tag URL"),
        (u.rlike(PAGING), "pagination URL"),
    )


def title_reason(title: Column) -> Column:
    t = F.trim(title)
    low = F.lower(t)
    return _reason(
        (t == "", "empty title"), (F.length(t) < 5, "title too short (<5 chars)"),
        (F.length(t) > 200, "title too long (>200 chars)"),
        (t.rlike(PLACEHOLDER_TITLE), "title is punctuation/placeholder only"),
        (low.isin(lx.GENERIC_TITLES), "generic single-word title"), (low.isin(lx.SITE_TITLES_WIDE), "site-name-only title"),
        (low.isin(lx.PUBLISHER_TITLES), "publisher-name-only title"),
        (low.isin(lx.CATEGORY_LABELS), "category-label-only title"),
        (scripts_in(t, GREEK) > 1, "mixed-script title (scraping artifact)"),
    )


def boilerplate_ratio(content: Column) -> Column:
    words = long_words(F.trim(content), 2)
    per = F.least(F.greatest(words / 10, F.lit(1.0)), F.lit(1000.0))
    return F.when(words > 0, tx.hits(F.lower(content), lx.BOILERPLATE) / per).otherwise(0.0)


def link_list(content: Column) -> Column:
    """Many lines, most of them short."""
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return tx.let(lines, lambda x: (F.size(x) > 5) & (
        F.size(F.filter(x, lambda s: F.length(s) < 30)) / F.greatest(F.size(x), F.lit(1)) > 0.7))


def content_reason(content: Column) -> Column:
    c = F.trim(content)
    return _reason(
        (content == "", "empty content"), (F.length(c) < 40, "content too short (<40 chars)"),
        (boilerplate_ratio(content) > 0.5, "content appears to be boilerplate/nav/ads"),
        (long_words(c, 3) < 5, "content has too few real words (<5)"),
        (~c.rlike(SENTENCE_END) & (F.length(c) > 200), "content lacks sentence structure (no terminal punctuation)"),
        (link_list(c), "content appears to be a link list / nav menu"),
    )


def mismatch_reason(title: Column, content: Column) -> Column:
    words = F.filter(F.split(tx.strip_accents(F.lower(title)), r"\s+"), lambda w: F.length(w) >= 4)
    found = tx.let(tx.strip_accents(F.lower(content)), lambda b: F.exists(words, lambda w: b.contains(w)))
    return _reason(((F.size(words) > 0) & ~found, "title words not found in body (title/body mismatch)"))


def reject_reason(title: Column, url: Column, content: Column, summary: Column) -> Column:
    """First failing rule of the news validator, null for a real article."""
    body = filled(F.trim(content), F.trim(summary))
    parts = (("URL", url_reason(url)), ("Title", title_reason(title)), ("Content", content_reason(body)),
             ("Mismatch", mismatch_reason(F.trim(title), body)))
    return F.coalesce(*[F.concat(F.lit(f"{name}: "), r) for name, r in parts])


def failed_rules(title: Column, url: Column, content: Column, summary: Column, image_url: Column) -> Column:
    """Names of all failed required-field rules."""
    body = filled(content, summary)
    rules = [
        ((title == "") | (url == "") | (summary == ""), "required_fields"),
        (tx.word_count(title) < 3, "title_length"),
        (F.length(F.trim(body)) < 40, "content_length"),
        (ux.host(url) == "", "source_url"),
        ((image_url != "") & ~image_url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/|^/"), "image_url"),
        (non_news(title, content, summary), "non_news_entry"),
        (~press_quality(title, content, summary), "press_quality"),
    ]
    return F.filter(F.array(*[F.when(c, n) for c, n in rules]), lambda r: r.isNotNull())


_SUFFIX = r"\s*[-|:—–]?\s*(?:" + "|".join(s.replace(".", r"\.") for s in lx.PUBLISHER_SUFFIXES) + r")\s*$"


def strip_publisher(title: Column) -> Column:
    """Title without a trailing publisher name, unless nothing would be left."""
    low = F.lower(F.trim(title))
    bare = F.trim(F.regexp_replace(low, _SUFFIX, ""))
    return F.when(bare != "", bare).otherwise(low)


def only_section_words(title: Column, vocabulary: list[str], most: int, breaks: str = r"\s+") -> Column:
    words = F.filter(F.split(title, breaks), lambda w: w != "")

    def check(w: Column) -> Column:
        known = F.forall(w, lambda x: F.regexp_replace(x, r"[^\w؀-ۿ]", "").isin(vocabulary))
        return F.size(w).between(1, most) & known

    return tx.let(words, check)


_SECTION_START = r"^(" + "|".join(lx.SECTION_WORDS) + r")(:| \|| –| -| )"
_LABEL_START = r"^(" + "|".join(sorted(lx.NON_NEWS_TITLES, key=len, reverse=True)) + r")(:| \|| –| -)"


def section_title(title: Column) -> Column:
    """A section label, or a section word followed by a short rest."""
    word = F.regexp_extract(title, _SECTION_START, 1)
    rest = F.length(F.trim(F.substring(title, F.length(word) + 1, F.length(title))))
    return ((word != "") & (rest <= 30)) | only_section_words(title, lx.SECTION_WORDS, 6, r"[\s&]+")


def non_news(title: Column, content: Column, summary: Column) -> Column:
    """Section headers, category pages, digests, courses and bare navigation titles."""
    t = F.trim(title)
    low, bare = F.lower(t), strip_publisher(t)
    body = F.trim(F.concat_ws(" ", F.trim(summary), F.trim(content)))
    return (
        (t == "") | ((bare != low) & section_title(bare)) | low.isin(lx.NON_NEWS_TITLES) | low.rlike(_LABEL_START)
        | section_title(low) | tx.any_of(low, lx.ROUNDUPS)
        | tx.any_of(F.lower(F.concat_ws(" ", t, body)), lx.TUTORIALS)
        | ((tx.word_count(t) <= 4) & (F.length(body) < 40))
    )


def press_quality(title: Column, content: Column, summary: Column) -> Column:
    c, s = F.trim(content), F.trim(summary)
    label = only_section_words(strip_publisher(title), lx.PRESS_SECTION_WORDS, 4)
    return ~label & ~((F.length(c) < 80) & (F.length(s) < 60)) & ~((F.length(c) < 300) & ~c.rlike("[.؟!।]"))


def home_feed_ok(title: Column, url: Column, content: Column) -> Column:
    t, u = F.trim(title), F.trim(url)
    seg = ux.segments(u)
    last = F.coalesce(F.try_element_at(seg, F.lit(-1)), F.lit(""))
    return (
        (t != "") & (F.length(u) >= 10) & (F.length(F.trim(content)) >= 50) & ~tx.any_of(F.lower(u), lx.AD_URL_PARTS)
        & ~tx.any_of(t, lx.SECTION_TITLE_PARTS) & (F.size(seg) > 1) & ((F.length(last) >= 6) | last.rlike(r"^\d+$"))
        & (long_words(t, 3) >= 2)
    )


def removable(title: Column, content: Column, url: Column, terms=tuple(lx.INVALID_ARTICLE_PARTS)) -> Column:
    """Article to drop from the store: listed term, short content or a category-like URL."""
    low = F.lower(F.concat_ws("\n", title, content))
    return tx.any_of(low, terms) | (F.length(content) < 100) | (F.size(ux.segments(url)) <= 2)


def noisy_paragraph(par: Column) -> Column:
    p = F.trim(par)
    letters = F.regexp_count(par, F.lit("[0-9A-Za-z؀-ۿﭐ-﷿ﹰ-﻿]"))
    n = F.length(par)
    return (
        p.rlike(NOISE_PATTERN) | ((n > 20) & (letters / n < 0.45))
        | (~par.contains(" ") & par.contains("/") & (n > 30))
    )


# Parts and endings that rule an image URL out.
IMAGE_PARTS = lx.phrases(
    "placeholder|default|spinner|loading|1x1|pixel|thumb_small|svg|favicon|profile-pic|coat-of-arms|watermark|badge|"
    "microsite|ad-banner|ad_banner|/assets/|/images/logos|/static/img/|/static/images/|/graphics/|/advertising/|/ads/|"
    "/banners/"
)
IMAGE_PARTS_STRICT = lx.phrases(
    "logo|banner|avatar|placeholder|default|icon|social|breaking-news|header|footer|sidebar|sponsor|ads|promo|"
    "watermark|thumb_small|svg|pixel|button|spinner|badge|tracking|analytics"
)
NON_IMAGE_END = r"\.(css|js|json|xml|pdf|zip|exe|dll|apk|bin|woff|woff2|ttf|eot|otf|mp3|mp4|webm|php)$"


def valid_image(url: Column, strict: bool = False) -> Column:
    low = F.lower(url)
    ok = low.rlike(r"^https?://" if strict else r"^http") & (F.length(url) >= 15) & ~low.rlike(NON_IMAGE_END)
    return ok & ~tx.any_of(low, IMAGE_PARTS_STRICT if strict else IMAGE_PARTS)


def is_real_news(title: Column, content: Column, summary: Column, url: Column) -> Column:
    """Gate before ranking: no section, digest, course or listing; a body with sentences."""
    low = F.lower(F.concat_ws(" ", title, summary, content))
    c = F.length(content)
    return (
        (title != "") & ~(tx.any_of(low, lx.GATE_SECTIONS) & (F.length(title) <= 60))
        & ~only_section_words(F.lower(title), lx.GATE_SECTIONS, 6, r"[^\p{L}\p{N}]+")
        & ~tx.any_of(low, lx.ROUNDUPS) & ~tx.any_of(low, lx.GATE_TUTORIALS)
        & ~((c < 120) & (F.length(summary) < 60)) & ~(~content.rlike("[.؟!।]") & (c < 300))
        & ~tx.any_of(F.lower(url), lx.GATE_URL_PARTS)
    )
