"""URL expressions. Parts are cut by pattern, so odd characters never fail a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY_PATTERN = r"^[^?#]*\?([^#]*)"

# Hosts, path parts and endings that never hold an article.
SOCIAL_HOSTS = (
    "facebook.com twitter.com x.com instagram.com youtube.com linkedin.com pinterest.com tiktok.com t.co "
    "bit.ly goo.gl apps.apple.com play.google.com telegram.org t.me chat.whatsapp.com wa.me reddit.com "
    "snapchat.com discord.com discord.gg slack.com"
).split()
FILE_ENDINGS = (
    ".css .js .json .xml .png .jpg .jpeg .gif .svg .webp .ico .pdf .zip .exe .dll .apk .bin .woff .woff2 .ttf "
    ".eot .otf .mp3 .mp4 .webm .php"
).split()
SECTION_NAMES = (
    "الأخبار أخبار تقنية تكنولوجيا اقتصاد اقتصادية أعمال سياسة رياضة فن ثقافة منوعات عالم دولي محليات محلي صحة "
    "علوم سفر سياحة ألعاب تعليم حوادث ميديا فيديو صور عاجل حصري رأي مقالات تحقيقات البطولات بطولات الدوري كأس "
    "news sports business tech technology world health science culture entertainment opinion analysis review "
    "lifestyle travel fashion food finance economy league tournament cup match standings"
).split()
SECTION_INDEX = SECTION_NAMES + "أسود section sections topic topics rubric home index".split()
NON_ARTICLE_PARTS = (
    "wp-admin wp-content wp-includes wp-json xmlrpc feed tag tags categories category author search weather "
    "prayer privacy terms contact about login register signup signin logout subscribe donate advertise jobs "
    "careers press sitemap rss widgets ads promo sponsor banner popup classified opinions weather-forecast "
    "prayer-times live program programcategory sportcategory almaraatv aljarida video videos multimedia gallery "
    "photos opinion livestream live-tv tv radio podcast writer admin mondial pollsarchive details cdn-cgi "
    "newsletter latest-news most-read trending popular team teams staff فريق-العمل فريق-التحرير مواقيت-الصلاة "
    "اوقات-الصلاة أوقات-الصلاة home index archive archives page pages section sections topic topics rubric "
    "rubriques 포럼 섹션 카테고리"
).split() + SECTION_NAMES
SLUG_STOP_WORDS = (
    "من في على إلى عن مع هذا هذه ذلك أن إن لا ما هو هي كان كانت تم تمت بين بعد قبل خلال ثم قد كل أو أم الذي "
    "التي الذين عبر إثر منذ لقد حيث كيف متى أين سوف بسبب حتى معا أيضا "
    "the and for with that this from was were been have has had not but they our your him her its their what "
    "which who whom when where why how all any both each few more most some such than too very just also into "
    "over under again once then here"
).split()
TRACKING_PATTERN = r"utm_source=|utm_medium=|ref=|share=|track="
ACCOUNT_PATTERN = r"/login|/signup|/account"

NON_ARTICLE_PATTERN = "/(" + "|".join(NON_ARTICLE_PARTS) + ")|(" + "|".join(NON_ARTICLE_PARTS) + ")$"
FILE_PATTERN = "(" + "|".join("\\" + e for e in FILE_ENDINGS) + r")$|\.php"
LISTING_PATTERN = (
    "authors?/|user/|profile/|tags?/|category/|categories/|query=|login|signup|newsletter|latest-news|"
    "most-read|trending|popular"
)

# Publisher name by a part of the host, first match wins.
PUBLISHER_NAMES = (
    ("hespress", "هسبريس"), ("le360", "Le360"), ("alyaoum24", "اليوم 24"), ("almountakhab", "المنتخب"),
    ("chouftv", "شوف تيفي"), ("febrayer", "فبراير"), ("rue20", "زنقة 20"), ("barlamane", "برلمان.كوم"),
    ("al3omk", "العمق المغربي"), ("ifada", "إفادة"), ("aljazeera", "الجزيرة"), ("alarabiya", "العربية"),
    ("skynews", "سكاي نيوز"), ("bbc", "BBC عربي"), ("france24", "فرانس 24"),
)


def host(url: Column) -> Column:
    """Lower-case host without ``www.``; empty when there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST_PATTERN, 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH_PATTERN, 1)


def decode(part: Column) -> Column:
    """Percent-decoding that leaves the text as it is when it is not decodable."""
    return F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def domain_or_url(url: Column) -> Column:
    return F.coalesce(F.nullif(host(url), F.lit("")), url)


def publisher_name(domain: Column) -> Column:
    low = F.lower(domain)
    out = F.when(low.contains(PUBLISHER_NAMES[0][0]), PUBLISHER_NAMES[0][1])
    for part, name in PUBLISHER_NAMES[1:]:
        out = out.when(low.contains(part), name)
    return out.when(domain != "", domain).otherwise("مصدر إخباري")


def display_source(source_name: Column, source_url: Column, url: Column) -> Column:
    """Publisher when known, else the domain of the source or article URL."""
    best = F.when(F.coalesce(source_url, F.lit("")) != "", source_url).otherwise(url)
    return F.when(F.coalesce(source_name, F.lit("")) != "", source_name).otherwise(domain_or_url(best))


def canonical(url: Column) -> Column:
    """Host lower-cased without ``www.``, empty path parts dropped, ``utm_*`` parameters and fragment dropped."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    clean_path = F.array_join(F.transform(segments(u), decode), "/")
    params = F.filter(
        F.split(F.regexp_extract(u, QUERY_PATTERN, 1), "&"),
        lambda p: (p != "") & ~F.lower(p).startswith("utm_"),
    )
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    built = F.concat(scheme, F.lit("://"), host(u), F.lit("/"), clean_path, query)
    return F.when(host(u) != "", built).otherwise(F.regexp_replace(u, r"\s+", " "))


def url_key(url: Column) -> Column:
    """Identity of an article URL."""
    return F.sha2(canonical(url), 256)


def is_article_url(url: Column) -> Column:
    low = F.lower(url)
    seg = segments(url)
    n, first = F.size(seg), F.coalesce(F.get(seg, 0), F.lit(""))
    p = F.lower(path(url))
    joined = F.lower(F.concat(F.lit("/"), F.array_join(F.transform(seg, decode), "/")))
    index_names = F.array(*[F.lit(s) for s in SECTION_INDEX])
    tail = F.when(n <= 2, F.transform(seg, F.lower)).otherwise(F.array().cast("array<string>"))
    digits = F.size(F.filter(seg, lambda s: s.rlike(r"^\d+$")))
    bad = (
        host(url).isin(SOCIAL_HOSTS)
        | (low.rlike(TRACKING_PATTERN) & low.rlike(ACCOUNT_PATTERN))
        | p.rlike(FILE_PATTERN)
        | p.rlike(NON_ARTICLE_PATTERN)
        | joined.rlike(NON_ARTICLE_PATTERN)
        | F.arrays_overlap(tail, index_names)
        | (n == 0)
        | ((n == 1) & (F.length(first) < 10))
        | p.rlike(LISTING_PATTERN)
        | ((n >= 2) & (digits == n - 1) & (F.length(first) < 5))
    )
    return F.coalesce(url.startswith("http") & (host(url) != "") & ~bad, F.lit(False))


def category_hint(url: Column, default: str = "general") -> Column:
    seg = segments(url)
    first = F.lower(F.try_element_at(seg, F.lit(1)))
    ok = (F.size(seg) > 1) & F.length(first).between(3, 14) & ~first.rlike(r"^\d+$") & ~first.contains("-")
    return F.when(ok, first).otherwise(default)


def date_hint(url: Column) -> Column:
    """``yyyy-mm-dd`` style parts of the path: a year and the short numbers that follow it."""
    seg = segments(url)
    year_at = F.array_position(F.transform(seg, lambda s: s.rlike(r"^20\d{2}$")), True).cast("int")
    after = F.slice(seg, F.greatest(year_at, F.lit(1)), F.size(seg))
    dated = F.filter(after, lambda s: s.rlike(r"^(20\d{2}|\d{1,2})$"))
    return F.when(year_at > 0, F.array_join(dated, "-")).otherwise("")


def slug_words(url: Column) -> Column:
    """Content words of the last path part."""
    last = decode(F.split(F.coalesce(F.try_element_at(segments(url), F.lit(-1)), F.lit("")), r"\.")[0])
    clean = F.lower(F.regexp_replace(F.regexp_replace(last, r"[-_+\s]+", " "), r"[^A-Za-z0-9_؀-ۿ ]", ""))
    stop = F.array(*[F.lit(w) for w in SLUG_STOP_WORDS])
    return F.filter(
        F.split(clean, " "),
        lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w) & ~w.rlike(r"^\d+$"),
    )


def priority(url: Column, default_category: str = "general") -> Column:
    """News priority of a URL, 0 to 10."""
    low, hint, n_slug = F.lower(url), date_hint(url), F.size(slug_words(url))

    def plus(cond, points):
        return F.when(cond, F.lit(float(points))).otherwise(0.0)

    score = (
        F.lit(5.0)
        + plus(hint != "", 2) + plus(hint.rlike("2025|2026"), 1)
        + plus(low.rlike("breaking|urgent|عاجل"), 2) + plus(low.rlike("news|خبر|أخبار"), 0.5)
        + plus(category_hint(url, default_category).isin("politics", "world", "business", "sports"), 1)
        + plus(F.size(segments(url)).between(3, 5), 0.5)
        + F.when(n_slug >= 4, 1.0).when(n_slug < 2, -1.5).otherwise(0.0)
    )
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(10.0))


def resolve_image(raw: Column, page_url: Column) -> Column:
    """Absolute http(s) image URL, resolved against its page; empty when it is not a web URL."""
    value = F.trim(raw)
    for old, new in (("&amp;", "&"), ("&#x2F;", "/"), ("&quot;", '"'), ("\\/", "/")):
        value = F.replace(value, F.lit(old), F.lit(new))
    base = F.regexp_extract(page_url, r"^(https?)://[^/?#]+", 0)
    scheme = F.regexp_extract(page_url, r"^(https?):", 1)
    folder = F.regexp_replace(F.regexp_extract(page_url, r"^https?://[^?#]*", 0), r"^(https?://[^/]+)$", "$1/")
    folder = F.regexp_extract(folder, r"^(https?://.*/)", 1)
    return (
        F.when(value == "", "")
        .when(value.rlike(r"^https?://[^/?#]+"), value)
        .when(value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "")
        .when(base == "", "")
        .when(value.startswith("//"), F.concat(scheme, F.lit(":"), value))
        .when(value.startswith("/"), F.concat(base, value))
        .otherwise(F.concat(folder, F.regexp_replace(value, r"^(\./)+", "")))
    )
