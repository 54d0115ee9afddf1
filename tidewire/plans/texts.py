"""Scalar text functions and scores over the articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import lexicon as lx
from tidewire.functions import scores as sc
from tidewire.functions import text as tx
from tidewire.functions import url as ux
from tidewire.functions import predicates as pr
from tidewire.plans import sqltext as sq
from tidewire.plans.views import ART, wide_articles as articles
from tidewire.registry import query

C = F.col


def joined(arr):
    return F.array_join(arr, " ")


def sql_joined(arr):
    return f"array_to_string({arr}, ' ')"


@query("arabic_normal_form", f"WITH {ART} SELECT id, md5({sq.normalize('content')}) AS h FROM art")
def _(t):
    return articles(t).select("id", F.md5(tx.normalize(C("content"))).alias("h"))


@query("search_normal_form", f"""WITH {ART} SELECT id, array_to_string(list_filter(string_split({sq.normalize('title')}, ' '),
  lambda w: w <> '' AND w NOT IN {sq.inn(lx.ARABIC_STOP)}), ' ') AS norm FROM art""")
def _(t):
    return articles(t).select("id", tx.normalize_for_search(C("title")).alias("norm"))


@query("significant_words", f"WITH {ART} SELECT id, {sql_joined(sq.significant('title'))} AS words FROM art")
def _(t):
    return articles(t).select("id", joined(F.array_sort(tx.significant_words(C("title")))).alias("words"))


@query("token_counts", f"""WITH {ART} SELECT id, CAST(len({sq.tokens('content')}) AS INT) AS n_tokens,
  CAST(len(list_filter(regexp_split_to_array(content, '[^\\pL]+'), lambda w: w <> '')) AS INT) AS n_letter_tokens FROM art""")
def _(t):
    return articles(t).select("id", F.size(tx.tokens(C("content"))).alias("n_tokens"),
                              F.size(tx.letter_tokens(C("content"))).alias("n_letter_tokens"))


@query("sentence_and_paragraph_counts")
def _(t):
    return articles(t).select("id", F.size(tx.sentences(C("content"))).alias("n_sentences"),
                              F.size(tx.marked_sentences(C("content"))).alias("n_marked"),
                              F.size(tx.paragraphs(C("content"), 20, r"\n{2,}")).alias("n_paragraphs"))


@query("whitespace_normal_form", f"""WITH {ART} SELECT id, md5({sq.squeeze('content')}) AS h,
  md5(regexp_replace(content, '[ \\t\\r\\f\\x0B]+', ' ', 'g')) AS kept_lines,
  md5(regexp_replace(content, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g')) AS printable FROM art""")
def _(t):
    c = C("content")
    return articles(t).select("id", F.md5(tx.squeeze(c)).alias("h"), F.md5(tx.squeeze_keep_lines(c)).alias("kept_lines"),
                              F.md5(tx.strip_control(c)).alias("printable"))


@query("article_fingerprints", f"""WITH {ART} SELECT id, md5({sq.fingerprint_form('title')}) AS title_fp,
  md5({sq.fingerprint_form('content')}) AS content_fp, md5({sq.host('url')} || lower({sq.path('url')})) AS url_fp FROM art""")
def _(t):
    u = C("url")
    return articles(t).select("id", tx.title_fingerprint(C("title")).alias("title_fp"),
                              tx.content_fingerprint(C("content")).alias("content_fp"),
                              tx.url_fingerprint(ux.host(u), ux.path(u)).alias("url_fp"))


@query("edge_fingerprint", f"""WITH {ART}, w AS (SELECT id, {sq.words('lower(content)')} AS w FROM art)
SELECT id, md5(CASE WHEN len(w) <= 100 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:50], ' ') || ' ' ||
  array_to_string(w[-50:], ' ') END) AS fp FROM w""")
def _(t):
    return articles(t).select("id", F.md5(tx.edge_fingerprint(C("content"))).alias("fp"))


_WORDSET = """list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(content), '\\s+'),
  lambda w: regexp_replace(w, '[!-/:-@\\[-`{-~]', '', 'g')), lambda w: length(w) >= 3)))"""


@query("word_set_fingerprint", f"""WITH {ART}, w AS (SELECT id, {_WORDSET} AS w FROM art)
SELECT id, CAST(len(w) AS INT) AS n, md5(array_to_string(w, ' ')) AS fp, md5(array_to_string(w[1:50], ' ')) AS short_fp FROM w""")
def _(t):
    w = tx.word_set(C("content"))
    return articles(t).select("id", F.size(w).alias("n"), F.md5(joined(w)).alias("fp"),
                              F.md5(joined(tx.word_set(C("content"), 50))).alias("short_fp"))


@query("ngram_sets", f"""WITH {ART}, l AS (SELECT id, lower(title) AS s, {sq.words('lower(title)', 2)} AS w FROM art)
SELECT id, CASE WHEN length(s) >= 3 THEN CAST(len(list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))) AS INT) ELSE 0 END AS n_char,
  CASE WHEN len(w) >= 2 THEN CAST(len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS INT) ELSE 0 END AS n_word
FROM l""")
def _(t):
    low = F.lower("title")
    return articles(t).select("id", F.size(tx.char_ngrams(low)).alias("n_char"), F.size(tx.word_bigrams(low)).alias("n_word"))


_SENT_WORDS = f"list_filter(regexp_split_to_array(regexp_replace(content, {sq.q(tx.NON_WORD)}, ' ', 'g'), '\\s+'), lambda w: length(w) >= 2)"


def _balance(p, n):
    return f"CASE WHEN {p} + {n} > 0 THEN CAST({p} - {n} AS DOUBLE) / ({p} + {n}) ELSE 0.0 END"


def _count(w, words):
    return f"CAST(len(list_filter({w}, lambda x: x IN {sq.inn(words)})) AS INT)"


def _prefixes(terms):
    return "^(?:" + "|".join(t if len(t) >= 4 else t + "$" for t in terms) + ")"


_OCC = [(t, v, f"(length(l) - length(replace(l, {sq.q(t)}, ''))) / CAST({len(t)} AS DOUBLE)")
        for t, v in lx.WEIGHTED_SENTIMENT.items()]
_CODES = (f"array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(lower({sq.normalize('content')}), '\\s+'), "
          f"lambda w: regexp_replace(w, {sq.q(sc.NON_WORD_CHARS)}, '', 'g')), lambda w: w <> ''), lambda w: CASE WHEN w IN {sq.inn(lx.NEGATORS)} THEN 'n' "
          f"WHEN regexp_matches(w, {sq.q(_prefixes(lx.PREFIX_POSITIVE))}) THEN '+' "
          f"WHEN regexp_matches(w, {sq.q(_prefixes(lx.PREFIX_NEGATIVE))}) THEN '-' ELSE '' END), '')")


@query("sentiment_scores", f"""WITH {ART}, s AS (SELECT id, content, {_SENT_WORDS} AS w,
  regexp_split_to_array(lower(content), '[^\\pL\\pN]+') AS m, lower(content) AS l, {_CODES} AS codes FROM art),
n AS (SELECT *, {_count('w', lx.POSITIVE)} AS p1, {_count('w', lx.NEGATIVE)} AS n1,
  {_count('m', lx.MULTI_POSITIVE)} AS p2, {_count('m', lx.MULTI_NEGATIVE)} AS n2,
  {' + '.join(o for _, _, o in _OCC)} AS wn, {' + '.join(f'{o} * CAST({v} AS DOUBLE)' for _, v, o in _OCC)} AS wt,
  len(regexp_extract_all(codes, 'n\\+')) AS np, len(regexp_extract_all(codes, 'n-')) AS nn,
  length(codes) - length(replace(codes, '+', '')) AS ap, length(codes) - length(replace(codes, '-', '')) AS an FROM s)
SELECT id, {_balance('p1', 'n1')} AS plain, {_balance('p2', 'n2')} AS multilingual,
  {_balance('(ap - np + nn)', '(an - nn + np)')} AS negated,
  CASE WHEN wn > 0 THEN least(greatest(wt / wn, -1.0), 1.0) ELSE 0.0 END AS weighted,
  CASE WHEN regexp_matches(l, 'فوز|win') AND NOT regexp_matches(l, 'خسارة|loss') THEN CAST(0.8 AS DOUBLE)
   WHEN NOT regexp_matches(l, 'فوز|win') AND regexp_matches(l, 'خسارة|loss') THEN CAST(-0.8 AS DOUBLE) ELSE 0.0 END AS flag FROM n""")
def _(t):
    c = C("content")
    return articles(t).select(
        "id", sc.sentiment(c).alias("plain"), sc.sentiment_multilingual(c).alias("multilingual"),
        sc.sentiment_negated(c).alias("negated"), sc.sentiment_weighted(c).alias("weighted"),
        sc.sentiment_flag(c).alias("flag"))


@query("clickbait_scores", f"""WITH {ART}, w AS (SELECT id, title, lower(title) AS l, regexp_split_to_array(title, '\\s+') AS w FROM art)
SELECT id, CASE WHEN title = '' THEN 0.0 ELSE {sq.clamp(sq.points(
    *[(f"regexp_matches(l, {sq.q(p)})", 0.2) for p in lx.SPAM_PATTERNS],
    ("len(list_filter(range(1, length(l) - 3), lambda i: substr(l, i, 5) = repeat(substr(l, i, 1), 5))) > 0", 0.2),
    ("len(regexp_extract_all(title, '[!?؟]')) > 3", 0.3),
    ("len(w) > 3 AND 1 - len(list_distinct(w)) / len(w) > 0.5", 0.3)))} END AS score FROM w""")
def _(t):
    return articles(t).select("id", sc.clickbait(C("title")).alias("score"))


_TW = "list_filter(regexp_split_to_array(lower(title), '[^\\pL]+'), lambda w: length(w) > 3)"
_MATCH = (f"CASE WHEN title = '' OR content = '' THEN 0.0 WHEN len({_TW}) = 0 THEN 0.5 ELSE "
          f"CAST(len(list_filter({_TW}, lambda w: contains(lower(content), w))) AS DOUBLE) / len({_TW}) END")


@query("headline_findings", f"""WITH {ART}, h AS (SELECT id, title, {sq.hits('lower(title)', lx.SENSATIONAL)} AS s,
  {sq.hits('lower(title)', lx.CLICKBAIT)} AS c, {_MATCH} AS m, len({_TW}) AS tw FROM art)
SELECT id, least(s / 5.0, 1.0)::DOUBLE AS sensationalism, least(c / CAST(3 AS DOUBLE), 1.0) AS clickbait, s / 5.0 > 0.4 AS is_sensational,
  c > 0 AS is_clickbait, suffix(title, '?') AS is_question, {sq.any_of('lower(title)', lx.ABSOLUTES)} AS has_exaggeration,
  tw > 0 AND m < 0.3 AS mismatch FROM h""")
def _(t):
    art = articles(t).select("id", sc.headline(C("title"), C("content")).alias("h"))
    return art.select("id", "h.*")


@query("title_body_match", f"WITH {ART} SELECT id, {_MATCH} AS match FROM art")
def _(t):
    return articles(t).select("id", sc.title_body_match(C("title"), C("content")).alias("match"))


_ACTION = f"coalesce(list_filter({sq.lst(lx.ACTION_VERBS)}, lambda v: contains(lower(content), v))[1], '')"


@query("event_specificity", f"""WITH {ART}, a AS (SELECT id, {_ACTION} AS action, title, published_at FROM art)
SELECT id, action, {sq.points(("action <> ''", 0.2), ("title <> ''", 0.2), ("published_at IS NOT NULL", 0.2))} AS specificity FROM a""")
def _(t):
    action = sc.first_action(C("content"))
    return articles(t).select("id", action.alias("action"), sc.specificity(
        action, C("title"), C("published_at").cast("string")).alias("specificity"))


_IMP = "CASE category " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in lx.CATEGORY_IMPORTANCE.items()) + " ELSE 0.05 END"


@query("importance_scores", f"""WITH {ART} SELECT id, round({sq.clamp(_IMP + ' + ' + sq.points(
    ("length(title) > 30", 0.1), ("length(title) > 60", 0.1), ("length(content) > 200", 0.1), ("length(content) > 500", 0.1),
    ("length(content) > 1000", 0.1)) + " + least(len(regexp_extract_all(content, '[0-9]{2,}')) * 0.05, 0.2)")}, 6) AS importance FROM art""")
def _(t):
    return articles(t).select("id", F.round(sc.importance(C("title"), C("content"), C("category")), 6).alias("importance"))


_WHOLE = "title || ' ' || summary || ' ' || content"


@query("article_quality", f"""WITH {ART} SELECT id, round({sq.clamp(sq.points(
    ("length(title) >= 25", 0.25), ("length(summary) >= 35", 0.15), ("length(content) >= 180", 0.35),
    ("length(content) >= 500", 0.10), (f"regexp_matches({_WHOLE}, '[.؟]')", 0.10),
    ("length(title) < 18 OR length(content) < 80", -0.35)) + f" - {sq.hits(f'lower({_WHOLE})', lx.QUALITY_BLOCKED)} * 0.35")}, 6) AS quality,
  {sq.points((f"len({sq.words('title')}) >= 5", 1), (f"len({sq.words('title')}) >= 8", 1), ("length(content) >= 100", 1),
             ("length(content) >= 300", 1), ("length(content) >= 600", 1), ("length(summary) >= 80", 1),
             ("published_at IS NOT NULL", 0.5))} AS keep_score,
  {sq.points(("length(content) > 200", 4), ("length(summary) > 50", 2), ("source_name <> ''", 1))} AS group_score FROM art""")
def _(t):
    none = F.lit(None).cast("string")
    return articles(t).select(
        "id", F.round(sc.article_quality(C("title"), C("content"), C("summary")), 6).alias("quality"),
        sc.dedup_quality(C("title"), C("content"), C("summary"), none, C("published_at")).alias("keep_score"),
        sc.group_quality(C("content"), C("summary"), none, C("source_name"), F.lit(0.0)).alias("group_score"))


def _marker(words):
    return f"len(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w IN {sq.inn(words)}))"


@query("language_labels", f"""WITH {ART}, s AS (SELECT id, language, len(regexp_extract_all(content, '[؀-ۿ]')) AS ar,
  {', '.join(f'{_marker(m)} AS {code}' for code, m in tx.LANGUAGES)} FROM art), b AS (SELECT *, greatest(ar, fr, en, de, es) AS best FROM s)
SELECT id, language, CASE WHEN best <= 0 THEN 'und' WHEN ar = best THEN 'ar' WHEN fr = best THEN 'fr' WHEN en = best THEN 'en'
  WHEN de = best THEN 'de' ELSE 'es' END AS detected, (ar > 0)::INT + (fr > 0)::INT + (en > 0)::INT >= 2 AS mixed FROM b""")
def _(t):
    s = articles(t).select("id", "language", tx.language_scores(C("content")).alias("s"))
    return s.select("id", "language", tx.language_label(C("s")).alias("detected"), tx.is_mixed_language(C("s")).alias("mixed"))


@query("script_labels", f"""WITH {ART}, s AS (SELECT id, title, len(regexp_extract_all(title, '[؀-ۿ]')) AS ar, len(regexp_extract_all(title, '[A-Za-z]')) AS la FROM art)
SELECT id, CASE WHEN title = '' OR ar >= la THEN 'ar' ELSE 'en' END AS script,
  title = '' OR ar >= greatest(1, floor(length(title) * 0.6)) AS arabic FROM s""")
def _(t):
    return articles(t).select("id", tx.arabic_or_latin(C("title")).alias("script"), tx.is_arabic(C("title")).alias("arabic"))


@query("reading_time", f"""WITH {ART} SELECT id, CAST(len({sq.words('content')}) AS INT) AS words,
  CAST(greatest(1, floor(len({sq.words('content')}) / 180.0)) AS INT) AS minutes FROM art""")
def _(t):
    return articles(t).select("id", tx.word_count(C("content")).alias("words"), tx.reading_minutes(C("content")).alias("minutes"))


_ENT = "{}"
for _name, _char in tx.ENTITIES:
    _ENT = f"replace({_ENT}, {sq.q(_name)}, {sq.q(_char)})"


def _html_text(col):
    out = col
    for p in ("<script\\b[^>]*>.*?</script>", "<style\\b[^>]*>.*?</style>", "<!--.*?-->"):
        out = f"regexp_replace({out}, '{p}', ' ', 'gis')"
    out = f"regexp_replace({out}, '<(?:{tx.BLOCK_TAGS})[^>]*>', E'\\n', 'gi')"
    out = _ENT.replace("{}", f"regexp_replace({out}, '<[^>]+>', ' ', 'g')")
    return f"regexp_replace({out}, '[ \\t]+', ' ', 'g')"


@query("page_plain_text", f"SELECT page_id, md5({_html_text('html')}) AS h, CAST(length({_html_text('html')}) AS INT) AS n FROM pages")
def _(t):
    text = tx.html_text(C("html"))
    return t.pages.select("page_id", F.md5(text).alias("h"), F.length(text).alias("n"))


@query("sanitized_fields", "SELECT event_id, substr(trim(props), 1, 8) AS props, substr(trim(event_type), 1, 5) AS kind FROM events")
def _(t):
    return t.events.select("event_id", tx.sanitize(C("props"), 8).alias("props"), tx.sanitize(C("event_type"), 5).alias("kind"))


@query("nation_distances", """WITH p AS (SELECT n_nationkey AS id, n_nationkey * 3.0 - 30 AS lat, n_nationkey * 7.0 - 80 AS lon FROM nation),
c AS (SELECT c_custkey, p.* FROM customer JOIN p ON c_nationkey = id)
SELECT c_custkey, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(31.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(31.0)) *
  pow(sin(radians(-7.0 - lon) / 2), 2))), 4) AS km FROM c""")
def _(t):
    lat, lon = C("c_nationkey") * 3.0 - 30, C("c_nationkey") * 7.0 - 80
    return t.customer.select("c_custkey", F.round(tx.haversine_km(lat, lon, F.lit(31.0), F.lit(-7.0)), 4).alias("km"))


@query("category_ids", f"""WITH {ART} SELECT id, CASE category WHEN 'economy' THEN 'economy' WHEN 'technology' THEN 'technology' ELSE category END AS category,
  CASE language WHEN 'en' THEN 'sports' WHEN 'fr' THEN 'economy' ELSE 'general' END AS mapped FROM art""")
def _(t):
    raw = F.when(C("language") == "en", "sport").when(C("language") == "fr", "markets").otherwise("world")
    return articles(t).select("id", tx.category_id(C("category")).alias("category"), tx.category_id(raw).alias("mapped"))


@query("clean_titles", f"""WITH {ART} SELECT id, {sq.squeeze('title')} AS title,
  md5({sq.squeeze("regexp_replace(summary, '\\s*#\\w+(?:\\s*#\\w+)*\\s*', ' ', 'g')")}) AS summary FROM art""")
def _(t):
    return articles(t).select("id", tx.clean_title(C("title")).alias("title"), F.md5(tx.clean_sentence(C("summary"))).alias("summary"))


@query("metadata_check", "SELECT event_id, CASE WHEN json_valid(props) THEN props END AS props FROM events")
def _(t):
    return t.events.select("event_id", tx.valid_metadata(C("props")).alias("props"))


# --- predicates -----------------------------------------------------------------------



@query("valid_titles", f"""WITH {ART}, x AS (SELECT id, trim(title) AS t FROM art)
SELECT id FROM x WHERE length(t) BETWEEN 5 AND 200 AND NOT regexp_matches(t, {sq.q(pr.NOISE_TITLE)}) AND lower(t) NOT IN ('test', 'news')
  AND len({sq.words('t')}) BETWEEN 3 AND 30 AND lower(t) NOT IN {sq.inn(lx.SITE_TITLES)}
  AND {' + '.join(f"regexp_matches(t, {sq.q(p)})::INT" for p in pr.SCRIPTS)} <= 1""")
def _(t):
    return articles(t).filter(pr.valid_title(C("title"))).select("id")


@query("valid_crawled_rows", f"""WITH {ART}, x AS (SELECT *, trim(title) AS t, CASE WHEN trim(content) <> '' THEN trim(content) ELSE trim(summary) END AS b FROM art)
SELECT id FROM x WHERE length(url) >= 10 AND b <> '' AND length(t) BETWEEN 5 AND 200 AND NOT regexp_matches(t, {sq.q(pr.NOISE_TITLE)})
  AND lower(t) NOT IN ('test', 'news') AND lower(t) NOT IN {sq.inn(lx.SITE_TITLES)}
  AND len(list_filter(regexp_split_to_array(b, '\\s+'), lambda w: length(w) >= 3)) >= 3""")
def _(t):
    return articles(t).filter(pr.valid_crawled(C("title"), C("url"), C("content"), C("summary"))).select("id")


_LINES = "list_filter(list_transform(string_split(b, E'\\n'), lambda l: trim(l)), lambda l: l <> '')"
_LW2 = "len(list_filter(regexp_split_to_array(b, '\\s+'), lambda w: length(w) >= 2))"
_REASON = f"""coalesce('URL: ' || {sq.ladder(
    ("u = ''", "empty URL"), ("length(u) < 10", "URL too short"), (f"{sq.host('u')} = ''", "no scheme/host"),
    (f"len({sq.segments('u')}) = 0 OR (len({sq.segments('u')}) = 1 AND {sq.segments('u')}[1] = 'home')", "homepage URL"),
    (f"regexp_matches(lower({sq.path('u')}), {sq.q(pr.SECTION_URL_PATTERN)})", "category/section/tag URL"),
    (f"regexp_matches(u, {sq.q(pr.PAGING)})", "pagination URL"))},
  'Title: ' || {sq.ladder(
    ("t = ''", "empty title"), ("length(t) < 5", "title too short (<5 chars)"), ("length(t) > 200", "title too long (>200 chars)"),
    (f"regexp_matches(t, {sq.q(pr.PLACEHOLDER_TITLE)})", "title is punctuation/placeholder only"),
    (f"lower(t) IN {sq.inn(lx.GENERIC_TITLES)}", "generic single-word title"),
    (f"lower(t) IN {sq.inn(lx.SITE_TITLES_WIDE)}", "site-name-only title"),
    (f"lower(t) IN {sq.inn(lx.PUBLISHER_TITLES)}", "publisher-name-only title"),
    (f"lower(t) IN {sq.inn(lx.CATEGORY_LABELS)}", "category-label-only title"))},
  'Content: ' || {sq.ladder(
    ("b = ''", "empty content"), ("length(b) < 40", "content too short (<40 chars)"),
    (f"{_LW2} > 0 AND {sq.hits('lower(b)', lx.BOILERPLATE)} / greatest({_LW2} / 10.0, 1) > 0.5", "content appears to be boilerplate/nav/ads"),
    ("len(list_filter(regexp_split_to_array(b, '\\s+'), lambda w: length(w) >= 3)) < 5", "content has too few real words (<5)"),
    (f"NOT regexp_matches(b, {sq.q(pr.SENTENCE_END)}) AND length(b) > 200", "content lacks sentence structure (no terminal punctuation)"),
    (f"len({_LINES}) > 5 AND len(list_filter({_LINES}, lambda l: length(l) < 30)) / len({_LINES}) > 0.7", "content appears to be a link list / nav menu"))},
  'Mismatch: ' || CASE WHEN len({{mw}}) > 0 AND len(list_filter({{mw}}, lambda w: contains({sq.strip_accents('lower(b)')}, w))) = 0
   THEN 'title words not found in body (title/body mismatch)' END)""".replace(
    "{mw}", f"list_filter(regexp_split_to_array({sq.strip_accents('lower(t)')}, '\\s+'), lambda w: length(w) >= 4)")
_TRIMMED = """x AS (SELECT *, trim(title) AS t, trim(url) AS u,
  CASE WHEN trim(content) <> '' THEN trim(content) ELSE trim(summary) END AS b FROM art)"""


@query("validation_reasons", f"WITH {ART}, {_TRIMMED} SELECT id, {_REASON} AS reason FROM x")
def _(t):
    return articles(t).select("id", pr.reject_reason(C("title"), C("url"), C("content"), C("summary")).alias("reason"))


def _only_section(text, vocab, most, breaks="\\s+"):
    w = f"list_filter(regexp_split_to_array({text}, '{breaks}'), lambda w: w <> '')"
    return (f"(len({w}) BETWEEN 1 AND {most} AND len(list_filter({w}, lambda w: regexp_replace(w, '[^\\w؀-ۿ]', '', 'g') "
            f"NOT IN {sq.inn(vocab)})) = 0)")


_BARE = f"CASE WHEN trim(regexp_replace(lower(t), {sq.q(pr._SUFFIX)}, '', 'g')) <> '' THEN trim(regexp_replace(lower(t), {sq.q(pr._SUFFIX)}, '', 'g')) ELSE lower(t) END"


def _section_title(text):
    word = f"regexp_extract({text}, {sq.q(pr._SECTION_START)}, 1)"
    return (f"(({word} <> '' AND length(trim(substr({text}, length({word}) + 1))) <= 30) OR "
            f"{_only_section(text, lx.SECTION_WORDS, 6, '[\\s&]+')})")


_BODY = "trim(trim(summary) || ' ' || trim(content))"
_NON_NEWS = f"""(t = '' OR (bare <> lower(t) AND {_section_title('bare')}) OR lower(t) IN {sq.inn(lx.NON_NEWS_TITLES)}
  OR regexp_matches(lower(t), {sq.q(pr._LABEL_START)}) OR {_section_title('lower(t)')} OR {sq.any_of('lower(t)', lx.ROUNDUPS)}
  OR {sq.any_of(f"lower(t || ' ' || {_BODY})", lx.TUTORIALS)} OR (len({sq.words('t')}) <= 4 AND length({_BODY}) < 40))"""
_PRESS = f"""(NOT {_only_section('bare', lx.PRESS_SECTION_WORDS, 4)} AND NOT (length(trim(content)) < 80 AND length(trim(summary)) < 60)
  AND NOT (length(trim(content)) < 300 AND NOT regexp_matches(trim(content), '[.؟!।]')))"""
_BARED = f"{_TRIMMED}, y AS (SELECT *, {_BARE} AS bare FROM x)"


@query("non_news_entries", f"WITH {ART}, {_BARED} SELECT id, {_NON_NEWS} AS non_news, {_PRESS} AS press_quality FROM y")
def _(t):
    return articles(t).select("id", pr.non_news(C("title"), C("content"), C("summary")).alias("non_news"), pr.press_quality(C("title"), C("content"), C("summary")).alias("press_quality"))


@query("failed_field_rules", f"""WITH {ART}, {_BARED} SELECT id, concat_ws(',',
  CASE WHEN title = '' OR url = '' OR summary = '' THEN 'required_fields' END,
  CASE WHEN len({sq.words('title')}) < 3 THEN 'title_length' END,
  CASE WHEN length(b) < 40 THEN 'content_length' END, CASE WHEN {sq.host('url')} = '' THEN 'source_url' END,
  CASE WHEN {_NON_NEWS} THEN 'non_news_entry' END, CASE WHEN NOT {_PRESS} THEN 'press_quality' END) AS failed FROM y""")
def _(t):
    return articles(t).select("id", F.array_join(pr.failed_rules(C("title"), C("url"), C("content"), C("summary"), F.lit("")), ",").alias("failed"))


@query("home_feed_articles", f"""WITH {ART}, {_TRIMMED}, z AS (SELECT *, {sq.segments('u')} AS seg FROM x)
SELECT id FROM z WHERE t <> '' AND length(u) >= 10 AND length(trim(content)) >= 50 AND NOT {sq.any_of('lower(u)', lx.AD_URL_PARTS)}
  AND NOT {sq.any_of('t', lx.SECTION_TITLE_PARTS)} AND len(seg) > 1 AND (length(seg[-1]) >= 6 OR regexp_matches(seg[-1], '^\\d+$'))
  AND len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: length(w) >= 3)) >= 2""")
def _(t):
    return articles(t).filter(pr.home_feed_ok(C("title"), C("url"), C("content"))).select("id")


@query("kept_after_cleanup", f"""WITH {ART} SELECT id FROM art WHERE NOT ({sq.any_of("lower(title || E'\\n' || content)", lx.INVALID_ARTICLE_PARTS)}
  OR length(content) < 100 OR len({sq.segments('url')}) <= 2)""")
def _(t):
    return articles(t).filter(~pr.removable(C("title"), C("content"), C("url"))).select("id")


_NOISY = f"""(regexp_matches(p, {sq.q(pr.NOISE_PATTERN)}) OR (length(p) > 20 AND
  len(regexp_extract_all(p, '[0-9A-Za-z؀-ۿﭐ-﷿ﹰ-﻿]')) / length(p) < 0.45) OR (NOT contains(p, ' ') AND contains(p, '/') AND length(p) > 30))"""


@query("paragraph_noise", f"""WITH {ART}, p AS (SELECT id, unnest(list_filter(list_transform(regexp_split_to_array(content, '\\n+'),
  lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) >= 1)) AS p FROM art)
SELECT id, count(*) AS paragraphs, count(*) FILTER ({_NOISY}) AS noisy FROM p GROUP BY 1""")
def _(t):
    p = articles(t).select("id", F.explode(tx.paragraphs(C("content"))).alias("p"))
    return p.groupBy("id").agg(F.count("*").alias("paragraphs"), F.count_if(pr.noisy_paragraph(C("p"))).alias("noisy"))


@query("real_news_gate", f"""WITH {ART}, g AS (SELECT *, lower({_WHOLE}) AS l FROM art)
SELECT id FROM g WHERE title <> '' AND NOT ({sq.any_of('l', lx.GATE_SECTIONS)} AND length(title) <= 60)
  AND NOT {_only_section('lower(title)', lx.GATE_SECTIONS, 6, '[^\\pL\\pN]+')} AND NOT {sq.any_of('l', lx.ROUNDUPS)}
  AND NOT {sq.any_of('l', lx.GATE_TUTORIALS)} AND NOT (length(content) < 120 AND length(summary) < 60)
  AND NOT (NOT regexp_matches(content, '[.؟!।]') AND length(content) < 300) AND NOT {sq.any_of('lower(url)', lx.GATE_URL_PARTS)}""")
def _(t):
    return articles(t).filter(pr.is_real_news(C("title"), C("content"), C("summary"), C("url"))).select("id")


# --- URLs -----------------------------------------------------------------------------

_SEG = sq.segments("url")
_BAD_URL = f"""({sq.host('url')} IN {sq.inn(ux.SOCIAL_HOSTS)} OR (regexp_matches(lower(url), '{ux.TRACKING_PATTERN}') AND regexp_matches(lower(url), '{ux.ACCOUNT_PATTERN}'))
  OR regexp_matches(lower({sq.path('url')}), {sq.q(ux.FILE_PATTERN)}) OR regexp_matches(lower({sq.path('url')}), {sq.q(ux.NON_ARTICLE_PATTERN)})
  OR len(seg) = 0 OR (len(seg) = 1 AND length(seg[1]) < 10) OR (len(seg) <= 2 AND len(list_filter(seg, lambda s: lower(s) IN {sq.inn(ux.SECTION_INDEX)})) > 0)
  OR regexp_matches(lower({sq.path('url')}), {sq.q(ux.LISTING_PATTERN)})
  OR (len(seg) >= 2 AND len(list_filter(seg, lambda s: regexp_matches(s, '^\\d+$'))) = len(seg) - 1 AND length(seg[1]) < 5))"""
_URLS = f"""urls AS (SELECT 'page' AS kind, page_id AS id, url FROM pages UNION ALL SELECT 'article', id, url FROM art)"""


def _urls(t):
    pages = t.pages.select(F.lit("page").alias("kind"), C("page_id").alias("id"), "url")
    return pages.unionByName(articles(t).select(F.lit("article").alias("kind"), "id", "url"))


@query("article_urls", f"""WITH {ART}, {_URLS}, s AS (SELECT *, {_SEG} AS seg FROM urls)
SELECT kind, id FROM s WHERE starts_with(url, 'http') AND {sq.host('url')} <> '' AND NOT {_BAD_URL}""")
def _(t):
    return _urls(t).filter(ux.is_article_url(C("url"))).select("kind", "id")


_SLUG = f"""list_filter(string_split(lower(regexp_replace(regexp_replace(string_split(coalesce(seg[-1], ''), '.')[1], '[-_+\\s]+', ' ', 'g'),
  '[^A-Za-z0-9_؀-ۿ ]', '', 'g')), ' '), lambda w: length(w) >= 3 AND w NOT IN {sq.inn(ux.SLUG_STOP_WORDS)} AND NOT regexp_matches(w, '^\\d+$'))"""
_PARTS = f"""s AS (SELECT *, {_SEG} AS seg FROM urls), h AS (SELECT *, {_SLUG} AS slug,
  list_position(list_transform(seg, lambda s: regexp_matches(s, '^20\\d{{2}}$')), true) AS y FROM s),
parts AS (SELECT *, CASE WHEN y > 0 THEN array_to_string(list_filter(seg[y:], lambda s: regexp_matches(s, '^(20\\d{{2}}|\\d{{1,2}})$')), '-') ELSE '' END AS hint,
  CASE WHEN len(seg) > 1 AND length(seg[1]) BETWEEN 3 AND 14 AND NOT regexp_matches(seg[1], '^\\d+$') AND NOT contains(seg[1], '-') THEN lower(seg[1]) ELSE 'general' END AS cat FROM h)"""
_PRIORITY = "least(greatest(5.0 + " + sq.points(
    ("hint <> ''", 2), ("regexp_matches(hint, '2025|2026')", 1), ("regexp_matches(lower(url), 'breaking|urgent|عاجل')", 2),
    ("regexp_matches(lower(url), 'news|خبر|أخبار')", 0.5), ("cat IN ('politics', 'world', 'business', 'sports')", 1),
    ("len(seg) BETWEEN 3 AND 5", 0.5), ("len(slug) >= 4", 1), ("len(slug) < 2", -1.5)) + ", 0.0), 10.0)"


@query("url_parts", f"""WITH {ART}, {_URLS}, {_PARTS}
SELECT kind, id, {sq.host('url')} AS host, cat AS category, hint AS date_hint, array_to_string(slug, ' ') AS slug FROM parts""")
def _(t):
    return _urls(t).select("kind", "id", ux.host(C("url")).alias("host"), ux.category_hint(C("url")).alias("category"),
                           ux.date_hint(C("url")).alias("date_hint"), joined(ux.slug_words(C("url"))).alias("slug"))


@query("url_priority", f"WITH {ART}, {_URLS}, {_PARTS} SELECT kind, id, CAST({_PRIORITY} AS DOUBLE) AS priority FROM parts")
def _(t):
    return _urls(t).select("kind", "id", ux.priority(C("url")).alias("priority"))


_PARAMS = "list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))"


@query("canonical_urls", f"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {sq.host('url')} || '/' ||
  array_to_string({_SEG}, '/') || CASE WHEN len({_PARAMS}) > 0 THEN '?' || array_to_string({_PARAMS}, '&') ELSE '' END AS canonical FROM pages""")
def _(t):
    return t.pages.select("page_id", ux.canonical(C("url")).alias("canonical"))


_PUB = "CASE " + " ".join(f"WHEN contains(h, {sq.q(k)}) THEN {sq.q(v)}" for k, v in ux.PUBLISHER_NAMES) + " ELSE h END"


@query("source_names", f"""WITH p AS (SELECT page_id, {sq.host('url')} AS h, url FROM pages)
SELECT page_id, h AS domain, {_PUB} AS publisher, CASE WHEN page_id % 2 = 0 THEN 'Paper' ELSE h END AS display FROM p""")
def _(t):
    name = F.when(C("page_id") % 2 == 0, "Paper").otherwise("")
    return t.pages.select("page_id", ux.domain_or_url(C("url")).alias("domain"), ux.publisher_name(ux.host(C("url"))).alias("publisher"),
                          ux.display_source(name, F.lit(""), C("url")).alias("display"))
