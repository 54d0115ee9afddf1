"""Extraction over the article corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import lexicon as lx
from tidewire.functions import predicates as pr
from tidewire.functions import scores as sc
from tidewire.functions import text as tx
from tidewire.operators import extraction as ex
from tidewire.plans import sqltext as sq
from tidewire.plans.texts import _ACTION, _BARED, _MATCH, _WHOLE
from tidewire.plans.views import ART, wide_articles as articles
from tidewire.registry import query

C = F.col


def joined(arr, sep=" | "):
    return F.array_join(arr, sep)


def _cat_rows(text="lower(content)"):
    rows = ", ".join(
        f"{{'category': '{name}', 'size': {len(lx.phrases(t))}, 'n': {sq.hits(text, lx.phrases(t))}}}"
        for name, t in lx.CATEGORY_TERMS.items())
    return f"list_filter([{rows}], lambda r: r.n > 0)"


def _first_max(rows, key):
    return f"list_filter({rows}, lambda r: {key} = list_max(list_transform({rows}, lambda s: {key.replace('r.', 's.')})))[1]"


_CATS = f"cats AS (SELECT *, {_cat_rows()} AS rows FROM art)"


@query("keyword_category", f"""WITH {ART}, {_CATS}
SELECT id, coalesce({_first_max('rows', 'r.n')}.category, 'general') AS category,
  CASE WHEN len(rows) > 0 THEN round(least(0.5 + CAST({_first_max('rows', 'r.n')}.n AS DOUBLE) / list_sum(list_transform(rows, lambda r: r.n)) * 0.4, 0.95), 6)
   ELSE 0.3 END AS confidence FROM cats""")
def _(t):
    return articles(t).select("id", sc.keyword_category(sc.category_hits(C("content"))).alias("c")).select(
        "id", "c.category", F.round("c.confidence", 6).alias("confidence"))


_SHARE = "CAST(r.n AS DOUBLE) / r.size"


@query("share_category", f"""WITH {ART}, {_CATS}, b AS (SELECT id, {_first_max('rows', _SHARE)} AS b FROM cats)
SELECT id, CASE WHEN coalesce(b.n / b.size < 0.2, true) THEN 'varieties' ELSE b.category END AS category,
  CASE WHEN coalesce(b.n / b.size < 0.2, true) THEN 0.3 ELSE round(CAST(b.n AS DOUBLE) / b.size, 6) END AS confidence,
  CAST(coalesce(b.n, 0) AS INT) AS matched FROM b""")
def _(t):
    return articles(t).select("id", sc.weighted_share_category(sc.category_hits(C("content"))).alias("c")).select(
        "id", "c.category", F.round("c.confidence", 6).alias("confidence"), F.size("c.matched").alias("matched"))


_FLAG = "(CASE WHEN r.category IN ('sport', 'politics', 'tech') THEN 3 ELSE 2 END)"


@query("flag_category", f"""WITH {ART}, {_CATS}
SELECT id, coalesce({_first_max('rows', _FLAG)}.category, 'general') AS category,
  CASE WHEN len(rows) > 0 THEN round(least(0.5 + CAST(list_max(list_transform(rows, lambda r: {_FLAG})) AS DOUBLE) /
   list_sum(list_transform(rows, lambda r: {_FLAG})) * 0.4, 0.95), 6) ELSE 0.3 END AS confidence FROM cats""")
def _(t):
    return articles(t).select("id", sc.flag_category(sc.category_hits(C("content"))).alias("c")).select(
        "id", "c.category", F.round("c.confidence", 6).alias("confidence"))


def _word_score(name):
    single = [w for w in lx.phrases(lx.CATEGORY_TERMS[name]) if " " not in w]
    base = (f"len(list_intersect({sq.lst(single)}, tw)) * 2.5 + len(list_filter(list_intersect({sq.lst(single)}, bw), "
            f"lambda w: NOT list_contains(tw, w))) * 1.0")
    for ph in (w for w in lx.phrases(lx.CATEGORY_TERMS[name]) if " " in w):
        base += f" + CASE WHEN contains(lower(title), {sq.q(ph)}) THEN 4.5 WHEN contains(lower(content), {sq.q(ph)}) THEN 2.5 ELSE 0 END"
    return f"CAST(({base}) + CASE WHEN ({base}) > 0 AND contains(lower(url), '{name}') THEN 0.2 ELSE 0 END AS DOUBLE)"


_SETS = (f"ws AS (SELECT id, title, content, url, list_distinct(regexp_split_to_array(regexp_replace(lower({sq.normalize('title')}), {sq.q(tx.NON_WORD)}, ' ', 'g'), '\\s+')) AS tw, "
         f"list_distinct(regexp_split_to_array(regexp_replace(lower({sq.normalize('content')}), {sq.q(tx.NON_WORD)}, ' ', 'g'), '\\s+')) AS bw FROM art)")


@query("word_category", f"""WITH {ART}, {_SETS}, s AS (SELECT id, [{', '.join(f"{{'category': '{n}', 'score': {_word_score(n)}}}" for n in lx.CATEGORY_TERMS)}] AS rows FROM ws),
b AS (SELECT id, list_sort(list_transform(rows, lambda r: {{'s': -r.score, 'c': r.category}}))[1] AS b FROM s)
SELECT id, CASE WHEN -b.s < 0.5 THEN 'general' ELSE b.c END AS category, round(-b.s, 6) AS score FROM b""")
def _(t):
    return articles(t).select("id", ex.word_category(C("title"), C("content"), C("url")).alias("c")).select(
        "id", "c.category", F.round("c.score", 6).alias("score"))


def _first_listed(text, listed, default):
    return "CASE " + " ".join(f"WHEN {sq.any_of(text, lx.phrases(v))} THEN '{k}'" for k, v in listed.items()) + f" ELSE '{default}' END"


@query("subcategories", f"WITH {ART} SELECT id, {_first_listed('lower(content)', lx.SUBCATEGORIES, '')} AS subcategory FROM art")
def _(t):
    return articles(t).select("id", sc.subcategory(C("content")).alias("subcategory"))


@query("event_types", f"""WITH {ART} SELECT id, {_first_listed(f"lower({sq.normalize('content')})", lx.EVENT_TYPES, 'General')} AS event_type,
  {_first_listed("lower(title || ' ' || content)", ex.UPDATE_KINDS, 'historical')} AS update_kind FROM art""")
def _(t):
    return articles(t).select("id", sc.event_type(C("content")).alias("event_type"),
                              ex.update_kind(F.concat_ws(" ", "title", "content")).alias("update_kind"))


@query("named_entities")
def _(t):
    found = articles(t).select("id", F.explode(ex.pattern_entities(F.concat_ws(" ", "title", "content"), ex.NAMED_PATTERNS)).alias("e"))
    return found.groupBy("id", "e.type").agg(F.count("*").alias("n"), F.min("e.value").alias("first_value"))


_CONTACTS = ", ".join(f"list_transform(list_distinct(regexp_extract_all(content, {sq.q(p)})), lambda v: {{'type': '{k}', 'value': v}})"
                      for k, p in ex.CONTACT_PATTERNS)


@query("contact_entities", f"""WITH {ART}, e AS (SELECT id, unnest(flatten([{_CONTACTS}])) AS e FROM art),
f AS (SELECT id, e.value AS value, min(CASE e.type WHEN 'email' THEN 0 WHEN 'phone' THEN 1 ELSE 2 END) AS k FROM e GROUP BY 1, 2)
SELECT id, ['email', 'phone', 'date'][k + 1] AS type, value FROM f""")
def _(t):
    return articles(t).select("id", F.inline(ex.pattern_entities(C("content"), ex.CONTACT_PATTERNS)))


@query("gazetteer_entities")
def _(t):
    return articles(t).select("id", F.inline(ex.gazetteer_entities(F.concat_ws(". ", "title", "content"))))


_EVLINES = ("list_filter(list_transform(string_split(regexp_replace(title || '. ' || content, '([.!?؟\\n])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
            "lambda s: trim(s)), lambda s: length(s) BETWEEN 15 AND 150)")
# cue words that occur in the invented prose of the corpus
_CUES = ["hoth", "onble", "the of", "de la", "nicht", "para", *ex.STORY_VERBS]
_MARKS = ["tionsh", "bleer", "mentou", *ex.PERSON_MARKERS]
_THAT = r"\b([A-Z][a-z]+) that ([^.!?\n]{10,140})"
_VERB = f"list_filter({sq.lst(_CUES)}, lambda v: contains(s, v))[1]"


@query("event_sentences", f"""WITH {ART}, l AS (SELECT id, unnest({_EVLINES}) AS s, generate_subscripts({_EVLINES}, 1) AS i FROM art),
a AS (SELECT id, i, {sq.squeeze(f"trim(substr(s, strpos(s, {_VERB}), 80))")} AS label FROM l WHERE {_VERB} IS NOT NULL),
u AS (SELECT id, label, min(i) AS i FROM a WHERE length(label) >= 5 GROUP BY 1, 2)
SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM u) WHERE r <= 8""")
def _(t):
    return articles(t).select("id", F.explode(ex.event_labels(F.concat_ws(". ", "title", "content"), verbs=_CUES)).alias("label"))


_LONG = f"list_filter(regexp_split_to_array(content, '\\s+'), lambda w: length(w) >= 4 AND w NOT IN {sq.inn(ex.TOPIC_STOP)})[1:5]"


@query("topics_and_themes", f"""WITH {ART} SELECT id, CASE WHEN len({_LONG}) > 0 THEN array_to_string({_LONG}, ' ') ELSE category END AS primary_topic,
  CAST(0.9 AS DOUBLE) AS confidence FROM art""")
def _(t):
    return articles(t).select("id", ex.topics(C("content"), C("category")).alias("x")).select(
        "id", "x.primary_topic", "x.confidence")


_DECL = (f"list_filter(list_transform(regexp_split_to_array(content, '[.!?]\\s+'), lambda s: trim(s)), lambda s: length(s) BETWEEN 31 AND 199 "
         f"AND regexp_matches(s, {sq.q(ex.MODAL)}))[1:5]")


@query("declared_claims", f"WITH {ART} SELECT id, unnest({_DECL}) AS claim FROM art")
def _(t):
    return articles(t).select("id", F.explode(ex.declared_claims(C("content"))).alias("claim"))


@query("unique_claims", f"""WITH {ART}, c AS (SELECT url, {sq.squeeze('claim')} AS k FROM (SELECT url, unnest({_DECL}) AS claim FROM art))
SELECT DISTINCT url, k AS claim, 'claim_' || sha256('claim|' || url || '|' || k) AS id FROM c WHERE k <> ''""")
def _(t):
    rows = articles(t).select("url", F.explode(ex.declared_claims(C("content"))).alias("claim"))
    rows = rows.withColumn("claim", tx.squeeze(C("claim")))
    return ex.unique_extractions(rows, "url", "claim", "claim", [F.asc("claim")]).select("url", "claim", "id")


_SAID = f"list_transform(regexp_extract_all(content, {sq.q(_THAT)}), lambda c: trim(c))[1:8]"


@query("attributed_claims", f"""WITH {ART}, c AS (SELECT id, unnest({_SAID}) AS claim FROM art)
SELECT id, claim, trim(regexp_extract(claim, {sq.q(_THAT)}, 1)) AS attributed_to, trim(regexp_extract(claim, {sq.q(_THAT)}, 2)) AS statement FROM c""")
def _(t):
    return articles(t).select("id", F.inline(ex.said_claims(C("content"), pattern=_THAT)))


_MARKED = ("list_filter(list_transform(string_split(regexp_replace(content, '([.!?])', '\\1' || chr(1), 'g'), chr(1)), "
           "lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')")
_TRIAGE = f"""l AS (SELECT id, unnest({_MARKED}) AS s, generate_subscripts({_MARKED}, 1) AS i FROM art),
k AS (SELECT *, CASE WHEN {sq.any_of('lower(s)', ex.CLAIM_WORDS)} THEN 'claim' WHEN {sq.any_of('lower(s)', ex.MAIN_EVENT_WORDS)} THEN 'event' ELSE 'statement' END AS kind FROM l),
m AS (SELECT *, CASE WHEN kind = 'event' AND i = min(i) FILTER (kind = 'event') OVER (PARTITION BY id) THEN 'main_event' ELSE kind END AS kind2 FROM k)"""


@query("sentence_triage", f"WITH {ART}, {_TRIAGE} SELECT id, kind2 AS kind, count(*) AS n FROM m GROUP BY 1, 2")
def _(t):
    rows = articles(t).select("id", F.inline(ex.triage(C("content"))))
    return rows.groupBy("id", "kind").agg(F.count("*").alias("n"))


@query("facts", f"""WITH {ART}, {_TRIAGE} SELECT id, CASE kind2 WHEN 'main_event' THEN 'confirmed' WHEN 'claim' THEN 'allegation' ELSE 'attributed' END AS fact_type,
  CASE kind2 WHEN 'main_event' THEN CAST(0.8 AS DOUBLE) WHEN 'claim' THEN 0.5 ELSE 0.6 END AS confidence, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars
FROM m WHERE kind2 <> 'event' GROUP BY ALL""")
def _(t):
    rows = articles(t).select("id", F.inline(ex.facts(ex.triage(C("content")))))
    return rows.groupBy("id", "fact_type", "confidence").agg(
        F.count("*").alias("n"), F.sum(F.length("object")).alias("chars"))


@query("marker_entities", f"""WITH {ART}, e AS (SELECT id, unnest(list_distinct(regexp_extract_all(content, {sq.q(r'\S*(?:' + '|'.join(_MARKS) + r')\S*')}))) AS value, 'person' AS type FROM art
UNION ALL SELECT id, unnest(list_filter({sq.lst([n for n, _ in ex.PLACES])}, lambda p: contains(content, p))), 'place' FROM art)
SELECT id, value, CASE WHEN type = 'person' THEN type WHEN value IN ('france', 'egypt') THEN 'country' ELSE 'city' END AS type FROM e""")
def _(t):
    return articles(t).select("id", F.inline(ex.marker_entities(C("content"), _MARKS)))


@query("story_elements")
def _(t):
    s = articles(t).select("id", ex.story_elements(C("title"), C("content")).alias("s"))
    return s.select("id", joined(C("s.dates")).alias("dates"), F.size("s.events").alias("n_events"))


def _top(words, k):
    return f"""w AS (SELECT id, unnest({words}) AS w FROM art), c AS (SELECT id, w, count(*) AS n FROM w GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, w) AS r FROM c)
SELECT art.id, coalesce(string_agg(w, ' ' ORDER BY r), '') AS words FROM art LEFT JOIN r ON art.id = r.id AND r <= {k} GROUP BY 1"""


_KW = f"list_filter(regexp_split_to_array(lower(content), '[^\\pL\\pN]+'), lambda w: length(w) >= 3 AND w NOT IN {sq.inn(lx.KEYWORD_STOP)})"
_SW = (f"list_filter(list_transform(regexp_split_to_array(content, '\\s+'), lambda w: lower(regexp_replace(w, '^[^\\w؀-ۿ]+|[^\\w؀-ۿ]+$', '', 'g'))), "
       f"lambda w: length(w) >= 3 AND w NOT IN {sq.inn(ex.STORY_STOP)} AND NOT regexp_matches(w, '^\\d+$'))")


@query("top_keywords", f"WITH {ART}, {_top(_KW, 10)}")
def _(t):
    return articles(t).select("id", joined(ex.keywords(C("content"), 10), " ").alias("words"))


@query("story_words", f"WITH {ART}, {_top(_SW, 20)}")
def _(t):
    return articles(t).select("id", joined(ex.story_words(C("content"), 20), " ").alias("words"))


_LINES = ("list_filter(list_transform(regexp_split_to_array(regexp_replace(content, '([.!?؟])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s)), "
          "lambda s: length(s) >= 10)")


def _wset(col):
    return f"list_distinct(list_filter(regexp_split_to_array(lower({col}), '[^\\pL\\pN]+'), lambda w: length(w) >= 3 AND w NOT IN {sq.inn(lx.KEYWORD_STOP)}))"


@query("extractive_summary", f"""WITH {ART}, l AS (SELECT id, {_wset('title')} AS h, unnest({_LINES}) AS s, generate_subscripts({_LINES}, 1) AS i FROM art),
sc AS (SELECT id, s, i, len(list_intersect(h, {_wset('s')})) * 2.0::DOUBLE + 1.0::DOUBLE / i AS score FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, i) AS r FROM sc),
j AS (SELECT art.id, coalesce(string_agg(s, ' ' ORDER BY r), '') AS x FROM art LEFT JOIN r ON art.id = r.id AND r <= 3 GROUP BY 1)
SELECT id, CASE WHEN length(x) > 150 THEN substr(x, 1, 150) || '...' ELSE x END AS summary FROM j""")
def _(t):
    return articles(t).select("id", ex.summary(C("title"), C("content")).alias("summary"))


@query("cleaned_content")
def _(t):
    c = articles(t).select("id", ex.cleaned_content(C("title"), C("content")).alias("c"))
    return c.select("id", F.md5(joined(C("c.kept"), " ")).alias("kept"), F.size("c.kept").alias("n_kept"), "c.removed")


_LINES2 = "regexp_matches(content, E'\\n')"


@query("editorial_findings", f"""WITH {ART}, f AS (SELECT id, content = '' AS e, title = '' AS h, NOT {_LINES2} AS p, {sq.any_of('content', ex.ABSOLUTE_WORDS)} AS a FROM art)
SELECT id, concat_ws(' | ', CASE WHEN e THEN 'Article is empty.' END, CASE WHEN h THEN 'Missing headline.' END,
  CASE WHEN p THEN 'Article lacks paragraph structure.' END, CASE WHEN a THEN 'Absolute term present.' END) AS findings,
  CASE WHEN e THEN 0.0::DOUBLE WHEN a THEN 0.5 WHEN NOT (h OR p) THEN 1.0 ELSE 0.75 END AS score FROM f""")
def _(t):
    return articles(t).select("id", ex.editorial_findings(C("content"), C("title")).alias("f")).select(
        "id", joined(C("f.findings")).alias("findings"), "f.score")


_ALLT = "title || ' ' || content || ' ' || summary"
_BW = "len(list_filter(regexp_split_to_array(content, '[^\\pL]+'), lambda w: length(w) > 2))"
_ACT = _ACTION.replace("lower(content)", f"lower({_ALLT})")
_IMPORT = ("CASE cat " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lx.CATEGORY_IMPORTANCE.items()) + " ELSE 0.05 END")
_EDIT = f"""{_CATS.replace('lower(content)', "lower(title || ' ' || content)")},
b AS (SELECT *, {_first_max('rows', _SHARE)} AS b, {_BW} AS bw, {sq.any_of(f'lower({_ALLT})', lx.EVENT_WORDS)} AS ev, {_ACT} AS act, {_MATCH} AS tbm FROM cats),
p AS (SELECT *, CASE WHEN coalesce(b.n / b.size < 0.2, true) THEN 'varieties' ELSE b.category END AS cat,
  CASE WHEN coalesce(b.n / b.size < 0.2, true) THEN 0.3 ELSE b.n / b.size END AS conf FROM b),
o AS (SELECT id, ev, {sq.ladder(("length(title) < 5", "Title empty or too short"), (f"lower(title) IN {sq.inn(lx.GENERIC_TITLES)}", "Generic single-word title"),
   (f"lower(title) IN {sq.inn(lx.SITE_TITLES_WIDE)}", "Site-name-only title"), ("length(content) < 40", "Body empty or too short (<40 chars)"),
   ("bw < 5", "Too few real words (<5)"), (f"NOT regexp_matches(content, {sq.q(pr.SENTENCE_END)}) AND length(content) > 200", "No sentence structure"),
   (f"{sq.hits('lower(content)', lx.BOILERPLATE)} / greatest(bw / 10.0, 1.0) > 0.5", "Content appears to be boilerplate/nav/ads"))} AS reject_reason,
  round(CASE WHEN ev AND bw >= 10 THEN 0.7 ELSE 0.2 END * 0.20::DOUBLE + least(bw / 100.0, 1.0) * 0.15::DOUBLE + CASE WHEN act <> '' THEN 0.2 ELSE 0.0 END * 0.15::DOUBLE
   + tbm * 0.10::DOUBLE + CASE WHEN published_at IS NULL THEN 0.5 ELSE 0.7 END * 0.10::DOUBLE + conf * 0.05::DOUBLE + 0.05::DOUBLE
   + {sq.clamp(_IMPORT + ' + ' + sq.points(("length(title) > 30", 0.1), ("length(title) > 60", 0.1), ("length(content) > 200", 0.1), ("length(content) > 500", 0.1), ("length(content) > 1000", 0.1)) + " + least(len(regexp_extract_all(content, '[0-9]{2,}')) * 0.05, 0.2)")} * 0.05::DOUBLE + 0.8 * 0.05::DOUBLE, 6) AS overall FROM p)"""


@query("editorial_decision", f"""WITH {ART}, {_EDIT} SELECT id, reject_reason, overall, CASE WHEN reject_reason IS NOT NULL OR overall < 0.30 THEN 'REJECT'
  WHEN NOT ev THEN 'REVIEW' WHEN overall >= 0.75 THEN 'ACCEPT' WHEN overall >= 0.5 THEN 'REVIEW' ELSE 'REJECT' END AS decision FROM o""")
def _(t):
    return ex.with_editorial_decision(articles(t)).select("id", "reject_reason", "overall", "decision")


@query("decision_label_agreement", f"""WITH {ART}, {_EDIT}, d AS (SELECT id, CASE WHEN reject_reason IS NOT NULL OR overall < 0.30 THEN 'REJECT'
  WHEN NOT ev THEN 'REVIEW' WHEN overall >= 0.75 THEN 'ACCEPT' WHEN overall >= 0.5 THEN 'REVIEW' ELSE 'REJECT' END AS decision FROM o)
SELECT decision, quality, toxic, count(*) AS n FROM d JOIN labels ON id = doc_id GROUP BY ALL""")
def _(t):
    d = ex.with_editorial_decision(articles(t)).select(C("id").alias("doc_id"), "decision")
    return d.join(t.labels, "doc_id").groupBy("decision", "quality", "toxic").agg(F.count("*").alias("n"))


@query("quality_gate", f"""WITH {ART}, q AS (SELECT id, {sq.clamp(sq.points(
    ("length(title) >= 25", 0.25), ("length(summary) >= 35", 0.15), ("length(content) >= 180", 0.35),
    ("length(content) >= 500", 0.10), (f"regexp_matches({_WHOLE}, '[.؟]')", 0.10),
    ("length(title) < 18 OR length(content) < 80", -0.35)) + f" - {sq.hits(f'lower({_WHOLE})', lx.QUALITY_BLOCKED)} * 0.35")} AS q FROM art)
SELECT id, round(q, 6) AS quality FROM q WHERE round(q, 6) >= 0.45""")
def _(t):
    q = articles(t).select("id", F.round(sc.article_quality(C("title"), C("content"), C("summary")), 6).alias("quality"))
    return q.filter(C("quality") >= 0.45)


_SET = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\pL]+'), lambda w: w <> ''))"


def _norm_set(col):
    return _SET.format(sq.normalize(col))


@query("source_overlap_report", f"""WITH {ART}, f AS (SELECT "cluster", arg_min(content, id) AS source, min(id) AS first_id FROM art GROUP BY 1),
s AS (SELECT id, {_norm_set('content')} AS a, {_norm_set('source')} AS s, {_norm_set('title')} AS h FROM art JOIN f USING ("cluster") WHERE id <> first_id),
j AS (SELECT id, {sq.jaccard('a', 's')} AS phrase_overlap, {sq.jaccard('h', 's')} AS headline_similarity FROM s)
SELECT id, round(phrase_overlap, 6) AS phrase_overlap, round(headline_similarity, 6) AS headline_similarity,
  CASE WHEN phrase_overlap > 0.6 THEN 'High phrase overlap with source material.' WHEN headline_similarity > 0.5 THEN
   'Headline closely resembles source headline.' ELSE 'No significant source overlap detected.' END AS warning FROM j""")
def _(t):
    art = articles(t).select("id", "cluster", "title", "content")
    first = art.groupBy("cluster").agg(F.min_by("content", "id").alias("source"), F.min("id").alias("first_id"))
    pairs = art.join(first, "cluster").filter(C("id") != C("first_id")).select(
        "id", C("content").alias("article"), "source", C("title").alias("headline"))
    return ex.overlap_report(pairs).select(
        "id", F.round("phrase_overlap", 6).alias("phrase_overlap"),
        F.round("headline_similarity", 6).alias("headline_similarity"), "warning")


@query("statement_support")
def _(t):
    art = articles(t).select("id", tx.marked_sentences(C("content")).alias("lines"),
                             ex.facts(F.filter(ex.triage(C("content")), lambda r: r["kind"] == "claim")).alias("facts"))
    art = art.withColumn("facts", F.transform("facts", lambda f: f.withField("subject", F.split(f["object"], " ")[0])))
    rows = ex.statement_support(art, "lines", "facts")
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.count_if("supported").alias("supported"),
                                  F.count_if("claim_as_fact").alias("claim_as_fact"))


@query("source_evidence", f"""WITH {ART} SELECT 'S' || substr(md5(url), 1, 12) AS source_id, url, source_name AS publisher, md5(substr(content, 1, 200)) AS passage,
  CAST(least(length(content), 200) AS INT) AS passage_length, language AS source_language FROM art""")
def _(t):
    return ex.evidence(articles(t)).select("source_id", "url", "publisher", F.md5("passage").alias("passage"),
                                           "passage_length", "source_language")


@query("article_defaults", f"""WITH {ART} SELECT id, category, 'src' || regexp_extract(source_name, '\\d+') || '.example.com' AS author,
  md5(CASE WHEN trim(content) = '' THEN summary ELSE trim(content) END) AS content FROM art""")
def _(t):
    art = articles(t).withColumn("author", F.lit(""))
    return ex.with_defaults(art).select("id", "category", "author", F.md5("content").alias("content"))
