"""Extraction over article text. Each extractor works inside its row and yields an array column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import bags
from tidewire.functions import lexicon as lx
from tidewire.functions import scores as sc
from tidewire.functions import text as tx
from tidewire.functions import url as ux
from tidewire.functions.predicates import GREEK, SENTENCE_END, scripts_in
from tidewire.operators.keyed import top_per_key

# Contact and date shapes.
CONTACT_PATTERNS = (
    ("email", r"\b[\w.-]+@[\w.-]+\.\w+\b"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("date", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
)
# Shapes of named things, by type.
NAMED_PATTERNS = (
    ("person", r"\b(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"),
    ("person", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"),
    ("person", r"(?:السيد|السيدة|الدكتور|البروفيسور|الأستاذ|الوزير|الرئيس|الملك|الأمير|الشيخ)\s+[؀-ۿ]+(?:\s+[؀-ۿ]+)*"),
    ("person", r"\b(?:M\.|Mme\.|Mlle\.|Dr\.|Pr\.)\s+[A-ZÀ-ÿ][a-zà-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zà-ÿ]+)*"),
    ("organization", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Inc|Corp|LLC|Ltd|Group|Org|Foundation|Institute|University|Association)\b"),
    ("organization", r"(?:شركة|مؤسسة|بنك|جامعة|وزارة|هيئة|منظمة|جمعية|مركز|مجموعة|قوة|جيش|شرطة|حكومة)\s+[؀-ۿ]+"),
    ("organization", r"\b(?:SARL|SAS|Groupe|Fondation|Institut|Université|Ministère|Banque|Société)\b"),
    ("location", r"\b(?:in|at|from|to|near|around)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"),
    ("location", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*[A-Z]{2}\b"),
    ("date", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"),
    ("date", r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"),
    ("date", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"),
    ("date", r"\b\d{1,2}\s+(?:janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)\s+\d{4}\b"),
    ("money", r"\$\s*\d+(?:,\d{3})*(?:\.\d{2})?"),
    ("money", r"\b\d+(?:,\d{3})*(?:\.\d{2})?\s*(?:USD|EUR|GBP|SAR|AED|EGP|MAD|TND|JOD|KWD|BHD|OMR|QAR)\b"),
    ("sports_team", r"\b(?:Real Madrid|Barcelona|Manchester United|Manchester City|Liverpool|Bayern Munich|PSG|Juventus|Inter Milan|AC Milan|Chelsea|Arsenal|Tottenham|Dortmund|Napoli)\b"),
)
# Word lists of the sentence rules.
STORY_VERBS = lx.phrases(
    "أعلن|وقع|زار|التقى|اتفق|أطلق|انتخب|عين|استقال|توفي|جرح|فاز|خسر|أنشأ|دمر|هاجم|دافع|استثمر|اشترى|باع|صرح|حقق|انتقل|"
    "تفاوض|أكد|كشف|افتتح|announced|signed|visited|met|agreed|launched|elected|appointed|resigned|died|injured|won|lost|"
    "created|attacked|invested|opened|discovered"
)
CLAIM_WORDS = lx.phrases(
    "claimed|alleged|accused|according to|said|reported|prétend|allègue|selon|a dit|a rapporté|زعم|اتهم|ادعى|أشار|قال"
)
MAIN_EVENT_WORDS = lx.phrases(
    "announced|declared|launched|signed|agreed|decided|a déclaré|a annoncé|a lancé|a signé|a décidé|أعلن|أعلنت|أطلق|وقع|"
    "اتفق|قرر"
)
UPDATE_KINDS = {
    "new": "announced|declared|launched|today|this morning|a annoncé|aujourd'hui|ce matin|أعلن|اليوم",
    "update": "update|follow-up|develops|continuing|mise à jour|suit|يتبع|تحديث",
    "reaction": "reacts|responds|welcomes|criticizes|réagit|répond|يرد",
}
PERSON_MARKERS = lx.phrases(
    "president|minister|director|mayor|governor|président|ministre|directeur|maire|الرئيس|الوزير|المدير|العمدة|المحافظ"
)
PLACES = (("france", "country"), ("egypt", "country"), ("paris", "city"), ("cairo", "city"), ("london", "city"),
          ("washington", "city"))
STORY_DATES = r"(\d{4}-\d{2}-\d{2})|(\d{1,2}/\d{1,2}/\d{4})|(\d{1,2}-\d{1,2}-\d{4})|(أمس|اليوم|غداً|غدا|قبل يوم|بعد يوم)"
STORY_EVENT_WORDS = lx.phrases(
    "أعلن|أعلنت|وقع|اتفق|حصل|نشر|بدأ|انتهى|كشف|اكتشف|افتتح|ألغى|ألغيت|قرر|صادق|visited|announced|signed|agreed|launched|"
    "discovered"
)
ACTOR_PATTERN = (
    "(?:الملك|الرئيس|الوزير|اللاعب|المدرب|الدكتور|السيد|المسؤول|المستشار|النائب|الأمين العام|الأستاذ|البطل|الوحدة|الفريق|"
    "المنتخب|النادي|الوزارة|الحكومة|الشركة|البنك|الجامعة|المحكمة|المنظمة|الحزب|المجلس|الاتحاد|الجمعية|الوكالة|نادي|فريق|"
    r"حكومة|وزارة|جامعة|برلمان|شركة|بنك|محكمة|منظمة|حزب|مجلس|اتحاد|جمعية|وكالة)\s+[ء-ي]{2,20}(?:\s+[ء-ي]{2,20}){0,2}"
)
THEMES = {
    "اقتصاد": "اقتصاد|استثمار|تجارة|سوق|أسهم|بورصة|مال|ميزانية|ضريبة",
    "حوكمة": "حكومة|برلمان|قانون|سياسة|انتخابات|وزير|رئيس|نائب|مجلس",
    "تقنية": "تقنية|تكنولوجيا|رقمي|ذكاء|تطبيق|برمجيات|انترنت",
    "رياضة": "مباراة|فريق|لاعب|دوري|بطولة|كرة|هدف|فوز|خسارة",
    "صحة": "صحة|مستشفى|دواء|طبي|علاج|أطباء|فيروس|لقاح|وباء",
    "تعليم": "مدرسة|جامعة|تعليم|دراسة|طلاب|أستاذ|مناهج|امتحان",
    "بيئة": "مناخ|بيئة|طاقة|احتباس|تلوث|نفايات|مياه|غابات",
    "ثقافة": "ثقافة|فن|مهرجان|سينما|مسرح|كتاب|أدب|فنان",
}
TOPIC_STOP = lx.words(
    "في من إلى على هذا هذه أن كان كانت ليس لكن أو ثم أي كل مع عند بعد قبل حتى أيضا حيث التي الذي الذين اللتين اللاتي ذلك"
)
SAID_THAT = r"(?:أكد|صرح|أوضح|قال|أعلن|أشار|شدد|أفاد|كشف)\s+([ء-ي\s]{2,30}?)\s+أ[نّ]\s+([^.!?؟\n]{10,140})"
MODAL = r"(?i)\b(is|are|was|were|has|have|had|will|would|could|should|must)\b"
PREFIX_ENTITIES = (
    ("person", r"(?:الملك|الرئيس|الوزير|اللاعب|المدرب|الدكتور|السيد|المسؤول|المستشار|النائب|الأمين العام|الأستاذ|البطل)"
               r"\s+([ء-ي]{2,15}(?:\s+[ء-ي]{2,15}){1,3})", 1, 3, 0.85),
    ("organization", r"((?:نادي|فريق|حكومة|وزارة|جامعة|برلمان|شركة|بنك|محكمة|منظمة|حزب|مجلس|اتحاد|جمعية|وكالة)"
                     r"\s+[ء-ي]{2,20}(?:\s+[ء-ي]{2,20}){1,3})", 1, 4, 0.8),
    ("statistic", r"((?:MAD|USD|EUR|AED|SAR|QAR|د\.م\.?|ر\.س\.?|درهم|دولار|يورو)\s*\d+(?:[.,]\d+)?|"
                  r"\d+(?:[.,]\d+)?\s*(?:مليون|مليار|ألف|درهم|دولار|يورو|%))", 1, 2, 0.85),
    ("date", r"(\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b|\b\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}\b)", 1, 2, 0.9),
)
GAZETTEER = {
    ("person", 0.95): "محمد السادس|عزيز أخنوش|فوزي لقجع|وليد الركراكي|أشرف حكيمي|سمير المرابط|حكيم زياش|محمد صلاح|"
                      "سفيان أمرابط|ياسين بونو|عبد الإله ابن كيران|ناصر بوريطة|عبد اللطيف لوديي|محمد بن سلمان|"
                      "تميم بن حمد|محمد بن زايد|عبد الفتاح السيسي|جو بايدن|دونالد ترامب|إيمانويل ماكرون|"
                      "فلاديمير بوتين|بنيامين نتنياهو",
    ("organization", 0.9): "الأمم المتحدة|مجلس الأمن|الجامعة العربية|الاتحاد الإفريقي|الاتحاد الأوروبي|الفيفا|الكاف|"
                           "صندوق النقد الدولي|البنك الدولي|الوداد|الرجاء|الجيش الملكي|ريال مدريد|برشلونة|لايبزيغ|"
                           "باريس سان جيرمان|مانشستر سيتي|ليفربول|الأهلي|الهلال",
    ("location", 0.9): "الرباط|الدار البيضاء|مراكش|طنجة|فاس|أكادير|تطوان|وجدة|مكناس|العيون|المغرب|الجزائر|تونس|مصر|"
                       "السعودية|الإمارات|قطر|فلسطين|غزة|القدس|القاهرة|الرياض|دبي|الدوحة|باريس|مدريد|لندن|برلين|"
                       "واشنطن|نيويورك|موسكو|بكين|ألمانيا|إسبانيا|فرنسا|إنجلترا|إيطاليا",
}
SHARE_SITES = lx.phrases(
    "telegram|linkedin|messenger|facebook|twitter|whatsapp|instagram|youtube|tiktok|طباعة|البريد|الالكتروني"
)
STORY_STOP = lx.words(
    "هذا هذه ذلك التي الذي على إلى من في عن مع بعد قبل كان كانت هو هي the and for with from that this will have has was are"
)
ABSOLUTE_WORDS = lx.phrases("always|never|tous|كل|أبداً")


def pattern_entities(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Array of (type, value): every match, first type of a value wins."""
    found = F.flatten(F.array(*[_typed(text, kind, p) for kind, p in patterns]))
    return unique_by(F.filter(found, lambda e: F.length(e["value"]) >= 2), lambda e: e["value"])


def _typed(text: Column, kind: str, pattern: str) -> Column:
    matches = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.transform(matches, lambda v: F.struct(F.lit(kind).alias("type"), F.trim(v).alias("value")))


def unique_by(items: Column, key) -> Column:
    """Items whose key did not occur earlier in the array."""
    def keep(arr: Column) -> Column:
        return let_keys(arr, F.transform(arr, key))

    def let_keys(arr: Column, keys: Column) -> Column:
        return tx.let(keys, lambda ks: F.filter(arr, lambda e, i: F.array_position(ks, key(e)) == i + 1))

    return tx.let(items, keep)


def gazetteer_entities(
    text: Column, gazetteer: Mapping[tuple[str, float], str] = GAZETTEER, prefixes=PREFIX_ENTITIES
) -> Column:
    """Array of (type, value, confidence, context); a value contained in, or containing, an earlier one is dropped."""
    def scan(s: Column) -> Column:
        parts = []
        for kind, pattern, group, shortest, conf in prefixes:
            parts.append(_candidates(F.regexp_extract_all(s, F.lit(pattern), F.lit(group)), kind, conf, shortest))
        for (kind, conf), names in gazetteer.items():
            listed = F.filter(tx.literals(lx.phrases(names)), lambda w: s.contains(w))
            parts.append(_candidates(listed, kind, conf, 2))
        kept = F.aggregate(F.flatten(F.array(*parts)), _no_candidates(), _keep_apart)
        lines = tx.sentences(s, 1)
        return tx.let(lines, lambda ls: F.transform(kept, lambda e: F.struct(
            e["type"].alias("type"), e["value"].alias("value"), e["confidence"].alias("confidence"),
            F.coalesce(F.try_element_at(F.filter(ls, lambda x: x.contains(e["value"])), F.lit(1)),
                       F.try_element_at(ls, F.lit(1)), F.lit("")).alias("context"))))

    return tx.let(text, scan)


def _candidates(values: Column, kind: str, confidence: float, shortest: int) -> Column:
    tidy = F.filter(F.transform(values, tx.squeeze), lambda v: F.length(v) >= shortest)
    return F.transform(tidy, lambda v: F.struct(
        F.lit(kind).alias("type"), v.alias("value"), F.lit(confidence).alias("confidence")))


def _no_candidates() -> Column:
    return F.array().cast("array<struct<type:string,value:string,confidence:double>>")


def _keep_apart(kept: Column, e: Column) -> Column:
    low = F.lower(e["value"])
    clash = F.exists(kept, lambda k: F.lower(k["value"]).contains(low) | low.contains(F.lower(k["value"])))
    return F.when(clash, kept).otherwise(F.concat(kept, F.array(e)))


def event_labels(text: Column, most: int = 8, verbs: Sequence[str] = tuple(STORY_VERBS)) -> Column:
    """Labels of short sentences with an event verb: actor (if named) and up to 80 characters of action."""
    lines = F.filter(
        F.transform(F.split(text, r"(?<=[.!?؟\n])\s+"), lambda s: F.trim(s)), lambda s: F.length(s).between(15, 150)
    )

    def label(s: Column) -> Column:
        verb = F.try_element_at(F.filter(tx.literals(verbs), lambda v: s.contains(v)), F.lit(1))
        actor = F.trim(F.regexp_extract(s, ACTOR_PATTERN, 0))
        action = F.trim(F.substring(s, F.position(verb, s), F.lit(80)))
        return tx.squeeze(F.when(actor != "", F.concat_ws(" ", actor, action)).otherwise(action))

    labels = F.filter(F.transform(lines, label), lambda x: x.isNotNull() & (F.length(x) >= 5))
    return F.slice(F.array_distinct(labels), 1, most)


def topics(text: Column, category: Column, themes: Mapping[str, str] = THEMES) -> Column:
    """(primary_topic, secondary_topics, themes, confidence)."""
    low = F.lower(text)
    hit = F.array(*[F.when(tx.any_of(low, lx.phrases(terms)), F.lit(name)) for name, terms in themes.items()])
    found = F.filter(hit, lambda x: x.isNotNull())
    primary = F.when(category != "", category).otherwise(F.lit("أخبار عامة"))
    long = F.slice(F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) >= 4) & ~w.isin(TOPIC_STOP)), 1, 5)
    title = F.when(F.size(long) > 0, F.array_join(long, " ")).otherwise(primary)
    second = F.filter(found, lambda x: x != primary)
    return F.struct(title.alias("primary_topic"), second.alias("secondary_topics"), found.alias("themes"),
                    F.when(F.size(second) == 0, 0.9).otherwise(0.75).alias("confidence"))


def said_claims(text: Column, most: int = 8, pattern: str = SAID_THAT) -> Column:
    """"X said that ..." claims: (claim, attributed_to, statement)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.slice(F.transform(whole, lambda c: F.struct(
        F.trim(c).alias("claim"), F.trim(F.regexp_extract(c, pattern, 1)).alias("attributed_to"),
        F.trim(F.regexp_extract(c, pattern, 2)).alias("statement"))), 1, most)


def declared_claims(text: Column, most: int = 5) -> Column:
    """First declarative sentences of 31-199 characters with a modal or auxiliary verb."""
    lines = F.transform(F.split(text, r"[.!?]\s+"), lambda s: F.trim(s))
    return F.slice(F.filter(lines, lambda s: F.length(s).between(31, 199) & s.rlike(MODAL)), 1, most)


def triage(text: Column) -> Column:
    """Array of (pos, kind, sentence): claim, main_event, event or statement."""
    def kind(s: Column) -> Column:
        low = F.lower(s)
        return F.when(tx.any_of(low, CLAIM_WORDS), "claim").when(tx.any_of(low, MAIN_EVENT_WORDS), "event").otherwise(
            "statement")

    def mark(rows: Column) -> Column:
        first = F.array_position(F.transform(rows, lambda r: r["kind"]), "event")
        return F.transform(rows, lambda r, i: F.struct(
            i.alias("pos"), F.when(i + 1 == first, "main_event").otherwise(r["kind"]).alias("kind"),
            r["sentence"].alias("sentence")))

    rows = F.transform(tx.marked_sentences(text), lambda s: F.struct(kind(s).alias("kind"), s.alias("sentence")))
    return tx.let(rows, mark)


# What a triaged sentence becomes as a fact.
FACT_KINDS = {
    "main_event": ("news item", "reports", "confirmed", 0.8), "statement": ("source", "states", "attributed", 0.6),
    "claim": ("source", "claims", "allegation", 0.5),
}


def facts(triaged: Column) -> Column:
    """Array of (subject, predicate, object, fact_type, confidence) from triaged sentences."""
    def fact(r: Column) -> Column:
        out = None
        for kind, (subject, predicate, fact_type, conf) in FACT_KINDS.items():
            row = F.struct(F.lit(subject).alias("subject"), F.lit(predicate).alias("predicate"),
                           r["sentence"].alias("object"), F.lit(fact_type).alias("fact_type"),
                           F.lit(conf).alias("confidence"))
            out = F.when(r["kind"] == kind, row) if out is None else out.when(r["kind"] == kind, row)
        return out

    return F.filter(F.transform(triaged, fact), lambda f: f.isNotNull())


def update_kind(text: Column) -> Column:
    return sc.first_listed(F.lower(text), UPDATE_KINDS, "historical")


def marker_entities(text: Column, markers: Sequence[str] = tuple(PERSON_MARKERS)) -> Column:
    """Array of (type, value): words holding a person marker, then known places."""
    marked = F.regexp_extract_all(text, F.lit(r"\S*(?:" + "|".join(markers) + r")\S*"), F.lit(0))
    people = F.transform(F.array_distinct(marked), lambda v: F.struct(F.lit("person").alias("type"), v.alias("value")))
    places = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(n).alias("value")) for n, k in PLACES])
    return tx.let(text, lambda s: F.concat(people, F.filter(places, lambda p: s.contains(p["value"]))))


def share_row(segment: Column) -> Column:
    low = F.lower(segment)
    return low.rlike("شارك|share") & (tx.hits(low, SHARE_SITES) >= 2)


def story_elements(title: Column, content: Column) -> Column:
    """(dates, events): sorted distinct dates and event sentences without share rows."""
    dates = F.array_sort(F.array_distinct(
        F.regexp_extract_all(F.concat_ws(" ", title, content), F.lit(STORY_DATES), F.lit(0))))
    lines = F.transform(F.split(content, r"\."), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    events = F.filter(lines, lambda s: tx.any_of(F.lower(s), STORY_EVENT_WORDS) & (F.length(s) > 5) & ~share_row(s))
    return F.struct(dates.alias("dates"), F.array_sort(F.array_distinct(events)).alias("events"))


def keywords(text: Column, k: int = 10, stop: Sequence[str] = tuple(lx.KEYWORD_STOP)) -> Column:
    """The ``k`` most frequent words of three or more letters that are not stop words."""
    kept = F.filter(F.split(F.lower(text), tx.WORD_BREAK), lambda w: (F.length(w) >= 3) & ~w.isin(list(stop)))
    return bags.top_terms(kept, k)


def story_words(text: Column, k: int = 20) -> Column:
    """Frequent words with outer punctuation stripped, numbers left out."""
    bare = F.transform(F.split(text, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\w؀-ۿ]+|[^\w؀-ۿ]+$", "")))
    kept = F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.isin(STORY_STOP) & ~w.rlike(r"^\d+$"))
    return bags.top_terms(kept, k)


def summary(title: Column, content: Column, max_len: int = 150, best: int = 3) -> Column:
    """Best sentences by twice the title overlap plus a bonus for coming early, cut to ``max_len``."""
    def word_set(s: Column) -> Column:
        return F.array_distinct(F.filter(
            F.split(F.lower(s), tx.WORD_BREAK), lambda w: (F.length(w) >= 3) & ~w.isin(lx.KEYWORD_STOP)))

    def rank(head: Column) -> Column:
        scored = F.transform(tx.sentences(content), lambda s, i: F.struct(
            (F.size(F.array_intersect(head, word_set(s))) * 2.0 + F.lit(1.0) / (i + 1)).alias("score"),
            i.alias("pos"), s.alias("sentence")))
        return F.array_join(F.transform(bags.best_n(scored, best), lambda r: r["sentence"]), " ")

    def cut(s: Column) -> Column:
        return F.when(F.length(s) > max_len, F.concat(F.substring(s, 1, max_len), F.lit("..."))).otherwise(s)

    return tx.let(tx.let(word_set(title), rank), cut)


def cleaned_content(title: Column, content: Column) -> Column:
    """(kept, removed) segments: no share rows, breadcrumbs, long off-title segments or repeats."""
    heads = F.array_distinct(F.filter(F.split(F.lower(title), r"\s+"), lambda w: F.length(w) >= 3))

    def judge(words: Column) -> Column:
        def off_title(low: Column) -> Column:
            return ~F.exists(words, lambda w: low.contains(w))

        def bad(s: Column) -> Column:
            low = F.lower(s)
            crumb = low.rlike("الرئيسية.*/|/.*الرئيسية|الرئيسية.*أخبار|أخبار.*الرئيسية|الصفحه.*الرئيسي|home.*>|>.*home")
            return share_row(s) | crumb | (off_title(low) & (F.length(s) >= 40))

        parts = F.filter(
            F.transform(F.split(content, r"(?<=[.!?؟\n])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")),
            lambda s: F.length(s) >= 3)
        rows = F.transform(parts, lambda s: F.struct(
            s.alias("text"), bad(s).alias("bad"), F.lower(F.regexp_replace(s, r"\s", "")).alias("key")))
        return tx.let(rows, split)

    def split(rows: Column) -> Column:
        good = F.filter(rows, lambda r: ~r["bad"])
        kept = unique_by(good, lambda r: r["key"])
        return tx.let(kept, lambda k: F.struct(
            F.transform(k, lambda r: r["text"]).alias("kept"), (F.size(rows) - F.size(k)).alias("removed")))

    return tx.let(heads, judge)


def editorial_findings(article: Column, headline: Column) -> Column:
    """(findings, score)."""
    rules = [
        (article == "", "Article is empty."), (headline == "", "Missing headline."),
        (~article.contains("\n"), "Article lacks paragraph structure."),
        (tx.any_of(article, ABSOLUTE_WORDS), "Absolute term present."),
    ]
    found = F.filter(F.array(*[F.when(c, t) for c, t in rules]), lambda x: x.isNotNull())
    score = F.when(article == "", 0.0).when(rules[3][0], 0.5).when(F.size(found) == 0, 1.0).otherwise(0.75)
    return F.struct(found.alias("findings"), score.alias("score"))


# Weights of the editorial score.
EDITORIAL_WEIGHTS = (
    ("news_signal", 0.20), ("article_quality", 0.15), ("event_specificity", 0.15), ("title_body_match", 0.10),
    ("semantic_confidence", 0.10), ("freshness", 0.10), ("category_confidence", 0.05), ("uniqueness", 0.05),
    ("importance", 0.05), ("extraction_confidence", 0.05),
)


def with_editorial_decision(
    df: DataFrame, accept: float = 0.75, review: float = 0.50, duplicate_probability: float = 0.0,
    terms: Mapping[str, str] = lx.CATEGORY_TERMS,
) -> DataFrame:
    """Adds ``reject_reason``, ``overall`` and ``decision`` (ACCEPT / REVIEW / REJECT) to articles."""
    title, body = F.col("title"), F.col("content")
    low = F.lower(title)
    df = df.select(
        "*",
        F.size(F.filter(F.split(body, r"[^\p{L}]+"), lambda w: F.length(w) > 2)).alias("__words"),
        tx.hits(F.lower(body), lx.BOILERPLATE).alias("__boiler"),
        tx.any_of(F.lower(F.concat_ws(" ", title, body, "summary")), lx.EVENT_WORDS).alias("__event"),
        sc.first_action(F.concat_ws(" ", title, body, "summary")).alias("__action"),
        sc.weighted_share_category(sc.category_hits(F.concat_ws(" ", title, body), terms)).alias("__cat"),
    )
    words = F.col("__words")
    reason = (
        F.when(F.length(title) < 5, "Title empty or too short")
        .when(low.isin(lx.GENERIC_TITLES), "Generic single-word title")
        .when(low.isin(lx.SITE_TITLES_WIDE), "Site-name-only title")
        .when(scripts_in(title, GREEK) > 1, "Mixed-script title (scraping artifact)")
        .when(F.length(body) < 40, "Body empty or too short (<40 chars)")
        .when(words < 5, "Too few real words (<5)")
        .when(~body.rlike(SENTENCE_END) & (F.length(body) > 200), "No sentence structure")
        .when(F.col("__boiler") / F.greatest(words / 10, F.lit(1.0)) > 0.5, "Content appears to be boilerplate/nav/ads")
    )
    parts = {
        "news_signal": F.when(F.col("__event") & (words >= 10), 0.7).otherwise(0.2),
        "article_quality": F.least(words / 100, F.lit(1.0)),
        "event_specificity": sc.specificity(F.col("__action")),
        "title_body_match": sc.title_body_match(title, body),
        "semantic_confidence": F.lit(0.0),
        "freshness": F.when(F.col("published_at").isNull(), 0.5).otherwise(0.7),
        "category_confidence": F.col("__cat.confidence"),
        "uniqueness": F.lit(1.0 - duplicate_probability),
        "importance": sc.importance(title, body, F.col("__cat.category")),
        "extraction_confidence": F.lit(0.8),
    }
    overall = sum((parts[name] * weight for name, weight in EDITORIAL_WEIGHTS), F.lit(0.0))
    df = df.select("*", reason.alias("reject_reason"), F.round(overall, 6).alias("overall"))
    decision = (
        F.when(F.col("reject_reason").isNotNull() | (F.col("overall") < 0.30), "REJECT")
        .when(~F.col("__event"), "REVIEW").when(F.col("overall") >= accept, "ACCEPT")
        .when(F.col("overall") >= review, "REVIEW").otherwise("REJECT")
    )
    return df.withColumn("decision", decision).drop("__words", "__boiler", "__event", "__action", "__cat")


def word_category(
    title: Column, text: Column, url: Column, terms: Mapping[str, str] = lx.CATEGORY_TERMS,
    valid_ids: Sequence[str] | None = None, hints: Mapping[str, Sequence[str]] | None = None,
) -> Column:
    """(category, score) by whole words and phrases: title counts more than body, URL hints break ties."""
    hints = hints or {name: (name,) for name in terms}
    sports_path = F.exists(ux.segments(F.lower(url)), lambda s: s.isin("sport", "sports"))

    def words_of(s: Column) -> Column:
        return F.array_distinct(F.split(F.regexp_replace(F.lower(tx.normalize(s)), tx.NON_WORD, " "), r"\s+"))

    def score(name: str, sets: Column) -> Column:
        listed = lx.phrases(terms[name])
        single = tx.literals([w for w in listed if " " not in w] or [""])
        in_title = F.array_intersect(single, sets["title"])
        in_body = F.array_except(F.array_intersect(single, sets["body"]), in_title)
        total = F.size(in_title) * 2.5 + F.size(in_body) * 1.0
        for phrase in (w for w in listed if " " in w):
            total = total + F.when(F.lower(title).contains(phrase), 4.5).when(
                F.lower(text).contains(phrase), 2.5).otherwise(0.0)
        hinted = total + F.when((total > 0) & tx.any_of(F.lower(url), hints[name]), 0.2).otherwise(0.0)
        return hinted + F.when(sports_path, 3.0).otherwise(0.0) if name == "sport" else hinted

    def pick(sets: Column) -> Column:
        rows = F.array(*[F.struct(score(n, sets).alias("score"), F.lit(n).alias("category")) for n in terms])
        return F.try_element_at(bags.best_n(rows, 1), F.lit(1))

    best = tx.let(F.struct(words_of(title).alias("title"), words_of(text).alias("body")), pick)

    def settle(b: Column) -> Column:
        weak = b["score"] < 0.5
        if valid_ids is not None:
            weak = weak | ~b["category"].isin(list(valid_ids))
        return F.struct(F.when(weak, "general").otherwise(b["category"]).alias("category"), b["score"].alias("score"))

    return tx.let(best, settle)


def with_defaults(df: DataFrame, category: str = "general", language: str = "ar") -> DataFrame:
    """Fill article gaps: content from summary, category, author from the domain, language."""
    def blank(c: str) -> Column:
        return F.nullif(F.trim(F.col(c)), F.lit(""))

    return df.withColumns({
        "content": F.coalesce(blank("content"), F.col("summary"), F.lit("")),
        "category": F.coalesce(blank("category"), F.lit(category)),
        "author": F.coalesce(blank("author"), ux.publisher_name(ux.host(F.col("url")))),
        "language": F.coalesce(blank("language"), F.lit(language)),
    })


def evidence(df: DataFrame, width: int = 200) -> DataFrame:
    """One bounded evidence passage per source row."""
    return df.select(
        F.concat(F.lit("S"), F.substring(F.md5("url"), 1, 12)).alias("source_id"), "url",
        F.col("source_name").alias("publisher"), F.substring("content", 1, width).alias("passage"),
        F.coalesce(F.nullif("source_name", F.lit("")), F.lit("unspecified")).alias("attribution"),
        F.least(F.length("content"), F.lit(width)).alias("passage_length"),
        F.coalesce(F.nullif("language", F.lit("")), F.lit("und")).alias("source_language"),
    )


def overlap_report(pairs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Word overlap of an article with its source, and of the headline with the source."""
    def word_set(c: str) -> Column:
        return F.array_distinct(tx.letter_tokens(F.lower(tx.normalize(F.col(c)))))

    df = pairs.select("*", word_set("article").alias("__a"), word_set("source").alias("__s"), word_set("headline").alias("__h"))
    phrase, head = tx.jaccard(F.col("__a"), F.col("__s")), tx.jaccard(F.col("__h"), F.col("__s"))
    df = df.select("*", phrase.alias("phrase_overlap"), head.alias("headline_similarity"))
    warn = F.when(F.col("phrase_overlap") > threshold, "High phrase overlap with source material.").when(
        F.col("headline_similarity") > 0.5, "Headline closely resembles source headline.").otherwise(
        "No significant source overlap detected.")
    return df.withColumns({
        "score": (F.col("phrase_overlap") + F.col("headline_similarity")) / 2, "warning": warn}).drop("__a", "__s", "__h")


def statement_support(df: DataFrame, sentences: str, fact_rows: str) -> DataFrame:
    """Per sentence: supported by a fact, or an allegation told as a fact."""
    s = F.col("statement")
    out = df.select("*", F.posexplode(sentences).alias("pos", "statement"))
    has = F.exists(fact_rows, lambda f: s.contains(f["subject"]) & s.contains(f["object"]))
    allegation = F.exists(fact_rows, lambda f: (f["fact_type"] == "allegation") & (
        s.contains(f["subject"]) | s.contains(f["object"])))
    return out.select("*", has.alias("supported"), (~has & allegation).alias("claim_as_fact"))


def unique_extractions(rows: DataFrame, article: str, value: str, prefix: str, order: Sequence[Column]) -> DataFrame:
    """One row per article and whitespace-normalised value, with a stable id."""
    df = rows.withColumn("__key", tx.squeeze(F.col(value))).filter(F.col("__key") != "")
    df = top_per_key(df, [article, "__key"], order, 1)
    return df.withColumn(
        "id", F.concat(F.lit(prefix + "_"), F.sha2(F.concat_ws("|", F.lit(prefix), F.col(article), F.col("__key")), 256))
    ).drop("__key")
