"""Scores and labels of a text or a headline, each one Column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import lexicon as lx
from tidewire.functions import text as tx


def points(*rules: tuple[Column, float]) -> Column:
    """Sum of the points of the rules that hold."""
    total = F.lit(0.0)
    for cond, value in rules:
        total = total + F.when(cond, F.lit(float(value))).otherwise(F.lit(0.0))
    return total


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


# --- sentiment ------------------------------------------------------------------------


def _balance(pos: Column, neg: Column) -> Column:
    return F.when(pos + neg > 0, (pos - neg) / (pos + neg)).otherwise(F.lit(0.0))


def _listed_balance(words: Column, positive, negative) -> Column:
    """The balance of listed words; those in neither list are left out in one pass."""

    def score(w: Column) -> Column:
        return _balance(F.size(F.filter(w, lambda x: x.isin(list(positive)))),
                        F.size(F.filter(w, lambda x: x.isin(list(negative)))))

    return tx.let(F.filter(words, lambda x: x.isin([*positive, *negative])), score)


def sentiment(text: Column, positive=tuple(lx.POSITIVE), negative=tuple(lx.NEGATIVE)) -> Column:
    """(positive - negative) / (positive + negative) over words of two or more letters, case-sensitive."""
    words = F.split(F.regexp_replace(text, tx.NON_WORD, " "), r"\s+")
    return _listed_balance(words, *([w for w in listed if len(w) >= 2] for listed in (positive, negative)))


def sentiment_multilingual(text: Column) -> Column:
    """The balance over lower-cased words, with English, Arabic and French lists."""
    return _listed_balance(F.split(F.lower(text), tx.WORD_BREAK), lx.MULTI_POSITIVE, lx.MULTI_NEGATIVE)


def starts_with_any(word: Column, terms) -> Column:
    """Equal to a term, or starting with one of at least four letters: one set lookup per term length."""
    out = word.isin(list(terms))
    for n in sorted({len(t) for t in terms if len(t) >= 4}):
        out = out | F.left(word, F.lit(n)).isin([t for t in terms if len(t) == n])
    return out


def sentiment_negated(text: Column) -> Column:
    """Word-start matching where a negation turns the next sentiment word around."""
    words = F.split(F.regexp_replace(F.lower(tx.normalize(text)), tx.NON_WORD, ""), r"\s+")
    listed = [*lx.NEGATORS, *lx.PREFIX_POSITIVE, *lx.PREFIX_NEGATIVE]
    heads = sorted({t[:4] for t in listed if len(t) >= 4})
    near = F.filter(words, lambda w: w.isin([t for t in listed if len(t) < 4]) | F.left(w, F.lit(4)).isin(heads))

    def code(w: Column) -> Column:
        return (F.when(w.isin(lx.NEGATORS), "n").when(starts_with_any(w, lx.PREFIX_POSITIVE), "+")
                .when(starts_with_any(w, lx.PREFIX_NEGATIVE), "-"))

    # other words change nothing, so only the codes of listed ones are passed through
    codes = F.filter(F.transform(near, code), lambda c: c.isNotNull())
    start = F.struct(F.lit(False).alias("neg"), F.lit(0).alias("up"), F.lit(0).alias("down"))

    def step(state: Column, c: Column) -> Column:
        flip = c == "n"
        good = ~flip & ((c == "+") != state["neg"])
        return F.struct(
            flip.alias("neg"),
            (state["up"] + good.cast("int")).alias("up"),
            (state["down"] + (~flip & ~good).cast("int")).alias("down"),
        )

    return F.aggregate(codes, start, step, lambda s: _balance(s["up"], s["down"]))


NON_WORD_CHARS = r"[^\w؀-ۿ]"


def sentiment_weighted(text: Column, weights: Mapping[str, float] = lx.WEIGHTED_SENTIMENT) -> Column:
    """Mean weight of all term occurrences, as containment."""

    listed = F.array(*(F.struct(F.lit(term).alias("term"), F.lit(float(weight)).alias("weight")) for term, weight in weights.items()))

    def found(s: Column) -> Column:
        def times(t: Column) -> Column:
            return (F.length(s) - F.length(F.replace(s, t["term"], F.lit("")))) / F.length(t["term"])

        return F.transform(F.filter(listed, lambda t: s.contains(t["term"])), lambda t: F.struct(times(t).alias("n"), t["weight"].alias("weight")))

    def mean(rows: Column) -> Column:
        total = _sum(rows, lambda r: r["n"] * r["weight"])
        return F.when(F.size(rows) > 0, clamp(total / _sum(rows, lambda r: r["n"]), -1.0, 1.0)).otherwise(0.0)

    return tx.let(tx.let(F.lower(text), found), mean)


def sentiment_flag(text: Column) -> Column:
    """+-0.8 by the presence of a win or loss word."""
    low = F.lower(text)
    s = points((low.rlike("فوز|win"), 2), (low.rlike("خسارة|loss"), -2))
    return F.when(s > 0, 0.8).when(s < 0, -0.8).otherwise(0.0)


# --- headlines ------------------------------------------------------------------------


def clickbait(text: Column) -> Column:
    """Spam likelihood of a headline, 0 to 1."""
    low = F.lower(text)
    words = F.split(text, r"\s+")
    rules = [(low.rlike(p), 0.2) for p in lx.SPAM_PATTERNS]
    rules.append((low.rlike(r"(.)\1{4,}"), 0.2))
    rules.append((F.regexp_count(text, F.lit("[!?؟]")) > 3, 0.3))
    repeated = 1 - F.size(F.array_distinct(words)) / F.size(words)
    rules.append(((F.size(words) > 3) & (repeated > 0.5), 0.3))
    return F.when(text == "", 0.0).otherwise(clamp(points(*rules)))


def title_words(title: Column) -> Column:
    """Letter runs of a title longer than three letters, lower-cased."""
    return F.filter(F.split(F.lower(title), r"[^\p{L}]+"), lambda w: F.length(w) > 3)


def title_body_match(title: Column, body: Column) -> Column:
    """Share of title words found in the body; 0.5 when the title has none."""

    def share(words: Column) -> Column:
        found = tx.let(F.lower(body), lambda b: F.size(F.filter(words, lambda w: b.contains(w))))
        return F.when(F.size(words) > 0, found / F.size(words)).otherwise(0.5)

    return F.when((title == "") | (body == ""), 0.0).otherwise(tx.let(title_words(title), share))


def headline(title: Column, body: Column) -> Column:
    """Struct of headline findings."""
    low = F.lower(title)
    sens = clamp(tx.hits(low, lx.SENSATIONAL) / 5)
    bait = clamp(tx.hits(low, lx.CLICKBAIT) / 3)
    match = title_body_match(title, body)
    mismatch = (F.size(title_words(title)) > 0) & (match < 0.3)
    return F.struct(
        sens.alias("sensationalism"), bait.alias("clickbait"), (sens > 0.4).alias("is_sensational"),
        (bait > 0.3).alias("is_clickbait"), title.endswith("?").alias("is_question"),
        tx.any_of(low, lx.ABSOLUTES).alias("has_exaggeration"), mismatch.alias("mismatch"),
    )


def specificity(*parts: Column) -> Column:
    """A fifth for each filled part of an event (action, subject, object, date, development)."""
    return clamp(points(*[(F.coalesce(p, F.lit("")) != "", 0.2) for p in parts]))


def first_action(text: Column) -> Column:
    """First listed action verb that occurs in the text, empty when none does."""

    def pick(s: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter(tx.literals(lx.ACTION_VERBS), lambda v: s.contains(v)), F.lit(1)),
                          F.lit(""))

    return tx.let(F.lower(text), pick)


def importance(title: Column, body: Column, category: Column) -> Column:
    base = F.lit(0.05)
    for name, value in lx.CATEGORY_IMPORTANCE.items():
        base = F.when(category == name, F.lit(value)).otherwise(base)
    numbers = F.regexp_count(body, F.lit(r"[0-9]{2,}"))
    t, b = F.length(title), F.length(body)
    score = base + points((t > 30, 0.1), (t > 60, 0.1), (b > 200, 0.1), (b > 500, 0.1), (b > 1000, 0.1))
    return clamp(score + F.least(numbers * 0.05, F.lit(0.2)))


# --- quality --------------------------------------------------------------------------


def article_quality(title: Column, content: Column, summary: Column) -> Column:
    """Additive quality, 0 to 1, with a penalty for each boilerplate term."""
    t, c = F.length(title), F.length(content)
    whole = F.concat_ws(" ", title, summary, content)
    score = points(
        (t >= 25, 0.25), (F.length(summary) >= 35, 0.15), (c >= 180, 0.35), (c >= 500, 0.10),
        (whole.rlike("[.؟]"), 0.10), ((t < 18) | (c < 80), -0.35),
    )
    return clamp(score - tx.hits(F.lower(whole), lx.QUALITY_BLOCKED) * 0.35)


def dedup_quality(title: Column, content: Column, summary: Column, image_url: Column, published: Column) -> Column:
    """Which of several copies to keep: richer title, longer text, image, date."""
    words, c = tx.word_count(title), F.length(content)
    image = F.coalesce(image_url, F.lit(""))
    return points(
        (words >= 5, 1), (words >= 8, 1), (c >= 100, 1), (c >= 300, 1), (c >= 600, 1), (F.length(summary) >= 80, 1),
        ((image != "") & ~image.contains("placehold.co"), 1), (published.isNotNull(), 0.5),
    )


def group_quality(content: Column, summary: Column, image_url: Column, author: Column, priority: Column) -> Column:
    image = F.coalesce(image_url, F.lit(""))
    return points(
        ((image != "") & ~image.contains("placeholder"), 5), (F.length(content) > 200, 4), (F.length(summary) > 50, 2),
        (F.coalesce(author, F.lit("")) != "", 1),
    ) + priority


# --- categories -----------------------------------------------------------------------


def category_hits(text: Column, terms: Mapping[str, str] = lx.CATEGORY_TERMS) -> Column:
    """Array of (category, size of its list, matched terms), in list order, for matched categories."""

    def scan(s: Column) -> Column:
        rows = []
        for name, listed in terms.items():
            vocabulary = lx.phrases(listed)
            rows.append(F.struct(
                F.lit(name).alias("category"), F.lit(len(vocabulary)).alias("size"),
                F.filter(tx.literals(vocabulary), lambda w: s.contains(w)).alias("matched"),
            ))
        return F.filter(F.array(*rows), lambda r: F.size(r["matched"]) > 0)

    return tx.let(F.lower(text), scan)


def _best(rows: Column, score) -> Column:
    """First row with the highest score (rows keep their list order)."""
    highest = F.array_max(F.transform(rows, score))
    return tx.let(highest, lambda top: F.try_element_at(F.filter(rows, lambda r: score(r) == top), F.lit(1)))


def _sum(rows: Column, score) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + score(r))


def keyword_category(hits: Column) -> Column:
    """(category, confidence) by the number of contained terms."""
    def n(r):
        return F.size(r["matched"]).cast("double")

    return _labelled(hits, n)


def _labelled(hits: Column, score) -> Column:
    """(category, confidence) of the best row; the text behind ``hits`` is scanned once."""

    def label(rows: Column) -> Column:
        return tx.let(_best(rows, score), lambda best: F.struct(
            F.coalesce(best["category"], F.lit("general")).alias("category"),
            F.when(F.size(rows) > 0, F.least(0.5 + score(best) / _sum(rows, score) * 0.4, F.lit(0.95))).otherwise(0.3).alias("confidence"),
        ))

    return tx.let(hits, label)


def weighted_share_category(hits: Column) -> Column:
    """(category, confidence, matched) by the share of a category's list that occurs; weak results fall back."""
    def share(r):
        return F.size(r["matched"]) / r["size"]

    def label(best: Column) -> Column:
        value = share(best)
        weak = F.coalesce(value < 0.2, F.lit(True))
        return F.struct(
            F.when(weak, "varieties").otherwise(best["category"]).alias("category"),
            F.when(weak, 0.3).otherwise(value).alias("confidence"),
            F.coalesce(best["matched"], F.array().cast("array<string>")).alias("matched"),
        )

    return tx.let(tx.let(hits, lambda rows: _best(rows, share)), label)


def flag_category(hits: Column) -> Column:
    """(category, confidence) where each hit category scores its flat points once."""
    pairs = [x for kv in lx.CATEGORY_POINTS.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))]

    def value(r):
        return F.coalesce(F.create_map(*pairs)[r["category"]], F.lit(2.0))

    return _labelled(hits, value)


def first_listed(text: Column, listed: Mapping[str, str], default: str) -> Column:
    """Name of the first list with a contained term."""
    def ladder(s: Column) -> Column:
        out = None
        for name, terms in listed.items():
            cond = tx.any_of(s, lx.phrases(terms))
            out = F.when(cond, name) if out is None else out.when(cond, name)
        return out.otherwise(default)

    return tx.let(text, ladder)


def subcategory(text: Column) -> Column:
    return first_listed(F.lower(text), lx.SUBCATEGORIES, "")


def event_type(text: Column) -> Column:
    return first_listed(F.lower(tx.normalize(text)), lx.EVENT_TYPES, "General")
