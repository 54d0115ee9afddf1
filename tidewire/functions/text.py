"""Text expressions: normal forms, tokens, n-grams, sentences, fingerprints, language."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import lexicon as lx

WORD_BREAK = r"[^\p{L}\p{N}]+"
NON_WORD = r"[^\w\s؀-ۿ]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def literals(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items])


def hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur in the text."""
    return let(text, lambda s: F.size(F.filter(literals(terms), lambda w: s.contains(w))))


def any_of(text: Column, terms: Sequence[str]) -> Column:
    return let(text, lambda s: F.exists(literals(terms), lambda w: s.contains(w)))


# --- Arabic -------------------------------------------------------------------------

# Fixed values of the normal form: marks dropped, letters folded, symbols that become spaces.
MARKS = "[\u064B-\u065F\u0670\u0640]"
MARK_LETTERS = "".join(map(chr, (*range(0x064B, 0x0660), 0x0670, 0x0640)))
FOLD_FROM, FOLD_TO = "أإآةى٠١٢٣٤٥٦٧٨٩", "اااهي0123456789"
SYMBOLS = "><‘\uFEFF°©؛~$+»«@\"%:!_-–#*|…¨’')([]}{/\\?؟&=;,¸،.″“”"


def normalize(text: Column) -> Column:
    # one pass over the characters; those without a counterpart are dropped
    spaced = F.translate(text, FOLD_FROM + SYMBOLS + MARK_LETTERS, FOLD_TO + " " * len(SYMBOLS))
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def drop_stop_words(text: Column, stop: Sequence[str] = tuple(lx.ARABIC_STOP)) -> Column:
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~w.isin(list(stop))), " ")


def normalize_for_search(text: Column) -> Column:
    return drop_stop_words(normalize(text))


def _from(word: Column, at: int) -> Column:
    """The word from its ``at``-th letter on."""
    return F.substring(word, F.lit(at), F.length(word))


def light_stem(word: Column) -> Column:
    """Drop one leading particle where the next letters show that it is one."""
    first, second, third = (F.substring(word, i, 1) for i in (1, 2, 3))
    n = F.length(word)
    alef = second.isin("أ", "إ", "ا")
    return (
        F.when(n <= 2, word)
        .when(first.isin("ب", "ك", "و") & (second == "ا") & (third == "ل") & (n >= 4), _from(word, 4))
        .when(first.isin("ب", "ك", "و", "ل") & alef, _from(word, 2))
        .when((first == "س") & (second == "ت"), _from(word, 3))
        .when((first == "س") & second.isin("أ", "إ", "ي"), _from(word, 2))
        .when((first == "أ") & (second == "أ"), _from(word, 2))
        .when((first == "ل") & (second == "ل") & third.isin("أ", "ا", "إ"), _from(word, 3))
        .when((first == "ل") & (second == "ل"), _from(word, 2))
        .when(first == "آ", F.concat(F.lit("أ"), _from(word, 2)))
        .otherwise(word)
    )


# Affixes in the order they are tried.
PREFIXES = ("وال", "بال", "فال", "لل", "ال", "و", "ب", "ف", "ل", "ك")
SUFFIXES = ("ية", "يه", "ون", "ين", "ات", "ان", "هم", "ها", "نا", "ني", "ه", "ي")


def affix_stem(word: Column) -> Column:
    """Strip the first matching prefix, then the first matching suffix, keeping at least three letters."""

    def strip_prefix(w: Column) -> Column:
        out = F.when(F.length(w) < 4, w)
        for p in PREFIXES:
            out = out.when(w.startswith(p) & (F.length(w) >= len(p) + 3), _from(w, len(p) + 1))
        return out.otherwise(w)

    def strip_suffix(w: Column) -> Column:
        out = F.when(F.length(word) < 4, w)
        for s in SUFFIXES:
            out = out.when(w.endswith(s) & (F.length(w) >= len(s) + 3), F.left(w, F.length(w) - len(s)))
        return out.otherwise(w)

    return let(strip_prefix(word), strip_suffix)


def significant_words(text: Column) -> Column:
    """Set of normalised, stemmed content words."""
    clean = F.regexp_replace(F.lower(normalize(text)), NON_WORD, " ")
    kept = F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) >= 2) & ~w.isin(lx.ARABIC_STOP))
    return F.array_distinct(F.filter(F.transform(kept, light_stem), lambda w: w != ""))


# --- tokens -------------------------------------------------------------------------


def tokens(text: Column, min_len: int = 3) -> Column:
    """Lower-case letter/digit runs of at least ``min_len`` characters."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: F.length(w) >= min_len)


def letter_tokens(text: Column, cap: int | None = None) -> Column:
    """Runs of letters, in order, optionally only the first ``cap``."""
    out = F.filter(F.split(text, r"[^\p{L}]+"), lambda w: w != "")
    return out if cap is None else F.slice(out, 1, cap)


def spaced_words(text: Column, min_len: int = 1) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) >= min_len)


def word_count(text: Column) -> Column:
    return F.size(spaced_words(text))


def reading_minutes(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(word_count(text) / 180)).cast("int")


def sentences(text: Column, min_len: int = 10) -> Column:
    """Split after sentence marks followed by space, and at line ends."""
    parts = F.transform(F.split(text, r"(?<=[.!?؟])\s+|\n+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= min_len)


def marked_sentences(text: Column) -> Column:
    """Split after every sentence mark, whatever follows."""
    parts = F.transform(F.split(text, r"(?<=[.!?])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def plain_sentences(text: Column, min_len: int = 1) -> Column:
    """Pieces between sentence marks and line ends, without the marks."""
    parts = F.transform(F.split(text, r"[.!?؟\n]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(parts, lambda s: F.length(s) >= min_len)


def paragraphs(text: Column, min_len: int = 1, breaks: str = r"\n+") -> Column:
    parts = F.transform(F.split(text, breaks), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(parts, lambda s: F.length(s) >= min_len)


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Set of character n-grams."""
    # a look-ahead match at every position walks the text once
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def word_bigrams(text: Column, min_len: int = 2) -> Column:
    """Set of adjacent word pairs."""
    kept = spaced_words(text, min_len)

    def pairs(w: Column) -> Column:
        n = F.size(w)
        left, right = F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1)
        joined = F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b))
        return F.when(n >= 2, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))

    return let(kept, pairs)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays without repeats; zero when either is empty."""

    def ratio(common: Column) -> Column:
        return common / (F.size(a) + F.size(b) - common)

    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, let(F.size(F.array_intersect(a, b)), ratio)).otherwise(F.lit(0.0))


# --- normal forms and fingerprints ----------------------------------------------------


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def squeeze_keep_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", "")


def sanitize(text: Column, max_len: int | None = None) -> Column:
    """Trimmed, and cut to a storage width, by characters, if one is given."""
    return F.trim(text) if max_len is None else F.substring(F.trim(text), 1, max_len)


ACCENT_FROM, ACCENT_TO = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "aaaaaaaceeeeiiiionoooooouuuuyyy"


def strip_accents(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, "[\u064B-\u065F\u0670]", ""), ACCENT_FROM, ACCENT_TO)


def fingerprint_form(text: Column) -> Column:
    bare = F.regexp_replace(strip_accents(F.lower(text)), r"[^\w\s]+", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def title_fingerprint(title: Column) -> Column:
    return F.md5(fingerprint_form(title))


def content_fingerprint(content: Column) -> Column:
    """Identity of a whole text in normal form."""
    return F.md5(fingerprint_form(content))


def url_fingerprint(host: Column, path: Column) -> Column:
    return F.md5(F.concat(F.lower(host), F.lower(path)))


def edge_fingerprint(content: Column, n: int = 50) -> Column:
    """First and last ``n`` words."""

    def edges(w: Column) -> Column:
        size = F.size(w)
        tail = F.slice(w, F.greatest(size - n + 1, F.lit(1)), F.lit(n))
        return F.when(size <= 2 * n, F.array_join(w, " ")).otherwise(
            F.concat_ws(" ", F.array_join(F.slice(w, 1, n), " "), F.array_join(tail, " "))
        )

    return let(spaced_words(F.lower(content)), edges)


def word_set(text: Column, limit: int | None = None) -> Column:
    """Sorted distinct words of three or more characters, punctuation removed.

    ``limit`` keeps only the first words of the sorted set; without it the whole text counts.
    """
    bare = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[!-/:-@\[-`{-~]", ""))
    out = F.array_sort(F.array_distinct(F.filter(bare, lambda w: F.length(w) >= 3)))
    return out if limit is None else F.slice(out, 1, limit)


# --- HTML -----------------------------------------------------------------------------

# Named entities decoded, in order.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&hellip;", "…"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&amp;", "&"),
)
BLOCK_TAGS = "br|p|div|section|article|header|footer|h[1-6]|li|tr|td|th|blockquote|figure|aside|nav"


def decode_entities(text: Column) -> Column:
    out = text
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def html_text(html: Column) -> Column:
    """Plain text with a line per block element."""
    out = html
    for pattern in (r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>", r"(?s)<!--.*?-->"):
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, rf"(?i)<(?:{BLOCK_TAGS})[^>]*>", "\n")
    out = decode_entities(F.regexp_replace(out, r"<[^>]+>", " "))
    return F.regexp_replace(out, r"[ \t]+", " ")


def strip_tags(text: Column) -> Column:
    return squeeze(decode_entities(F.regexp_replace(text, r"<[^>]*>", "")))


def clean_title(title: Column) -> Column:
    return squeeze(F.regexp_replace(F.trim(title), r"^(?:فيديو|عاجل|صور|شاهد|حصرياً|متابعة|هام)\s*[:：\-]\s*", ""))


def clean_sentence(sentence: Column) -> Column:
    out = sentence
    for part in lx.SENTENCE_BOILERPLATE:
        out = F.replace(out, F.lit(part), F.lit(""))
    return squeeze(F.regexp_replace(out, r"\s*#\w+(?:\s*#\w+)*\s*", " "))


# --- language -------------------------------------------------------------------------

LANGUAGES = (
    ("fr", lx.FRENCH_MARKERS), ("en", lx.ENGLISH_MARKERS), ("de", lx.GERMAN_MARKERS), ("es", lx.SPANISH_MARKERS),
)


def language_scores(text: Column) -> Column:
    """Struct of evidence per language: Arabic letters, marker words of the others."""

    def count(words: Column, markers: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(markers)))

    def marked(words: Column) -> Column:
        fields = [count(words, markers).alias(code) for code, markers in LANGUAGES]
        return F.struct(F.regexp_count(text, F.lit("[؀-ۿ]")).alias("ar"), *fields)

    return let(F.split(F.lower(text), r"\s+"), marked)


def language_label(scores: Column) -> Column:
    codes = ("ar", *[c for c, _ in LANGUAGES])
    best = F.greatest(*[scores[c] for c in codes])
    out = F.when(best <= 0, "und")
    for code in codes:
        out = out.when(scores[code] == best, code)
    return out


def is_mixed_language(scores: Column) -> Column:
    return sum(((scores[c] > 0).cast("int") for c in ("ar", "fr", "en")), F.lit(0)) >= 2


def arabic_or_latin(text: Column) -> Column:
    ar, latin = F.regexp_count(text, F.lit("[؀-ۿ]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((text == "") | (ar >= latin), "ar").otherwise("en")


def is_arabic(text: Column) -> Column:
    need = F.greatest(F.lit(1), F.floor(F.length(text) * 0.6))
    return (text == "") | (F.regexp_count(text, F.lit("[؀-ۿ]")) >= need)


# --- names ------------------------------------------------------------------------------


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))


# Category ids that fold into another.
CATEGORY_IDS = {
    "general_news": "general", "tech": "technology", "world": "general", "international": "general",
    "biz": "economy", "business": "economy", "markets": "economy", "sport": "sports",
}


def category_id(raw: Column) -> Column:
    pairs = [x for kv in CATEGORY_IDS.items() for x in map(F.lit, kv)]
    return F.coalesce(F.create_map(*pairs)[raw], raw)


def valid_metadata(raw: Column, max_len: int | None = None) -> Column:
    """JSON text, null when it is not valid JSON or, where a storage width is given, longer than that."""
    valid = (raw != "") & F.try_parse_json(raw).isNotNull()
    return F.when(valid if max_len is None else valid & (F.char_length(raw) <= max_len), raw)
