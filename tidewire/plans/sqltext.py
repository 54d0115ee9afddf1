"""SQL spellings of the text helpers, for the query twins."""

from __future__ import annotations

from tidewire.functions import lexicon as lx
from tidewire.functions import text as tx


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def inn(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def hits(text: str, terms) -> str:
    return f"len(list_filter({lst(terms)}, lambda w: contains({text}, w)))"


def any_of(text: str, terms) -> str:
    return f"({hits(text, terms)} > 0)"


def words(text: str, min_len: int = 1) -> str:
    return f"list_filter(regexp_split_to_array(trim({text}), '\\s+'), lambda w: length(w) >= {min_len})"


def tokens(text: str, min_len: int = 3) -> str:
    return (f"list_filter(string_split(regexp_replace(lower({text}), '[^\\pL\\pN]+', ' ', 'g'), ' '), "
            f"lambda w: length(w) >= {min_len})")


def squeeze(text: str) -> str:
    return f"regexp_replace(trim({text}), '\\s+', ' ', 'g')"


def normalize(text: str) -> str:
    return (f"trim(regexp_replace(translate(translate(regexp_replace({text}, {q(tx.MARKS)}, '', 'g'), "
            f"{q(tx.FOLD_FROM)}, {q(tx.FOLD_TO)}), {q(tx.SYMBOLS)}, {q(' ' * len(tx.SYMBOLS))}), '\\s+', ' ', 'g'))")


def strip_accents(text: str) -> str:
    marks = "[ً-ٰٟ]"
    return f"translate(regexp_replace({text}, '{marks}', '', 'g'), {q(tx.ACCENT_FROM)}, {q(tx.ACCENT_TO)})"


def fingerprint_form(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace({strip_accents(f'lower({text})')}, '[^\\w\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def significant(text: str) -> str:
    """Stemming is left out: no Latin word starts with an Arabic particle."""
    clean = f"regexp_replace(lower({normalize(text)}), {q(tx.NON_WORD)}, ' ', 'g')"
    return (f"list_sort(list_distinct(list_filter(regexp_split_to_array({clean}, '\\s+'), "
            f"lambda w: length(w) >= 2 AND w NOT IN {inn(lx.ARABIC_STOP)})))")


def jaccard(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / "
            f"(len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0.0 END")


def points(*rules: tuple[str, float]) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN CAST({v} AS DOUBLE) ELSE 0.0 END" for c, v in rules) + ")"


def clamp(value: str) -> str:
    return f"least(greatest({value}, 0.0), 1.0)"


def host(url: str) -> str:
    return (f"regexp_replace(lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), "
            f"'^www\\.', '')")


def path(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def segments(url: str) -> str:
    return f"list_filter(string_split({path(url)}, '/'), lambda s: s <> '')"


def decoded(part: str) -> str:
    return f"coalesce(TRY(url_decode({part})), {part})"


def ladder(*rules: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {q(t)}" for c, t in rules) + " END"
