"""Text features as Column expressions: words, sentences, hedges, tone, readability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that results depend on.
STOPWORDS = (
    "a an the and or but if then than as at by for from in into of on to with is are was were be been being have has had it its this "
    "that these those which who whom we our us they their them he she his her not no so such also"
).split()
HEDGES = (
    "may might could would should possibly possible perhaps probable probably likely unlikely appear appears appeared "
    "seem seems seemed suggest suggests indicate indicates believe believes believed expect expects expected anticipate "
    "anticipates anticipated assume assumes assumed estimate estimates estimated approximately roughly around substantially "
    "generally largely partially somewhat relatively potential potentially tentative uncertain pending presumably"
).split()
HEDGE_PHRASES = ["subject to", "to the extent", "in the event that", "no assurance", "cannot be assured", "cannot assure", "depending upon", "depending on", "in due course", "at this stage", "as and when"]
DISTRESS_PHRASES = [
    "one time settlement", "corporate debt restructuring", "strategic debt restructuring", "non performing asset", "wilful defaulter", "willful defaulter",
    "default in repayment", "defaulted in repayment", "delay in repayment", "invoked the pledge", "pledge invoked", "recall notice", "sarfaesi",
    "debt recovery tribunal", "asset reconstruction company", "resolution plan", "net worth has eroded", "erosion of net worth",
    "sick industrial", "restructuring of debt", "moratorium under section", "insolvency resolution", "failed to pay", "unable to service",
]
SYLLABLES = {"business": 2, "businesses": 3, "revenue": 3, "revenues": 3, "employee": 3, "employees": 4, "family": 3, "families": 3}
TONES = ["negative", "positive", "uncertainty", "litigious", "strong_modal", "weak_modal", "constraining"]


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once: a lambda's variable is not expanded where it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def as_text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def unbroken(text: Column) -> Column:
    """A hyphen at a line's end joins the word's halves."""
    return F.regexp_replace(text, r"-[ \t\r\n\f\x0B]*\n[ \t\r\n\f\x0B]*", "")


def words(text: Column) -> Column:
    """Runs of A-Z letters, lower-cased: the denominator of every share."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(unbroken(text), "[^A-Za-z]+", " ")), F.lit("[a-z]+"), F.lit(0))


def cleaned(tokens: Column) -> Column:
    """Without stopwords and single letters."""
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def sentences(text: Column) -> Column:
    """Lines are units; list markers go; a line is cut where end punctuation meets what starts a sentence."""
    bullet = r"(?i)^[ \t\r\f]*(?:[-•·*●▪]|\(?[ivxlc]{1,4}\)|\(?[a-z]\)|[0-9]{1,2}[.)])[ \t\r\f]+"
    lines = F.transform(F.split(unbroken(text), "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), bullet, ""), "[ \t]+", " ")))
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def share(part: Column, whole: Column) -> Column:
    """part / whole; null where the whole is nothing."""
    return F.when(whole > 0, part.cast("double") / whole)


def member_count(tokens: Column, members) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(list(members))))


def member_distinct(tokens: Column, members) -> Column:
    return F.size(F.array_distinct(F.filter(tokens, lambda t: t.isin(list(members)))))


def for_phrases(text: Column) -> Column:
    """Lower case; hyphens and white space of any kind are one space."""
    return F.regexp_replace(F.lower(unbroken(text)), r"[\s\-‐-―]+", " ")


def phrase_pattern(phrases) -> str:
    """One alternation, longest first, so that matches do not overlap."""
    return "|".join(sorted({p.lower() for p in phrases}, key=lambda p: (-len(p), p)))


def phrase_hits(text: Column, phrases) -> Column:
    return F.regexp_extract_all(for_phrases(text), F.lit(phrase_pattern(phrases)), F.lit(0))


def syllables(word: Column) -> Column:
    """By vowel groups: a silent last e is none, split pairs are two; at least one."""
    plain = F.regexp_count(word, F.lit("[aeiouy]+"))
    silent = word.rlike("(^|[^aeiouy])e$") & ~word.rlike("(le|ee|ye)$") & (plain > 1)
    # A pair in -tion, -sion or -cion stays one. No pair ends with a letter that another starts with, so one count has them all.
    pairs = F.regexp_count(word, F.lit("ia|(?<![tsc])io|io(?!n)|eo|ua|uo"))
    n = F.greatest(F.lit(1), plain - silent.cast("int") + pairs)
    known = F.create_map(*[F.lit(x) for kv in SYLLABLES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, word), n)


def is_complex(word: Column) -> Column:
    """Three syllables or more, an ending -es or -ed aside."""
    stem = F.when(word.isin("es", "ed"), word).otherwise(F.regexp_replace(word, "(es|ed)$", ""))
    return F.get(F.transform(F.array(stem), lambda s: syllables(s) >= 3), F.lit(0))  # the stem is worked out once


def fog(n_words: Column, n_sentences: Column, n_complex: Column) -> Column:
    return F.when((n_words > 0) & (n_sentences > 0), 0.4 * (n_words / n_sentences + 100.0 * n_complex / n_words))


def grams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, space-joined; none if there are fewer. The tokens are worked out once, not again at each place."""

    def runs(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))

    return let(tokens, runs)
