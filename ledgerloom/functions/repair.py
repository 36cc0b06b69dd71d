"""Text as read from pages made whole again, and keys made from parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.names import _nfkc_lines

# Signs and what stands for them; word ends that page text cuts off after fi or fl.
SIGNS = {"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "}
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
SOFT_HYPHEN = "­"
CUT_ENDS = ["ed", "es", "er", "cation", "cations", "nancial", "rm", "ve", "x", "ne"]


def plain_signs(text: Column) -> Column:
    """Ligatures spelt out, quotes and dashes made plain, soft hyphens gone, blanks collapsed; line breaks stay, one empty line at most. Null stays null."""
    for sign, letters in LIGATURES.items():
        text = F.replace(text, F.lit(sign), F.lit(letters))
    text = F.translate(text, "".join(SIGNS) + SOFT_HYPHEN, "".join(SIGNS.values()))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n\s*\n+", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def page_text(text: Column) -> Column:
    """plain_signs of the compatibility form (NFKC), for which Spark has no function: in Arrow batches."""
    return plain_signs(F.pandas_udf(_nfkc_lines, "string")(text))


def rejoined(text: Column) -> Column:
    """Words that were cut after fi or fl and go on with a known end."""
    return F.regexp_replace(text, rf"(?<=[a-z])(fi|fl) (?=(?:{'|'.join(CUT_ENDS)})\b)", "$1")


def undoubled(text: Column) -> Column:
    """Letters and blanks of lower-cased text, with a word that repeats at once, or two that do, standing once."""
    letters = F.btrim(F.regexp_replace(F.regexp_replace(rejoined(F.lower(text)), r"[^a-z\s]", " "), r"\s+", " "))
    words = F.split(letters, " ")
    single = F.array_join(F.filter(words, lambda w, i: (i == 0) | (w != F.get(words, i - 1))), " ")
    return F.regexp_replace(single, r"\b(\w+ \w+)(?: \1\b)+", "$1")


def numbers_as_zero(text: Column) -> Column:
    """Lower case, a run of digits, points and commas as ' 0 '. Null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[0-9][0-9,.]*", " 0 ")


def sentence_key(text: Column, size: int = 120) -> Column:
    """The first `size` small letters and blanks: by it, sentences that differ in figures alone are equal."""
    return F.substring(F.btrim(F.regexp_replace(F.lower(text), "[^a-z ]", "")), 1, size)


def document_key(firm: Column, fy: Column) -> Column:
    return F.concat(firm.cast("string"), F.lit("_FY"), fy.cast("int").cast("string"))


def code_text(code: Column) -> Column:
    """A code read as a number is text without the '.0' that it got."""
    return F.regexp_replace(F.btrim(code.cast("string")), r"\.0$", "")


def prefixed_id(*parts: tuple[str, Column]) -> Column:
    """The first part that is neither null nor blank, after its prefix."""
    return F.coalesce(*[F.when(F.btrim(c.cast("string")) != "", F.concat(F.lit(p), F.btrim(c.cast("string")))) for p, c in parts])
