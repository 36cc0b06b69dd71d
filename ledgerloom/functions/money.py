"""Printed money to numbers, as Column expressions. Figures come out in crore (10^7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import let

# Factor of each unit to crore, and cells that mean "no figure".
TO_CRORE = {"crore": 1.0, "lakh": 1e-2, "million": 1e-1, "billion": 1e2, "thousand": 1e-4, "hundred": 1e-5, "rupee": 1e-7}
NIL = ["", "-", "--", "---", "–", "—", "―", "−", "nil", "nill", "null", "na", "n.a.", "n/a", "none", "not applicable", "*", "**", "#", "."]
UNITS = [
    ("crore", r"\bcrores?\b|\bcr\.?\b|\bkoti\b"), ("lakh", r"\blakhs?\b|\blaks?\b|\blacs?\b"), ("billion", r"\bbillions?\b|\bbn\b"),
    ("million", r"\bmillions?\b|\bmn\b|\bmio\b"), ("thousand", r"\bthousands?\b|['’]000|\bin\s+000"), ("hundred", r"\bhundreds?\b"),
    ("rupee", r"\bin\s+(?:₹\s*)?rupees\b|\bin\s+absolute\s+(?:terms|figures)\b|\bin\s+units\b|\bamounts?\s+in\s+(?:rs\.?|₹|`)\s*\)"),
]
SLIPS = ("OoDIl|SsBZg", "00011155829")  # letters that scanning takes for digits


def parse(raw: Column, unit: Column | str = "crore") -> Column:
    """STRUCT<value, printed, raw, unit, is_nil, confidence, flags>.

    Brackets, or a minus that touches its digits, make a figure negative. A nil
    cell is not zero. Two numbers in a cell, two decimal points and what is no number are
    refused; slips of scanning, odd grouping and too many decimals cost confidence."""
    unit = F.lit(unit) if isinstance(unit, str) else unit
    return let(F.trim(F.coalesce(raw.cast("string"), F.lit(""))), lambda text: _signed(text, raw, unit))


def _signed(text: Column, raw: Column, unit: Column) -> Column:
    bracket = text.rlike(r"\(\s*[0-9.,OoIlSB|]+\s*\)")
    minus = text.rlike(r"^[-−–][0-9]") | text.rlike(r"[0-9][-−]$")
    lost = text.rlike(r"^\s*[0-9.,]+\s*\)\s*$")
    style = F.when(bracket, "bracket").when(minus, "minus").when(lost, "lost").otherwise("")

    def bared(style: Column) -> Column:
        bare = F.when(style.isin("bracket", "lost"), F.regexp_replace(text, r"[()]", "")).when(style == "minus", F.regexp_replace(text, "[-−–]", "")).otherwise(text)
        bare = F.trim(F.regexp_replace(bare, r"(?i)₹|\brs\.?|\binr\b|\brupees\b|\$|\busd\b|\[[^\]]*\]|[*#†‡^~\x{A0}]", ""))
        return let(bare, lambda b: _mended(text, b, style, raw, unit))

    return let(style, bared)


def _mended(text: Column, bare: Column, style: Column, raw: Column, unit: Column) -> Column:
    # A letter between digits is a slip; at the end it is a suffix. Neighbours may share a digit, so twice.
    fixed = s = F.regexp_replace(bare, r"\s+", "")
    for a, b in zip(*SLIPS, strict=True):
        for _ in range(2):
            fixed = F.regexp_replace(fixed, rf"(?<=[0-9,.])[{a}](?=[0-9,.])", b)
    letters = F.when(s.rlike(r"[0-9,.][OoDIl|SsBZg][0-9,.]"), fixed).otherwise(s)
    return let(s, lambda plain: let(letters, lambda m: let(F.regexp_replace(m, ",", ""), lambda digits: _read(text, bare, plain, m, digits, style, raw, unit))))


def _read(text, bare, plain, mended, digits, style, raw, unit) -> Column:
    nil = F.lower(text).isin(NIL) | F.lower(bare).isin(NIL)
    two = bare.rlike(r"[0-9][0-9,.]*\s+[0-9,.]*[0-9]")
    lost, slipped = style == "lost", mended != plain
    numeric = mended.rlike(r"^[0-9.,]+$")
    shape = numeric & digits.rlike(r"^[0-9]+(\.[0-9]+)?$")
    points = numeric & digits.rlike(r"\..*\.")
    western = mended.rlike(r"^[0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)?$")
    indian = ~western & mended.rlike(r"^[0-9]{1,2}(,[0-9]{2})+,[0-9]{3}(\.[0-9]+)?$")
    odd = mended.contains(",") & ~western & ~indian
    long_tail = digits.rlike(r"\.[0-9]{3,}$")
    good = ~nil & ~two & shape
    told = [
        ("ocr_lost_open_bracket", lost & ~nil), ("multiple_numbers_in_cell", ~nil & two), ("ocr_char_substitution", ~nil & ~two & slipped), ("multiple_decimal_points", ~nil & ~two & points),
        ("unparseable", ~nil & ~two & ~shape & ~points), ("indian_grouping", good & indian), ("irregular_digit_grouping", good & odd), ("unexpected_decimal_precision", good & long_tail),
    ]
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in told]))
    cost = F.when(lost, 0.15).otherwise(0.0) + F.when(slipped, 0.25).otherwise(0.0) + F.when(odd, 0.30).otherwise(0.0) + F.when(long_tail, 0.20).otherwise(0.0)
    printed = F.when(good, F.when(style == "", 1.0).otherwise(-1.0) * digits.try_cast("double"))
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in TO_CRORE.items() for x in kv]), unit)
    confidence = F.when(nil, 1.0).when(good, F.greatest(F.lit(0.0), F.round(1.0 - cost, 4))).otherwise(0.0)
    return F.struct(F.bround(printed * factor, 9).alias("value"), printed.alias("printed"), raw.cast("string").alias("raw"), unit.alias("unit"), nil.alias("is_nil"), confidence.alias("confidence"), flags.alias("flags"))


def detect_unit(caption: Column, default: str = "crore") -> Column:
    """STRUCT<unit, confidence>: a unit in a caption (in brackets, or after "amounts in", "Rs. in") counts before one in prose.

    One unit in a caption is sure; a second anywhere costs confidence; none leaves the default, unsure."""
    t = F.regexp_replace(F.lower(F.coalesce(caption, F.lit(""))), r"\bdr\.?\s+cr\.?\b", " ")
    return let(t, lambda x: _unit_of(x, default))


def _unit_of(t: Column, default: str) -> Column:
    captions = F.array_join(F.regexp_extract_all(t, F.lit(r"\([^()\n]*\b(?:in|amounts?|figures|₹|rs\.?|inr)[^()\n]*\)?|(?:all\s+)?(?:amounts?|figures|rs\.?|₹)\s+(?:are\s+)?in\b[^\n]*"), F.lit(0)), "\n")

    def found(where: Column) -> Column:
        plain = F.regexp_replace(where, r"\(all amounts in rupees\)", "in rupees")
        return F.array_compact(F.array(*[F.when(plain.rlike(p), F.lit(u)) for u, p in UNITS]))

    return let(found(captions), lambda first: let(found(t), lambda any_: _chosen(first, any_, default)))


def _chosen(first: Column, any_: Column, default: str) -> Column:
    pick = F.coalesce(F.get(first, F.lit(0)), F.get(any_, F.lit(0)))
    sure = F.when(F.size(first) > 0, F.when(F.size(any_) > 1, 0.75).otherwise(0.95)).when(F.size(any_) > 0, 0.55).otherwise(0.3)
    return F.struct(F.coalesce(pick, F.lit(default)).alias("unit"), sure.alias("confidence"))


_CELL = r"\(?\s?[0-9][0-9,]*(?:\.[0-9]+)?\s?\)?|(?<=\s)[-–—](?=\s|$)|(?i)\bnil\b"


def split_line(line: Column, periods: int = 2) -> Column:
    """STRUCT<label, figures>: the last `periods` money cells of a statement's line; dashes and nil are cells too.

    What stands between label and figures, a note's number, goes. Formulas in brackets and spaces that scanning put into figures are closed first."""
    t = F.coalesce(line, F.lit(""))
    t = F.regexp_replace(t, r"\((?:[0-9IVXivx]{1,4}\s*[-+]\s*)+[0-9IVXivx]{1,4}\)", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?<=[0-9]) +(?=,[0-9])|(?<=[0-9],) +(?=[0-9]{2,3}(?![0-9]))", ""), r"(?<=[0-9]) *\. *(?=[0-9]{2}(?![0-9]))", ".")
    t = F.regexp_replace(t, r"^[^A-Za-z]*(?=[A-Za-z])", "")
    return let(t, lambda x: let(F.transform(F.regexp_extract_all(x, F.lit(_CELL), F.lit(0)), lambda c: F.trim(c)), lambda cells: _columns(x, cells, periods)))


def _columns(t: Column, cells: Column, periods: int) -> Column:
    n = F.size(cells)
    note = F.get(cells, F.lit(0)).rlike("^[0-9]{1,2}$")
    money = lambda c: c.rlike(r",|\(|\.[0-9]{1,2}$") | (F.length(F.regexp_replace(c, "[^0-9]", "")) >= 4)
    short = (n > 0) & (n <= periods) & note & ((n == 1) | F.exists(F.slice(cells, 2, periods), money))
    figures = F.when(short, F.slice(cells, 2, periods)).when(n > periods, F.slice(cells, -periods, periods)).otherwise(cells)
    head = F.get(F.split(t, r"(?<![A-Za-z])\(?[0-9][0-9,]*(?:\.[0-9]+)?\)?(?=\s|$)|\s[-–—](?=\s|$)|(?i)\bnil\b", 2), F.lit(0))
    label = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(head, r"\.{2,}", " "), r"\s+", " ")), r"^[ .:…\-–—|]+|[ .:…\-–—|(]+$", "")
    return F.struct(label.alias("label"), figures.alias("figures"))
