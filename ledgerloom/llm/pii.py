"""Personal data, found by DataFrame functions alone.

Regular expressions propose spans. A text is split at each pattern and the same
pattern's matches extracted, so offsets are running sums of lengths; they are
summed in blocks, which stays linear in practice for any number of matches.
Checksums and digit counts confirm the spans, and words shortly before them
raise the score. Offsets count code points; ends are exclusive.

Every pattern is written so that a failed attempt costs no more than the run it
looked at: possessive repeats, and starts only where a run starts (or where the
last match ended, as the plain pattern would).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order of listing, their patterns and a string without which a text has none.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A maximal run of digits with single separators, of 12 to 19 digits: shorter and longer runs fail anyway.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+", "iban": "", "ssn": "-"}
WORDS = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse|dirección",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "tel|phone|call|mobile|fax|ruf|llam|appel",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|insurance",
}
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
LEAST = 0.5
CONTEXT = 40
BLOCK = 64


def _starts(pieces: Column, hits: Column) -> Column:
    """Offset of each hit: lengths of the pieces up to it and of the hits before it."""
    steps = F.transform(hits, lambda h, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0))
    n = F.size(hits)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))

    def running(values: Column, first: Column) -> Column:
        empty = F.array().cast("array<int>")
        return F.aggregate(values, F.struct(first.alias("at"), empty.alias("out")), lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["out"], a["at"] + v).alias("out")), lambda a: a["out"])

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v))
    ends = running(totals, F.lit(0))
    return F.flatten(F.transform(blocks, lambda b, i: running(b, F.when(i > 0, F.get(ends, i - 1)).otherwise(0))))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where every second digit from the right, doubled, and the others sum to a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: x.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def mod97(code: Column) -> Column:
    """True where an account number, its first four characters moved to the end and letters counted from 10, is 1 modulo 97."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    letters = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    values = F.transform(F.split(moved, ""), lambda c: F.instr(letters, c) - 1)
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        return luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        code = F.replace(hit, F.lit(" "), F.lit(""))
        return F.length(code).between(15, 34) & mod97(code)
    if kind == "ssn":
        return ~hit.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def find(df: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """`df` with `out`: ARRAY<STRUCT<kind, start, end, text, score>>, by start, then kind as listed.

    A null or empty text has an empty array. Matches of one kind never
    overlap, those of different kinds may. Spans of BASE kinds stay whatever
    their score; those of ADDED kinds need LEAST. A column named `out` is
    replaced; other columns stay as they are. There is no shuffle: repeated
    rows, hot keys and row order do not matter."""
    kinds = BASE + ADDED
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    own = "__pii_{}".format
    none = F.array().cast("array<string>")
    rows = df.select(*keep, text.alias(own("text")))
    at = F.col(own("text"))
    hits = [F.when(at.contains(HINTS[k]) if HINTS[k] else at.rlike("[0-9]"), F.regexp_extract_all(at, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(own(f"{k}_hits")) for k in kinds]
    rows = rows.select("*", *hits)
    rows = rows.select("*", *[F.when(F.size(own(f"{k}_hits")) > 0, F.split(at, PATTERNS[k], -1)).otherwise(none).alias(own(f"{k}_pieces")) for k in kinds])
    rows = rows.select("*", *[F.when(F.size(own(f"{k}_hits")) > 0, _starts(F.col(own(f"{k}_pieces")), F.col(own(f"{k}_hits")))).otherwise(F.array().cast("array<int>")).alias(own(f"{k}_at")) for k in kinds])

    def span(k: str) -> Column:
        score = lambda s, h: F.lit(START[k]) + F.when(F.lower(F.substring(at, F.greatest(s - CONTEXT, F.lit(0)) + 1, F.least(s, F.lit(CONTEXT)))).rlike(WORDS[k]), 0.2).otherwise(0.0)
        made = F.zip_with(own(f"{k}_at"), own(f"{k}_hits"), lambda s, h: F.struct(s.alias("start"), F.lit(kinds.index(k)).alias("rank"), F.lit(k).alias("kind"), (s + F.length(h)).alias("end"), h.alias("text"), score(s, h).alias("score")))
        sure = F.filter(made, lambda x: _confirmed(k, x["text"]))
        return sure if k in BASE else F.filter(sure, lambda x: x["score"] >= LEAST)

    rows = rows.select("*", *[F.when(F.size(own(f"{k}_hits")) > 0, span(k)).otherwise(F.array()).alias(own(f"{k}_spans")) for k in kinds])
    whole = F.array_sort(F.concat(*[F.col(own(f"{k}_spans")) for k in kinds]))
    fields = F.transform(whole, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["score"].alias("score")))
    return rows.select(*keep, fields.alias(out))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(df: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of documents(doc_id, text)."""
    found = find(df.select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    of = lambda k: F.filter("pii", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with each span of `text_col` replaced by its kind in angle brackets.

    Where spans overlap, the one that starts first stands, then the one of the
    kind listed first; the rest of a longer one goes with it. A null text stays null. Columns keep their order."""
    name = "__pii_found"
    text = F.col(text_col)

    def step(a: Column, x: Column) -> Column:
        """Spans that overlap are joined to one under the first one's kind."""
        last = F.element_at(a, -1)
        joined = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        new = F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
        return F.when((F.size(a) > 0) & (x["start"] < F.try_element_at(a, F.lit(-1))["end"]), F.array_append(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.when(F.size(a) > 0, joined))).otherwise(F.array_append(a, new))

    found = find(df, text_col, name)
    spans = F.aggregate(name, F.array().cast("array<struct<kind:string,start:int,end:int>>"), step)
    found = found.select("*", spans.alias("__pii_spans"))
    s = F.col("__pii_spans")
    parts = F.transform(s, lambda x, i: F.concat(F.substring(text, F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(0) + 1, x["start"] - F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(0)), F.lit("<"), x["kind"], F.lit(">")))
    rest = F.substring(text, F.element_at(s, -1)["end"] + 1, F.length(text))
    clean = F.when(F.size(s) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
