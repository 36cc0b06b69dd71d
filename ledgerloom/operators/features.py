"""The wide feature row of a document: its sections' language, and what its auditor states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X

# Which sections are read, the rank of opinions, sections that are flags by being there, where a clause ends, what denies
# or supposes, and what two reportable failures look like in lower case. The third is a failure with its own "not".
SECTIONS = {"mdna": "mdna", "auditor": "auditor_report"}
SEVERITY = {"unmodified": 0.0, "qualified": 1.0, "adverse": 2.0, "disclaimer": 3.0}
PRESENT = {
    "has_going_concern": "going_concern", "has_emphasis_of_matter": "emphasis_of_matter", "has_modified_opinion_basis": "basis_for_modified_opinion",
    "has_mdna": "mdna", "has_auditor_report": "auditor_report", "has_caro_annexure": "caro_annexure",
}
ITEM = r"\s*(?:\(?[ivxlc]{1,5}\)|\(?[a-z]\)|[0-9]{1,2}[.)]|[•\-–])"
CUE = r"\b(?:not|no|never|neither|nor|without|whether|nil|none)\b"
LOAN_DEFAULT = r"default(?:ed|s)?\s+in\s+(?:the\s+)?(?:repayment|payment)|has\s+defaulted|wil{1,2}ful\s+defaulter|delay(?:s|ed)?\s+in\s+(?:the\s+)?repayment"
UNPAID_DUES = r"arrears\s+of\s+statutory\s+dues|statutory\s+dues([\w\s,'\-]{0,60})(?:outstanding|in\s+arrears|not\s+been\s+paid)"
IRREGULAR = r"\bnot\s+been\s+regular\s+in\s+depositing"
# Columns that name a row or its place in the study, no features.
NAMING = [
    "doc_id", "firm_id", "fy", "pair_id", "role", "label", "horizon", "included", "exclude_reason", "perplexity_source",
    "has_previous_year", "perplexity_in_training", "drift_previous_doc_id",
]


def states(text: Column, phrase: str, gap: bool = False) -> Column:
    """Whether a clause states `phrase`: no cue before it there, nor, with `gap`, in the phrase's own group.

    The first match of a clause decides: what denies it stands before all later ones too. Null for a null text."""
    clauses = F.transform(F.split(F.lower(text), rf"[.;]+|\n(?={ITEM})"), lambda c: F.regexp_replace(c, r"\s+", " "))

    def free(clause: Column, group: int) -> Column:
        return ~F.regexp_extract(clause, f"(?s)^(.*?)(?:{phrase})", group).rlike(CUE)

    return F.exists(clauses, lambda c: c.rlike(phrase) & (free(c, 1) & free(c, 2) if gap else free(c, 1)))


def section_features(words: Column, sentences: Column, hedged: Column, distress: Column, tones: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Shares and counts of one section; shares are null without words. Without lists of words, tones are null."""
    n, ns = F.size(words), F.size(sentences)
    some = n > 0
    read = some & (ns > 0)
    hard = F.size(F.filter(words, X.is_complex))
    out = {f"lm_{t}_ratio": X.share(X.member_count(words, tones[t]), n) if tones.get(t) else F.lit(None).cast("double") for t in X.TONES}
    out |= {"hedge_density": X.share(X.member_count(words, X.HEDGES), n), "hedge_distinct": F.when(some, X.member_distinct(words, X.HEDGES).cast("double")), "hedge_phrase_density": X.share(F.size(hedged), n)}
    out |= {"distress_phrase_density": X.share(F.size(distress), n), "distress_phrase_distinct": F.when(some, F.size(F.array_distinct(distress)).cast("double"))}
    out |= {"fog_index": X.fog(n, ns, hard), "avg_sentence_length": F.when(read, n / ns), "complex_word_ratio": F.when(read, hard / n)}
    return out | {"n_words": F.when(read, n.cast("double")).otherwise(0.0), "n_sentences": F.when(read, ns.cast("double")).otherwise(0.0)}


def document_features(docs: DataFrame, keys: Sequence[str], tones: Mapping[str, Sequence[str]], sections: Mapping[str, str] = SECTIONS) -> DataFrame:
    """keys, then the features of each section under its prefix, and the flags; a row for each row, with no shuffle.

    docs: keys, texts MAP<section, text>, opinion. A section that is missing has no words; flags of the annexure are null without it."""
    of = lambda name: F.coalesce(F.try_element_at("texts", F.lit(name)), F.lit(""))
    parts = {}
    for prefix, name in sections.items():
        t = of(name)
        parts |= {f"__{prefix}_w": X.words(t), f"__{prefix}_s": X.sentences(t), f"__{prefix}_h": X.phrase_hits(t, X.HEDGE_PHRASES), f"__{prefix}_d": X.phrase_hits(t, X.DISTRESS_PHRASES)}
    rows = docs.withColumns({**parts, "__caro": F.nullif(of("caro_annexure"), F.lit(""))})
    told = [c.alias(f"{p}_{n}") for p in sections for n, c in section_features(*[F.col(f"__{p}_{x}") for x in "wshd"], tones).items()]
    caro = F.col("__caro")
    severity = F.coalesce(*[F.when(F.col("opinion") == o, F.lit(v)) for o, v in SEVERITY.items()])
    dues = F.lower(caro).rlike(IRREGULAR) | states(caro, UNPAID_DUES, gap=True)
    flags = {"audit_opinion_severity": severity, "audit_opinion_found": severity.isNotNull().cast("double"), "caro_default_flag": states(caro, LOAN_DEFAULT).cast("double"), "caro_statutory_dues_flag": dues.cast("double")}
    flags |= {flag: F.try_element_at("texts", F.lit(name)).isNotNull().cast("double") for flag, name in PRESENT.items()}
    return rows.select(*keys, *told, *[c.alias(n) for n, c in flags.items()])


def feature_columns(df: DataFrame, naming: Sequence[str] = NAMING) -> list[str]:
    """Columns that describe a row, in their order."""
    return [c for c in df.columns if c not in naming]
