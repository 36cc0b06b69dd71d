"""The wide feature row over documents, beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import features
from ledgerloom.plans.base import Book, table
from ledgerloom.plans.text import _HEDGE, _KNOWN, _UNBROKEN, TONE, _list, sql_sentences, sql_words

book = Book()
# What an annexure says after the text, by doc_id; every fourth document has none. Fixed values.
SAID = [
    "\nThe Company has not\ndefaulted in repayment of loans; there were arrears of statutory dues.",
    "\n(vii) statutory dues, and no such dues, were outstanding\n(viii) The Company has defaulted in repayment, as no bank denies",
    "\nwhether it has defaulted. It has not been regular in depositing dues",
]
OPINION = ["unmodified", "qualified", "disclaimer", "unknown", "adverse"]
_SAID_SQL = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN coalesce(text, '') || " + " || chr(10) || ".join(f"'{part}'" for part in said.split("\n")) for i, said in enumerate(SAID)) + " END"
_HITS = "regexp_extract_all(regexp_replace(lower(" + _UNBROKEN.format(t="t") + r"), '[ \t\r\n\f\v\-‐-―]+', ' ', 'g'), '{p}')"
_H, _D = _HITS.format(p=X.phrase_pattern(X.HEDGE_PHRASES)), _HITS.format(p=X.phrase_pattern(X.DISTRESS_PHRASES))
_ITEM = features.ITEM.replace("'", "''")


def _stated(phrase: str, gap: bool) -> str:
    p = phrase.replace("'", "''")
    found = [f"NOT regexp_matches(regexp_extract(c, '(?s)^(.*?)(?:{p})', {g}), '{features.CUE}')" for g in ((1, 2) if gap else (1,))]
    return f"len(list_filter(cl, lambda c: regexp_matches(c, '{p}') AND {' AND '.join(found)})) > 0"


_FEATURES = {f"lm_{t}_ratio": f"CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains({_list(v)}, x))) / len(w), 8) END" for t, v in TONE.items()} | {
    "hedge_density": f"CASE WHEN len(w) > 0 THEN round({_HEDGE} / len(w), 8) END",
    "hedge_distinct": f"CASE WHEN len(w) > 0 THEN CAST(len(list_distinct(list_filter(w, lambda x: list_contains({_list(X.HEDGES)}, x)))) AS DOUBLE) END",
    "hedge_phrase_density": f"CASE WHEN len(w) > 0 THEN round(len({_H}) / len(w), 8) END",
    "distress_phrase_density": f"CASE WHEN len(w) > 0 THEN round(len({_D}) / len(w), 8) END",
    "distress_phrase_distinct": f"CASE WHEN len(w) > 0 THEN CAST(len(list_distinct({_D})) AS DOUBLE) END",
    "fog_index": "CASE WHEN len(w) > 0 AND ns > 0 THEN round(0.4 * (len(w) / ns + 100.0 * coalesce(nc, 0) / len(w)), 6) END",
    "avg_sentence_length": "CASE WHEN len(w) > 0 AND ns > 0 THEN round(len(w) / ns, 8) END",
    "complex_word_ratio": "CASE WHEN len(w) > 0 AND ns > 0 THEN round(coalesce(nc, 0) / len(w), 8) END",
    "n_words": "CAST(CASE WHEN ns > 0 THEN len(w) ELSE 0 END AS DOUBLE)",
    "n_sentences": "CAST(CASE WHEN len(w) > 0 THEN ns ELSE 0 END AS DOUBLE)",
}
_FLAGS = {"has_mdna": "text IS NOT NULL", "has_auditor_report": "z.doc_id % 2 = 0 AND text IS NOT NULL", "has_caro_annexure": "caro IS NOT NULL", "has_going_concern": "false", "has_emphasis_of_matter": "false", "has_modified_opinion_basis": "false"}


@book.add(rf"""
WITH d AS (SELECT doc_id, 'mdna' AS p, coalesce(text, '') AS t FROM documents UNION ALL SELECT doc_id, 'auditor', CASE WHEN doc_id % 2 = 0 THEN coalesce(source || '. ' || text, '') ELSE '' END FROM documents),
e AS (SELECT doc_id, p, t, {sql_words('t')} AS w, len({sql_sentences('t')}) AS ns FROM d), u AS (SELECT doc_id, p, unnest(w) AS word FROM e),
v AS (SELECT DISTINCT word, CASE WHEN regexp_replace(word, '(es|ed)$', '') = '' THEN word ELSE regexp_replace(word, '(es|ed)$', '') END AS s FROM u), m AS (SELECT word, s, regexp_replace(s, '([tsc])io(n)', '\1_\2', 'g') AS m FROM v),
h AS (SELECT word, {_KNOWN} >= 3 AS hard FROM m), k AS (SELECT doc_id, p, count(CASE WHEN hard THEN 1 END) AS nc FROM u JOIN h USING (word) GROUP BY 1, 2),
f AS (SELECT doc_id, p, {', '.join(f'{sql} AS {name}' for name, sql in _FEATURES.items())} FROM e LEFT JOIN k USING (doc_id, p)),
c AS (SELECT doc_id, text, {_SAID_SQL} AS caro, ({_list(OPINION)})[doc_id % 5 + 1] AS opinion FROM documents),
z AS (SELECT *, list_transform(regexp_split_to_array(regexp_replace(lower(caro), '\n({_ITEM})', ';\1', 'g'), '[.;]+'), lambda x: regexp_replace(x, '\s+', ' ', 'g')) AS cl FROM c)
SELECT z.doc_id, {', '.join(f'{a}.{n} AS {p}_{n}' for a, p in (('a', 'mdna'), ('b', 'auditor')) for n in _FEATURES)},
 CASE opinion WHEN 'unmodified' THEN 0.0 WHEN 'qualified' THEN 1.0 WHEN 'adverse' THEN 2.0 WHEN 'disclaimer' THEN 3.0 END AS audit_opinion_severity, CASE WHEN opinion = 'unknown' THEN 0.0 ELSE 1.0 END AS audit_opinion_found,
 CASE WHEN caro IS NOT NULL THEN CAST({_stated(features.LOAN_DEFAULT, False)} AS DOUBLE) END AS caro_default_flag,
 CASE WHEN caro IS NOT NULL THEN CAST(regexp_matches(lower(caro), '{features.IRREGULAR}') OR {_stated(features.UNPAID_DUES, True)} AS DOUBLE) END AS caro_statutory_dues_flag,
 {', '.join(f'CAST({sql} AS DOUBLE) AS {n}' for n, sql in _FLAGS.items())}
FROM z JOIN f a ON a.doc_id = z.doc_id AND a.p = 'mdna' JOIN f b ON b.doc_id = z.doc_id AND b.p = 'auditor'
""", audit_opinion_severity="DOUBLE", audit_opinion_found="DOUBLE")
def document_features(s, d):
    """Each text as one section, with its source before it as another, and followed by a planted statement as the annexure."""
    at = (F.col("doc_id") % 4).cast("int")
    caro = F.concat(F.coalesce("text", F.lit("")), F.get(F.array(*map(F.lit, SAID)), at))
    auditor = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(". "), "text"))
    texts = F.create_map(F.lit("mdna"), F.col("text"), F.lit("auditor_report"), auditor, F.lit("caro_annexure"), caro)
    opinion = F.get(F.array(*map(F.lit, OPINION)), (F.col("doc_id") % 5).cast("int"))
    got = features.document_features(table(s, d, "documents").select("doc_id", texts.alias("texts"), opinion.alias("opinion")), ["doc_id"], TONE)
    shares = [c for c in got.columns if c.endswith(("_ratio", "_density", "_length"))]
    return got.withColumns({**{c: F.round(c, 8) for c in shares}, **{c: F.round(c, 6) for c in got.columns if c.endswith("fog_index")}})


QUERIES, ORACLES = book.queries, book.oracles
