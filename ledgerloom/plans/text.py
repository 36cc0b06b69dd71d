"""Text-feature queries over documents and conversations, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import names as N
from ledgerloom.functions import text as X
from ledgerloom.operators import shingles as S
from ledgerloom.plans.base import Book, table

book = Book()
# The corpus has no English prose of its own, so tone lists are short words that it has. Fixed values.
TONE = {"negative": ["no", "not", "was"], "positive": ["are", "with", "for"], "uncertainty": ["that", "this"], "litigious": ["by"], "strong_modal": ["be"], "weak_modal": ["on"], "constraining": ["from", "as"]}
PHRASES = ["of the", "in the", "to the", "and the the", "with by of"]


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# The SQL text of words(), sentences() and hedges: lists rather than word-boundary patterns, whose meaning differs by engine.
_UNBROKEN = r"regexp_replace({t}, '-[ \t\r\n\f\v]*\n[ \t\r\n\f\v]*', '', 'g')"
_WORDS = r"regexp_extract_all(lower(regexp_replace(" + _UNBROKEN + r", '[^A-Za-z]+', ' ', 'g')), '[a-z]+')"
_LINES = r"list_transform(string_split(" + _UNBROKEN + r", chr(10)), lambda x: trim(regexp_replace(regexp_replace(trim(x), '(?i)^[ \t\r\f]*(?:[-•·*●▪]|\(?[ivxlc]{{1,4}}\)|\(?[a-z]\)|[0-9]{{1,2}}[.)])[ \t\r\f]+', ''), '[ \t]+', ' ', 'g')))"
_SENTENCES = r"list_filter(flatten(list_transform(" + _LINES + r""", lambda x: string_split(regexp_replace(x, '([.!?])[ \t\r\n\f\v]+(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda x: trim(x) <> '')"""


def sql_words(t: str = "text") -> str:
    return _WORDS.format(t=t)


def sql_sentences(t: str = "text") -> str:
    return _SENTENCES.format(t=t)


def _docs(s, d):
    return table(s, d, "documents").withColumn("w", X.words(X.as_text("text")))


_W = f"WITH d AS (SELECT doc_id, lang, source, text, {sql_words()} AS w FROM documents)"
_HEDGE = "len(list_filter(w, lambda x: list_contains(" + _list(X.HEDGES) + ", x)))"


@book.add(_W + f""", f AS (SELECT lang, quality, len(w) AS nw, len({sql_sentences()}) AS ns, CASE WHEN len(w) > 0 THEN {_HEDGE} / len(w) END AS hedge FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT lang, quality, count(*) AS n_docs, round(avg(nw), 4) AS mean_words, round(avg(ns), 4) AS mean_sentences, round(avg(hedge), 6) AS mean_hedge FROM f GROUP BY 1, 2
""")
def text_word_stats(s, d):
    f = _docs(s, d).join(table(s, d, "labels"), "doc_id", "left")
    n = F.size("w")
    f = f.select("lang", "quality", n.alias("nw"), F.size(X.sentences(X.as_text("text"))).alias("ns"), X.share(X.member_count(F.col("w"), X.HEDGES), n).alias("hedge"))
    return f.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("nw"), 4).alias("mean_words"), F.round(F.avg("ns"), 4).alias("mean_sentences"), F.round(F.avg("hedge"), 6).alias("mean_hedge"))


@book.add(_W + f" SELECT doc_id, CASE WHEN len(w) > 0 THEN round({_HEDGE} / len(w), 8) END AS hedge_density, len(list_distinct(list_filter(w, lambda x: list_contains({_list(X.HEDGES)}, x)))) AS hedge_distinct FROM d")
def hedging(s, d):
    w = F.col("w")
    return _docs(s, d).select("doc_id", F.round(X.share(X.member_count(w, X.HEDGES), F.size(w)), 8).alias("hedge_density"), X.member_distinct(w, X.HEDGES).cast("long").alias("hedge_distinct"))


@book.add(_W + " SELECT doc_id, " + ", ".join(f"CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains({_list(v)}, x))) / len(w), 8) END AS lm_{k}_ratio" for k, v in TONE.items()) + " FROM d")
def tone(s, d):
    w = F.col("w")
    return _docs(s, d).select("doc_id", *[F.round(X.share(X.member_count(w, v), F.size(w)), 8).alias(f"lm_{k}_ratio") for k, v in TONE.items()])


_NORM = r"regexp_replace(lower(" + _UNBROKEN.format(t="text") + r"), '[ \t\r\n\f\v\-‐-―]+', ' ', 'g')"
_PHRASE_SQL = f"regexp_extract_all({_NORM}, '{X.phrase_pattern(PHRASES)}')"


@book.add(_W + f" SELECT doc_id, CASE WHEN len(w) > 0 THEN round(len({_PHRASE_SQL}) / len(w), 8) END AS phrase_density, len(list_distinct({_PHRASE_SQL})) AS phrase_distinct FROM d")
def phrase_density(s, d):
    hits = X.phrase_hits(X.as_text("text"), PHRASES)
    return _docs(s, d).select("doc_id", F.round(X.share(F.size(hits), F.size("w")), 8).alias("phrase_density"), F.size(F.array_distinct(hits)).cast("long").alias("phrase_distinct"))


_SYL = r"""greatest(1, len(regexp_extract_all(s, '[aeiouy]+')) - CASE WHEN regexp_matches(s, '(^|[^aeiouy])e$') AND len(regexp_extract_all(s, '[aeiouy]+')) > 1 AND NOT regexp_matches(s, '(le|ee|ye)$') THEN 1 ELSE 0 END
 + len(regexp_extract_all(m, 'ia')) + len(regexp_extract_all(m, 'io')) + len(regexp_extract_all(m, 'eo')) + len(regexp_extract_all(m, 'ua')) + len(regexp_extract_all(m, 'uo')))"""
_KNOWN = "CASE s " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.SYLLABLES.items()) + f" ELSE {_SYL} END"


@book.add(f"""
WITH e AS (SELECT doc_id, {sql_words()} AS w, len({sql_sentences()}) AS ns FROM documents), u AS (SELECT doc_id, ns, unnest(w) AS word FROM e),
v AS (SELECT DISTINCT word, CASE WHEN regexp_replace(word, '(es|ed)$', '') = '' THEN word ELSE regexp_replace(word, '(es|ed)$', '') END AS s FROM u), m AS (SELECT word, s, regexp_replace(s, '([tsc])io(n)', '\\1_\\2', 'g') AS m FROM v),
c AS (SELECT word, {_KNOWN} >= 3 AS hard FROM m),
t AS (SELECT doc_id, ns, count(*) AS nw, count(CASE WHEN hard THEN 1 END) AS nc FROM u JOIN c ON c.word = u.word GROUP BY 1, 2)
SELECT doc_id, nw AS n_words, ns AS n_sentences, round(nc / nw, 8) AS complex_word_ratio, CASE WHEN ns > 0 THEN round(0.4 * (nw / ns + 100.0 * nc / nw), 6) END AS fog_index FROM t
""")
def fog(s, d):
    """Syllables are counted once for each distinct word and joined back: words repeat, and the rule is dear."""
    e = _docs(s, d).select("doc_id", F.size(X.sentences(X.as_text("text"))).cast("long").alias("ns"), "w")
    u = e.select("doc_id", "ns", F.explode("w").alias("word"))
    tf = u.groupBy("doc_id", "ns", "word").agg(F.count(F.lit(1)).alias("tf"))
    hard = tf.select("word").distinct().select("word", X.is_complex(F.col("word")).alias("hard"))
    t = tf.join(hard, "word").groupBy("doc_id", "ns").agg(F.sum("tf").alias("nw"), F.sum(F.when(F.col("hard"), F.col("tf")).otherwise(0)).alias("nc"))
    return t.select("doc_id", F.col("nw").alias("n_words"), F.col("ns").alias("n_sentences"), F.round(F.col("nc") / F.col("nw"), 8).alias("complex_word_ratio"), F.round(X.fog(F.col("nw"), F.col("ns"), F.col("nc")), 6).alias("fog_index"))


_STOP = f"list_filter(w, lambda x: len(x) > 1 AND NOT list_contains({_list(X.STOPWORDS)}, x))"


@book.add(_W + f""", k AS (SELECT doc_id, source, {_STOP} AS c, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM d),
p AS (SELECT a.doc_id, a.prev, a.c, b.c AS pc FROM k a LEFT JOIN k b ON b.doc_id = a.prev),
tf AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(c) AS word FROM k) GROUP BY 1, 2), nm AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM tf GROUP BY 1),
dt AS (SELECT p.doc_id, sum(x.n * y.n) AS dot FROM p JOIN tf x ON x.doc_id = p.doc_id JOIN tf y ON y.doc_id = p.prev AND y.word = x.word GROUP BY 1)
SELECT p.doc_id, ok AS has_previous, CASE WHEN ok THEN round(len(list_distinct(list_intersect(c, pc))) / len(list_distinct(list_concat(c, pc))), 8) END AS drift_jaccard,
 CASE WHEN ok THEN round(coalesce(dot, 0) / (n1.norm * n2.norm), 8) END AS drift_cosine, CASE WHEN ok THEN round((len(list_distinct(c)) - len(list_distinct(list_intersect(c, pc)))) / len(list_distinct(c)), 8) END AS drift_new_word_share,
 CASE WHEN ok THEN round(len(c) / len(pc), 8) END AS drift_length_ratio
FROM (SELECT *, coalesce(len(c) > 0 AND len(pc) > 0, false) AS ok FROM p) p LEFT JOIN nm n1 ON n1.doc_id = p.doc_id LEFT JOIN nm n2 ON n2.doc_id = p.prev LEFT JOIN dt ON dt.doc_id = p.doc_id
""")
def drift_previous(s, d):
    """Against the document before it of the same source; all null without one."""
    f = S.word_overlap(table(s, d, "documents"), "doc_id", "source", X.cleaned(X.words(X.as_text("text"))))
    ok = F.coalesce((F.col("n") > 0) & (F.col("previous_n") > 0), F.lit(False))
    told = lambda e, name: F.when(ok, F.round(e, 8)).alias(name)
    c = F.col
    return f.select("doc_id", ok.alias("has_previous"), told(c("both") / c("either"), "drift_jaccard"), told(c("dot") / (F.sqrt("squares") * F.sqrt("previous_squares")), "drift_cosine"), told((c("mine") - c("both")) / c("mine"), "drift_new_word_share"), told(c("n") / c("previous_n"), "drift_length_ratio"))


_CUE = "(^|[^a-z])(not|no|never|without|in)([^a-z]|$)"
_FACT = "(the|that) [a-z]+"


@book.add(rf"""
WITH c AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[.;]+')) AS clause FROM documents), n AS (SELECT doc_id, regexp_replace(clause, '[ \t\r\n\f\v]+', ' ', 'g') AS clause FROM c),
p AS (SELECT doc_id, regexp_matches(clause, '{_FACT}') AS hit, regexp_matches(regexp_extract(clause, '^(.*?){_FACT}', 1), '{_CUE}') AS denied FROM n)
SELECT doc_id, CAST(count(CASE WHEN hit THEN 1 END) AS BIGINT) AS n_clauses, CAST(count(CASE WHEN hit AND NOT denied THEN 1 END) AS BIGINT) AS n_asserted, count(CASE WHEN hit AND NOT denied THEN 1 END) > 0 AS flag FROM p GROUP BY 1
""")
def negation_flags(s, d):
    """A clause states the thing unless a cue of negation stands before it in the clause."""
    clauses = F.transform(F.split(F.lower(X.as_text("text")), "[.;]+"), lambda c: F.regexp_replace(c, r"[ \t\r\n\f\x0B]+", " "))
    hits = F.filter(clauses, lambda c: c.rlike(_FACT))
    asserted = F.filter(hits, lambda c: ~F.regexp_extract(c, f"^(.*?){_FACT}", 1).rlike(_CUE))
    return table(s, d, "documents").select("doc_id", F.size(hits).cast("long").alias("n_clauses"), F.size(asserted).cast("long").alias("n_asserted"), (F.size(asserted) > 0).alias("flag"))


@book.add(f"""
WITH c AS (SELECT conv_id, turn, role, {sql_words()} AS w FROM conversations), g AS (SELECT role, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM c WHERE len(w) >= 3)
SELECT role, gram, count(*) AS n FROM g GROUP BY 1, 2
""")
def trigram_counts(s, d):
    g = table(s, d, "conversations").select("role", F.explode(X.grams(X.words(X.as_text("text")), 3)).alias("gram"))
    return g.groupBy("role", "gram").agg(F.count(F.lit(1)).alias("n"))


@book.add(_W + f""", t AS (SELECT doc_id, source, unnest(list_distinct({_STOP})) AS term FROM d)
SELECT term, count(*) AS n_docs, count(DISTINCT source) AS n_firms FROM t GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT source) >= 10
""")
def term_firm_frequency(s, d):
    t = _docs(s, d).select("doc_id", "source", F.explode(F.array_distinct(X.cleaned(F.col("w")))).alias("term"))
    per = t.groupBy("term", "source").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_firms")).where("n_docs >= 3 AND n_firms >= 10")


_LOGODDS = f"""
WITH d AS (SELECT quality, {sql_words()} AS w FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), t AS (SELECT quality, unnest(w) AS term FROM d),
n AS (SELECT term, count(CASE WHEN quality = 1 THEN 1 END) AS a, count(CASE WHEN quality = 0 THEN 1 END) AS b FROM t GROUP BY 1 HAVING count(*) >= 20), s AS (SELECT sum(a) AS na, sum(b) AS nb, sum(a + b) AS n0 FROM n),
z AS (SELECT term, a, b, ln((a + a + b) / (na + n0 - a - (a + b))) - ln((b + a + b) / (nb + n0 - b - (a + b))) AS delta, 1.0 / (a + a + b) + 1.0 / (b + a + b) AS v FROM n, s)
SELECT term, a AS n_good, b AS n_bad, round(delta, 6) AS log_odds, round(delta / sqrt(v), 5) AS z FROM z
"""


@book.add(_LOGODDS)
def log_odds(s, d):
    """Log-odds of terms between two classes, the corpus as an informative Dirichlet prior."""
    t = _docs(s, d).join(table(s, d, "labels").where("quality IS NOT NULL"), "doc_id").select("quality", F.explode("w").alias("term"))
    n = t.groupBy("term").agg(F.count_if(F.col("quality") == 1).alias("a"), F.count_if(F.col("quality") == 0).alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    total = n.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") + F.col("b")).alias("n0"))
    a, b, p = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    delta = F.ln((a + p) / (F.col("na") + F.col("n0") - a - p)) - F.ln((b + p) / (F.col("nb") + F.col("n0") - b - p))
    v = F.lit(1.0) / (a + p) + F.lit(1.0) / (b + p)
    return n.join(F.broadcast(total)).select("term", a.alias("n_good"), b.alias("n_bad"), F.round(delta, 6).alias("log_odds"), F.round(delta / F.sqrt(v), 5).alias("z"))


@book.add(_W + """, g AS (SELECT doc_id, source, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM d WHERE len(w) >= 5),
f AS (SELECT gram, count(DISTINCT source) AS n FROM g GROUP BY 1)
SELECT doc_id, count(*) AS n_grams, round(avg(CASE WHEN n >= 10 THEN 1.0 ELSE 0.0 END), 6) AS boilerplate_share FROM g JOIN f USING (gram) GROUP BY 1
""")
def boilerplate_share(s, d):
    """Share of a document's word 5-grams that ten sources or more use."""
    g = S.wide_shares(table(s, d, "documents"), "doc_id", "source", X.words(X.as_text("text")), 5, 10)
    return g.select("doc_id", "n_grams", F.round("share", 6).alias("boilerplate_share"))


@book.add(f"""
WITH x AS (SELECT doc_id, {sql_sentences()} AS s FROM documents), f AS (SELECT doc_id, list_filter(s, lambda y: len(string_split(y, ' ')) >= 5)[1:200] AS s FROM x)
SELECT doc_id, len(s) AS n_sentences, coalesce(list_sum(list_transform(s, lambda y: len(string_split(y, ' ')))), 0) AS n_words FROM f
""", n_words="BIGINT")
def long_sentences(s, d):
    """The first 200 sentences of five words or more: the operator's own limit."""
    kept = F.slice(F.filter(X.sentences(X.as_text("text")), lambda y: F.size(F.split(y, " ")) >= 5), 1, 200)
    f = table(s, d, "documents").select("doc_id", kept.alias("s"))
    return f.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, y: a + F.size(F.split(y, " "))).alias("n_words"))


@book.add(r"""
WITH p AS (SELECT p_partkey, upper(p_name || CASE p_partkey % 4 WHEN 0 THEN ' Pvt. Ltd. (In Liquidation)' WHEN 1 THEN ' & Sons Limited' WHEN 2 THEN ' The Private Limited formerly X' ELSE '' END) AS s FROM part),
a AS (SELECT p_partkey, regexp_matches(s, 'PRIVATE[ \t]+LIMITED|PVT\.?[ \t]*LTD|PVT\.?[ \t]+LIMITED|\(OPC\)') AS is_private, string_split(regexp_replace(s, '\(.*?\)', ' ', 'g'), 'FORMERLY')[1] AS s FROM p),
b AS (SELECT p_partkey, is_private, regexp_replace(replace(replace(replace(s, '&', ' AND '), 'PVT.', ' PRIVATE '), 'PVT', ' PRIVATE '), '[^A-Z0-9 ]', ' ', 'g') AS s FROM a)
SELECT p_partkey, array_to_string(list_filter(string_split(s, ' '), lambda t: t <> '' AND t NOT IN ('LIMITED', 'LTD', 'THE')), ' ') AS name_norm, is_private FROM b
""")
def company_names(s, d):
    extra = F.element_at(F.array(*map(F.lit, [" Pvt. Ltd. (In Liquidation)", " & Sons Limited", " The Private Limited formerly X", ""])), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(s, d, "part").select("p_partkey", F.concat("p_name", extra).alias("name"))
    return p.select("p_partkey", N.canonical(F.col("name")).alias("name_norm"), N.is_private(F.col("name")).alias("is_private"))


QUERIES, ORACLES = book.queries, book.oracles
