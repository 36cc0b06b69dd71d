import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import features as W

SAID = [
    ("the firm has defaulted in repayment to a bank", True, False),
    ("the firm has not\ndefaulted in repayment to a bank", False, False),
    ("whether it has defaulted; later it HAS  DEFAULTED", True, False),
    ("no bank is owed\n(ix) it has defaulted", True, False),
    ("no statutory dues outstanding. arrears of statutory dues remain", False, True),
    ("statutory dues, and no such dues, were outstanding", False, False),
    ("statutory dues of tax were outstanding", False, True),
    ("it has not been regular in depositing tax", False, True),
    ("", None, None),
    (None, None, None),
]


@pytest.fixture(scope="module")
def told(spark):
    rows = [(i, {"caro_annexure": t, "mdna": "It may fail.\nSubject to a one time settlement, revenues possibly may rise."}, "qualified" if i else None) for i, (t, _, _) in enumerate(SAID)]
    docs = spark.createDataFrame([*rows, (98, {}, "unknown"), (99, None, "disclaimer")], "doc_id int, texts map<string,string>, opinion string")
    return {r["doc_id"]: r.asDict() for r in W.document_features(docs, ["doc_id"], {"negative": ["fail"]}).collect()}


def test_what_an_annexure_states(told):
    for i, (_, loans, dues) in enumerate(SAID):
        assert (told[i]["caro_default_flag"], told[i]["caro_statutory_dues_flag"]) == (loans, dues), SAID[i]


def test_sections_and_flags(told):
    r = told[0]
    assert r["mdna_n_words"] == 13 and r["mdna_n_sentences"] == 2 and r["mdna_avg_sentence_length"] == 6.5 and r["mdna_lm_negative_ratio"] == 1 / 13 and r["mdna_lm_positive_ratio"] is None
    assert r["mdna_hedge_density"] == 3 / 13 and r["mdna_hedge_distinct"] == 2 and r["mdna_hedge_phrase_density"] == 1 / 13 and r["mdna_distress_phrase_distinct"] == 1
    assert r["auditor_n_words"] == 0 and r["auditor_fog_index"] is None and r["auditor_hedge_distinct"] is None
    assert (r["audit_opinion_severity"], r["audit_opinion_found"], told[1]["audit_opinion_severity"]) == (None, 0, 1)
    assert (r["has_mdna"], r["has_auditor_report"], r["has_caro_annexure"], told[9]["has_caro_annexure"]) == (1, 0, 1, 0)
    assert told[98]["mdna_n_words"] == told[99]["has_mdna"] == 0 and told[99]["audit_opinion_severity"] == 3 and told[99]["caro_default_flag"] is None


def test_no_rows_and_feature_columns(spark):
    got = W.document_features(spark.createDataFrame([], "doc_id int, fy int, texts map<string,string>, opinion string"), ["doc_id", "fy"], {})
    assert got.count() == 0 and not {"doc_id", "fy"} & set(W.feature_columns(got)) and len(W.feature_columns(got)) == len(got.columns) - 2


def test_syllables(spark):
    want = {"nation": 2, "ratio": 3, "lion": 2, "tension": 2, "area": 2, "table": 2, "fire": 1, "e": 1, "the": 1, "radio": 3, "revenue": 3, "duo": 2, "brr": 1}
    rows = spark.createDataFrame([(w,) for w in want], "w string").select("w", X.syllables(F.col("w")).alias("n")).collect()
    assert {r["w"]: r["n"] for r in rows} == want
    hard = spark.createDataFrame([("es",), ("radios",), ("radioed",), ("boxes",), ("",)], "w string").select(X.is_complex(F.col("w")).alias("h")).collect()
    assert [r["h"] for r in hard] == [False, True, True, False, False]
