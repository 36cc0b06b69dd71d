import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def confirmed(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    found = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if confirmed(k, m[0]))
    listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
    return ([sum(f[2] == k for f in found) for k in PLAIN], hashlib.sha256(listed.encode()).hexdigest(), listed)


TEXTS = [
    None, "", "x@y.z.@w.q", "a@b@c.d b@c.d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1", "+1 (555) 123-4567 and +12345678 4111 1111 1111 1111 4111-1111-1111-1112 12345678901234567890123",
    "é" * 20 + " a@b.co 😀 5500000000000004", "+1 555 123 4567. ", "1.1.1.1 " * 3000, "4111111111111111 4111111111111111", "a.b@c.d-e.f_g@h.i", "a" * 60_000, "1" * 60_000, "+1" + " " * 50_000 + "2",
]


def check(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        counts, digest, listed = brute(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts and r["base_sha256"] == digest
        base = [s for s in r["spans"].split(",") if s.split(":")[0] in PLAIN]
        assert ",".join(base) == listed


def test_base_spans_equal_plain_regular_expressions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, TEXTS + [r[0] for r in docs.select("text").collect()])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text("019.@ -+()ab\n_4é", max_size=60), min_size=40, max_size=40))
def test_base_spans_of_random_texts(spark, texts):
    check(spark, texts)


def test_added_kinds_need_checksums_and_context(frame):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32"), (2, "IBAN GB82 WEST 1234 5698 7654 33"), (3, "ssn 123-45-6789"), (4, "code 123-45-6789"), (5, "ssn 666-45-6789")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(frame(rows)).collect()}
    assert got == {1: "iban:5:32", 2: "", 3: "ssn:4:15", 4: "", 5: ""}


def test_context_raises_the_score(frame):
    got = pii.find(frame([(1, "mail a@b.co"), (2, "zzz  a@b.co")])).collect()
    assert got[0]["pii"][0]["score"] > got[1]["pii"][0]["score"] and got[0]["pii"][0]["text"] == "a@b.co"


def test_redact_keeps_columns_nulls_and_rows(frame):
    rows = [(1, "write a@b.co or +1 555 123 4567.", "k"), (1, "write a@b.co or +1 555 123 4567.", "k"), (2, None, "n"), (None, "", "e"), (3, "host 10.0.0.1@x.yz é", "o")]
    df = frame(rows, "doc_id long, text string, pii string")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted(got.collect(), key=str) == sorted([(1, "write <email> or <phone>.", "k"), (1, "write <email> or <phone>.", "k"), (2, None, "n"), (None, "", "e"), (3, "host <email> é", "o")], key=str)


def test_the_plan_has_no_python_and_no_shuffle(spark, frame):
    plan = pii.report(frame([(1, "a")]).select(F.col("doc_id"), "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(frame):
    assert pii.report(frame([])).count() == 0
