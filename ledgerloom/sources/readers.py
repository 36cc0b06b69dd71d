"""Sources: CSV and TSV with checks, keyed JSON logs, HTML tables, XBRL, dictionaries, files by hash."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import TONES
from ledgerloom.operators.tables import latest_per_key


def read_csv(spark: SparkSession, path: str, required: Sequence[str] = (), schema=None, sep: str = ",") -> DataFrame:
    """CSV with a header, all text unless a schema is given; missing columns are named in the error."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    gone = [c for c in required if c not in df.columns]
    if gone:
        raise ValueError(f"{path} is missing required columns: {gone}")
    return df


def read_tsv_export(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Tab-separated without quotes; headers renamed, day-first dates read, entities decoded."""
    df = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    df = df.select(*[F.col(f"`{c}`").alias(names.get(c.strip(), c.strip().lower().replace(" ", "_"))) for c in df.columns])
    return df.select(*[(F.try_to_date(c, "dd-MM-yyyy") if c.endswith("_date") else unescape(F.col(c))).alias(c) for c in df.columns])


def unescape(text: Column) -> Column:
    """The entities that exports have; &amp; last, so that nothing is decoded twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.regexp_replace(text, entity, char)
    return text


def cin_parts(cin: Column) -> Column:
    """STRUCT<cin, listed, industry, state, year, kind> of a company id; null where it is none."""
    c = F.upper(F.trim(cin))
    ok = c.rlike("^[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$")
    return F.when(ok, F.struct(c.alias("cin"), (F.substring(c, 1, 1) == "L").alias("listed"), F.substring(c, 2, 5).alias("industry"), F.substring(c, 7, 2).alias("state"), F.substring(c, 9, 4).try_cast("int").alias("year"), F.substring(c, 13, 3).alias("kind")))


def read_log(spark: SparkSession, paths: list[str] | str, body_schema: str | None = None) -> DataFrame:
    """A keyed request log of JSON lines {key, url, http, fetched_at, body}: damaged lines are passed over, and the latest record of each key, by file and time, wins.

    With a schema, `data` is the parsed body where http is 200."""
    df = spark.read.schema("key string, url string, http int, fetched_at string, body string").option("mode", "DROPMALFORMED").json(paths)
    df = latest_per_key(df.withColumn("__file", F.input_file_name()).where("key IS NOT NULL"), ["key"], "__file", "fetched_at").drop("__file")
    return df.withColumn("data", F.when(F.col("http") == 200, F.from_json("body", body_schema, {"mode": "PERMISSIVE"}))) if body_schema else df


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.isin("", "-", "--"), t)


class _Tables(HTMLParser):
    """Rows of cells of each table, with the first link of a cell."""

    def __init__(self):
        super().__init__()
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = ["", None]
            self.tables[-1][-1].append(self.cell)
        elif tag == "a" and self.cell is not None and self.cell[1] is None:
            self.cell[1] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


def html_rows(pages: DataFrame, wanted: dict[str, str], base: str = "", key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows of the table whose header has all keywords: key, row, cells MAP<name, text>, links MAP<name, absolute url>.

    wanted: name of a cell to the keyword that its header has. Pages without such a table give no rows."""
    from urllib.parse import urljoin

    kind = pages.schema[key].dataType.simpleString()

    def run(frames):
        for frame in frames:
            rows = []
            for page, text in frame.itertuples(index=False, name=None):
                parser = _Tables()
                parser.feed(text or "")
                for t in parser.tables:
                    head = next((r for r in t if r), None)
                    at = {n: next((i for i, c in enumerate(head or []) if k.lower() in c[0].lower()), None) for n, k in wanted.items()}
                    if head is None or None in at.values():
                        continue
                    for n, r in enumerate(r for r in t[t.index(head) + 1 :] if r):
                        got = {k: r[i] for k, i in at.items() if i < len(r)}
                        rows.append((page, n, {k: " ".join(c[0].split()) for k, c in got.items()}, {k: urljoin(base, c[1]) for k, c in got.items() if c[1]}))
            if rows:
                yield pd.DataFrame(rows, columns=[key, "row", "cells", "links"])

    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, row int, cells map<string,string>, links map<string,string>")


# Tags of each field, the first that is there counts; balances are at the year's end, the others over the year.
XBRL_BALANCES = {
    "total_assets": ["Assets", "TotalAssets"],
    "current_assets": ["CurrentAssets", "TotalCurrentAssets"],
    "non_current_assets": ["NoncurrentAssets", "TotalNonCurrentAssets"],
    "inventories": ["Inventories"],
    "cash_and_equivalents": ["CashAndCashEquivalents", "CashAndBankBalances"],
    "bank_balances_other": ["BankBalanceOtherThanCashAndCashEquivalents"],
    "trade_receivables": ["TradeReceivablesCurrent", "TradeReceivables"],
    "total_equity": ["Equity", "EquityAttributableToOwnersOfParent", "ShareholdersFunds"],
    "equity_share_capital": ["EquityShareCapital", "PaidUpValueOfEquityShareCapital"],
    "other_equity": ["OtherEquity", "ReservesAndSurplus"],
    "borrowings_long_term": ["BorrowingsNoncurrent", "LongTermBorrowings"],
    "borrowings_short_term": ["BorrowingsCurrent", "ShortTermBorrowings"],
    "current_liabilities": ["CurrentLiabilities", "TotalCurrentLiabilities"],
    "non_current_liabilities": ["NoncurrentLiabilities", "TotalNonCurrentLiabilities"],
    "total_liabilities": ["Liabilities"],
    "total_equity_and_liabilities": ["EquityAndLiabilities", "EquityAndLiabilitiesTotal"],
}
XBRL_FLOWS = {
    "revenue": ["RevenueFromOperations", "NetSalesIncomeFromOperations", "IncomeFromOperations"],
    "other_income": ["OtherIncome"],
    "total_income": ["Income", "TotalIncome", "TotalIncomeFromOperations"],
    "total_expenses": ["Expenses", "TotalExpenses"],
    "finance_costs": ["FinanceCosts", "FinanceCost", "InterestExpense"],
    "depreciation": ["DepreciationDepletionAndAmortisationExpense", "DepreciationAndAmortisationExpense"],
    "exceptional_items": ["ExceptionalItemsBeforeTax", "ExceptionalItems"],
    "pbt": ["ProfitBeforeTax", "ProfitLossBeforeTax"],
    "tax_expense": ["TaxExpense"],
    "net_profit": ["ProfitLossForPeriod", "ProfitLossForThePeriod", "NetProfitLossForThePeriod"],
    "cfo": ["CashFlowsFromUsedInOperatingActivities"],
}
XBRL_FIELDS = XBRL_BALANCES | XBRL_FLOWS


def xbrl_facts(xml: str, fy: int) -> list[tuple[str, float]]:
    """(field, crore) of a filing: contexts without dimensions, the full year of 360 days or more to 31 March, or its last day; rupees only."""
    import xml.etree.ElementTree as ET
    from datetime import date

    root = ET.fromstring(xml)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    end = date(fy, 3, 31)
    years, instants, currency = set(), set(), {}
    for e in root.iter():
        if local(e) == "unit":
            currency[e.get("id")] = "".join(x.text or "" for x in e.iter() if local(x) == "measure")
        if local(e) != "context" or any(local(x) in ("explicitMember", "typedMember") for x in e.iter()):
            continue
        dates = {local(x): date.fromisoformat((x.text or "").strip()[:10]) for x in e.iter() if local(x) in ("startDate", "endDate", "instant")}
        if dates.get("instant") == end:
            instants.add(e.get("id"))
        elif dates.get("endDate") == end and "startDate" in dates and (end - dates["startDate"]).days >= 360:
            years.add(e.get("id"))
    found: dict[str, dict[str, float]] = {}
    for e in root.iter():
        if (ref := e.get("contextRef")) and (e.text or "").strip() and "INR" in currency.get(e.get("unitRef"), ""):
            field = next((f for f, tags in XBRL_FIELDS.items() if local(e) in tags), None)
            if field and ref in (instants if field in XBRL_BALANCES else years):
                try:
                    found.setdefault(field, {}).setdefault(local(e), float(e.text.replace(",", "")) / 1e7)
                except ValueError:
                    continue
    return [(f, next(v[t] for t in XBRL_FIELDS[f] if t in v)) for f, v in found.items()]


def read_xbrl(filings: DataFrame) -> DataFrame:
    """firm_id, fy, field, value_cr, error from filings(firm_id, fy, xml): a filing that cannot be read gives one row with its error."""
    kind = filings.schema["firm_id"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            rows = []
            for firm, fy, xml in frame.itertuples(index=False, name=None):
                try:
                    rows += [(firm, fy, f, round(v, 9), None) for f, v in xbrl_facts(xml or "", int(fy))]
                except Exception as e:  # one bad filing must not end the job
                    rows.append((firm, fy, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pd.DataFrame(rows, columns=["firm_id", "fy", "field", "value_cr", "error"]).astype({"fy": "Int64"})

    return filings.select("firm_id", "fy", "xml").mapInPandas(run, f"firm_id {kind}, fy long, field string, value_cr double, error string")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, category from a long file (word, category) or a wide one, whose non-zero cells are members."""
    df = read_csv(spark, path)
    df = df.toDF(*[c.strip().lower().replace(" ", "_").lstrip("﻿") for c in df.columns])
    word = F.lower(F.trim("word"))
    if "category" in df.columns:
        long = df.select(word.alias("word"), F.regexp_replace(F.lower(F.trim("category")), " ", "_").alias("category"))
    else:
        there = [c for c in TONES if c in df.columns] + [c for c in ("strongmodal", "weakmodal") if c in df.columns]
        long = df.select(word.alias("word"), F.explode(F.map_from_arrays(F.array(*map(F.lit, there)), F.array(*[F.col(c).try_cast("double") for c in there]))).alias("category", "v")).where("v <> 0").drop("v")
    fixed = F.when(F.col("category") == "strongmodal", "strong_modal").when(F.col("category") == "weakmodal", "weak_modal").otherwise(F.col("category"))
    return long.withColumn("category", fixed).where(F.col("category").isin(TONES) & (F.col("word") != "")).distinct()


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf", keys: str = r"([^/]+)/FY(\d{4})\.\w+$") -> DataFrame:
    """firm_id, fy, path, sha256, size of a folder's files; keys come from the path."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return df.select(F.regexp_extract("path", keys, 1).alias("firm_id"), F.regexp_extract("path", keys, 2).try_cast("int").alias("fy"), "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Sources of differing columns, by name; missing ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_text_parts(df: DataFrame, path: str, key: str, parts: int = 2) -> None:
    """Gzipped JSON lines in `parts` files by ranges of the key."""
    df.repartitionByRange(parts, key).sortWithinPartitions(key).write.mode("overwrite").option("compression", "gzip").json(path)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> int:
    """Writes, and returns the number of rows that were written; for Parquet that is read from footers."""
    writer = df.write.mode("overwrite").format(form)
    (writer.option("header", True) if form == "csv" else writer).save(path)
    return df.sparkSession.read.format(form).option("header", True).load(path).count()
