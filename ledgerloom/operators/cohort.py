"""Matched cohorts: sample frames, labels with exclusions, and checks of identity and scale."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fiscal, names
from ledgerloom.operators import tables as T

CIN = "[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}"  # fixed form of a company id


def sample_frame(cohort: DataFrame, years: int = 4, lag_days: int = 60) -> DataFrame:
    """One row for each firm and each of the `years` fiscal years that end before its reference date, newest first."""
    last = fiscal.reference_fy(F.col("reference_date"))
    rows = cohort.select("pair_id", "firm_id", "role", "label", "reference_date", F.posexplode(F.sequence(last, last - (years - 1), F.lit(-1))).alias("pos", "fy"))
    end = fiscal.fy_end(F.col("fy"))
    return rows.select("pair_id", "firm_id", "role", "label", "reference_date", "fy", end.alias("fy_end_date"), (F.col("pos") + 1).alias("fy_rank_before_reference"), F.date_add(end, lag_days).alias("expected_pub_date"), F.concat_ws("_FY", "firm_id", "fy").alias("doc_id"))


def assign_labels(frame: DataFrame, documents: DataFrame, petitions: DataFrame, review: DataFrame | None = None, close_days: int = 90, lag_days: int = 60, keep: int = 3) -> DataFrame:
    """`frame` with publication, exclusion, horizon and label columns.

    documents: doc_id, local_path, pub_date, wrong_year; petitions: pair_id, petition_date; review: doc_id, decision. The first
    rule that holds excludes. A healthy row goes with its distressed partner's year, never the other way round. Horizons rank the
    distressed firm's years that are left; years beyond `keep` are excluded."""
    docs = documents.dropDuplicates(["doc_id"])
    df = frame.join(T.shuffled(docs), "doc_id", "left").join(T.shuffled(petitions.dropDuplicates(["pair_id"])), "pair_id", "left")
    df = df.join(T.shuffled(review.dropDuplicates(["doc_id"])), "doc_id", "left") if review is not None else df.withColumn("decision", F.lit(None).cast("string"))
    have = F.col("local_path").isNotNull()
    known = F.col("pub_date").isNotNull()
    df = df.withColumns({"pub_date_source": F.when(known, "filing").otherwise("assumed"), "pub_date": F.coalesce("pub_date", F.date_add("fy_end_date", lag_days)), "has_document": have})
    df = df.withColumn("days_before_reference", F.datediff("reference_date", "pub_date"))
    df = df.withColumns({"months_before_reference": fiscal.months_between_days(F.col("days_before_reference")), "filing_delay_days": F.datediff("pub_date", "fy_end_date")})
    why = T.cascade(
        ("missing_document", ~have), ("report_is_for_another_year", F.col("wrong_year")), (f"published_within_{close_days}d_of_admission", F.col("days_before_reference") < close_days),
        ("published_after_petition", F.col("pub_date") >= F.col("petition_date")), ("leakage_review_excluded", F.lower("decision") == "exclude"),
    )
    df = T.exclude_partners(df.withColumn("exclude_reason", why), ["pair_id", "fy"], "role", "distressed", "healthy")
    df = T.horizon(df, ["pair_id"], "fy", (F.col("role") == "distressed") & (F.col("exclude_reason") == ""), keep)
    out = F.col("exclude_reason") == ""
    df = df.withColumns({"horizon": F.when(out, F.col("horizon")), "exclude_reason": F.when(out & F.col("horizon").isNull(), "beyond_n_years_before").otherwise(F.col("exclude_reason"))})
    near = lambda m: (F.col("label") == 1) & (F.col("months_before_reference") <= m)
    return df.withColumns({"within_12m": near(12), "within_24m": near(24), "included": F.col("exclude_reason") == ""})


def id_status(expected: Column, text: Column) -> Column:
    """STRUCT<status, found>: how the ids printed in a text agree with the expected one; the most frequent is found.

    exact; state_moved (all but state the same); same_registration (the last six digits); mismatch; none_printed."""
    ids = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(f"({CIN})"), F.lit(1))
    e = F.upper(F.trim(expected))
    same = lambda c: F.concat(F.substring(c, 2, 5), F.substring(c, 9, 13)) == F.concat(F.substring(e, 2, 5), F.substring(e, 9, 13))
    number = lambda c: F.substring(c, 16, 6) == F.substring(e, 16, 6)
    status = F.when(F.size(ids) == 0, "none_printed").when(F.array_contains(ids, e), "exact").when(F.exists(ids, same), "state_moved").when(F.exists(ids, number), "same_registration").otherwise("mismatch")
    counted = F.transform(F.array_distinct(ids), lambda c: F.struct(-F.size(F.filter(ids, lambda x: x == c)), c.alias("id")))
    return F.struct(status.alias("status"), F.get(F.array_sort(counted), F.lit(0))["id"].alias("found"))


def other_listings(listed: DataFrame) -> DataFrame:
    """code, other: codes of another listing of the same firm, by canonical name, and those whose ISIN marks a partly paid share."""
    n = listed.select("code", "isin", names.canonical(F.col("name")).alias("norm")).where("norm <> '' AND code IS NOT NULL")
    codes = n.select("norm", "code").distinct()
    codes = codes.join(T.shuffled(codes.groupBy("code").agg((F.count(F.lit(1)) > 1).alias("many"))), "code")
    # Only codes of several names can meet twice, so no other pair has to be held to find out.
    side = lambda df, name, many: df.select("norm", F.col("code").alias(name), F.col("many").alias(many))
    meet = lambda df: T.dealt_join(side(df, "code", "x"), side(df, "other", "y"), "norm").where("code <> other")
    once, often = meet(codes).where("NOT (x AND y)").select("code", "other"), meet(codes.where("many")).select("code", "other").distinct()
    return once.unionByName(often).unionByName(n.where("isin LIKE 'IN9%'").select("code", F.col("code").alias("other")).distinct())


def unit_suspects(figures: DataFrame, rivals: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """firm_id, fy, side: which of two sources slipped by a power of ten where they differ by one.

    figures and rivals: firm_id, fy, value. The side further from the firm's other years, by the upper median of log distances, is suspect."""
    both = figures.select("firm_id", "fy", F.col("value").alias("a")).join(rivals.select("firm_id", "fy", F.col("value").alias("b")), ["firm_id", "fy"]).where("a > 0 AND b > 0")
    gap = F.log10(F.col("a") / F.col("b"))
    slip = both.where((F.abs(F.round(gap)) >= 1) & (F.abs(gap - F.round(gap)) <= tolerance))
    pool = figures.select("firm_id", F.col("fy").alias("y"), "value").unionByName(rivals.select("firm_id", F.col("fy").alias("y"), "value")).where("value > 0")
    near = slip.join(pool, "firm_id").where("y <> fy").groupBy("firm_id", "fy").agg(*[F.array_sort(F.collect_list(F.abs(F.log10(F.col("value") / F.col(c))))).alias(f"d{c}") for c in "ab"])  # two figures a year
    near = near.select("firm_id", "fy", *[F.get(f"d{c}", F.floor(F.size(f"d{c}") / 2).cast("int")).alias(f"d{c}") for c in "ab"])
    return near.select("firm_id", "fy", F.when(F.col("da") > F.col("db"), "figures").when(F.col("db") > F.col("da"), "rivals").otherwise("unclear").alias("side"))


def capped_round_robin(df: DataFrame, n: int, year: str, industry: str, key: str, cap: int = 2, seed: int = 42) -> DataFrame:
    """Up to n rows, one for each year in turn, at most `cap` of an industry: the cap runs across years, so the draw is sequential.

    No more than n * cap of each year, in hashed order with `cap` of an industry at most, can be drawn, so only those reach the one task."""
    from pyspark.sql import Window

    order = [F.xxhash64(F.lit(seed), key), F.col(key)]
    few = df.withColumn("__i", F.row_number().over(Window.partitionBy(year, industry).orderBy(*order))).where(F.col("__i") <= cap)
    few = few.withColumn("__r", F.row_number().over(Window.partitionBy(year).orderBy(*order))).where(F.col("__r") <= n * cap).drop("__i")

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        queues = {y: g.sort_values("__r").to_dict("records") for y, g in frame.groupby(year)}
        used: dict = {}
        rows = []
        while len(rows) < n and any(queues.values()):
            for y in sorted(queues):
                while queues[y]:
                    r = queues[y].pop(0)
                    if used.get(r[industry], 0) < cap:
                        used[r[industry]] = used.get(r[industry], 0) + 1
                        rows.append((r[key], r[year], r[industry], len(rows) + 1))
                        break
                if len(rows) == n:
                    break
        return pd.DataFrame(rows, columns=[key, year, industry, "draw"])

    t = lambda c: df.schema[c].dataType.simpleString()
    return few.select(key, year, industry, "__r", F.lit(0).alias("__one")).groupBy("__one").applyInPandas(draw, f"`{key}` {t(key)}, `{year}` {t(year)}, `{industry}` {t(industry)}, draw int")
