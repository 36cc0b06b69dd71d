"""What is done to a cohort and its tables after they were first drawn: who may stay, who is looked up where, what is renumbered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.quantiles import quantiles
from ledgerloom.operators.tables import dealt_join, first_per_key, shuffled


def possibly_listed(debtors: DataFrame) -> DataFrame:
    """Debtors(cin, private_by_name, ...) that may be listed, with listing_evidence: an id of a listed company, or none and no private name."""
    listed = F.coalesce(F.col("cin").startswith("L"), F.lit(False))
    unknown = F.col("cin").isNull() & ~F.coalesce("private_by_name", F.lit(False))
    return debtors.where(listed | unknown).withColumn("listing_evidence", F.when(listed, "cin_L").otherwise("no_cin"))


def accepted(matches: DataFrame) -> DataFrame:
    """Accepted matches, the earliest of each firm_id: its date is the verified one, else the announced one, and its source is told.

    matches: firm_id, accept, admission_date_verified, announcement_date. Ties go by announcement date; a match without any date comes last."""
    yes = matches.where(F.upper(F.btrim("accept")) == "Y")
    dated = yes.withColumns({"admission_date": F.coalesce("admission_date_verified", "announcement_date"), "admission_date_source": F.when(F.col("admission_date_verified").isNotNull(), "verified").otherwise("announced")})
    return first_per_key(dated, ["firm_id"], F.asc_nulls_last("admission_date"), F.asc_nulls_last("announcement_date"), F.col("admission_date_source"))


def excluded_ids(matches: DataFrame, reviewed: DataFrame) -> DataFrame:
    """firm_id of every match that is automatic or waits for review, without those that a reviewer refused, with those accepted.

    Any acceptance outweighs a refusal. Null ids are none."""
    held = matches.where(F.col("match_status").isin("auto_accepted", "needs_review")).select("firm_id", F.lit(1).alias("found"), F.lit(0).alias("no"), F.lit(0).alias("yes"))
    mark = F.upper(F.btrim("accept"))
    told = reviewed.select("firm_id", F.lit(0).alias("found"), (mark == "N").cast("int").alias("no"), (mark == "Y").cast("int").alias("yes"))
    sums = held.unionByName(told).where("firm_id IS NOT NULL").groupBy("firm_id").agg(*[F.max(c).alias(c) for c in ("found", "no", "yes")])
    return sums.where("yes = 1 OR (found = 1 AND coalesce(no, 0) = 0)").select("firm_id")


def without_suspects(facts: DataFrame, suspects: DataFrame, stale: DataFrame, flow_fields: Sequence[str]) -> DataFrame:
    """Facts(firm_id, fy, field, ...) without firm-years in the wrong unit, and without the flow fields of copied years."""
    keys = ["firm_id", "fy"]
    right = facts.join(suspects.select(*keys).distinct(), keys, "left_anti")
    copied = stale.select(*keys).distinct().withColumn("field", F.explode(F.array(*map(F.lit, flow_fields))))
    return right.join(copied, [*keys, "field"], "left_anti")


def usable(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows without an exclusion, or excluded for their partner's sake only, whose document is there."""
    kept = rows.where(F.coalesce("exclude_reason", F.lit("")).isin("", "pair_partner_excluded"))
    return kept.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def subsets(rows: DataFrame, strict: str, horizon: str, z: str, rank: str, safe: float = 2.6) -> DataFrame:
    """Rows once for each named subset that they belong to, in a column `subset`.

    all; strict; each horizon by its name; z above its median; z in the safe zone; the lower half by the ratio model's rank."""
    middle = (quantiles(rows, F.lit("all"), z, (0.5,)).get("all") or [None])[0]
    named = [(F.lit(True), F.lit("all")), (F.col(strict), F.lit("strict")), (F.col(horizon).isNotNull(), F.col(horizon).cast("string")), (F.col(z) > F.lit(middle).cast("double"), F.lit("z_above_median")), (F.col(z) > safe, F.lit("z_safe_zone")), (F.col(rank) <= 0.5, F.lit("ratio_model_low_risk"))]
    return rows.withColumn("subset", F.explode(F.array_compact(F.array(*[F.when(c, n) for c, n in named]))))


def without_impossible(wide: DataFrame, total: str, components: Sequence[str], balance: str, flags: str, tolerance: float = 0.05) -> DataFrame:
    """Components that exceed the total by more than `tolerance` are blanked and flagged, where the sheet balances. flags: text joined by ';'."""
    sound = (F.col(total) > 0) & (F.col(balance) <= 0.01)
    over = {c: F.coalesce(sound & (F.col(c) > F.col(total) * (1 + tolerance)), F.lit(False)) for c in components}
    before = F.filter(F.split(F.coalesce(flags, F.lit("")), ";"), lambda f: f != "")
    added = F.array_compact(F.array(*[F.when(o, F.lit(f"{c}_exceeds_total_dropped")) for c, o in over.items()]))
    told = F.array_join(F.array_distinct(F.concat(before, added)), ";")
    return wide.withColumns({**{c: F.when(~o, F.col(c)) for c, o in over.items()}, flags: told})


def carried(rows: DataFrame, source: DataFrame, key: str, columns: Sequence[str], *order: Column) -> DataFrame:
    """rows with `columns` of the first row of `source` for their key; null where it has none. Aggregated before the join."""
    first = source.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__of"))
    return rows.join(first, key, "left").select(*rows.columns, *[F.col(f"__of.{c}").alias(c) for c in columns])


def expected(keys: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """Exactly the wanted keys, in their number, with nulls where nothing was found."""
    return keys.join(found, list(on), "left")


def modelling_table(labels: DataFrame, language: DataFrame, ratios: DataFrame, texts: DataFrame, text_columns: Sequence[str]) -> DataFrame:
    """labels by (doc_id, firm_id, fy) with language features, ratios by (firm_id, fy) and texts by doc_id; a missing text is empty.

    strict: included in its own right."""
    wide = labels.join(language, ["doc_id", "firm_id", "fy"], "left").join(ratios, ["firm_id", "fy"], "left").join(texts.select("doc_id", *text_columns), "doc_id", "left")
    return wide.withColumns({**{c: F.coalesce(c, F.lit("")) for c in text_columns}, "strict": F.coalesce("exclude_reason", F.lit("")) == ""})


def healthy_pool(financials: DataFrame, *excluded: DataFrame) -> DataFrame:
    """firm_id and its years, of firms that are in none of the excluded lists."""
    for ids in excluded:
        financials = financials.join(ids.select("firm_id").distinct(), "firm_id", "left_anti")
    return financials.groupBy("firm_id").agg(F.array_sort(F.collect_set("fy")).alias("years"))


def group_candidates(firms: DataFrame, pool: DataFrame, others: DataFrame, prefix: int = 8, few: int = 32) -> DataFrame:
    """firm, candidate, match_quality: candidates of the firm's own group, or where that has none those of its first `prefix` letters.

    firms: firm, group; pool: candidate, grp; others: firm, other (listings of one company). A firm is never its own candidate. Groups are
    joined, never all pairs; whether the own group has anyone is asked before the firm itself is taken out, as in the rule."""
    pool = pool.where("grp IS NOT NULL").dropDuplicates(["candidate"])
    filled = pool.select(F.col("grp").alias("group")).distinct().withColumn("__any", F.lit(True))
    barred = others.where("firm IS NOT NULL AND other IS NOT NULL").select("firm", "other").distinct()
    # A firm has few other listings: it takes them along, and no pair is shuffled for their sake. Those of a firm with many are joined.
    told = barred.groupBy("firm").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= few)
    brought = barred.join(shuffled(told), "firm", "left_semi").groupBy("firm").agg(F.collect_set("other").alias("__few"))
    many = barred.join(shuffled(told), "firm", "left_anti").select("firm").distinct().withColumn("__many", F.lit(True))
    asked = firms.select("firm", "group").join(shuffled(filled), "group", "left").join(shuffled(brought), "firm", "left").join(shuffled(many), "firm", "left")
    key = F.when(F.col("__any"), F.col("group")).otherwise(F.substring("group", 1, prefix))
    asked = asked.select(key.alias("__key"), "firm", "__few", "__many", F.coalesce("__any", F.lit(False)).alias("__any"))
    exact = dealt_join(asked.where("__any"), pool.select(F.col("grp").alias("__key"), "candidate"), "__key")
    near = dealt_join(asked.where("NOT __any"), pool.select(F.substring("grp", 1, prefix).alias("__key"), "candidate"), "__key")
    out = None
    for pairs, quality in ((exact, "exact_industry"), (near, f"industry_prefix_{prefix}")):
        free = pairs.where("firm <> candidate").withColumn("match_quality", F.lit(quality))
        easy = free.where(F.col("__many").isNull() & ~F.coalesce(F.array_contains("__few", F.col("candidate")), F.lit(False))).select("firm", "candidate", "match_quality")
        hard = free.where("__many").select("firm", "candidate", "match_quality").join(shuffled(barred.withColumnRenamed("other", "candidate")), ["firm", "candidate"], "left_anti")
        out = easy.unionByName(hard) if out is None else out.unionByName(easy).unionByName(hard)
    return out


def checked_documents(suspects: DataFrame, facts: DataFrame, field: str, sources: Sequence[str]) -> DataFrame:
    """firm_id, fy, doc_id: the one document whose figure the check used, by the order of `sources`."""
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    used = facts.where((F.col("field") == field) & (place > 0)).withColumn("__place", place)
    best = used.groupBy("firm_id", "fy").agg(F.min_by("source_doc_id", F.struct("__place", "source_doc_id")).alias("doc_id"))
    return suspects.select("firm_id", "fy").distinct().join(best, ["firm_id", "fy"])


def size_year(firms: DataFrame, sizes: DataFrame) -> DataFrame:
    """firms(firm_id, reference_fy) with size_fy: the reference year if it has a size, else the year before, else null."""
    known = sizes.where("total_assets IS NOT NULL").select("firm_id", "fy").distinct()
    near = firms.join(known, "firm_id").where("fy IN (reference_fy, reference_fy - 1)").groupBy("firm_id", "reference_fy").agg(F.max("fy").alias("size_fy"))
    return firms.join(near, ["firm_id", "reference_fy"], "left")


def retired_pairs(pairs: DataFrame, accepted_ids: DataFrame, id_status: DataFrame, others: DataFrame, assets: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """pair_id and why it cannot stand, all reasons in order; pairs that stand have no row.

    pairs: pair_id, distressed, healthy, size_fy; id_status: firm, status; others: firm, other; assets: firm, fy, total (corrected)."""
    p = pairs.join(accepted_ids.select(F.col("firm_id").alias("distressed")).distinct().withColumn("__yes", F.lit(True)), "distressed", "left")
    p = p.join(id_status.select(F.col("firm").alias("distressed"), "status"), "distressed", "left")
    p = p.join(others.select(F.col("firm").alias("distressed"), F.col("other").alias("healthy")).distinct().withColumn("__same", F.lit(True)), ["distressed", "healthy"], "left")
    for role in ("distressed", "healthy"):
        p = p.join(assets.select(F.col("firm").alias(role), F.col("fy").alias("size_fy"), F.col("total").alias(f"__{role}")), [role, "size_fy"], "left")
    share = F.try_divide(F.when(F.col("__healthy") != 0, F.col("__healthy")), F.col("__distressed"))
    rules = [("another_debtor", F.col("__yes").isNull()), ("id_mismatch", F.col("status") == "mismatch"), ("same_company", F.col("__same")), ("size_match_fails", ~share.between(1 - tolerance, 1 + tolerance))]
    told = p.withColumn("reason", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules])), "; "))
    return told.where("reason <> ''").select("pair_id", "reason")


def next_ids(new: DataFrame, old: DataFrame, id_col: str, *order: Column, prefix: str = "P", width: int = 4) -> DataFrame:
    """New rows numbered on from the largest number of the old ids, in `order`.

    The numbering is a range sort and a count by partition: no task sees all rows."""
    top = old.agg(F.coalesce(F.max(F.regexp_extract(id_col, r"([0-9]+)$", 1).cast("long")), F.lit(0)).alias("top")).first()["top"]
    spark = new.sparkSession
    made = new.sort(*order).rdd.zipWithIndex().map(lambda row: (*row[0], row[1]))
    numbered = spark.createDataFrame(made, new.schema.add("__n", "long"))
    return numbered.withColumn(id_col, F.concat(F.lit(prefix), F.lpad((F.col("__n") + 1 + top).cast("string"), width, "0"))).drop("__n")


def linked(rows: DataFrame, links: DataFrame, on: Sequence[str], url: str, *order: Column) -> tuple[DataFrame, DataFrame]:
    """rows with the first link of their key, and the rows that have none."""
    one = links.where(F.col(url).isNotNull()).groupBy(*on).agg(F.min_by(url, F.struct(*order)).alias(url))
    whole = rows.dropDuplicates(list(on)).join(one, list(on), "left")
    return whole, whole.where(F.col(url).isNull()).select(*on)


def debtors(announcements: DataFrame, keyword: str = "corporate insolvency resolution") -> DataFrame:
    """One row for each company of announcements of a kind, known by its id or else by its name.

    announcements: row_id (the order of ties), pa_type, cin, name_norm, corporate_debtor, announcement_date, applicant. Names are
    distinct and in the order of their first announcement."""
    mine = announcements.where(F.contains(F.lower("pa_type"), F.lit(keyword))).withColumn("debtor_key", F.coalesce("cin", F.concat(F.lit("NAME:"), "name_norm")))
    at = F.struct(F.col("announcement_date").isNull(), F.col("announcement_date"), F.col("row_id"))
    names = mine.groupBy("debtor_key", "corporate_debtor").agg(F.min(at).alias("__at")).groupBy("debtor_key").agg(F.array_sort(F.collect_list(F.struct("__at", "corporate_debtor"))).alias("__names"))
    figures = mine.groupBy("debtor_key").agg(F.min_by(F.struct("corporate_debtor", "name_norm", "cin", "applicant"), at).alias("__first"), F.min("announcement_date").alias("first_date"), F.max("announcement_date").alias("last_date"), F.count(F.lit(1)).alias("n_announcements"))
    joined = figures.join(names, "debtor_key")
    cin = F.col("__first.cin")
    return joined.select("debtor_key", "__first.corporate_debtor", "__first.name_norm", cin.alias("cin"), F.array_join(F.transform("__names", lambda x: x["corporate_debtor"]), " | ").alias("all_names"), "first_date", "last_date", "n_announcements", cin.startswith("L").alias("cin_listed"), F.substring(cin, 2, 5).alias("cin_nic"))


def mean_by_levels(values: DataFrame, key: str, columns: Sequence[str], classes: DataFrame, label: str) -> DataFrame:
    """Means by key first, so that each counts once, then of all and by class: level, n and the columns."""
    per = values.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns]).join(classes.select(key, label), key)
    figures = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns]]
    by = per.groupBy(F.col(label).cast("string").alias("level")).agg(*figures)
    return per.agg(*figures).select(F.lit("all").alias("level"), "n", *columns).unionByName(by)


def stage_totals(records: DataFrame, prefixes: Sequence[str], base: str, factor: float) -> DataFrame:
    """prefix, kwh, co2 and times_less (the base's total over its own) of stage records(stage, kwh), summed by the prefixes of their names."""
    first = F.coalesce(*[F.when(F.col("stage").startswith(p), F.lit(p)) for p in sorted(prefixes, key=len, reverse=True)])
    sums = records.withColumn("prefix", first).where("prefix IS NOT NULL").groupBy("prefix").agg(F.sum("kwh").alias("kwh"))
    of = sums.where(F.col("prefix") == base).select(F.col("kwh").alias("__base"))
    return sums.join(F.broadcast(of)).select("prefix", "kwh", (F.col("kwh") * factor).alias("co2"), F.try_divide("__base", "kwh").alias("times_less"))


def last_years(figures: DataFrame, firms: DataFrame, n: int, keep_short: bool = False) -> DataFrame:
    """The last n years up to each firm's reference year; firms with fewer have no rows, unless kept."""
    due = figures.join(firms.select("firm_id", "reference_fy"), "firm_id").where("fy <= reference_fy").dropDuplicates(["firm_id", "fy"])
    last = first_per_key(due, ["firm_id"], F.desc("fy"), n=n, rank="back")
    return last if keep_short else last.join(last.groupBy("firm_id").agg(F.max("back").alias("__most")).where(F.col("__most") == n), "firm_id", "left_semi")


def in_order(df: DataFrame, column: str, order: Sequence[str], *then: Column) -> DataFrame:
    """Sorted by the place of a value in `order`; values that are not in it come last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.orderBy(F.coalesce(F.nullif(place, F.lit(0)), F.lit(len(order) + 1)), *then)


def majority(votes: DataFrame, key: str, vote: str, least: int, share: float) -> DataFrame:
    """key and the value that at least `least` votes and `share` of them give; null where none does. Ties go to the smaller value."""
    counted = votes.where(F.col(vote).isNotNull()).groupBy(key, vote).agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy(key).agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.min_by(vote, F.struct(-F.col("n"), F.col(vote))).alias("best"))
    return top.select(key, F.when((F.col("most") >= least) & (F.col("most") >= share * F.col("all")), F.col("best")).alias("majority"))


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """name, there, n_rows of each table; None is one that is missing."""
    spark = next(df for df in tables.values() if df is not None).sparkSession
    found = [df.agg(F.lit(n).alias("name"), F.lit(True).alias("there"), F.count(F.lit(1)).alias("n_rows")) for n, df in tables.items() if df is not None]
    gone = spark.createDataFrame([(n, False, None) for n, df in tables.items() if df is None], "name string, there boolean, n_rows long")
    for df in found:
        gone = gone.unionByName(df)
    return gone
