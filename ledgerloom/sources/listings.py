"""Bodies of request logs as tables: company headers, members of a group, result filings, report links, listings of any shape; and stores of finished work."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.fiscal import parse_fy
from ledgerloom.operators.tables import first_per_key
from ledgerloom.sources.readers import blank_to_null

# The fields of a company header and their names in the body; the form of a quarter's label; what a report's link ends with.
HEADER_FIELDS = {"security_id": "SecurityId", "isin": "ISIN", "bse_group": "Group", "industry_old": "Industry", "sector": "Sector", "industry_new": "IndustryNew", "igroup": "IGroup", "isubgroup": "ISubGroup"}
QUARTER = r"^(Standalone|Consolidated)-([A-Za-z]{3})-([0-9]{2});([A-Z]{2})([0-9]{4})-([0-9]{4});([0-9.]+);(\w+)$"
REPORT_END = "(?i)\\.pdf$"
ROWS_UNDER = ("Table", "Table1", "data")


def body_rows(log: DataFrame, fields: Sequence[str], under: Sequence[str] = ROWS_UNDER) -> DataFrame:
    """key and the text fields of each row that a JSON body lists, itself or under one of the names; bodies of failed requests have none."""
    row = ", ".join(f"`{f}` string" for f in fields)
    raw = F.when(F.col("http") == 200, F.btrim("body"))
    lists = F.coalesce(F.when(raw.startswith("["), raw), *[F.get_json_object(raw, f"$.{u}") for u in under])
    parsed = log.select("key", F.explode(F.from_json(lists, f"array<struct<{row}>>")).alias("r"))
    return parsed.select("key", *[F.col("r")[f].alias(f) for f in fields])


def company_headers(log: DataFrame, industries: DataFrame | None = None) -> DataFrame:
    """One row for each body that is an object: its fields, dashes as null, and the code of its sub-group by name, whatever the case."""
    row = ", ".join(f"`{f}` string" for f in HEADER_FIELDS.values())
    body = F.when((F.col("http") == 200) & F.btrim("body").startswith("{"), F.from_json("body", row))
    got = log.select(F.col("key").alias("bse_code"), body.alias("b")).where("b IS NOT NULL")
    got = got.select("bse_code", *[blank_to_null(F.col("b")[f]).alias(n) for n, f in HEADER_FIELDS.items()])
    if industries is None:
        return got
    codes = industries.groupBy(F.lower(F.btrim("isubgroup")).alias("__name")).agg(F.max("isubgroup_code").alias("isubgroup_code"))
    return got.withColumn("__name", F.lower(F.btrim(F.coalesce("isubgroup", F.lit(""))))).join(codes, "__name", "left").drop("__name")


def traded_members(log: DataFrame, mark: str = "$#$") -> DataFrame:
    """isubgroup_code, symbol, bse_code of bodies that list members as comma-joined fields between bars, after a mark: nine fields or more, the ninth a number."""
    body = F.btrim(F.col("body"), F.lit(' "'))
    rest = F.when(F.contains(body, F.lit(mark)), F.expr(f"substring(btrim(body, ' \"'), locate('{mark}', btrim(body, ' \"')) + {len(mark)})")).otherwise(body)
    parts = log.select(F.col("key").alias("isubgroup_code"), F.explode(F.split(rest, r"\|")).alias("part")).select("isubgroup_code", F.split("part", ",").alias("f"))
    good = parts.where((F.size("f") >= 9) & F.btrim(F.get("f", 8)).rlike("^[0-9]+$"))
    return good.groupBy("isubgroup_code", F.btrim(F.get("f", 8)).alias("bse_code")).agg(F.min(F.btrim(F.get("f", 0))).alias("symbol")).select("isubgroup_code", "symbol", "bse_code")


def quarter(label: Column) -> Column:
    """STRUCT<nature, month, period_kind, fy> of a quarter's label; null where it has another form."""
    part = lambda i: F.regexp_extract(label, QUARTER, i)
    return F.when(label.rlike(QUARTER), F.struct(F.lower(part(1)).alias("nature"), part(2).alias("month"), part(4).alias("period_kind"), part(6).cast("int").alias("fy")))


def result_archive(log: DataFrame, base: str) -> DataFrame:
    """Filings: bse_code, quarter_label, nature, period_kind, month, fy, url (absolute), filed_at, revised_at."""
    rows = body_rows(log, ["Quarter", "stand_xbrl_link", "conso_xbrl_link", "Filing_Date_Time", "Revised_Date_Time"])
    q = quarter(F.col("Quarter"))
    link = F.coalesce(F.nullif("stand_xbrl_link", F.lit("")), F.nullif("conso_xbrl_link", F.lit("")))
    link = F.when(~link.endswith("/"), link)
    at = lambda c: F.try_to_timestamp(blank_to_null(F.col(c)))
    url = F.when(link.startswith("/"), F.concat(F.lit(base), link)).otherwise(link)
    return rows.select(F.col("key").alias("bse_code"), F.coalesce("Quarter", F.lit("")).alias("quarter_label"), q["nature"].alias("nature"), q["period_kind"].alias("period_kind"), q["month"].alias("month"), q["fy"].alias("fy"), url.alias("url"), at("Filing_Date_Time").alias("filed_at"), at("Revised_Date_Time").alias("revised_at"))


def full_year_filings(archive: DataFrame, month: str = "Mar", kind: str = "MC") -> DataFrame:
    """The first filing of each (bse_code, fy) for a whole standalone year, by the time it was filed."""
    mine = archive.where((F.col("nature") == "standalone") & (F.col("period_kind") == kind) & (F.col("month") == month))
    return first_per_key(mine, ["bse_code", "fy"], F.asc_nulls_last("filed_at"), F.asc_nulls_last("url")).select("bse_code", "fy", "url", "filed_at", "revised_at")


def plain_link(url: Column) -> Column:
    """Slashes of one kind, and single but after a scheme."""
    return F.regexp_replace(F.replace(F.btrim(url), F.lit("\\"), F.lit("/")), "(?<!:)//+", "/")


def report_links(log: DataFrame) -> DataFrame:
    """bse_code, fy, url, filed_at of reports; links that are no report file are passed over, a year that is no number is null."""
    rows = body_rows(log, ["PDFDownload", "Year", "Fld_AuthoriseDate"])
    url = plain_link(F.col("PDFDownload"))
    return rows.select(F.col("key").alias("bse_code"), F.col("Year").try_cast("double").cast("int").alias("fy"), url.alias("url"), F.try_to_timestamp(blank_to_null(F.col("Fld_AuthoriseDate"))).alias("filed_at")).where(F.col("url").rlike(REPORT_END))


def any_listing(items: DataFrame, base: str = "") -> DataFrame:
    """key, fy, url, pub_date of items MAP<field, text> whose fields have no fixed names: the first that ends as a file, a year's and a date's field by their names.

    The fiscal year is that of the year field, else of the file's name; an item without file or year is passed over. Fields are taken in the order of their names."""
    pairs = F.array_sort(F.map_entries("item"))
    first = lambda test: F.get(F.filter(pairs, test), 0)["value"]
    file = first(lambda e: e["value"].rlike(r"(?i)\.(pdf|zip)$"))
    year = first(lambda e: F.contains(F.lower(e["key"]), F.lit("year")) & (e["value"] != ""))
    date = first(lambda e: F.lower(e["key"]).rlike("date|dttm|dt$") & (e["value"] != ""))
    url = F.when(file.startswith("http"), file).otherwise(F.concat(F.lit(base), F.lit("/"), F.col("key").cast("string"), F.lit("/"), file))
    found = items.select("key", F.coalesce(parse_fy(year), parse_fy(file)).alias("fy"), url.alias("url"), F.coalesce(F.try_to_date(date), F.try_to_date(date, "dd-MM-yyyy")).alias("pub_date"))
    return found.where("fy IS NOT NULL AND url IS NOT NULL")


def upper_headers(df: DataFrame, **constants: str) -> DataFrame:
    """Column names trimmed and in capitals, and constant columns added."""
    return df.select(*[F.col(f"`{c}`").alias(c.strip().upper()) for c in df.columns], *[F.lit(v).alias(k) for k, v in constants.items()])


def with_file_stem(spark: SparkSession, pattern: str, keys: Sequence[str], column: str = "source_file") -> DataFrame:
    """CSV files of a pattern in one frame, each row with its file's name without ending; of rows alike in `keys` that of the first file stays."""
    df = spark.read.option("header", True).csv(pattern)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    every = [c for c in df.columns if c not in keys]
    named = df.select(*df.columns, stem.alias(column))
    return named.groupBy(*keys).agg(F.min_by(F.struct(*every, column), F.struct(column, *every)).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in [*every, column]])


def json_folder(spark: SparkSession, folder: str, schema: str, ids: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Documents of a folder of JSON files, one each, in the order of their ids; only the wanted ids where given."""
    df = spark.read.schema(schema).option("multiLine", True).json(folder)
    return (df if ids is None else df.join(ids.select(key).distinct(), key, "left_semi")).orderBy(key)


def optional_facts(spark: SparkSession, path: str, schema: str, number: str = "value") -> DataFrame:
    """Long facts of a CSV that may be missing: none then. Rows whose figure is no number are passed over."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    want = spark.createDataFrame([], schema).schema
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in want]).where(F.col(number).isNotNull())


def json_parts(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Rows of compressed JSON-lines parts; missing texts are empty."""
    df = spark.read.schema(schema).json(list(paths))
    return df.fillna("")


def resumed(spark: SparkSession, path: str, todo: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The store at `path` with the results of `work` added for the rows of `todo` whose key it has not. Finished rows are never worked on again."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        todo = todo.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    work(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def evidence(files: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, sha256, n_bytes) of the wanted files(name, content) that are there, and the names of those that are not."""
    found = files.join(wanted.select("name").distinct(), "name", "left_semi").select("name", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("n_bytes"))
    return found, wanted.select("name").distinct().join(files.select("name"), "name", "left_anti")
