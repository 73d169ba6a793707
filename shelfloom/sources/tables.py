"""Readers: tables of a directory, and sheets with their dynamic headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfloom.operators.ranking import numbered

#: The tables of a data directory.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Header names of a sheet by field, in English and Arabic.
HEADERS = {
    "barcode": ("barcode", "gtin", "ean", "الباركود"),
    "name": ("product name", "name", "title", "اسم المنتج"),
    "brand": ("brand", "الماركة", "العلامة التجارية"),
    "link": ("image link", "image url", "image", "رابط الصورة"),
}
#: The place of a field whose header is missing.
DEFAULT_PLACES = {"name": 1, "brand": 3}
REVIEW_PREFIX = "needs_review:"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table of a directory that Spark can read, whatever the store."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, in whatever store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.exists(at) and store.getFileStatus(at).isDirectory()


def header_fields(columns: list[str]) -> dict[str, str]:
    """Field to column, by the first alias that a header equals in any case; else by the default place."""
    low = {c.strip().lower(): c for c in reversed(columns)}
    found = {field: next((low[a] for a in aliases if a in low), None) for field, aliases in HEADERS.items()}
    for field, place in DEFAULT_PLACES.items():
        if found[field] is None and place < len(columns):
            found[field] = columns[place]
    return {k: v for k, v in found.items() if v is not None}


def sheet(df: DataFrame, order: Column) -> DataFrame:
    """Rows of a sheet with a name: trimmed fields, row_number from 2 in ``order``, search_query, link and needs_review."""
    fields = header_fields(df.columns)
    text = {k: F.trim(F.coalesce(F.col(fields[k]).cast("string"), F.lit(""))) if k in fields else F.lit("") for k in HEADERS}
    rows = numbered(df.select(order.alias("at"), *[c.alias(k) for k, c in text.items()]), F.col("at"), "row_number")
    rows = rows.withColumn("row_number", (F.col("row_number") + 1).cast("int")).filter("name <> ''")
    flagged = F.col("link").startswith(REVIEW_PREFIX)
    return rows.select(
        "row_number", "barcode", "name", "brand",
        F.trim(F.concat_ws(" ", "name", "brand")).alias("search_query"),
        F.when(flagged, F.trim(F.expr(f"substring(link, {len(REVIEW_PREFIX) + 1})"))).otherwise(F.col("link")).alias("link"),
        flagged.alias("needs_review"),
    )


def brand_mappings(df: DataFrame, brand: str, synonyms: str, excluded: str) -> DataFrame:
    """(key, brand, synonyms, excluded): comma lists to arrays; the brand itself is the first synonym."""
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    name = F.trim(F.col(brand))
    return df.filter(name != "").select(F.lower(name).alias("key"), name.alias("brand"), F.array_distinct(F.concat(F.array(name), listed(synonyms))).alias("synonyms"), listed(excluded).alias("excluded"))


def row_ranges(text: str | None) -> list[tuple[int, int]] | None:
    """``"2-5,9"`` to closed ranges; None (no filter) for anything else."""
    try:
        out = []
        for part in (text or "").split(","):
            low, _, high = part.strip().partition("-")
            out.append((int(low), int(high or low)))
        return out
    except ValueError:
        return None


def in_ranges(c: Column, ranges: list[tuple[int, int]] | None) -> Column:
    """A predicate that reaches the scan; true without ranges."""
    return reduce(lambda a, b: a | b, [c.between(a, b) for a, b in ranges]) if ranges else F.lit(True)


def settings(df: DataFrame, key: str = "key", value: str = "value") -> dict[str, str]:
    """A key and value table of at most a thousand rows (more is an error: settings are no data) as a dictionary on the driver."""
    rows = df.select(key, value).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a settings table has at most 1000 rows")
    return {r[0]: r[1] for r in rows}


def typed_settings(found: dict[str, str], kinds: dict[str, str]) -> dict:
    """Settings that are known, as ``list`` (split at commas, blanks dropped), ``bool``, ``int``, ``float`` or text; one that can't be read is left out."""
    casts = {
        "list": lambda v: [x.strip() for x in v.split(",") if x.strip()],
        "bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on"),
        "int": int,
        "float": float,
        "text": str,
    }
    out = {}
    for name, kind in kinds.items():
        try:
            if found.get(name) is not None:
                out[name] = casts[kind](found[name])
        except ValueError:
            continue
    return out


def log_tail(spark: SparkSession, path: str, lines: int = 100, across: bool = False) -> DataFrame:
    """The last lines of a log: (file, line_number, line), oldest first. Files go by name; numbers are those of the lines in their file, or in all files if ``across``.

    A file is read in splits. A line's place is its file, the byte at which its split
    starts, and its row there; each task keeps ``lines`` rows, and the rows of a split
    are counted for the numbers, so a long log is neither sorted nor gathered.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    last = rows.orderBy(F.desc("file"), F.desc("split"), F.desc("row")).limit(lines)
    # a row for each split: few, also where they are ordered as one list
    order = Window.partitionBy(F.lit(1)).orderBy("file", "split") if across else Window.partitionBy("file").orderBy("split")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("row").alias("first")).withColumn("before", F.coalesce(before, F.lit(0)))
    numbered_lines = last.join(counts, ["file", "split"])
    return numbered_lines.select("file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("line_number"), "line").orderBy("file", "line_number")


def rdbms_table(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a relational database by its driver, read in ``parts`` ranges of an integer key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def key_values(lines: list[str]) -> dict[str, str]:
    """``KEY=value`` lines of an environment file; comments and blanks are skipped, quotes around a value go."""
    out = {}
    for line in lines:
        key, sign, value = line.strip().partition("=")
        if sign and not key.startswith("#"):
            out[key.strip()] = value.strip().strip("'\"")
    return out


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records under a given schema; nothing is inferred."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def candidates(df: DataFrame, key: str, value, order: list[Column]) -> DataFrame:
    """The rows of one key in an order; the key reaches the scan."""
    return df.filter(F.col(key) == value).orderBy(*order)


def fresh(df: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    """Rows written less than ``seconds`` before ``now``."""
    return df.filter(F.col(at) > now - F.make_dt_interval(secs=F.lit(seconds)))
