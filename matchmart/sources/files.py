"""Small-file formats of the feed: JSON id lists, JSON arrays/maps of objects, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchmart.operators.load import table_exists
from matchmart.sources.jsonl import as_text, typed


# --------------------------------------------------------------------------- id lists

#: ids in one line of a saved list
IDS_A_LINE = 1000


def save_id_list(ids: DataFrame, path: str, column: str | None = None) -> None:
    """Write ids as JSON arrays of at most ``IDS_A_LINE`` ids, a line each (overwrite).

    Several arrays in a row are one list to ``load_id_list``. An array holds ids of one
    task, cut at a fixed number, so no line grows with the list. Null ids are left out.
    """
    one = ids.select(F.col(column or ids.columns[0]).alias("id")).where("id IS NOT NULL")
    one = one.withColumn("line", F.floor(F.monotonically_increasing_id() / IDS_A_LINE))
    lines = one.groupBy("line").agg(F.to_json(F.collect_list("id")).alias("value"))
    lines.select("value").write.mode("overwrite").text(path)


def id_list_pieces(spark: SparkSession, path: str) -> DataFrame:
    """What the reader sees of JSON arrays of ids: one short ``value`` per comma.

    Neither a file's single line of any length nor its number of lines makes a long row.
    """
    return spark.read.text(path, lineSep=",")


def load_id_list(spark: SparkSession, path: str, column: str = "match_id") -> DataFrame:
    """Read JSON array file(s) of ids as rows; a missing path gives no rows."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(column, T.LongType())]))
    # A file may hold one (indented) array or several arrays in a row; ids are plain
    # numbers, so commas, brackets and white space part them, whatever the lines.
    ids = id_list_pieces(spark, path).select(F.explode(F.split("value", r"[\[\]\s]+")).alias("id")).where("id <> ''")
    return ids.select(F.when(F.col("id") != "null", F.col("id").cast("long")).alias(column))


# --------------------------------------------------------------------------- object lists

def json_array_rows(docs: DataFrame, element: T.StructType, text_col: str = "value") -> DataFrame:
    """Each text value is a JSON array of objects; one output row per object.

    Scalars are read as text and typed as the match documents' are, so 25, 25.0 and "25" are one
    number; a field that is missing or has no value of its type is NULL.
    """
    rows = docs.select(F.inline(F.from_json(F.col(text_col), T.ArrayType(as_text(element)))))
    return rows.select(*[typed(F.col(f.name), f.dataType).alias(f.name) for f in element.fields])


def json_map_rows(docs: DataFrame, value: T.StructType, key_name: str = "item_key",
                  text_col: str = "value") -> DataFrame:
    """Each text value is a JSON object ``{key: {...}}``; one row per key, key as a column."""
    m = F.from_json(F.col(text_col), T.MapType(T.StringType(), value))
    kv = docs.select(F.explode(m).alias(key_name, "_v"))
    return kv.select(key_name, "_v.*")


# Objects whose keys are not known beforehand: the item dictionary has other keys for
# other items, and one key may be a number here and ``false`` there.

def entry_rows(docs: DataFrame, key_name: str = "item_key", text_col: str = "value") -> DataFrame:
    """One row per entry of each JSON object: the key, and ``object`` (VARIANT), whatever is in it.

    Documents that are not JSON fail the read; NULL documents and empty objects give no rows.
    """
    parsed = docs.select(F.parse_json(F.col(text_col)).alias("_doc"))
    each = docs.sparkSession.tvf.variant_explode(F.col("_doc").outer())
    return parsed.lateralJoin(each).select(F.col("key").alias(key_name), F.col("value").alias("object"))


def entry_types(rows: DataFrame) -> dict[str, str]:
    """Every key of any row's object with its type over all rows (VARIANT where they differ).

    An aggregate merges the types; a row per distinct key comes to the driver, which names
    the columns.
    """
    each = rows.sparkSession.tvf.variant_explode(F.col("object").outer())
    fields = rows.lateralJoin(each).select("key", "value")
    types = fields.groupBy("key").agg(F.schema_of_variant_agg("value").alias("type"))
    return {r["key"]: r["type"] for r in types.collect()}


_SCALARS = ("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN", "DATE", "TIMESTAMP", "DECIMAL")


def entry_table(rows: DataFrame, known: T.StructType | None = None, rest: str = "other") -> DataFrame:
    """Rows with a column per key of their objects.

    Without ``known`` every key that any object has becomes a column (in order of name):
    scalars of one type keep it, anything else is text (nested values and mixed types as
    JSON, strings as they are). With ``known`` these fields are columns, typed as stated,
    and all other keys stay in the map column ``rest`` (key to JSON), so none is lost.
    """
    key = [c for c in rows.columns if c != "object"]
    fields = rows.select(*key, F.col("object").cast("map<string,variant>").alias("_fields"))
    if known is None:
        types = entry_types(rows)
        names = {n: t if t.startswith(_SCALARS) else "STRING" for n, t in sorted(types.items())}
        return fields.select(*key, *[F.col("_fields")[n].cast(t).alias(n) for n, t in names.items()])
    found = [typed(F.col("_fields")[f.name].cast("string"), f.dataType).alias(f.name) for f in known.fields]
    others = F.map_filter("_fields", lambda k, _: ~k.isin(known.fieldNames()))
    return fields.select(*key, *found, F.transform_values(others, lambda _, v: F.to_json(v)).alias(rest))


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one text value each (for JSON documents spanning lines)."""
    return spark.read.text(path, wholetext=True)


# --------------------------------------------------------------------------- CSV

def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header row, comma separated, UTF-8, NULL as an empty field; text unchanged.

    Text that needs it is quoted, quotes in it doubled, so that line ends, commas, quotes and
    white space at the edges come back as they were. Empty text and NULL are both
    an empty field, which reads as NULL.
    """
    (df.write.mode(mode).option("header", True).option("encoding", "UTF-8")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("escape", '"').csv(path))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files: ``file``, ``first`` (the file's first record) and ``record``.

    Quoted text may hold line ends, so whether a line end closes a record depends on all
    quotes before it in the file. Files are split all the same: an aggregate counts the
    quotes of each split, a running sum over a file's splits says which of them begin inside
    quotes, and a running sum within a split says so for each line. A line that begins
    and ends outside quotes is a record; the others are put together by the split and
    line in which their record begins, also across splits. The lines of a split that begins
    outside quotes and has no line with an odd number of them are records each: they are not
    numbered, sorted or shuffled.

    Quotes stand around a field, and doubled within it, as ``write_csv`` and pandas write
    them; a file with an odd number of quotes is an error.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    odd = F.col("quotes") % 2 == 1
    # A split that begins inside quotes has a line that begins outside if one follows its first odd line.
    splits = lines.groupBy("file", "block").agg(
        (F.sum("quotes") % 2).alias("odd"), F.min("id").alias("low"), F.max(odd).alias("breaks"),
        (F.min(F.when(odd, F.col("id"))) < F.max("id")).alias("reopens"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    splits = splits.withColumn("inside", F.coalesce(F.sum("odd").over(ahead), F.lit(0)) % 2)
    broken = F.raise_error(F.concat(F.lit("odd number of quotes in "), F.col("file")))
    splits = splits.withColumn("inside", F.when(F.sum("odd").over(whole) % 2 == 1, broken.cast("long"))
                               .otherwise(F.col("inside")))
    begins = (F.col("inside") == 0) | F.coalesce("reopens", F.lit(False))
    # The split whose last record is still open when this one begins.
    splits = splits.withColumn("carry", F.last(F.when(begins, F.col("block")), True).over(ahead))

    # a row per split, so each task can hold them and the lines stay where they are
    at = lines.join(F.broadcast(splits), ["file", "block"])
    first = (F.col("block") == 0) & (F.col("id") == F.col("low"))
    plain = (F.col("inside") == 0) & ~F.col("breaks")
    whole_lines = at.where(plain).select("file", first.alias("first"), F.col("value").alias("record"))

    at = at.where(~plain)
    split = Window.partitionBy("file", "block").orderBy("id")
    so_far = F.coalesce(F.sum("quotes").over(split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = at.withColumn("opens", (F.col("inside") + so_far) % 2 == 0)
    opener = F.when(F.col("opens"), F.col("id"))
    at = at.withColumn("opener", F.last(opener, True).over(split.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("last", F.max(opener).over(Window.partitionBy("file", "block")))

    alone = F.col("opens") & ~odd
    lone = at.where(alone).select("file", first.alias("first"), F.col("value").alias("record"))
    # A record: the split it begins in, and its first line there (none for the one open at the split's end).
    parts = at.where(~alone).select(
        "file", first.alias("first"), "block", "id", "value",
        F.when(F.col("opener").isNull(), F.col("carry")).otherwise(F.col("block")).alias("from"),
        F.when(F.col("opener") < F.col("last"), F.col("opener")).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "id", "value")))
    parts = parts.groupBy("file", "from", "line").agg(F.bool_or("first").alias("first"), ordered.alias("lines"))
    return whole_lines.union(lone).union(parts.select("file", "first", F.array_join("lines.value", "\n").alias("record")))


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             null_words: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header and an explicit schema (no inference pass over the data).

    Large files are read by many tasks even where quoted text holds line ends
    (``csv_records``). ``null_words`` lists extra spellings of a missing value that older
    snapshots may contain (e.g. 'nan', 'None'); an empty field is NULL.
    """
    records = csv_records(spark, path).where("NOT first")
    text = F.regexp_replace("record", "\r$", "")
    options = {"mode": "FAILFAST", "multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    rows = records.where(text != "").select(F.from_csv(text, schema.toDDL(), options).alias("row"))
    df = rows.select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields])
    if null_words:
        words = list(null_words)
        df = df.select(*[
            F.when(F.col(f.name).isin(words), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in schema.fields])
    return df
