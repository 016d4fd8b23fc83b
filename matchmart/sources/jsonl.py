"""Raw match documents: JSON Lines in, typed frames out.

The feed is one match per line with a nested ``players`` list. Parsing is
``from_json`` with an explicit schema over a text column, so the same code
reads a landing folder (``spark.read.text``) or lines already in a
DataFrame. Tolerant mode's skip rules: blank lines, lines that are not one JSON
object and a missing, NULL or non-integer ``match_id`` are dropped (and kept in
a rejects frame for the quality report); strict mode fails on a bad line
instead. Scalars are read as text and cast, and ``lost_values`` reports what a
cast could not take.

Each line is read for its key and validity once (no value is built but the id), and
for its fields once, with a schema of only the fields that are asked for, after
duplicates are gone. Fields are parsed straight into their types; only a line that has a
value of another type is parsed again, as text. A parsed value that several
columns use comes out of a one-element ``inline``, which the optimizer does not merge into
them; merged, each column would parse the line again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchmart.operators.dedup import MANY_KEYS, first_per_key, first_per_stored_key
from matchmart.schemas import ITEM_SLOTS, MATCH_COLUMNS, PLAYER_WIDE_COLUMNS, RAW_MATCH, RAW_PLAYER
from matchmart.session import written


RUN_DATE = "run_date"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of a JSONL file or folder, with the file they came from.

    A folder that was landed by run date also gives ``run_date``, its partition column:
    a filter on it reads only these days' files.
    """
    lines = spark.read.text(path)
    dated = [F.col(RUN_DATE).cast("string").alias(RUN_DATE)] if RUN_DATE in lines.columns else []
    return lines.select(F.col("value"), F.col("_metadata.file_path").alias("source_file"), *dated)


_EDGE_SPACE = r"(?U)^\s+|\s+$"


def as_text(t: T.DataType) -> T.DataType:
    """The same shape with every scalar as text, so that no value is lost while parsing."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, as_text(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(as_text(t.elementType))
    return T.StringType()


def typed(x: Column, t: T.DataType) -> Column:
    """Text to the target type: "1500", 1500 and 1500.0 are one number, true and 1 one flag.

    The plain cast comes first; white space, decimals and flags are looked at only
    where it has no value.
    """
    if isinstance(t, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[typed(x[f.name], f.dataType).alias(f.name) for f in t.fields]))
    if isinstance(t, T.ArrayType):
        return F.transform(x, lambda e: typed(e, t.elementType))
    if isinstance(t, T.StringType):
        return x
    word = F.lower(F.regexp_replace(x, _EDGE_SPACE, ""))
    number = word.try_cast("decimal(38,10)")
    if isinstance(t, T.BooleanType):
        return (F.when(x.isNull(), F.lit(None)).when(x == "true", F.lit(True)).when(x == "false", F.lit(False))
                .when((word == "true") | (number == 1), F.lit(True))
                .when((word == "false") | (number == 0), F.lit(False)))
    if isinstance(t, T.DoubleType):
        return F.coalesce(x.try_cast(t), F.when(word == "true", 1.0).when(word == "false", 0.0)
                          .otherwise(word.try_cast(t)))
    whole = F.when(number == F.floor(number), number)
    return F.coalesce(x.try_cast(t), F.when(word == "true", 1).when(word == "false", 0).otherwise(whole.try_cast(t)))


def _lost(x: Column, t: T.DataType) -> Column:
    """Paths of scalars that have text but no value of the target type."""
    none = F.array().cast("array<string>")
    if isinstance(t, T.StructType):
        return F.when(x.isNull(), none).otherwise(F.concat(*[
            F.transform(_lost(x[f.name], f.dataType), _prefixed(f.name))
            for f in t.fields]))
    if isinstance(t, T.ArrayType):
        inner = F.flatten(F.transform(x, lambda e: _lost(e, t.elementType)))
        return F.coalesce(F.transform(inner, lambda e: F.concat(F.lit("[]."), e)), none)
    return F.when(x.isNotNull() & typed(x, t).isNull(), F.array(F.lit(""))).otherwise(none)


def _prefixed(name: str):
    return lambda path: F.concat(F.lit(name), path)


def _trimmed(line: Column) -> Column:
    return (F.when(line.startswith("{") & line.endswith("}"), line)
            .otherwise(F.regexp_replace(line, _EDGE_SPACE, "")))


def _raw_doc(line: Column, schema: T.StructType = RAW_MATCH) -> Column:
    """The line's fields as text."""
    return F.from_json(_trimmed(line), as_text(schema))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, however often they are used."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def parse_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``doc`` (typed struct), ``match_key`` (bigint) and ``reject`` (reason or NULL).

    A line is good if, without the white space around it, it is one JSON object
    and nothing else, and its ``match_id`` is a whole number (3, "3" or 3.0; a
    fraction or a boolean is no id). Strict mode raises on a line that is not one
    JSON object; blank lines are skipped, a missing or odd id is NULL there.
    """
    text = _trimmed(F.col("value"))
    # In brackets the line is an array: of one element if nothing follows the object.
    head = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<struct<match_id: string>>")
    kind = F.when(text == "", "blank").when(~text.startswith("{"), "not_an_object")
    once = _once(lines, _kind=kind, _head=head)
    good = F.col("_kind").isNull() & F.coalesce(F.size("_head") == 1, F.lit(False))
    fail = F.raise_error(F.concat(F.lit("not one JSON object: "), F.col("value")))
    ident = F.when(good, F.col("_head")[0]["match_id"])
    key = F.when(~F.lower(ident).isin("true", "false"), typed(ident, T.LongType()))
    doc = F.when(good, typed(_raw_doc(F.col("value")), RAW_MATCH))
    if strict:
        doc = doc.otherwise(fail.cast(RAW_MATCH))
        reject = F.when(~good, fail.cast("string"))
        once = once.where(~F.coalesce(F.col("_kind") == "blank", F.lit(False)))
    else:
        reject = (F.when(F.col("_kind").isNotNull(), F.col("_kind"))
                  .when(ident.isNull(), F.lit("unparsable_or_no_match_id"))
                  .when(key.isNull(), F.lit("bad_match_id")))
    return once.select(*lines.columns, key.alias("match_key"), reject.alias("reject"), doc.alias("doc"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject").isNull())


def rejects(parsed: DataFrame) -> DataFrame:
    """Rejected lines with their reason and source file ('' when unknown)."""
    src = F.col("source_file") if "source_file" in parsed.columns else F.lit(None).cast("string")
    return (parsed.where(F.col("reject").isNotNull())
            .select(F.coalesce(src, F.lit("")).alias("source_file"), "value", "reject"))


def lost_values(parsed: DataFrame) -> DataFrame:
    """Quality report: accepted lines' fields that hold text of another type, and how many."""
    raw = _once(accepted(parsed).select("value"), raw=F.struct(_raw_doc(F.col("value")).alias("doc")))
    return (raw.select(F.explode(_lost(F.col("raw.doc"), RAW_MATCH)).alias("field"))
            .groupBy("field").agg(F.count(F.lit(1)).alias("values")))


#: fields of a match without its players
MATCH_FIELDS = tuple(MATCH_COLUMNS[1:])


def dedup_batch(parsed: DataFrame, known_keys: DataFrame | None = None, stored: bool = False,
                fields: Sequence[str] | None = None, staging: str | None = None) -> DataFrame:
    """Accepted lines, one per match id, minus ids already in the warehouse.

    With ``staging``, if lines fall away, the documents that stay are written there, typed, and
    only ``match_key`` and ``doc`` come out.

    ``stored`` says that ``parsed`` is a written table: its keys are read first, and only lines
    of duplicated ids are compared, so documents are not shuffled for being single.
    ``fields`` names the top-level fields that the caller needs: only these are shuffled, and
    ``match_key``, ``source_file`` and ``doc`` (with these fields) come out.

    "First" within the batch is the smallest (source file, line text): a
    total order that does not depend on how the input was split. Only these two
    enter the aggregate; ``match_key``, ``source_file``, ``value`` and the typed ``doc``
    come out, and the documents are parsed from what it keeps.
    """
    good = accepted(parsed)
    if "source_file" not in good.columns:
        good = good.withColumn("source_file", F.lit(""))
    good = whole = good.select("match_key", "source_file", "value")
    if known_keys is not None:
        known = known_keys.select(F.col(known_keys.columns[0]).alias("match_key"))
        good = _without_known(good, known) if stored else good.join(known, "match_key", "left_anti")
    if fields is not None:
        return _first_fields(good, fields)
    one = (first_per_stored_key if stored else first_per_key)(good, ["match_key"], ["source_file", "value"])
    if staging is not None and one is not whole:
        typed_documents(one).write.mode("overwrite").option("compression", "zstd").parquet(staging)
        return one.sparkSession.read.parquet(staging)
    return one.withColumn("doc", typed(_raw_doc(F.col("value")), RAW_MATCH))


def _without_known(good: DataFrame, known: DataFrame) -> DataFrame:
    """Lines whose id is not known. Ids are compared first, so the lines of a batch that is
    all new or all known, but for some ids, are not shuffled."""
    ids = good.select("match_key").distinct()
    seen = written(known.join(ids, "match_key", "left_semi"), "known-ids")
    n = seen.count()
    if n == 0:
        return good
    if n <= MANY_KEYS:
        return good.join(F.broadcast(seen), "match_key", "left_anti")
    fresh = written(ids.join(seen, "match_key", "left_anti").withColumnRenamed("match_key", "_id"), "new-ids")
    if fresh.count() <= MANY_KEYS:
        return good.join(F.broadcast(fresh), F.col("match_key").eqNullSafe(F.col("_id")), "left_semi")
    return good.join(seen, "match_key", "left_anti")


def _first_fields(good: DataFrame, names: Sequence[str]) -> DataFrame:
    """``names`` of each id's first line by (source file, line text), without shuffling lines.

    Two digests tell whether an id's lines in its first file are one text. Only where they
    are not are the lines read again and compared.
    """
    some = T.StructType([f for f in RAW_MATCH.fields if f.name in names])
    first_file = [F.col("source_file").isNull().alias("_none"), F.col("source_file")]
    sums = {"_a": F.xxhash64("value"), "_b": F.xxhash64(F.lit(1), F.col("value"))}
    rows = _typed_once(good, some).select("match_key", "source_file", *[F.col("_doc")[n].alias(n) for n in names],
                                          *[h.alias(n) for n, h in sums.items()])
    by_file = rows.groupBy("match_key", "source_file").agg(
        *[F.min(n).alias(n) for n in names],
        ((F.min("_a") != F.max("_a")) | (F.min("_b") != F.max("_b"))).alias("_differ"))
    one = written(by_file.groupBy("match_key").agg(
        F.min(F.struct(*first_file, "_differ", *names)).alias("_first")).select("match_key", "_first.*"), "first-lines")
    plain = one.where("NOT _differ").select("match_key", "source_file", F.struct(*names).alias("doc"))
    differ = one.where("_differ").select(F.col("match_key").alias("_key"), F.col("source_file").alias("_file"))
    if differ.isEmpty():
        return plain
    same = F.col("match_key").eqNullSafe(F.col("_key")) & F.col("source_file").eqNullSafe(F.col("_file"))
    again = first_per_key(good.join(differ, same, "left_semi"), ["match_key"], ["source_file", "value"])
    return plain.unionByName(_typed_once(again, some).select(
        "match_key", "source_file", F.struct(*[F.col("_doc")[n].alias(n) for n in names]).alias("doc")))


_BAD = "_corrupt_record"


def _typed_once(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """``lines`` (with ``value``) and ``_doc``, the line's fields of ``schema`` typed.

    Nearly all lines have every scalar in its own type and are parsed straight into it. A
    line with a value of another type (which the parser marks) is parsed again, as text.
    """
    marked = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    plain = F.from_json(_trimmed(F.col("value")), marked, {"columnNameOfCorruptRecord": _BAD})
    once = _once(lines, _plain=plain)
    odd = F.col("_plain")[_BAD].isNotNull()
    once = _once(once, _text=F.when(odd, _raw_doc(F.col("value"), schema)))
    fields = [F.when(odd, typed(F.col("_text")[f.name], f.dataType)).otherwise(F.col("_plain")[f.name]).alias(f.name)
              for f in schema.fields]
    return once.select(*lines.columns, F.struct(*fields).alias("_doc"))


def typed_documents(docs: DataFrame) -> DataFrame:
    """``match_key`` and ``doc``, typed: the form that is written between stages."""
    return _typed_once(docs.select("match_key", "value"), RAW_MATCH).select("match_key", F.col("_doc").alias("doc"))


def _fields(docs: DataFrame, names: list[str]) -> DataFrame:
    """``match_key`` and typed fields of documents that come as lines or as ``doc`` structs."""
    if "value" not in docs.columns:
        return docs.select("match_key", *[F.col("doc")[n].alias(n) for n in names])
    some = T.StructType([f for f in RAW_MATCH.fields if f.name in names])
    return _typed_once(docs.select("match_key", "value"), some).select(
        "match_key", *[F.col("_doc")[n].alias(n) for n in names])


def project_matches(docs: DataFrame) -> DataFrame:
    """Match-level fields; a missing field is NULL."""
    return _fields(docs, MATCH_COLUMNS[1:]).withColumnRenamed("match_key", "match_id")


def explode_players(docs: DataFrame) -> DataFrame:
    """One row per player carrying the match key; a missing, NULL or empty list gives no rows."""
    rows = _fields(docs, ["players"])
    p = rows.select(F.col("match_key").alias("match_id"), F.explode("players").alias("p"))
    names = {"account_id": "steam_id", "isRadiant": "is_radiant"}
    return p.select("match_id", *[F.col("p")[f.name].alias(names.get(f.name, f.name)) for f in RAW_PLAYER.fields]).select(
        *PLAYER_WIDE_COLUMNS)


def read_raw_matches(spark: SparkSession, path: str, known_keys: DataFrame | None = None,
                     strict: bool = False, fields: Sequence[str] | None = None) -> DataFrame:
    """Landing folder → de-duplicated accepted documents (``match_key``, ``doc``)."""
    return dedup_batch(parse_lines(read_lines(spark, path), strict), known_keys, fields=fields)


# --------------------------------------------------------------------------- writing

def documents_from_tables(matches: DataFrame, players_wide: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Assemble one JSON document per match from warehouse-shaped frames.

    Columns of ``matches`` named in ``keep`` come out beside the documents.

    Players are grouped per match; after key de-duplication a match has at
    most one row per player slot, so each list is bounded by the slot
    domain. A match without players has no ``players`` field.
    """
    pw = players_wide
    player = F.struct(
        F.col("player_slot"), F.col("steam_id").alias("account_id"), F.col("personaname"),
        *[F.col(c) for c in ["assists", "deaths", "denies", "gold_per_min"]],
        F.col("hero_id").cast("int").alias("hero_id"),
        *[F.col(c) for c in ITEM_SLOTS],
        F.col("kills"), F.col("xp_per_min"), F.col("is_radiant").alias("isRadiant"),
        F.col("win").cast("int").alias("win"),
        *[F.col(c) for c in ["last_hits", "hero_damage", "hero_healing", "tower_damage"]],
    )
    plist = pw.groupBy("match_id").agg(
        F.sort_array(F.collect_list(player)).alias("players"))
    m = matches.select("match_id", "duration", "first_blood_time", "radiant_win",
                       F.col("region").cast("bigint").alias("region"), *keep)
    doc = m.join(plist, "match_id", "left")
    return doc.select(F.to_json(F.struct(*[F.col(c) for c in doc.columns if c not in keep])).alias("value"), *keep)


def land(lines: DataFrame, path: str, run_date: Column | str | None = None) -> None:
    """Append lines to a landing folder (one JSON document per line, files compressed).

    With ``run_date`` (a column of ``lines``, or a literal by ``F.lit``) they go into one
    folder per date, ``run_date=yyyy-MM-dd``.
    """
    if run_date is None:
        lines.select("value").write.mode("append").option("compression", "gzip").text(path)
        return
    date = F.col(run_date) if isinstance(run_date, str) else run_date
    (lines.select("value", date.cast("string").alias(RUN_DATE))
     .write.mode("append").option("compression", "gzip").partitionBy(RUN_DATE).text(path))
