"""Secret scan by corpus-wide ownership frequency (native).

Each text is scanned for candidates: assignments to a password-like name,
access keys, long hex strings, and, more widely, any long token that mixes
letters and digits. Candidate values are hashed and counted over the corpus by
distinct owners and distinct repositories (map-side partial aggregates first,
so a value copied a billion times costs a row per task). A value that many
owners or many repositories hold is a widely copied example, also where all of these are
one owner's; one that a single owner holds in few repositories and that looks random is
a live-looking credential.

Base spans always stay. What the method adds are spans of kind ``owned``: wide
candidates outside every base span whose value looks live and belongs to one
owner only (a bare repeat of a secret that is assigned elsewhere, say). Every
span also gets its class: live, example or unclear.

Positions come from built-in functions alone: ``split`` and
``regexp_extract_all`` with one pattern give the gaps and the matches in turn,
and their running lengths are the offsets. A fold that appends to an array copies it
at each step, so running values are made in blocks of sqrt(n) elements: a text with n
matches costs n * sqrt(n) copied numbers, not n^2. Which wide candidates lie outside
every base span comes from running values as well, not from comparing each with each.

Defined cases: null and empty texts have no span; null owners and repositories
count as one owner or repository named by the empty string; rows with equal ids
stay separate rows; an empty table gives an empty table; further columns are
left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, load, stage, text_of

# Kind, pattern, group that holds the value, least length of that group.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
KINDS = [k for k, *_ in BASE]
#: A run of 24 or more in place of "a run, 24 or more long" finds the same runs without the short ones.
FAST = {"hex": r"[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}"}
#: wide candidates: long tokens with a digit and a letter
WIDE, WIDE_LEAST = r"[A-Za-z0-9+/_=-]{20,}", 20
#: owners, or repositories, from which on a value counts as a widely copied example
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 4
#: distinct characters that a live-looking value has at least
LIVE_CHARS = 8

_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, step: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running results of ``step`` over an array of longs, in blocks of about sqrt(n) elements."""
    def scan(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("last"), F.array().cast("array<bigint>").alias("done"))

        def add(acc: Column, x: Column) -> Column:
            return _let(step(acc["last"], x), lambda n: F.struct(
                n.alias("last"), F.concat(acc["done"], F.array(n)).alias("done")))

        return F.aggregate(part, start, add, lambda acc: acc["done"])

    none = F.lit(zero).cast("long")

    def blockwise(all_: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_))).cast("int"))
        last = F.greatest(F.lit(0), F.ceil(F.size(all_) / size).cast("int") - 1)
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_, b * size + 1, size))

        def joined(parts: Column) -> Column:
            tops = F.transform(parts, lambda p: F.aggregate(p, none, step))
            starts = F.concat(F.array(none), scan(tops, none))
            return F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), scan))

        return _let(blocks, joined)

    return _let(values, blockwise)


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Matches of ``pattern`` as structs (start, kind, stop, value), in order."""
    def span(hit: Column, stop: Column) -> Column:
        value = F.regexp_extract(hit, pattern, group) if group else hit
        return F.struct((stop - F.length(hit)).cast("int").alias("start"), F.lit(kind).alias("kind"),
                        stop.cast("int").alias("stop"), value.alias("value"))

    def placed(found: Column) -> Column:
        # The last gap has no match after it and falls away.
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        widths = F.zip_with(gaps, found, lambda gap, hit: (F.length(gap) + F.length(hit)).cast("long"))
        ends = running(widths, lambda a, x: a + x, 0)
        return F.filter(F.zip_with(found, ends, span), lambda s: F.length(s["value"]) >= least)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.regexp_like(text, F.lit(pattern)), _let(hits, placed)).otherwise(F.array().cast(_SPAN))


def outside(wide: Column, base: Column) -> Column:
    """The wide spans that no base span overlaps."""
    far = 1 << 40

    def judged(spans: Column) -> Column:
        # In order of start: the furthest end of a base span so far, and the next base span's start.
        is_base = lambda s: s["kind"] < len(BASE)
        ends = running(F.transform(spans, lambda s: F.when(is_base(s), s["stop"]).otherwise(-1).cast("long")),
                       lambda a, x: F.greatest(a, x), -1)
        nexts = running(F.reverse(F.transform(spans, lambda s: F.when(is_base(s), s["start"]).otherwise(F.lit(far))
                                              .cast("long"))), lambda a, x: F.least(a, x), far)
        pairs = F.zip_with(ends, F.reverse(nexts), lambda e, n: F.struct(e.alias("e"), n.alias("n")))
        told = F.zip_with(spans, pairs, lambda s, p: F.struct(
            s.alias("s"), (~is_base(s) & (p["e"] <= s["start"]) & (p["n"] >= s["stop"])).alias("free")))
        return F.transform(F.filter(told, lambda t: t["free"]), lambda t: t["s"])

    return F.when((F.size(wide) > 0) & (F.size(base) > 0),
                  _let(F.array_sort(F.concat(base, wide)), judged)).otherwise(wide)


def base_spans(text: Column) -> Column:
    each = [_spans(text, i, FAST.get(k, p), g, least) for i, (k, p, g, least) in enumerate(BASE)]
    return F.array_sort(F.concat(*each))


def wide_spans(text: Column) -> Column:
    mixed = _spans(text, len(BASE), WIDE, 0, WIDE_LEAST)
    return F.filter(mixed, lambda s: F.regexp_like(s["value"], F.lit("[0-9]"))
                    & F.regexp_like(s["value"], F.lit("[A-Za-z]")))


def looks_live(value: Column) -> Column:
    """Random rather than a placeholder: enough different characters, digits among them."""
    return ((F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARS)
            & F.regexp_like(value, F.lit("[0-9]")))


def render(spans: Column) -> Column:
    """kind:start:stop of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in [*KINDS, "owned"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def value_classes(candidates: DataFrame, example_owners: int = EXAMPLE_OWNERS,
                  example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """(hash, live, owner, repo) rows to hash, owners, repos, docs, class."""
    per = candidates.groupBy("hash", "owner", "repo").agg(
        F.max("live").alias("live"), F.count(F.lit(1)).alias("docs"))
    per = per.groupBy("hash", "owner").agg(
        F.max("live").alias("live"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("repos"))
    per = per.groupBy("hash").agg(F.max("live").alias("live"), F.sum("docs").alias("docs"),
                                  F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))
    copied = (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)
    kind = (F.when(copied, "example")
            .when((F.col("owners") == 1) & F.col("live"), "live").otherwise("unclear"))
    return per.withColumn("class", kind)


def scan(docs: DataFrame, owner: str = "source", repo: str = "lang",
         example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per document.

    doc_id, base and all (arrays of start, kind, stop, value hash), n_live and
    n_example (spans by class). A repository is named by its owner and ``repo``.
    """
    text = text_of(docs)
    own = F.coalesce(col(docs, owner).cast("string"), F.lit(""))
    rep = F.coalesce(col(docs, repo).cast("string"), F.lit(""))
    found = docs.select(col(docs, "doc_id").alias("doc_id"), own.alias("owner"), rep.alias("repo"),
                        base_spans(text).alias("base"), wide_spans(text).alias("wide"))
    def hashed(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"),
            F.substring(F.sha2(s["value"].cast("binary"), 256), 1, 32).alias("hash"),
            looks_live(s["value"]).alias("live")))

    # Texts end here: what is staged has a few spans per document.
    rows = stage(found.select("doc_id", "owner", "repo", hashed(F.col("base")).alias("base"),
                              hashed(outside(F.col("wide"), F.col("base"))).alias("wide"))
                 .withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    each = rows.select("row", "owner", "repo", F.explode(F.concat("base", "wide")).alias("s"))
    each = each.select("row", "owner", "repo", "s.*")
    classes = value_classes(each.select("hash", "live", "owner", "repo"), example_owners, example_repos)
    judged = each.join(classes.select("hash", "class"), "hash")
    added = F.when((F.col("kind") == len(BASE)) & (F.col("class") == "live"),
                   F.struct("start", "kind", "stop", "hash", "live"))
    told = F.when(F.col("kind") < len(BASE), F.col("class")).when(added.isNotNull(), F.col("class"))
    # One row per document that has candidates; the lists are as long as its own spans.
    per_row = judged.groupBy("row").agg(
        F.collect_list(added).alias("added"),
        F.count_if(told == "live").alias("n_live"), F.count_if(told == "example").alias("n_example"))
    out = rows.join(per_row, "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.slice("wide", 1, 0))))
    return out.select("doc_id", "base", every.alias("all"),
                      F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
                      F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: numbers of base spans, their digest, and all spans of every document."""
    rows = scan(load(spark, sf_dir, "documents"))
    count = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}")
             for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *count,
                       F.sha2(render(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       render(F.col("all")).alias("spans"), "n_live", "n_example")
