"""Materialised marts: committed versions, catalogue views, refresh one, refresh all.

A mart is recomputed into a folder of its own, ``<root>/<mart>/v=<id>``, and becomes
version n by creating the marker ``_published/<n>`` that names the folder. Markers are
created only if absent, so of two writers who both read version n - 1 one commits n
and the other is told (``Conflict``) or, if what it wrote does not depend on n - 1,
takes the next number. Readers follow the greatest number: no clock takes part, nothing is
overwritten, and a failed refresh leaves the version before in place.

``publish`` also points a persistent view of the catalogue at the new version. The view's
properties mark it as a mart and say where it lives; ``refresh_all`` finds its marts by
these marks, so other sessions of the catalogue see them and other views are left alone.
``vacuum`` removes superseded versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchmart import storage

MartFn = Callable[[], DataFrame]

STATUS_SCHEMA = T.StructType([
    T.StructField("mart", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])

_MARKS = "_published"
#: view properties that mark a mart
_MART, _ROOT = "matchmart.mart", "matchmart.root"
#: versions that vacuum keeps, and the age from which it removes data that no marker names
KEEP, ORPHAN_SECONDS = 2, 86_400


class Conflict(RuntimeError):
    """Another writer committed the version that this one was based on."""


def _folder(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _numbers(spark: SparkSession, root: str, name: str) -> list[int]:
    found = storage.names(spark, f"{_folder(root, name)}/{_MARKS}")
    return sorted(int(n) for n, _ in found if n.isdigit())


def mark(spark: SparkSession, root: str, name: str, number: int) -> dict:
    """A version's folder (``data``) and ``note``."""
    return json.loads(storage.read_text(spark, f"{_folder(root, name)}/{_MARKS}/{number:012d}"))


def current_version(spark: SparkSession, root: str, name: str) -> int | None:
    """The number of the published version, None if there is none."""
    return max(_numbers(spark, root, name), default=None)


def current_note(spark: SparkSession, root: str, name: str) -> str:
    """What the published version's marker says."""
    number = current_version(spark, root, name)
    return "" if number is None else mark(spark, root, name, number)["note"]


def version(spark: SparkSession, root: str, name: str, number: int) -> DataFrame:
    """One version of mart ``name``."""
    return spark.read.parquet(f"{_folder(root, name)}/{mark(spark, root, name, number)['data']}")


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The published version of mart ``name``."""
    number = current_version(spark, root, name)
    if number is None:
        raise FileNotFoundError(f"mart {name} has not been published under {root}")
    return version(spark, root, name, number)


def publish(spark: SparkSession, root: str, name: str, df: DataFrame, note: str = "",
            after: int | None = None, view: bool = True) -> int:
    """Write ``df`` as a new version of mart ``name``; returns its number.

    With ``after`` (the version it was computed from, 0 for none) the new one is ``after + 1``
    or nothing: if that number is taken, the data is removed and ``Conflict`` raised.
    ``note`` is kept in the marker.
    """
    if view:
        _own_view(spark, name)
    data = f"v={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{_folder(root, name)}/{data}")
    number = (after if after is not None else current_version(spark, root, name) or 0) + 1
    text = json.dumps({"data": data, "note": note})
    while not storage.create(spark, f"{_folder(root, name)}/{_MARKS}/{number:012d}", text):
        if after is not None:
            storage.remove(spark, f"{_folder(root, name)}/{data}")
            raise Conflict(f"version {number} of {name} was published by another writer")
        number += 1
    if view:
        _point_view(spark, root, name)
    return number


# --------------------------------------------------------------------------- catalogue

def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _properties(spark: SparkSession, view: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {_quoted(view)}").collect()}


def _views(spark: SparkSession) -> list[str]:
    return [t.name for t in spark.catalog.listTables() if t.tableType == "VIEW" and not t.isTemporary]


def mart_views(spark: SparkSession, root: str) -> list[str]:
    """The marts under ``root`` that the current database has views of."""
    found = (_properties(spark, v) for v in _views(spark))
    return sorted(p[_MART] for p in found if p.get(_ROOT) == root.rstrip("/") and _MART in p)


def _own_view(spark: SparkSession, name: str) -> None:
    """Raise if the catalogue's ``name`` is somebody else's table or view."""
    if any(t.name.lower() == name.lower() and not t.isTemporary for t in spark.catalog.listTables()):
        if name.lower() not in map(str.lower, _views(spark)) or _MART not in _properties(spark, name):
            raise ValueError(f"{name} is in the catalogue and is not the view of a mart")


def _point_view(spark: SparkSession, root: str, name: str) -> None:
    """Let the view show the current version, also if another one is committed meanwhile."""
    shown = None
    while shown != (shown := current_version(spark, root, name)):
        path = f"{_folder(root, name)}/{mark(spark, root, name, shown)['data']}"
        marks = {_MART: name, _ROOT: root.rstrip("/")}
        marks = ", ".join(f"{json.dumps(k)} = {json.dumps(v)}" for k, v in marks.items())
        spark.sql(f"CREATE OR REPLACE VIEW {_quoted(name)} TBLPROPERTIES ({marks}) "
                  f"AS SELECT * FROM parquet.{_quoted(path)}")


# --------------------------------------------------------------------------- refresh

def refresh(spark: SparkSession, root: str, name: str, build: MartFn) -> tuple[int, int]:
    """Full recompute of one mart (``REFRESH MATERIALIZED VIEW``): its version and rows."""
    number = publish(spark, root, name, build())
    vacuum(spark, root, name)
    return number, version(spark, root, name, number).count()


def refresh_all(spark: SparkSession, root: str, marts: dict[str, MartFn]) -> DataFrame:
    """Refresh every mart under ``root`` that the catalogue shows; one failure does not stop the others.

    Definitions that the catalogue does not show yet are created. A mart in the catalogue
    without a definition is reported as failed.
    """
    status = []
    shown = mart_views(spark, root)
    for name in [*marts, *(n for n in shown if n not in marts)]:
        try:
            if name not in marts:
                raise LookupError("the catalogue has this mart, but it has no definition here")
            number, rows = refresh(spark, root, name, marts[name])
            status.append((name, str(number), rows, "refreshed", None))
        except Exception as e:  # noqa: BLE001 - reported per mart
            status.append((name, None, None, "failed", f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(status, STATUS_SCHEMA).withColumn(
        "refreshed_at", F.current_timestamp())


def vacuum(spark: SparkSession, root: str, name: str, keep: int = KEEP,
           orphan_seconds: float = ORPHAN_SECONDS) -> list[str]:
    """Remove all but the last ``keep`` versions, and old data that no marker names; their folders.

    Data without a marker may be another writer's that is about to commit, so it goes
    only after ``orphan_seconds``. A version's marker goes before its data.
    """
    folder, numbers = _folder(root, name), _numbers(spark, root, name)
    old, kept = numbers[:-keep], {mark(spark, root, name, n)["data"] for n in numbers[-keep:]}
    gone = []
    for n in old:
        gone.append(mark(spark, root, name, n)["data"])
        storage.remove(spark, f"{folder}/{_MARKS}/{n:012d}")
    gone += [n for n, age in storage.names(spark, folder)
             if n.startswith("v=") and n not in kept and n not in gone and age > orphan_seconds]
    for data in gone:
        storage.remove(spark, f"{folder}/{data}")
    return gone
