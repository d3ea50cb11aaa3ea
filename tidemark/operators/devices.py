"""Merging device registries: J16.

A row of one registry meets a row of another where their ids are equal and not empty, or their names are equal.
Rows are edges between an id and a name, so rows that can meet at all lie in one component of that graph; a component's incoming rows
are applied in order, each to the first row that it meets then.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.operators.trees import components

#: Fields that an incoming row fills where they are empty.
FILLED = ("device_id", "signing_key_hash", "description")


def _real(row: dict) -> bool:
    return bool(row["public_key"]) and not row["placeholder"]


class _Component:
    """Rows of a component in the registry's order, found by id and by name."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.at: dict[tuple[str, str], list[int]] = {}

    def _keys(self, row: dict) -> list[tuple[str, str]]:
        return [("id", row["device_id"])] * bool(row["device_id"]) + [("name", row["name"] or "")]

    def _index(self, i: int) -> None:
        for key in self._keys(self.rows[i]):
            bisect.insort(self.at.setdefault(key, []), i)

    def add(self, row: dict) -> None:
        self.rows.append(row)
        self._index(len(self.rows) - 1)

    def take(self, row: dict) -> None:
        """Apply one incoming row."""
        met = [self.at[key][0] for key in self._keys(row) if self.at.get(key)]
        if not met:
            self.add(row | {"added": True, "changed": True})
            return
        i = min(met)
        held = self.rows[i]
        if _real(held) and _real(row) and held["public_key"] != row["public_key"]:
            held["refused"] += 1
            return
        for key in self._keys(held):
            self.at[key].remove(i)
        if _real(row) and not _real(held):
            self.rows[i] = row | {"added": held["added"], "changed": True, "refused": held["refused"]}
        else:
            new = {c: row[c] for c in FILLED if c in held and not held[c] and row[c]}
            new |= {"revoked": True} if row["revoked"] and not held["revoked"] else {}
            new |= {"sequence": row["sequence"]} if row["sequence"] is not None and (held["sequence"] is None or row["sequence"] > held["sequence"]) else {}
            held |= new | {"changed": held["changed"] or bool(new)}
        self._index(i)


def merge_registry(local: DataFrame, incoming: DataFrame, strict: bool = True, position: str = "position") -> DataFrame:
    """The local registry (device_id, name, public_key, placeholder, revoked, sequence, position, ...) after the incoming one.

    Incoming rows come in order of ``position``, each to the first local row of its id (if not empty) or name.  Two
    different real keys under one id or name are an error; with strict=False the incoming row is counted as ``refused`` instead.  A
    real key replaces a row without one by the incoming row as it is, also where that one is revoked or its sequence larger.
    Otherwise empty ids, signing keys and descriptions are filled, revoked is sticky and the sequence is the larger;
    names and keys stay.  A row that meets none is ``added``.  Null names count as empty ones, which meet each other.
    A component's rows are held by one task: those that share ids and names, in turn.
    """
    columns = [c for c in local.columns if c in incoming.columns]
    sides = local.select(F.lit(0).alias("side"), *columns).unionByName(incoming.select(F.lit(1).alias("side"), *columns))
    name = F.concat(F.lit("n:"), F.coalesce("name", F.lit("")))
    key = F.when(F.coalesce("device_id", F.lit("")) != "", F.concat(F.lit("i:"), "device_id")).otherwise(name)
    keyed = sides.withColumns({"_a": key, "_b": name})
    found = components(keyed.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    joined = keyed.join(found.select(F.col("node").alias("_a"), "root"), "_a", "left").withColumn("_root", F.coalesce("root", "_a")).drop("root", "_a", "_b")
    schema = StructType([*local.select(*columns).schema.fields, *StructType.fromDDL("added boolean, changed boolean, refused long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held = None, _Component()
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if row["_root"] != root:
                    out += held.rows
                    root, held = row["_root"], _Component()
                side = row.pop("side")
                del row["_root"]
                row |= {"added": False, "changed": False, "refused": 0}
                held.take(row) if side else held.add(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        yield pa.RecordBatch.from_pylist(held.rows, arrow)

    merged = joined.repartition("_root").sortWithinPartitions("_root", "side", position).mapInArrow(run, schema)
    if strict:
        clash = F.raise_error(F.concat(F.lit("two real keys differ for device "), F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce("device_id", F.lit("")), F.lit(")")))
        merged = merged.withColumn("refused", F.when(F.col("refused") > 0, clash.cast("long")).otherwise(F.col("refused"))).where("refused = 0").drop("refused")
    return merged
