"""Vector clocks as map<string,bigint> columns, with built-in map functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_clock() -> Column:
    return F.create_map().cast("map<string,bigint>")


def get(clock: Column, device: Column) -> Column:
    """A device's count; missing is 0."""
    return F.coalesce(F.try_element_at(clock, device), F.lit(0)).cast("bigint")


def compare(a: Column, b: Column) -> Column:
    """Greater / less / equal / concurrent over the union of devices; null clocks are empty."""
    apart = F.map_values(F.map_zip_with(F.coalesce(a, empty_clock()), F.coalesce(b, empty_clock()), lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    above, below = F.exists(apart, lambda d: d > 0), F.exists(apart, lambda d: d < 0)
    return F.when(above & below, "concurrent").when(above, "greater").when(below, "less").otherwise("equal")


def is_concurrent(a: Column, b: Column) -> Column:
    """C03"""
    return compare(a, b) == "concurrent"


def merge(a: Column, b: Column) -> Column:
    """Pointwise maximum."""
    return F.map_zip_with(F.coalesce(a, empty_clock()), F.coalesce(b, empty_clock()), lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def tick(clock: Column, device: Column) -> Column:
    """The device's own count goes up by one."""
    held = F.coalesce(clock, empty_clock())
    return F.map_concat(F.map_filter(held, lambda k, _: k != device), F.create_map(device, get(held, device) + 1))


def inferred_tick(clock: Column, remote: Column, device: Column, tracked_hash: Column, local_hash: Column) -> Column:
    """A local clock strictly behind ticks once if the content changed since it was tracked."""
    changed = tracked_hash.isNotNull() & (tracked_hash != local_hash) & (compare(clock, remote) == "less")
    return F.when(changed, tick(clock, device)).otherwise(clock)


def outcome(local: Column, remote: Column, local_hash: Column, remote_hash: Column) -> Column:
    """up_to_date on equal content whatever the clocks; else by clock order; ties conflict."""
    order = compare(local, remote)
    return F.when(local_hash == remote_hash, "up_to_date").when(order == "greater", "local_newer").when(order == "less", "remote_newer").otherwise("conflict")


def auto_resolution(local_device: Column, remote_device: Column) -> Column:
    """The smaller device name (byte order) keeps its version."""
    return F.when(local_device <= remote_device, "keep_local").otherwise("keep_remote")


def after_upload(state_clock: Column, remote_clock: Column, uploaded: Column) -> Column:
    """The remote clock merges into the state only once the upload succeeded."""
    return F.when(uploaded, merge(state_clock, remote_clock)).otherwise(state_clock)


def dominate(local: Column, remote: Column, device: Column, planned_manifest: Column, current_manifest: Column) -> Column:
    """Merge and tick on a fast-forward whose remote manifest is still the planned one; else null."""
    return F.when(planned_manifest.eqNullSafe(current_manifest), tick(merge(local, remote), device))


def text(clock: Column) -> Column:
    """Devices in order, ``a:1,b:2``: a form that every engine can compare."""
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce(clock, empty_clock()))), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return F.array_join(pairs, ",")
