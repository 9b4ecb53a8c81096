"""Origin of fibres and sanitised compositions (inventory B36, D40, F10, G8, G9, H34-H37, H44-H46, H48)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import catalogues
from loomspan.functions.text import distinct_trimmed, fold, once

_ORIGIN = [(name, origin) for origin, names in catalogues.FIBRES.items() for name in names]


def tokens(composition: Column) -> Column:
    """Single fibres of a composition: entries split at separators, pure measurements left out."""
    parts = F.flatten(F.transform(distinct_trimmed(composition), lambda s: F.split(s, "[,/+·;]+")))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: fold(s).rlike("[a-z]"))


def known_fibre(token: Column) -> Column:
    """Name in the catalogue and its origin: the exact one, else the longest name inside the token."""
    names = F.array(*(F.struct(F.lit(len(n)).alias("size"), F.lit(n).alias("name"), F.lit(o).alias("origin")) for n, o in _ORIGIN))
    # no name inside the token is longer than the token itself, so the longest one is the exact one where there is one
    return once(fold(token), lambda folded: F.array_max(F.filter(names, lambda n: F.contains(folded, n["name"]))))


def origins(composition: Column) -> Column:
    """Sorted distinct origins; a fibre that is not known gives null among them."""
    return F.array_distinct(F.transform(tokens(composition), lambda t: known_fibre(t)["origin"]))


def origin_key(composition: Column) -> Column:
    """Null without fibres, ``incomplete`` if one is unknown, ``mixed`` if there are several, else the origin."""
    key = lambda found: F.when(F.size(found) == 0, None).when(F.exists(found, lambda o: o.isNull()), "incomplete").when(F.size(found) > 1, "mixed").otherwise(F.try_element_at(found, F.lit(1)))
    return once(origins(composition), key)


def animal_entries(composition: Column) -> Column:
    """Entries with an animal fibre."""
    return F.filter(distinct_trimmed(composition), lambda s: F.exists(tokens(F.array(s)), lambda t: F.coalesce(known_fibre(t)["origin"] == "animal", F.lit(False))))


def labels(raw: Column) -> Column:
    """Known labels, lower case, ordered distinct."""
    return F.array_distinct(F.filter(F.transform(distinct_trimmed(raw), lambda s: F.lower(s)), lambda s: s.isin(list(catalogues.LABELS))))


def ordered_labels(raw: Column) -> Column:
    """Known labels in catalogue order."""
    return F.array_intersect(F.array(*map(F.lit, catalogues.LABELS)), labels(raw))


def percentages(raw: Column) -> Column:
    """Map of fibre to percentage without blank keys and values that are no numbers."""
    return F.map_filter(raw, lambda k, v: (F.trim(k) != "") & v.isNotNull() & ~F.isnan(v))


def cable(raw: Column) -> Column:
    """"80|s" to a struct of length and join; an unknown join is null, an unreadable length makes all null."""
    cm, join = F.try_element_at(F.split(raw, r"\|"), F.lit(1)).try_cast("double"), F.try_element_at(F.split(raw, r"\|"), F.lit(2))
    return F.when(cm.isNotNull(), F.struct(cm.alias("cm"), F.when(join.isin(list(catalogues.CABLE_JOINS)), join).alias("join")))


def cables(raw: Column) -> Column:
    """Cables of a kit, sorted by length then join rank; ones without length go."""
    rank = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, catalogues.CABLE_JOINS)), c["join"]), F.lit(0).cast("long")), F.lit(9).cast("long"))
    keyed = F.transform(F.filter(raw, lambda c: c["cm"].isNotNull()), lambda c: F.struct(c["cm"].alias("cm"), rank(c).alias("rank"), c["join"].alias("join")))
    return F.transform(F.array_sort(keyed), lambda c: F.struct(c["cm"].alias("cm"), c["join"].alias("join")))


def swatches(raw: Column) -> Column:
    """Gauge swatches with at least one number."""
    return F.filter(raw, lambda s: (s["stitches"] > 0) | (s["rows"] > 0))
