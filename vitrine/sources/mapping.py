"""A source mapping: a declared raw schema, a keep rule, and the item columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions.rights import Rights
from vitrine.functions.text import first_nonblank, nonblank
from vitrine.schema import ITEM, no_files


def raw(path: str) -> Column:
    """Field of the raw record. The record sits in one struct so that no output column can shadow it."""
    return F.col("r." + ".".join(f"`{p}`" for p in path.split(".")))


def strings(path: str) -> Column:
    """Array field with null treated as empty."""
    return F.coalesce(raw(path), F.array().cast("array<string>"))


def present(values: Column) -> Column:
    """Array without null and empty strings."""
    return F.filter(values, lambda x: x.isNotNull() & (x != ""))


def first(values: Column) -> Column:
    return F.get(values, F.lit(0))


@dataclass(frozen=True)
class Limits:
    """How much of its long fields a source keeps; a field that is not named is kept whole."""

    fields: Mapping[str, int] = field(default_factory=dict)

    def first(self, values: Column, name: str) -> Column:
        """The first elements of an array."""
        return F.slice(values, 1, self.fields[name]) if name in self.fields else values

    def length(self, name: str) -> int | None:
        """Characters of a text, for ``clean`` and ``join_unique``."""
        return self.fields.get(name)


# The published limits, elements of lists and characters of texts, by source.
SITE_FIELDS: dict[str, dict[str, int]] = {
    "met": {"views": 8, "biography": 120},
    "cma": {"description": 600},
    "si": {"notes": 2, "note": 300, "creator": 3, "culture": 3},
    "rijks": {"creator": 3, "object_type": 3, "medium": 4, "place": 3, "description": 200},
    "harvard": {"creator": 3, "date": 80, "kinds": 2, "medium": 160, "place": 3},
    "smk": {"creator": 3, "object_type": 3, "medium": 4},
    "europeana": {"title": 220, "provider": 90, "creator": 3, "creators": 140, "place": 2, "description": 220},
    "flickr": {"title": 220, "creator": 100, "description": 240},
    "wellcome": {"creator": 3, "date": 80, "kinds": 2, "place": 3, "subjects": 8, "description": 220},
    "nypl": {"title": 220},
    "nasa3d": {"description": 500},
    "nih3d": {"keywords": 12, "files": 8, "description": 250},
    "patents": {"title": 200, "person": 120},
}


def year_columns(span: Column) -> dict[str, Column]:
    """Both year columns from one parsed range; ``apply`` evaluates the range once."""
    return {"_years": span}


def rights_columns(rights: Rights | Column) -> dict[str, Column]:
    if isinstance(rights, Rights):
        return rights.columns()
    return {k: rights[k] for k in ("public_domain", "rights_label", "license_url")}


@dataclass(frozen=True)
class SourceMapping:
    key: str
    schema: str  # DDL of the raw record
    source_id: Callable[[], Column]
    keep: Callable[[], Column]
    columns: Callable[[Limits], dict[str, Column]]
    # computed once per record before ``columns``, available as ``prepared(name)``
    prepare: Callable[[Limits], dict[str, Column]] | None = None

    def apply(
        self, records: DataFrame, carry: tuple[str, ...] = (), limits: Mapping[str, Mapping[str, int]] | None = None
    ) -> DataFrame:
        """Normalize raw records. ``carry`` names raw columns to keep beside the item columns.

        ``limits`` names, by source, how much of a long field is kept (``SITE_FIELDS``); by default all of it.
        """
        kept = Limits((limits or {}).get(self.key, {}))
        df = records.select(F.struct("*").alias("r"))
        if self.prepare:
            # columns of their own: Catalyst evaluates a costly column that is used twice only once,
            # which it does not do for the fields of a struct
            df = df.select("r", *[c.alias(f"_p_{k}") for k, c in self.prepare(kept).items()])
        df = df.filter(F.coalesce(self.keep(), F.lit(False)))
        cols = self.columns(kept)
        years = cols.pop("_years", None)
        if years is not None:
            df = df.withColumn("_years", years)
            cols |= {"year_start": F.col("_years.start"), "year_end": F.col("_years.end")}
        source_id = self.source_id().cast("string")
        defaults = {
            "id": F.concat(F.lit(f"{self.key}:"), source_id),
            "source": F.lit(self.key),
            "source_id": source_id,
            "content_type": F.lit("image"),
            "files": no_files(),
            "boost": F.lit(0),
        }
        out = {**defaults, **cols}
        item = [out.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ITEM.fields]
        mapped = df.select(*item, *[raw(c).alias(c) for c in carry])
        # a record without a title is dropped, like one the keep rule refuses
        return mapped.filter(nonblank(F.col("title")).isNotNull())


def prepared(name: str) -> Column:
    return F.col(f"_p_{name}")


def or_untitled(*titles: Column) -> Column:
    return first_nonblank(*titles, F.lit("Untitled"))
