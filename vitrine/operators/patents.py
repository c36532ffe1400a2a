"""Patent search over a landed table of patent records."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.operators.filters import contains_ci
from vitrine.operators.merge import page

DATE_FIELDS = {"priority": "priority_date", "filing": "filing_date", "publication": "publication_date"}


@dataclass(frozen=True)
class PatentQuery:
    q: str = ""
    num: int | None = None
    page: int | None = None
    sort: str | None = None  # new, old
    after: str | None = None
    before: str | None = None
    date_type: str = "publication"
    inventor: str | None = None
    assignee: str | None = None
    country: str | None = None
    status: str | None = None  # GRANT, APPLICATION
    type: str | None = None  # PATENT, DESIGN


def patent_date_op(kind: str, value: Column) -> Column:
    """Bound of a date window: ``YYYY`` opens at Jan 1 or closes at Dec 31; anything else but a date is null."""
    t = F.trim(value)
    year = F.regexp_extract(t, r"^(\d{4})$", 1)
    expanded = F.concat(year, F.lit("-01-01" if kind == "after" else "-12-31"))
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(year != "", expanded)
    return day.try_cast("date")


def patent_filter(query: PatentQuery, columns: Sequence[str]) -> Column:
    """Filter over patent records with ISO date strings. ``columns`` names what the table has."""
    cond = F.lit(True)
    field = F.col(DATE_FIELDS.get(query.date_type, "publication_date")).try_cast("date")
    for kind, value in (("after", query.after), ("before", query.before)):
        bound = patent_date_op(kind, F.lit(value))
        if value and re.fullmatch(r"\s*\d{4}(-\d{2}-\d{2})?\s*", value):
            cond = cond & ((field >= bound) if kind == "after" else (field <= bound))
    cond = cond & contains_ci("inventor", (query.inventor or "").replace('"', ""))
    cond = cond & contains_ci("assignee", (query.assignee or "").replace('"', ""))
    codes = [c for c in re.sub(r"[^A-Z,]", "", (query.country or "").strip().upper()).split(",") if c]
    if codes:
        cond = cond & F.substring("publication_number", 1, 2).isin(codes)
    if query.status in ("GRANT", "APPLICATION"):
        granted = F.coalesce(F.col("grant_date"), F.lit("")) != ""
        cond = cond & (granted if query.status == "GRANT" else ~granted)
    if query.type in ("PATENT", "DESIGN"):
        design = F.col("publication_number").startswith("USD")
        cond = cond & (design if query.type == "DESIGN" else ~design)
    for word in re.sub(r"\s+", " ", query.q.strip()).split(" "):
        cond = cond & contains_ci("title", word)
    return cond


def patent_sort(query: PatentQuery) -> list[Column]:
    field = F.col(DATE_FIELDS.get(query.date_type, "publication_date"))
    number = F.col("publication_number").asc()
    if query.sort == "old":
        return [field.asc_nulls_last(), number]
    return [field.desc_nulls_last(), number] if query.sort == "new" else [number]


# Page bounds of a public site, for callers that want them.
SITE_PATENT_PAGES = {"min_num": 10, "max_num": 100, "max_page": 50}


def clamp_patent_page(
    num: int | None, page_no: int | None, min_num: int = 1, max_num: int | None = None, max_page: int | None = None
) -> tuple[int, int]:
    """Page size and number. Every page can be reached unless the caller sets bounds."""
    num = 100 if num is None else max(min_num, num)
    page_no = max(0, page_no or 0)
    return num if max_num is None else min(max_num, num), page_no if max_page is None else min(max_page, page_no)


def page_of_offset(offset: int, num: int) -> int:
    return offset // num


def search_patents(
    records: DataFrame, query: PatentQuery, pos: str | None = "pos", bounds: Mapping[str, int] | None = None
) -> DataFrame:
    num, page_no = clamp_patent_page(query.num, query.page, **(bounds or {}))
    hits = records.filter(patent_filter(query, records.columns))
    return page(hits, patent_sort(query), page_no * num, num, pos)
