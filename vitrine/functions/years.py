"""Free-text dates to signed year ranges (BC negative)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vitrine.functions.text import BLANKS, as_col, let, to_int

YEARS = "struct<start:int,end:int>"

# The date grammar, tried in this order.
NO_DATE = r"(?i)^(n\.?d\.?|undated|unknown|date unknown|no date)$"
MILLENNIUM = r"(?i)(\d)(?:st|nd|rd|th)\s*millennium"
CENTURY = r"(?i)(\d{1,2})(?:st|nd|rd|th)\s*(?:-|to|or)?\s*(?:(\d{1,2})(?:st|nd|rd|th))?\s*(?:century|c\b)"
DECADE = r"\b(\d{3})0['’]?s\b"
YEAR = r"(?<![\d.])(\d{3,4})(?![\d])"
SHORT_RANGE = r"(\d{4})\s*-\s*(\d{2})(?!\d)"
SMALL_YEAR = r"(?i)(?<![\d.])(\d{1,2})(?![\d])\s*(b\.?c\.?e?|a\.?d\.?|c\.?e\.?)"
BC = r"(?i)\bb\.?c\.?e?\b"
FIRST_PART = r"(?i)\bearly\b|\bfirst (half|quarter)\b|\bbeginning\b"
LAST_PART = r"(?i)\blate\b|\bsecond half\b|\bend\b|\blast quarter\b"
MIDDLE = r"(?i)\bmid\b|\bmiddle\b"
EARLY = r"(?i)\bearly\b"
LATE = r"(?i)\blate\b"
BEFORE = r"(?i)\bbefore\b|\bby\b|\bprior to\b|\buntil\b"
AFTER = r"(?i)\bafter\b|\bpost\b|\bfrom\b|\bsince\b"
ABOUT = r"(?i)\b(ca?\.|circa|c\.|about|approximately)"
LAST_YEAR = 2100
LONGEST_SPAN = 1200


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _num(s: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(s, pattern, group).try_cast("int")


def _millennium(s: Column) -> Column:
    n = _num(s, MILLENNIUM)
    bc = s.rlike(r"(?i)b\.?c")
    return F.when(bc, _range(-(n * 1000), -((n - 1) * 1000 + 1))).otherwise(_range((n - 1) * 1000 + 1, n * 1000))


def _century(s: Column) -> Column:
    firsts = F.regexp_extract_all(s, F.lit(CENTURY), F.lit(1))
    seconds = F.regexp_extract_all(s, F.lit(CENTURY), F.lit(2))
    first = F.get(firsts, F.lit(0)).try_cast("int")
    last = F.coalesce(F.get(seconds, F.lit(0)).try_cast("int"), F.element_at(firsts, -1).try_cast("int"))

    def spread(span: Column) -> Column:
        lo, hi = span["lo"], span["hi"]
        single = span["single"]
        start = (
            F.when(single & ~s.rlike(FIRST_PART) & s.rlike(LAST_PART), hi - 49)
            .when(single & ~s.rlike(FIRST_PART) & s.rlike(MIDDLE), lo + 25)
            .otherwise(lo)
        )
        end = (
            F.when(single & s.rlike(FIRST_PART), lo + 49)
            .when(single & ~s.rlike(LAST_PART) & s.rlike(MIDDLE), hi - 25)
            .otherwise(hi)
        )
        # BC runs backwards; a descending pair of BC centuries is put in order
        return F.when(s.rlike(BC), _range(-F.greatest(start, end), -F.least(start, end))).otherwise(_range(start, end))

    span = F.struct(
        ((first - 1) * 100 + 1).alias("lo"), (last * 100).alias("hi"), (first == last).alias("single")
    )
    return let(span, spread)


def _decade(s: Column) -> Column:
    start = _num(s, DECADE) * 10
    return (
        F.when(s.rlike(EARLY), _range(start, start + 4))
        .when(s.rlike(LATE), _range(start + 5, start + 9))
        .otherwise(_range(start, start + 9))
    )


def _explicit(s: Column, found: Column) -> Column:
    one = F.size(found) == 1
    low, high = F.array_min(found), F.array_max(found)
    short = one & s.rlike(SHORT_RANGE)
    short_start = _num(s, SHORT_RANGE)
    short_end = F.greatest(F.floor(short_start / 100) * 100 + _num(s, SHORT_RANGE, 2), short_start)
    start0 = F.when(short, short_start).otherwise(low)
    end0 = F.when(short, short_end).otherwise(high)

    def widen(r: Column) -> Column:
        start = F.when(one & s.rlike(BEFORE), r["end"] - 30).otherwise(r["start"])
        # the lower bound is moved first, so "since" counts from the moved bound
        end = F.when(one & s.rlike(AFTER), start + 30).otherwise(r["end"])
        return let(_range(start, end), about)

    def about(r: Column) -> Column:
        vague = s.rlike(ABOUT) & (r["start"] == r["end"])
        start = F.when(vague, r["start"] - 5).otherwise(r["start"])
        end = F.when(vague, r["end"] + 5).otherwise(r["end"])
        return F.when(s.rlike(BC), _range(-end, -start)).when(end - start <= LONGEST_SPAN, _range(start, end))

    return let(_range(start0, end0), widen)


def _small(s: Column) -> Column:
    n = _num(s, SMALL_YEAR)
    bc = F.regexp_extract(s, SMALL_YEAR, 2).rlike("(?i)^b")
    signed = F.when(bc, -n).otherwise(n)
    return F.when(n.isNotNull(), _range(signed, signed))


def parse_years(c: Column | str) -> Column:
    """struct<start,end>, or null when the text states no usable date."""

    def rules(s: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(s, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
        usable = F.filter(numbers, lambda y: (y > 0) & (y <= LAST_YEAR))
        return (
            F.when(s.isNull() | (s == "") | s.rlike(NO_DATE), F.lit(None).cast(YEARS))
            .when(s.rlike(MILLENNIUM), _millennium(s))
            .when(s.rlike(CENTURY), _century(s))
            .when(s.rlike(DECADE), _decade(s))
            .otherwise(let(usable, lambda found: F.when(F.size(found) > 0, _explicit(s, found)).otherwise(_small(s))))
        )

    dashes = F.translate(as_col(c), "–—−", "---")
    return let(F.regexp_replace(dashes, rf"^{BLANKS}|{BLANKS}$", ""), rules)


def years(start: Column | None, end: Column | None, display: Column | None) -> Column:
    """Numeric bounds when they make sense, else the parsed display text, else the start alone."""
    none = F.lit(None).cast("bigint")
    bounds = F.struct(
        (none if start is None else to_int(start)).alias("s"),
        (none if end is None else to_int(end)).alias("e"),
        (F.lit(None).cast("string") if display is None else display.cast("string")).alias("d"),
    )

    def choose(b: Column) -> Column:
        s, e = b["s"], b["e"]
        sane = (s != 0) & (e != 0) & (s <= e) & (e - s <= LONGEST_SPAN) & (e <= LAST_YEAR)
        fallback = F.when(s != 0, _range(s, F.when((e != 0) & (e >= s), e).otherwise(s)))
        return (
            F.when(F.coalesce(sane, F.lit(False)), _range(s, e))
            .when((s != 0) & e.isNull(), _range(s, s))
            .otherwise(F.coalesce(parse_years(b["d"]), fallback))
        )

    return let(bounds, choose)


def year_span(parsed: Column) -> Column:
    """Smallest start and largest end over an array of parsed ranges; null when the array is empty."""
    found = F.filter(parsed, lambda r: r.isNotNull())
    span = _range(
        F.array_min(F.transform(found, lambda r: r["start"])),
        F.array_max(F.transform(found, lambda r: r["end"])),
    )
    return F.when(F.size(found) > 0, span)
