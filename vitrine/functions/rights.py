"""Rights vocabulary and the rules that map upstream statements to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Rights:
    public_domain: bool | None
    label: str
    license_url: str | None

    def columns(self) -> dict[str, Column]:
        return {
            "public_domain": F.lit(self.public_domain).cast("boolean"),
            "rights_label": F.lit(self.label),
            "license_url": F.lit(self.license_url).cast("string"),
        }

    def struct(self) -> Column:
        return F.struct(*[c.alias(k) for k, c in self.columns().items()])


# The rights vocabulary.
PD = Rights(True, "Public domain", "https://creativecommons.org/publicdomain/mark/1.0/")
CC0 = Rights(True, "CC0", "https://creativecommons.org/publicdomain/zero/1.0/")
CC_BY = Rights(False, "CC BY 4.0", "https://creativecommons.org/licenses/by/4.0/")
CC_BY_SA = Rights(False, "CC BY-SA 4.0", "https://creativecommons.org/licenses/by-sa/4.0/")
CC_BY_NC = Rights(False, "CC BY-NC 4.0", "https://creativecommons.org/licenses/by-nc/4.0/")
NASA = Rights(True, "Public domain (NASA)", "https://www.nasa.gov/nasa-brand-center/images-and-media/")
UNCLEAR = Rights(None, "Rights unclear — check source", None)
RESTRICTED = Rights(False, "Restricted — see source", None)
NO_KNOWN = Rights(True, "No known copyright restrictions", "https://www.flickr.com/commons/usage/")


def rights_from_url(url: Column) -> Column:
    """Rights of a license URL; null when it is not an open license."""
    return (
        F.when(url.contains("publicdomain/mark"), PD.struct())
        .when(url.contains("publicdomain/zero"), CC0.struct())
        .when(url.rlike("licenses/by/(?!nc|nd)"), CC_BY.struct())
        .when(url.contains("licenses/by-sa"), CC_BY_SA.struct())
    )


def rights_from_license_id(code: Column) -> Column:
    return F.when(code == "pdm", PD.struct()).when(code == "cc0", CC0.struct()).when(code == "cc-by", CC_BY.struct())


def rights_from_license_name(name: Column) -> Column:
    """Rights of a free-text license name. Non-commercial and no-derivatives variants are not open."""
    n = F.lower(name)
    closed = n.rlike(r"\bn[cd]\b|noncommercial|non-commercial|no ?deriv")
    return (
        F.when(n.contains("public domain"), PD.struct())
        .when(n.contains("cc0"), CC0.struct())
        .when(closed, F.lit(None).cast("struct<public_domain:boolean,rights_label:string,license_url:string>"))
        .when(n.rlike(r"cc[- ]by-sa"), CC_BY_SA.struct())
        .when((n == "cc-by") | n.contains("cc-by 4") | n.contains("cc by"), CC_BY.struct())
    )


def rights_from_photo_license(code: Column) -> Column:
    """Numeric license codes of a photo service; null for any other code."""
    return F.when(code == "9", CC0.struct()).when(code == "10", PD.struct()).when(code == "7", NO_KNOWN.struct())
