"""Readers, sinks and per-source mappings to the item schema."""


def simple_mappings():
    """Sources whose raw record maps to an item on its own, by key."""
    from vitrine.sources import aggregators as g, museums as m

    mappings = [m.CMA, m.AIC, m.SI, m.HARVARD, m.SMK, g.EUROPEANA, g.FLICKR, g.WELLCOME, g.NYPL, g.NASA3D, g.NIH3D, g.PATENTS]
    return {mapping.key: mapping for mapping in mappings}
