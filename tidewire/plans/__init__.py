"""Registered queries, one module per family."""

from importlib import import_module

FAMILIES = ("engagement", "mart", "texts", "extraction", "corpus", "pages", "ingest")

for _family in FAMILIES:
    import_module(f"{__name__}.{_family}")
