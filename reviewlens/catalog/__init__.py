"""Registered queries over the test tables, each with SQL for the same result where SQL can say it."""

from __future__ import annotations

from reviewlens.catalog import cleaning, collab, insight, similar, stats, text
from reviewlens.catalog.base import Entry

ENTRIES: dict[str, Entry] = {}
for _module in (cleaning, stats, text, similar, collab, insight):
    for _name, _entry in _module.ENTRIES.items():
        if _name in ENTRIES:
            raise ValueError(f"query {_name} registered twice")
        ENTRIES[_name] = _entry
