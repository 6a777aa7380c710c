"""The plug-in surfaces (section 2.11): what goes by which name, and a place to add one's own."""

from __future__ import annotations

from collections.abc import Callable

from ledgerloom.operators import analysis, cascade, classify, extract
from ledgerloom.sources import readers

#: Surface -> name -> what implements it.
SURFACES: dict[str, dict[str, Callable]] = {
    "classifier": {"v1": classify.classify_v1, "v2": classify.classify_v2, "ensemble": classify.vote, "pages": classify.page_kind, "metadata": classify.metadata_signals},
    "analyser": {"transitional": analysis.year_split, "correction": analysis.correction_pairs, "deltas": analysis.correction_deltas, "flags": analysis.analysis_flags},
    "ingestor": {"folder": readers.documents_in, "bytes": readers.from_bytes, "uploads": readers.judged_uploads, "csv": readers.csv_texts, "json_lines": readers.json_lines, "jdbc": readers.jdbc_table},
    "ocr_engine": {"render": readers.render_adapter, "text_layer": readers.text_layer},
    "strategy": {"regex": cascade.RegexExtractor, "model": cascade.ModelExtractor, "patterns": extract.extract_invoices},
}


def implementation(surface: str, name: str) -> Callable:
    """What goes by a name; an unknown surface or name lists what there is."""
    known = SURFACES.get(surface, SURFACES)
    if surface not in SURFACES or name not in known:
        raise KeyError(f"unknown {surface} {name!r}; available: {', '.join(sorted(known))}")
    return known[name]


def register(surface: str, name: str, function: Callable) -> None:
    """Add an implementation, or replace one."""
    SURFACES.setdefault(surface, {})[name] = function
