"""Documents on Spark: the modules of the engine under one name, imported when they are first used."""

import importlib

_PLACES = {
    "functions": ("geometry", "patterns", "quality", "stats", "text"), "operators": ("image", "layout", "lines", "passes", "session", "words"),
    "sources": ("files", "pdf_items"), "sinks": ("docx", "encode", "pdf"), "plans": ("pipelines",), "streaming": ("drop_folder",),
}
__all__ = [name for names in _PLACES.values() for name in names]


def __getattr__(name: str):
    for place, names in _PLACES.items():
        if name in names:
            return importlib.import_module(f"parchmint.{place}.{name}")
    raise AttributeError(f"module 'parchmint' has no attribute '{name}'")
