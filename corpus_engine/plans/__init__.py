"""All registered queries."""

from importlib import import_module

GROUPS = ["catalog", "records", "chunks", "retrieval", "structured", "entities", "metadata", "reports", "files"]

for _group in GROUPS:
    import_module(f"corpus_engine.plans.{_group}")
