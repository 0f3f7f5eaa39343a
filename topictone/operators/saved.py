"""Saved models that are either whole or not there.

A model's files are a version in the folder, and a mark that is renamed into place
after them names the version with a note on the model (``VersionedTable``).  A save that
stops half-way leaves no mark: loading finds the version before, or raises
when there is none.  Overwriting is a new version; the old one goes after it counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..session import remove_path
from ..streaming.versions import VersionedTable


def save_version(spark: SparkSession, path: str, write: Callable[[str], None], note: dict, overwrite: bool = False) -> None:
    """``write(folder)`` writes the files; fails where a model is saved
    already, unless ``overwrite``."""
    store = VersionedTable(spark, path)
    last = store.latest()
    if last is not None and not overwrite:
        raise FileExistsError(f"a model already exists at {path}; overwrite it or choose another folder")
    version = 0 if last is None else last + 1
    remove_path(spark, store.folder(version))   # what a save that stopped left there
    write(store.folder(version))
    store.commit(version, json.dumps(note))
    store.forget(version)


def load_version(spark: SparkSession, path: str) -> tuple[str, dict]:
    """The folder and the note of the last whole version."""
    store = VersionedTable(spark, path)
    last = store.latest()
    if last is None:
        raise FileNotFoundError(f"no whole model is saved at {path}")
    return store.folder(last), json.loads(store.note(last))
