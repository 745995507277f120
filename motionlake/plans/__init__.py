"""Registered queries and the SQL that they are held against."""

from . import artefacts, cells, clips, documents, frames, jobs, sidecars, sizes  # noqa: F401
from .queries import ORACLE, QUERIES  # noqa: F401
