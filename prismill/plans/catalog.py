"""Importing this module fills the catalogue."""

from prismill.plans import business, explore, journal, learn, prepare, quality, streams  # noqa: F401
