"""Registered plans; importing them fills the registry."""

from tessera.plans import corpus, diagnosis, documents, files, gates, logs, scoring, trajectories
