"""Defaults of a pangenome (P15): an argument beats the object's setting, which beats the table below."""

from __future__ import annotations

from typing import Any

#: The documented defaults.
DEFAULTS: dict[str, Any] = {
    "group_prefix": "OG",
    "next_group": 1,
    "core_threshold": 1.0,
    "kmer_size": 5,
    "lower_limit": 0.5,
    "algorithm": "infomap",
    "flank_size": 4,
    "min_flank": 0,
    "force_paralogues": True,
    "rescale": True,
    "transform": None,
    "max_length_dif": 0.1,
    "gene_chunk_size": 1_000_000,
    "cdhit_opts": {},
}
PROTECTED = ("translated", "next_group")


def resolve(settings: dict[str, Any], **given: Any) -> dict[str, Any]:
    """``given`` with None filled from ``settings``."""
    return {k: settings.get(k, DEFAULTS.get(k)) if v is None else v for k, v in given.items()}


def change(settings: dict[str, Any], **new: Any) -> dict[str, Any]:
    """A copy with new values; protected and unknown keys are errors."""
    for key in new:
        if key in PROTECTED:
            raise ValueError(f"{key} cannot be set")
        if key not in DEFAULTS:
            raise KeyError(key)
    return settings | new
