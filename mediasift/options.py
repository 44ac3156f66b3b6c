"""Job parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CandidateOptions:
    """What becomes a candidate (C9). The defaults are the shipped ones.

    ``strict_scheme`` drops everything but http(s), noise included; without it
    the resource-type fallback may still admit a ``blob:`` address.
    """

    min_progressive_bytes: int = 65_536
    include_subtitles: bool = True
    include_audio: bool = True
    filter_noise: bool = True
    strict_scheme: bool = False
