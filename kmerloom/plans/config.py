"""Named parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    k: int = 23
    long_k: int = 41
    spaced_k: int = 83
    jump: int = 3
    min_segment: int = 30000
    max_segment: int = 65000
    code_bits: int = 5
    merge_k: int = 11
    min_indel: int = 50
    similarity: float = 0.25
    max_bp_score: float = 3.0
    reliability: float = 2.499
    flank: int = 300
    #: Bases of the left k-mer that are part of a spaced seed's key.
    spaced_left: int = 18
    #: Odd offsets of a read take their hit from those three before and after where these agree.
    interpolate: bool = False
    #: An index of at most so many rows, composite ones included, is broadcast to the scan; a larger one is joined.
    broadcast_rows: int = 4_000_000
    #: A larger index of at most so many rows is searched in files that workers map, where the shared folder is a local
    #: path; beyond, it is joined.
    mapped_rows: int = 1_000_000_000
