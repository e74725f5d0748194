"""Options, with the defaults that results are compared under."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class SearchOptions:
    topk: int = 20
    candidates_topn: int = 200
    min_hits: int = 2
    max_postings_per_hash: int = 50_000
    span_min_len: int = 6
    span_gap: int = 0
    max_spans_per_doc: int = 10
    alpha: float = 0.60


@dataclass(frozen=True)
class BuildOptions:
    #: Limits of 0 hold nothing back; only the beginning of a text beyond one is indexed.
    max_text_bytes: int = 8 << 20
    max_tokens: int = 100_000
    max_shingles: int = 50_000
    max_docs: int = 0
    shingle_stride: int = 1
    strict_text_is_normalized: bool = False
    preview_bytes: int = 240
    exact_hashes: bool = False

    @property
    def strict(self) -> bool:
        return self.strict_text_is_normalized or env_bool("TEXTWEAVE_STRICT_TEXT_IS_NORMALIZED", False)

    @property
    def max_line_bytes(self) -> int:
        return max(self.max_text_bytes + (1 << 20), 2 << 20)


def parse_bool(text: str | None, default: bool) -> bool:
    """1, true, yes, on; 0, false, no, off; else the default."""
    word = (text or "").strip().lower()
    return word in ("1", "true", "yes", "on") or (default and word not in ("0", "false", "no", "off"))


def env_bool(name: str, default: bool) -> bool:
    return parse_bool(os.environ.get(name), default)
