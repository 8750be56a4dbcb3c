"""Rule parameters as data, with a version hash of their canonical text."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

NAME_NORM_VERSION = 1


@dataclass(frozen=True)
class RuleSet:
    tax_year: int = 1998
    threshold_cents: int = 6_000_000
    name_norm_version: int = NAME_NORM_VERSION

    def canonical(self) -> str:
        return f"taxYear={self.tax_year};thresholdCents={self.threshold_cents};nameNorm={self.name_norm_version}"

    @property
    def version(self) -> str:
        """First 16 hex digits of the SHA-256 of the canonical text."""
        return hashlib.sha256(self.canonical().encode()).hexdigest()[:16]
