"""Analysis thresholds as plain configuration; operators turn them into literals."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

#: Prefix of the environment variables that override a threshold.
ENV_PREFIX = "SEO_THRESHOLD_"


@dataclass(frozen=True)
class Thresholds:
    # fixed values: the published defaults
    title_min: int = 30
    title_max: int = 60
    description_min: int = 120
    description_max: int = 160
    thin_words: int = 300
    thin_words_critical: int = 100
    slow_seconds: float = 3.0
    slow_seconds_critical: float = 5.0
    images_without_alt_critical: int = 5
    lcp_good: float = 2500.0
    lcp_poor: float = 4000.0
    cls_good: float = 0.1
    cls_poor: float = 0.25
    tbt_good: float = 200.0
    tbt_poor: float = 600.0
    fid_good: float = 100.0
    fid_poor: float = 300.0
    ttfb_good: float = 800.0
    ttfb_poor: float = 1800.0
    page_bytes: int = 2 * 1024 * 1024
    js_bytes: int = 500 * 1024
    css_bytes: int = 200 * 1024
    image_bytes: int = 1024 * 1024
    lazy_position: int = 3
    redirect_ms: int = 100
    long_chain: int = 3
    lab_field_gap: float = 20.0
    third_party_share: float = 30.0
    third_party_requests: int = 20
    modern_saving: float = 0.30
    top_keywords: int = 10
    min_keyword_length: int = 3
    difficult_syllables: int = 3
    reliable_words: int = 50
    stuffing_percent: float = 3.0

    def overridden(self, values: Mapping[str, object]) -> Thresholds:
        """A copy with ``values``; each is cast to the type of its default, a bad one is left out."""
        changed = {}
        for f in fields(self):
            if f.name in values:
                try:
                    changed[f.name] = type(getattr(self, f.name))(values[f.name])
                except (TypeError, ValueError):
                    continue
        return replace(self, **changed)

    @classmethod
    def from_env(cls, environ: Mapping[str, str]) -> Thresholds:
        return cls().overridden({k[len(ENV_PREFIX) :].lower(): v for k, v in environ.items() if k.startswith(ENV_PREFIX)})

    @classmethod
    def from_file(cls, path: str) -> Thresholds:
        return cls().overridden(json.loads(Path(path).read_text()))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))


DEFAULTS = Thresholds()
