"""Settings: defaults, a JSON file over them, environment variables over both."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping
from typing import Any

DEFAULTS: dict[str, dict[str, Any]] = {
    "compression": {"level": "semantic", "profile": "balanced"},
    "privacy": {"enabled": True, "auto_masking": True, "language": "en", "whitelist": [], "block_on_risk": False, "block_min_score": 61, "ai_transparency_notice": True},
    "waf": {"enabled": True, "block_mode": False, "rate_limit_requests_per_minute": 120, "auto_ban_threshold": 8, "auto_ban_window_minutes": 10, "auto_ban_duration_minutes": 120, "log_retention_days": 30, "inspect_body": False},
    "loop_guard": {"max_repeats": 2, "window": 10, "ttl_seconds": 600},
    "budget": {"daily_usd": 0.0},
}
CHOICES = {("compression", "level"): ["none", "light", "semantic", "aggressive", "statistical", "syntactic"], ("compression", "profile"): ["light", "balanced", "agent", "aggressive"]}
PREFIX = "WINNOWER_"


def merge(base: Mapping, over: Mapping) -> dict:
    """``over`` laid over ``base``, mapping by mapping; lists and scalars are replaced."""
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def _typed(text: str, like: Any) -> Any:
    if isinstance(like, bool):
        if text.lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(f"{text!r} is neither true nor false")
        return text.lower() in ("1", "true", "yes", "on")
    if isinstance(like, (int, float)):
        return type(like)(text)
    return [x for x in text.split(",") if x] if isinstance(like, list) else text


def validate(config: Mapping) -> list[str]:
    """What is wrong with a configuration; unknown sections are allowed, wrong types are not."""
    wrong = []
    for section, known in DEFAULTS.items():
        own = config.get(section, {})
        if not isinstance(own, Mapping):
            wrong.append(f"{section}: not a section")
            continue
        for key, like in known.items():
            v = own.get(key, like)
            numeric = isinstance(like, (int, float)) and not isinstance(like, bool)
            if (numeric and (isinstance(v, bool) or not isinstance(v, (int, float)))) or (not numeric and not isinstance(v, type(like))):
                wrong.append(f"{section}.{key}: {v!r} is not like {like!r}")
            elif v not in CHOICES.get((section, key), [v]):
                wrong.append(f"{section}.{key}: {v!r} is none of {CHOICES[section, key]}")
    return wrong


def load(path: str | None = None, environment: Mapping[str, str] = os.environ) -> dict:
    """The settings; a missing file counts as empty, a wrong value is an error.

    ``WINNOWER_PRIVACY__BLOCK_MIN_SCORE=70`` overrides ``privacy.block_min_score``.
    """
    config = copy.deepcopy(DEFAULTS)
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            config = merge(config, json.load(f))
    for name, text in environment.items():
        section, sep, key = name.removeprefix(PREFIX).lower().partition("__")
        if name.startswith(PREFIX) and sep and key in config.get(section, {}):
            config[section][key] = _typed(text, config[section][key])
    if wrong := validate(config):
        raise ValueError("; ".join(wrong))
    return config
