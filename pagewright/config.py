"""Run settings, as an immutable value that callers pass to the plans."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from . import fixed_values as fv


def _whole_number(raw: str | None, fallback: int) -> int:
    try:
        return fallback if raw is None else int(raw)
    except ValueError:
        return fallback


@dataclass(frozen=True)
class Config:
    model: str = fv.MODEL
    translator: str = fv.WINDOW_TRANSLATOR
    target_lang: str = fv.TARGET_LANGUAGE
    src_lang: str = fv.SOURCE_LANGUAGE
    max_chunk_chars: int = fv.CHUNK_CHARS
    max_body_mb: int = fv.UPLOAD_MAX_MB
    ocr: bool = True
    traditional: bool = True

    @property
    def use_traditional(self) -> bool:
        """The script fix applies only when the target is Traditional Chinese."""
        return self.traditional and self.target_lang == "zho_Hant"

    @property
    def by_windows(self) -> bool:
        """Translate windows with the chat model, else sentences with a named translator."""
        return self.translator == fv.WINDOW_TRANSLATOR

    @property
    def max_body_bytes(self) -> int:
        return self.max_body_mb * 1024 * 1024

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> "Config":
        base = cls()
        return cls(
            model=env.get("SUMMARIZE_MODEL", base.model),
            translator=env.get("TRANSLATOR", base.translator),
            target_lang=env.get("TARGET_LANG", base.target_lang),
            src_lang=env.get("SRC_LANG", base.src_lang),
            max_chunk_chars=_whole_number(env.get("MAX_CHUNK_CHARS"), base.max_chunk_chars),
            max_body_mb=_whole_number(env.get("MAX_BODY_MB"), base.max_body_mb),
            ocr=env.get("DISABLE_OCR") != "1",
            traditional=env.get("DISABLE_OPENCC") != "1",
        )


def check_features(features: str) -> str:
    """A request must ask for something."""
    if not any(part.strip() for part in features.split(",")):
        raise ValueError("choose at least one of: " + fv.FEATURES)
    return features


def check_steps(summary: bool, translate: bool) -> None:
    """The command-line variant has nothing to do with both steps off."""
    if not (summary or translate):
        raise ValueError("summary and translation cannot both be switched off")
