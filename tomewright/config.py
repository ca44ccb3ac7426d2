"""Options of a run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from tomewright import constants as K


@dataclass(frozen=True)
class KbConfig:
    """``ignore_patterns`` are added to the built-in ones; no extensions means all."""

    ignore_patterns: tuple[str, ...] = ()
    include_extensions: tuple[str, ...] = ()
    max_file_bytes: int = K.MAX_FILE_BYTES

    @classmethod
    def from_mapping(cls, options: Mapping | None) -> KbConfig:
        """Known options of a mapping; unknown or missing ones leave the defaults."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v
                      for k, v in (options or {}).items() if k in known and v is not None})

    @property
    def all_ignored(self) -> list[str]:
        return [*K.DEFAULT_IGNORE_PATTERNS, *self.ignore_patterns]
