"""Job options (defaults < config map < explicit arguments)."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any, Mapping

ENGINE_MODES = ("regex", "llm", "hybrid")


@dataclass(frozen=True)
class MaskOptions:
    lang: str = "en"
    engines: str = "hybrid"
    strict_validation: bool = True
    custom_literals: tuple[str, ...] = field(default_factory=tuple)
    auto_unmask: bool = False

    def __post_init__(self) -> None:
        if self.engines not in ENGINE_MODES:
            raise ValueError(f"engines must be one of {ENGINE_MODES}, got {self.engines!r}")
        object.__setattr__(self, "custom_literals", tuple(self.custom_literals or ()))

    @staticmethod
    def parse_literals(value: str | list[str] | tuple[str, ...] | None) -> tuple[str, ...]:
        """A comma string is split and trimmed, blanks dropped; lists are taken as given."""
        if value is None:
            return ()
        if isinstance(value, str):
            return tuple(p.strip() for p in value.split(",") if p.strip())
        return tuple(value)

    @classmethod
    def resolve(cls, config: Mapping[str, Any] | None = None, **explicit: Any) -> "MaskOptions":
        """Shallow merge: defaults, then ``config`` keys, then explicit arguments that are not None."""
        names = {f.name for f in fields(cls)}
        merged: dict[str, Any] = {}
        for source in (config or {}, explicit):
            for k, v in source.items():
                if k in names and v is not None:
                    merged[k] = v
        if "custom_literals" in merged:
            merged["custom_literals"] = cls.parse_literals(merged["custom_literals"])
        return replace(cls(), **merged)
