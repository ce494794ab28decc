"""Extension points and configuration; both are driver-side Python."""

from __future__ import annotations

import importlib
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from importlib.metadata import entry_points
from pathlib import Path
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame

GROUPS = {"detector": "spanforge.waste_detectors", "formatter": "spanforge.formatters", "middleware": "spanforge.middleware"}


@runtime_checkable
class WasteDetector(Protocol):
    name: str

    def detect(self, spans: DataFrame) -> DataFrame: ...


@runtime_checkable
class OutputFormatter(Protocol):
    name: str

    def format_result(self, result: dict) -> str: ...

    def format_comparison(self, results: list[dict]) -> str: ...


@runtime_checkable
class Middleware(Protocol):
    name: str

    def pre_process(self, spans: DataFrame) -> DataFrame: ...

    def post_process(self, results: DataFrame) -> DataFrame: ...


_PROTOCOLS: dict[str, type] = {"detector": WasteDetector, "formatter": OutputFormatter, "middleware": Middleware}


class Registry:
    """Detectors and middleware keep the first of a name, formatters the last."""

    def __init__(self) -> None:
        self.of: dict[str, dict[str, Any]] = {k: {} for k in _PROTOCOLS}

    def register(self, kind: str, plugin: Any) -> Any:
        if not isinstance(plugin, _PROTOCOLS[kind]):
            raise TypeError(f"{plugin!r} is no {kind}")
        if kind == "formatter":
            self.of[kind][plugin.name] = plugin
        else:
            self.of[kind].setdefault(plugin.name, plugin)
        return plugin

    def discover(self) -> int:
        found = 0
        for kind, group in GROUPS.items():
            for point in entry_points(group=group):
                made = point.load()
                self.register(kind, made() if isinstance(made, type) else made)
                found += 1
        return found

    def load(self, dotted: dict[str, list[str]]) -> None:
        for kind, names in dotted.items():
            for name in names:
                module, _, attribute = name.replace(":", ".").rpartition(".")
                made = getattr(importlib.import_module(module), attribute)
                self.register(kind, made() if isinstance(made, type) else made)

    def reset(self) -> None:
        for plugins in self.of.values():
            plugins.clear()

    # What the analysis calls.

    def before(self, spans: DataFrame) -> DataFrame:
        for m in self.of["middleware"].values():
            spans = m.pre_process(spans)
        return spans

    def after(self, results: DataFrame) -> DataFrame:
        for m in self.of["middleware"].values():
            results = m.post_process(results)
        return results

    def detected(self, labelled: DataFrame) -> list[DataFrame]:
        """What the detectors find; each must give the patterns' columns."""
        from spanforge.operators.patterns import COLUMNS

        out = []
        for d in self.of["detector"].values():
            found = d.detect(labelled)
            if missing := set(COLUMNS) - set(found.columns):
                raise TypeError(f"detector {d.name} lacks {', '.join(sorted(missing))}")
            out.append(found.select(*COLUMNS))
        return out

    def formatter(self, name: str) -> OutputFormatter | None:
        return self.of["formatter"].get(name)


REGISTRY = Registry()


def _decorator(kind: str) -> Callable[[type], type]:
    def apply(cls: type) -> type:
        REGISTRY.register(kind, cls())
        return cls

    return apply


waste_detector, output_formatter, middleware = _decorator("detector"), _decorator("formatter"), _decorator("middleware")


@dataclass(frozen=True)
class Config:
    similarity: float = 0.40
    confidence: float = 0.75
    restatement: float = 0.85
    prompt_similarity: float = 0.75
    weights: tuple[float, float, float] = (0.3, 0.4, 0.3)
    model: str | dict[str, float] = "sonnet"
    format: str = "text"
    plugins: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """The given file, or the first of the known names in the working or home folder; a bad file gives the defaults."""
        places = [Path(path)] if path else [d / n for d in (Path.cwd(), Path.home()) for n in ("spanforge.toml", ".spanforgerc")]
        for place in places:
            if place.is_file():
                try:
                    return cls.of(tomllib.loads(place.read_text()))
                except (tomllib.TOMLDecodeError, ValueError, TypeError):
                    return cls()
        return cls()

    @classmethod
    def of(cls, data: dict) -> Config:
        flat = dict(data.get("thresholds", {})) | dict(data.get("output", {}))
        out = replace(cls(), **{k: v for k, v in flat.items() if k in cls.__dataclass_fields__})
        if w := data.get("weights"):
            out = replace(out, weights=parse_weights(",".join(str(w[k]) for k in ("reasoning", "tool_use", "generation"))))
        return replace(out, plugins=dict(data.get("plugins", {})))

    def merge(self, **given: Any) -> Config:
        """Command-line values, where given, win."""
        return replace(self, **{k: v for k, v in given.items() if v is not None})


def parse_weights(text: str) -> tuple[float, float, float]:
    parts = tuple(float(x) for x in text.split(","))
    if len(parts) != 3 or abs(sum(parts) - 1) > 0.01:
        raise ValueError("three weights that add up to 1 are needed")
    return parts


def parse_cost_model(text: str) -> dict[str, float]:
    """A model's name, or four rates: input, output, cache read, cache write."""
    from spanforge.operators.economics import RATES

    if text.lower() in RATES:
        return dict(RATES[text.lower()])
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a model name or four rates are needed")
    return dict(zip(("input", "output", "cached_read", "cached_write"), parts, strict=True))
