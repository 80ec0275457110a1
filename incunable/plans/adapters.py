"""Text adapters by name, and the profiles that choose them. An adapter maps a column of texts to a column."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import pick_text, xml_safe

Adapter = Callable[[Column], Column]
DEFAULT_PROFILES = {"default_profile": "fast", "profiles": {"fast": {"backend": "placeholder", "source_lang": "en", "target_lang": "ru"}}}
_ADAPTERS: dict[str, Callable[[str], Adapter]] = {}


def register(name: str, make: Callable[[str], Adapter]) -> None:
    """make(model) gives the adapter."""
    _ADAPTERS[name] = make


#: Models that this worker has loaded, by loader and name.
_LOADED: dict = {}


def python_adapter(function: Callable, load: Callable[[str], object] | None = None) -> Callable[[str], Adapter]:
    """An adapter over Arrow batches from a function of one text; where that raises, the row's translation is null.

    With `load`, function(model, text) gets what load(name) gave; each worker loads a model once and keeps it.
    """

    def make(model: str) -> Adapter:
        @F.pandas_udf(T.StringType())
        def run(texts: pd.Series) -> pd.Series:
            if load:
                key = (load.__module__, load.__qualname__, model)
                if key not in _LOADED:
                    _LOADED[key] = load(model)

            def one(x):
                try:
                    return function(_LOADED[key], x) if load else function(x)
                except Exception:  # noqa: BLE001  one row's failure must not end the job
                    return None

            return texts.map(one)

        return run

    return make


class TextModel:
    """What a provider offers, on columns. A provider overrides what it can do; the rest raises."""

    def translate(self, text: Column) -> Column:
        raise NotImplementedError("translate")

    def analyze(self, text: Column) -> Column:
        raise NotImplementedError("analyze")

    def qa(self, source: Column, target: Column) -> Column:
        raise NotImplementedError("qa")

    def ocr(self, image: Column) -> Column:
        raise NotImplementedError("ocr")


class EchoModel(TextModel):
    """Texts as they are; a check compares them for equality."""

    def translate(self, text: Column) -> Column:
        return text

    def analyze(self, text: Column) -> Column:
        return text

    def qa(self, source: Column, target: Column) -> Column:
        return F.struct(semantic_score(source, target).alias("semantic_score"), F.array().cast("array<string>").alias("issues"))


def unavailable(name: str) -> Callable[[str], Adapter]:
    def make(model: str) -> Adapter:
        raise NotImplementedError(f"the adapter {name} needs a service that is not configured")

    return make


register("dummy", lambda model: lambda c: c)
register("local", lambda model: lambda c: c)
register("placeholder", lambda model: lambda c: xml_safe(c))
for _name in ("openai", "deepseek", "gemini", "hf", "ollama", "nllb"):
    register(_name, unavailable(_name))


def adapter(spec: str) -> tuple[Adapter, str]:
    """The adapter of provider:model and the model's name; an empty or unknown provider is the echoing one."""
    provider, _, model = (spec or "dummy:echo").partition(":")
    provider = provider.strip() or "dummy"
    if provider not in _ADAPTERS:
        return _ADAPTERS["dummy"]("echo"), "echo"
    return _ADAPTERS[provider](model.strip()), model.strip()


def placeholder_text(translated: str = "translated_text", normalized: str = "normalized_text", text: str = "text") -> Column:
    return xml_safe(pick_text(translated, normalized, text))


def semantic_score(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(a.eqNullSafe(b), 1.0).otherwise(0.5)


def profile(config: dict | None, mode: str | None) -> dict:
    """The profile of a mode: else the default profile, else `fast`, else the built-in one."""
    config = config or DEFAULT_PROFILES
    known = config.get("profiles") or {}
    for name in (mode, config.get("default_profile"), "fast"):
        if name in known:
            return {**DEFAULT_PROFILES["profiles"]["fast"], **known[name], "name": name}
    return {**DEFAULT_PROFILES["profiles"]["fast"], "name": "fast"}
