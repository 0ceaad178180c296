"""The phrase library: small YAML (or JSON) files written by hand."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import portable
from ..schemas import PHRASES
from .whole import read_whole


@dataclass(frozen=True)
class Phrase:
    id: str
    pattern: str
    regex: bool
    severity: int
    curricula: tuple[str, ...]
    guards: tuple[str, ...] = ()
    source_file: str = ""

    @property
    def source(self) -> str:
        """Regex source: literals escaped, blanks and word edges made explicit."""
        return portable(self.pattern if self.regex else re.escape(self.pattern))


@dataclass(frozen=True)
class Library:
    phrases: list[Phrase]
    sha256: str
    files: list[str] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (p.id, p.pattern, p.regex, p.severity, list(p.curricula), list(p.guards), p.source_file)
            for p in self.phrases
        ]
        return spark.createDataFrame(rows, PHRASES)


def _parse(name: str, text: str) -> dict:
    if not name.endswith(".yaml"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as exc:  # pragma: no cover - depends on the install
        raise RuntimeError("PyYAML is needed for .yaml phrase files; .json works without") from exc
    return yaml.safe_load(text)


def _phrase(raw: dict, file: str) -> Phrase:
    def fail(why: str):
        raise ValueError(f"phrase library {file}: {why} in {raw!r}")

    if not isinstance(raw.get("id"), str) or not raw["id"]:
        fail("id missing")
    if not isinstance(raw.get("pattern"), str) or not raw["pattern"]:
        fail("pattern missing")
    if raw.get("severity") not in (1, 2, 3):
        fail("severity must be 1, 2 or 3")
    if not raw.get("curricula"):
        fail("curricula must not be empty")
    return Phrase(
        raw["id"],
        raw["pattern"],
        bool(raw.get("regex", False)),
        raw["severity"],
        tuple(raw["curricula"]),
        tuple(raw.get("guards") or ()),
        file,
    )


def load_library(spark: SparkSession, folder: str, pattern: str = "*.{yaml,json}") -> Library:
    """Read all phrase files of a folder, on any store Spark reads, in name order; ids must be unique."""
    files = read_whole(spark, folder, pattern)
    phrases: dict[str, Phrase] = {}
    for name, text in files:
        for raw in _parse(name, text)["phrases"]:
            phrase = _phrase(raw, name)
            if phrase.id in phrases:
                raise ValueError(f"duplicate phrase id {phrase.id!r} in {name}")
            re.compile(phrase.source)
            phrases[phrase.id] = phrase
    joined = "\n---\n".join(text for _, text in files)
    return Library(list(phrases.values()), hashlib.sha256(joined.encode()).hexdigest(), [name for name, _ in files])


def load_phrases(spark: SparkSession, folder: str, pattern: str = "*.{yaml,json}") -> DataFrame:
    return load_library(spark, folder, pattern).table(spark)
