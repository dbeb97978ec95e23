"""The configuration file: sections, their keys and defaults, and the rules between them."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

# The names of sections and keys, here and in the classes below, and all their defaults.
MAX_GAP_LENGTH = 500_000


def _section(kind: type, name: str, entry: Any, **given: Any) -> Any:
    """An instance of a dataclass from a table: unknown and missing keys are errors, values get the type of their default."""
    if not isinstance(entry, dict):
        raise ValueError(f"[{name}] must be a table")
    known = {f.name: f for f in fields(kind)}
    if extra := entry.keys() - known.keys():
        raise ValueError(f"[{name}] has unknown keys: {', '.join(sorted(extra))}")
    values = dict(given)
    for key, value in entry.items():
        wanted = known[key].metadata.get("as")
        values[key] = wanted(value) if wanted and value is not None else value
    lacking = [n for n, f in known.items() if f.metadata.get("need") and n not in values]
    if lacking:
        raise ValueError(f"[{name}] lacks: {', '.join(lacking)}")
    return kind(**values)


def _need(of: type | None = None) -> Any:
    return field(default=None, metadata={"need": True, "as": of})


def _plain(default: Any, of: type | None = None) -> Any:
    return field(default=default, metadata={"as": of})


def _names(value: Any) -> list[str]:
    if not isinstance(value, list):
        raise ValueError("sources must be a list of source names")
    return [str(v) for v in value]


@dataclass
class Source:
    """A named view of a store: its path, filters and times."""

    path: str = _need(str)
    name: str = _need()
    include: str | None = None
    exclude: str | None = None
    samples: str | None = None
    regions: str | None = None
    targets: str | None = None
    sample_time: Any = None

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a source needs a name")


@dataclass
class AncestralState:
    path: str = _need(str)
    field: str | None = None
    is_reference: bool | None = None

    def __post_init__(self) -> None:
        if self.field is None and self.is_reference is None:
            raise ValueError("[ancestral_state] needs field or is_reference")
        if self.field is not None and self.is_reference:
            raise ValueError("[ancestral_state] takes field or is_reference, not both")


@dataclass
class AncestorsConfig:
    path: str = _need(str)
    sources: list[str] = _need(_names)
    name: str = "ancestors"
    max_gap_length: int = _plain(MAX_GAP_LENGTH, int)
    samples_chunk_size: int = _plain(100, int)
    variants_chunk_size: int = _plain(50_000, int)
    compressor: str = _plain("zstd", str)
    compression_level: int = _plain(7, int)


@dataclass
class MatchSourceConfig:
    node_flags: int = _plain(1, int)
    create_individuals: bool = _plain(True, bool)
    recombination: float | None = _plain(None, float)
    mismatch: float | None = _plain(None, float)


@dataclass
class MatchConfig:
    sources: dict[str, MatchSourceConfig] = _need()
    output: str = _need(str)
    path_compression: bool = _plain(False, bool)
    reference_ts: str | None = _plain(None, str)
    workdir: str | None = _plain(None, str)
    keep_intermediates: bool = _plain(False, bool)


@dataclass
class IndividualMetadataConfig:
    fields: dict[str, str] = field(default_factory=dict)
    population: str | None = None


@dataclass
class PostProcessConfig:
    split_ultimate: bool = _plain(True, bool)
    erase_flanks: bool = _plain(True, bool)


@dataclass
class AugmentSitesConfig:
    sources: list[str] = _need(_names)


@dataclass
class Config:
    """All sections; made from a file by ``from_toml``, or directly."""

    sources: dict[str, Source]
    ancestors: list[AncestorsConfig]
    match: MatchConfig
    ancestral_state: AncestralState
    individual_metadata: IndividualMetadataConfig | None = None
    post_process: PostProcessConfig | None = None
    augment_sites: AugmentSitesConfig | None = None

    def __post_init__(self) -> None:
        if not self.ancestors and self.match.reference_ts is None:
            raise ValueError("either [[ancestors]] or [match].reference_ts is needed")
        if self.match.keep_intermediates and self.match.workdir is None:
            raise ValueError("keep_intermediates needs workdir")
        for a in self.ancestors:
            if a.name not in self.match.sources:
                raise ValueError(f"[match.sources] lacks the ancestors '{a.name}'")

    @classmethod
    def from_toml(cls, path: str | Path) -> Config:
        with open(path, "rb") as f:
            return cls.from_dict(tomllib.load(f))

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> Config:
        sections = {"source", "ancestral_state", "ancestors", "match", "individual_metadata", "post_process", "augment_sites"}
        if extra := raw.keys() - sections:
            raise ValueError(f"unknown sections: {', '.join(sorted(extra))}")
        for name in ("match", "ancestral_state"):
            if name not in raw:
                raise ValueError(f"[{name}] is needed")
        sources: dict[str, Source] = {}
        for entry in raw.get("source", []):
            one = _section(Source, "source", entry)
            if one.name in sources:
                raise ValueError(f"two sources are named '{one.name}'")
            sources[one.name] = one
        found = raw.get("ancestors", [])
        if not isinstance(found, dict | list):
            raise ValueError("[ancestors] must be a table or an array of tables")
        ancestors = [_section(AncestorsConfig, "ancestors", e) for e in (found if isinstance(found, list) else [found])]
        entry = dict(raw["match"])
        each = entry.pop("sources", None)
        if not isinstance(each, dict):
            raise ValueError("[match.sources] must be a table")
        own = {n: _section(MatchSourceConfig, f"match.sources.{n}", v if isinstance(v, dict) else {}) for n, v in each.items()}
        match = _section(MatchConfig, "match", entry, sources=own)
        for a in ancestors:
            if a.name in sources:
                raise ValueError(f"the ancestors '{a.name}' have the name of a source")
            sources[a.name] = Source(a.path, a.name, sample_time="sample_time")
        optional = {"individual_metadata": IndividualMetadataConfig, "post_process": PostProcessConfig, "augment_sites": AugmentSitesConfig}
        more = {n: _section(kind, n, raw[n]) for n, kind in optional.items() if n in raw}
        return cls(sources, ancestors, match, _section(AncestralState, "ancestral_state", raw["ancestral_state"]), **more)

    def format(self) -> str:
        """All sections with all values, defaults included."""
        out: list[str] = []

        def put(title: str, value: Any) -> None:
            out.append(f"[{title}]")
            out.extend(f"  {f.name} = {getattr(value, f.name)}" for f in fields(value) if not isinstance(getattr(value, f.name), dict) or f.name == "fields")

        for n, s in self.sources.items():
            put(f"source.{n}", s)
        put("ancestral_state", self.ancestral_state)
        for a in self.ancestors:
            put(f"ancestors.{a.name}", a)
        put("match", self.match)
        for n, m in self.match.sources.items():
            put(f"match.sources.{n}", m)
        for title in ("individual_metadata", "post_process", "augment_sites"):
            if getattr(self, title) is not None:
                put(title, getattr(self, title))
        return "\n".join(out)

    def validate(self) -> list[str]:
        """What is wrong with the paths and names, as a list; outputs of the ancestors step needn't exist yet."""
        made = {a.name for a in self.ancestors}

        def missing(path: str) -> bool:
            return "://" not in str(path) and not Path(path).exists()

        wrong = [f"source '{n}': no such path: {s.path}" for n, s in self.sources.items() if n not in made and missing(s.path)]
        if missing(self.ancestral_state.path):
            wrong.append(f"ancestral_state: no such path: {self.ancestral_state.path}")
        if self.match.reference_ts is not None and missing(self.match.reference_ts):
            wrong.append(f"match: no such path: {self.match.reference_ts}")
        named = [(f"ancestors '{a.name}'", a.sources) for a in self.ancestors] + [("match", list(self.match.sources))]
        if self.augment_sites:
            named.append(("augment_sites", self.augment_sites.sources))
        return wrong + [f"{who}: no source is named '{n}'" for who, names in named for n in names if n not in self.sources]
