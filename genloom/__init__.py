"""Genealogy inference and corpus processing on Spark."""

from genloom.config import AncestorsConfig, AncestralState, AugmentSitesConfig, Config, IndividualMetadataConfig, MatchConfig, MatchSourceConfig, PostProcessConfig, Source

__all__ = [
    "AncestorsConfig",
    "AncestralState",
    "AugmentSitesConfig",
    "Config",
    "IndividualMetadataConfig",
    "InferenceSites",
    "MatchConfig",
    "MatchSourceConfig",
    "PostProcessConfig",
    "Source",
    "augment_sites",
    "infer_ancestors",
    "match",
    "post_process",
    "run",
]


def __getattr__(name: str) -> object:
    """The steps, which need Spark, when first asked for."""
    if name == "InferenceSites":
        from genloom.operators.sites import InferenceSites

        return InferenceSites
    if name in __all__:
        from genloom.plans import runner

        return getattr(runner, name)
    raise AttributeError(name)
