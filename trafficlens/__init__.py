"""trafficlens: packet tables to traffic features, verdicts and reports, on Spark."""

from trafficlens.settings import FeatureSettings, ModelSettings

__all__ = ["FeatureSettings", "ModelSettings"]
