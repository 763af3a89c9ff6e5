"""Detectors: fit on in-distribution outputs, score any outputs."""

from driftlens.operators.detectors.base import BestBeam, Scorer, load_scorer, save_scorer
from driftlens.operators.detectors.depth import DataDepth
from driftlens.operators.detectors.forest import FunctionalIsolationForest
from driftlens.operators.detectors.gaussian import Mahalanobis, accumulate_gaussian, fit_gaussian, merge_gaussian
from driftlens.operators.detectors.projection import BeamRenyiProjection, CosineProjection, InformationProjection
from driftlens.operators.detectors.softmax import (
    MSP,
    Energy,
    FisherRao,
    RenyiDataFitted,
    RenyiNeg,
)

__all__ = [
    "MSP",
    "BeamRenyiProjection",
    "BestBeam",
    "CosineProjection",
    "DataDepth",
    "Energy",
    "FisherRao",
    "FunctionalIsolationForest",
    "InformationProjection",
    "Mahalanobis",
    "RenyiDataFitted",
    "RenyiNeg",
    "Scorer",
    "accumulate_gaussian",
    "fit_gaussian",
    "load_scorer",
    "merge_gaussian",
    "save_scorer",
]
