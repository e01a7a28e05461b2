from .common import ModelSpec, Outcome
from .registry import MODELS, Candidates, fit_predict

__all__ = ["ModelSpec", "Outcome", "MODELS", "Candidates", "fit_predict"]
