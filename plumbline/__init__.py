"""Plumbline: score predictions against labelled tables with Spark."""

from plumbline.plans.evaluate import Evaluation, evaluate, evaluate_many
from plumbline.plans.inputs import load_inputs, load_training_data
from plumbline.plans.silver import build_silver
from plumbline.registry import SECTORS
from plumbline.session import build_session
from plumbline.sources.tables import load_gold, load_silver

__all__ = [
    "Evaluation", "SECTORS", "build_session", "build_silver", "evaluate",
    "evaluate_many", "load_gold", "load_inputs", "load_silver", "load_training_data",
]
