"""Scalar function library; importing it fills the registry."""

from tidegraph.functions import lists, numeric, temporal, text
from tidegraph.functions.registry import FUNCTIONS, Registry

__all__ = ["FUNCTIONS", "Registry", "lists", "numeric", "temporal", "text"]
