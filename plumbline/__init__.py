"""Spark-native exploratory data analysis."""

from plumbline.plans.analyze import analyze
from plumbline.session import InputError
from plumbline.settings import DEFAULTS, Settings
from plumbline.sources.tables import read_table

__all__ = ["analyze", "read_table", "Settings", "DEFAULTS", "InputError"]
