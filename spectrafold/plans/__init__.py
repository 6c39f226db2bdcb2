"""Registered queries; importing the package fills the catalogue."""

from . import io, models, preprocessing, validation  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
