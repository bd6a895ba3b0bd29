"""Small fixed dimension tables.

Each builder returns a local relation whose exact size Catalyst knows, so joins
against it are broadcast without a hint.
"""

from .personas import PERSONAS, personas
from .phrases import phrases, voices
from .scenes import scene_pools, scenes

__all__ = ["PERSONAS", "personas", "phrases", "voices", "scenes", "scene_pools"]
