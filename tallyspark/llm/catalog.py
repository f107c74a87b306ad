"""Imports every query module of this subpackage."""

from . import q_align, q_chat, q_divergence, q_extract, q_iblt, q_langid, q_linecrf, q_linedup, q_mixing, q_packing, q_pq, q_setsketch, q_toxicity  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
