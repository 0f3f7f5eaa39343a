"""Column expressions (JVM-side): text cleaning, tokens, classes."""

from .labels import (absolute_confidence, absolute_id, argmax_index, binary_reply, label_of,
                     micro_units, positive_probability, quantise, three_way)
from .text import is_valid_text, null_to_empty, strip_col, tokens

__all__ = ["absolute_confidence", "absolute_id", "argmax_index", "binary_reply", "label_of",
           "micro_units", "positive_probability", "quantise", "three_way", "is_valid_text",
           "null_to_empty", "strip_col", "tokens"]
