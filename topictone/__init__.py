"""topictone: topic-aware comment polarity on Spark.

Comments are scored by a distributed text classifier, averaged into a
baseline per topic, and shifted toward their topic's leaning; everything is
DataFrame, Spark ML and Structured Streaming operations.
"""

from .config import (DEFAULT_TOPIC, LABELS_EN, LABELS_ZH, REPLY_LABELS, JoinConfig,
                     Labels, TokenConfig, TopicConfig)
from .plans.topic_analysis import TopicAnalysis, analyze_topics

__all__ = ["DEFAULT_TOPIC", "LABELS_EN", "LABELS_ZH", "REPLY_LABELS", "JoinConfig", "Labels",
           "TokenConfig", "TopicConfig", "TopicAnalysis", "analyze_topics"]
