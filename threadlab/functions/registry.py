"""Topics, candidate labels and the fine-to-coarse label map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Labels, topics and their mapping, as the analysis defines them.
COARSE_LABELS = ("spreads misinformation", "corrects misinformation",
                 "provides neutral or unrelated commentary")
FINE_LABELS = {
    "environment": ("outrage", "endorse", "skepticism", "fact-check", "off-topic", "meta"),
    "health": ("disbelief", "insistence", "clarification", "skepticism", "political", "meta"),
    "immigration": ("criminal", "insistence", "clarification", "photoshop", "political", "meta"),
}
LABEL_MAP = {
    "spreads misinformation": "belief",
    "outrage": "belief",
    "endorse": "belief",
    "disbelief": "belief",
    "insistence": "belief",
    "criminal": "belief",
    "corrects misinformation": "fact-check",
    "provides neutral or unrelated commentary": "other",
    "fact-check": "fact-check",
    "skepticism": "fact-check",
    "clarification": "fact-check",
    "photoshop": "fact-check",
    "off-topic": "other",
    "meta": "other",
}
DEFAULT_LABEL = "other"
CLASSES = ("belief", "fact-check", "other")
DEFAULT_TOPICS = ("environment", "health", "immigration")


@dataclass(frozen=True)
class Topic:
    """One topic: its inputs and how its comments are labelled."""

    name: str
    posts_csv: str | None = None
    labels: Sequence[str] = COARSE_LABELS
    scorer: str = "lexicon"
    label_map: Mapping[str, str] = field(default_factory=lambda: dict(LABEL_MAP))


def topics_frame(spark: SparkSession, topics: Sequence[Topic]) -> DataFrame:
    """The registry as a table, so that topic is a column and one job serves all topics."""
    rows = [(t.name, t.posts_csv, list(t.labels), t.scorer) for t in topics]
    return spark.createDataFrame(
        rows, "topic string, posts_csv string, label_set array<string>, scorer string"
    )
