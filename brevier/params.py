"""Parameters of the article and audience operators; every operator gets time as ``as_of``."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

# Fixed values of the domain.
TOPICS = ("world", "russia", "economy", "business", "technology", "science", "politics", "society", "sports", "culture")
SEGMENT_OF = {
    "economy": "economy", "business": "economy", "technology": "tech", "science": "tech", "world": "news",
    "russia": "news", "politics": "news", "society": "news", "sports": "lifestyle", "culture": "lifestyle",
}
PRICES = (199, 299, 399)
FREQUENCY_DAYS = {"DAILY": 1, "EVERY_2_DAYS": 2, "EVERY_3_DAYS": 3}
MAJOR_MEDIA = ("BBC", "CNN", "REUTERS", "NYTIMES", "DW", "RIA", "TASS", "RBK", "KOMMERSANT", "VEDOMOSTI")


@dataclass(frozen=True)
class Params:
    day: datetime = datetime(2024, 1, 8)
    as_of: datetime = datetime(2024, 1, 20)
    lease: timedelta = timedelta(minutes=30)
    maturity: timedelta = timedelta(minutes=15)
    batch_content: int = 24
    batch_embedding: int = 16
    batch_summary: int = 8
    similar_min: float = 0.40
    similar_top: int = 5
    neighbours: int = 100
    top_representatives: int = 12
    brief_limit: int = 7
    window_hours: int = 24


DEFAULT = Params()
