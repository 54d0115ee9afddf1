"""Which columns and event types play which role in the engagement operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class EventBinding:
    """Column names of an event log and the event types behind each reader action."""

    id: str = "id"
    time: str = "created_at"
    type: str = "event_type"
    session: str = "session_id"
    user: str = "user_id"
    article: str = "article_id"
    title: str = "article_title"
    category: str = "category"
    duration: str = "duration_ms"
    metadata: str = "metadata"
    country: str = "country_code"
    os: str = "device_os"
    term_path: str = "$.term"
    roles: dict[str, str] = field(
        default_factory=lambda: {
            "open": "article_open",
            "read": "article_read",
            "like": "like",
            "save": "save",
            "comment": "comment",
            "share": "share",
            "search": "search",
            "app_open": "app_open",
        }
    )

    def is_role(self, role: str) -> Column:
        return F.col(self.type) == F.lit(self.roles[role])


def moment(df: DataFrame, column: str, at: datetime) -> Column:
    """A time literal of the column's own type, so comparisons stay pushable to the scan."""
    kind = df.schema[column].dataType
    literal = F.lit(at)
    return literal.cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else literal
