"""Filters, ordering and pages of hotspots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Named regions, (state codes in the place, box of south, north, west, east).
REGIONS: dict[str, tuple[tuple[str, ...], tuple[float, float, float, float] | None]] = {
    "california": (("CA",), (32.0, 42.0, -125.0, -114.0)),
    "gulf_industrial": (("TX", "LA"), (25.0, 31.0, -98.0, -88.0)),
    "pacific_nw": (("OR", "WA"), None),
    "hawaii": (("HI",), (18.0, 23.0, -161.0, -154.0)),
}


@dataclass(frozen=True)
class HotspotFilter:
    risk_level: str | None = None
    source_type: str | None = None
    min_frp: float | None = None
    confidence: str | None = None  # equal to, not at least
    is_anomaly: bool | None = None
    cluster_id: str | None = None
    text: str | None = None
    region: str | None = None
    fold_case: bool = False  # compare levels, sources and confidences without regard to case

    def apply(self, rows: DataFrame) -> DataFrame:
        """All given conditions. Each is a plain predicate, so those on stored columns reach the Parquet scan."""
        tests: list[Column] = [F.col(c) == v for c in ("is_anomaly", "cluster_id") if (v := getattr(self, c)) is not None]
        folded = [(c, v) for c in ("risk_level", "source_type", "confidence") if (v := getattr(self, c)) is not None]
        tests += [F.lower(c) == v.lower() if self.fold_case else F.col(c) == v for c, v in folded]
        if self.min_frp is not None:
            tests.append(F.col("frp") >= self.min_frp)
        if self.text:
            tests.append(text_match(self.text))
        if self.region:
            tests.append(in_region(self.region))
        for t in tests:
            rows = rows.where(t)
        return rows


def text_match(query: str) -> Column:
    """Case-insensitive substring of id, place or cluster."""
    q = query.strip().lower()
    hits = [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q)), F.lit(False)) for c in ("id", "nearest_place", "cluster_id")]
    return hits[0] | hits[1] | hits[2]


def in_region(name: str) -> Column:
    codes, box = REGIONS[name]
    test = F.lit(False)
    for code in codes:
        test = test | F.coalesce(F.contains(F.col("nearest_place"), F.lit(code)), F.lit(False))
    if box:
        test = test | (F.col("latitude").between(*box[:2]) & F.col("longitude").between(*box[2:]))
    return test


def page(rows: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """A page by frp, date and time, all descending, and id: a top-k plan, not a full sort."""
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("page numbers start at 1 and a page has 1 to 500 rows")
    return rows.orderBy(F.desc("frp"), F.desc("acq_date"), F.desc("acq_time"), "id").offset((number - 1) * size).limit(size)


FEED_ORDERS = {"risk": ("risk_score",), "frp": ("frp",), "time": ("acq_date", "acq_time")}


def feed(rows: DataFrame, by: str = "risk", limit: int | None = None) -> DataFrame:
    """The client's list: by risk, frp or time, descending, ties by id."""
    ordered = rows.orderBy(*(F.desc(c) for c in FEED_ORDERS[by]), "id")
    return ordered.limit(limit) if limit else ordered
