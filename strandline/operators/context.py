"""Time, season and place of mentions: finders and their alignment with sentences."""

from __future__ import annotations

import datetime as dt
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import broadcast_if_small

MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "|".join(MONTHS)
_UNIT = {"day": "D", "week": "W", "month": "M", "year": "Y"}
_NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
_TIME = re.compile(
    rf"\b(?:(?P<day>\d{{1,2}}) (?P<m1>{_MONTH}) (?P<y1>\d{{4}})|(?:[Bb]etween )?(?P<from>{_MONTH})(?: and |–|-)(?P<to>{_MONTH}) (?P<y4>\d{{4}})|(?P<m2>{_MONTH})(?:,? (?P<y2>\d{{4}}))?"
    rf"|(?P<iso>\d{{4}}-\d\d-\d\d)|(?P<side>(?:the )?(?:past|last|previous|next|following|coming)) (?:(?P<n>\d+|{'|'.join(_NUMBERS)}) )?(?P<unit>day|week|month|year)s?|(?P<y3>(?:19|20)\d\d))\b"
)


def _add_months(day: dt.date, months: int) -> dt.date:
    at = day.year * 12 + day.month - 1 + months
    year, month = divmod(at, 12)
    last = (dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(1)).day
    return dt.date(year, month + 1, min(day.day, last))


def time_interval(m: re.Match, dct: dt.date | None) -> tuple[dt.date, dt.date] | None:
    """Half-open interval of a time expression; None where it needs the document's date and there is none, or is impossible."""
    g = m.groupdict()
    try:
        if g["iso"]:
            day = dt.date.fromisoformat(g["iso"])
            return day, day + dt.timedelta(1)
        if g["day"]:
            day = dt.date(int(g["y1"]), MONTHS.index(g["m1"]) + 1, int(g["day"]))
            return day, day + dt.timedelta(1)
        if g["from"]:
            begin = dt.date(int(g["y4"]), MONTHS.index(g["from"]) + 1, 1)
            end = _add_months(dt.date(int(g["y4"]), MONTHS.index(g["to"]) + 1, 1), 1)
            return (begin, end) if begin < end else (_add_months(begin, -12), end)
        if g["m2"]:
            if not g["y2"] and dct is None:
                return None
            begin = dt.date(int(g["y2"] or dct.year), MONTHS.index(g["m2"]) + 1, 1)
            return begin, _add_months(begin, 1)
        if g["y3"]:
            return dt.date(int(g["y3"]), 1, 1), dt.date(int(g["y3"]) + 1, 1, 1)
        if dct is None:
            return None
        n = int(g["n"]) if (g["n"] or "").isdigit() else _NUMBERS.get(g["n"] or "one", 1)
        step = {"D": lambda k: dct + dt.timedelta(k), "W": lambda k: dct + dt.timedelta(7 * k), "M": lambda k: _add_months(dct, k), "Y": lambda k: _add_months(dct, 12 * k)}[_UNIT[g["unit"]]]
        other = step(-n if re.search("past|last|previous", g["side"]) else n)
        return min(dct, other), max(dct, other)
    except (ValueError, OverflowError):
        return None


def times(docs: DataFrame) -> DataFrame:
    """``doc_id, start, stop, text, begins, ends`` of the English time expressions of ``docs(doc_id, text, dct date)``.

    Expressions relative to the document's date have null limits where that is null. Null texts have none.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, dct in zip(*(c.to_pylist() for c in batch.columns)):
                for m in _TIME.finditer(text or ""):
                    span = time_interval(m, dct)
                    rows.append((doc, m.start(), m.end(), m[0], *(span or (None, None))))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.date32(), pa.date32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=["doc_id", "start", "stop", "text", "begins", "ends"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("dct").cast("date")).mapInArrow(run, "doc_id long, start int, stop int, text string, begins date, ends date")


def seasons(triggers: DataFrame, times: DataFrame, places: DataFrame, calendar: DataFrame, reach: int = 5) -> DataFrame:
    """Seasons with their interval: each trigger takes the nearest dated time and the nearest place with a known calendar.

    ``triggers(doc_id, sent_no, pos, season, shift)``, ``times(doc_id, sent_no, pos, begins)``, ``places(doc_id, sent_no,
    pos, place)``, ``calendar(place, season, first_month, last_month)``. Nearest is in the same sentence by distance, else
    in the sentence closest before, at most ``reach`` back (ties: the later mention). The interval lies in the year of the
    time and ends a year later if it wraps; ``shift`` moves it by months (early -1, late +1).
    """
    key = ["doc_id", "sent_no", "pos", "season"]

    def nearest(found: DataFrame, value: str) -> DataFrame:
        f = found.select("doc_id", F.col("sent_no").alias("__s"), F.col("pos").alias("__p"), value)
        # a sentence offers itself to the ``reach`` sentences behind it: an equality join instead of a range join
        offered = f.withColumn("sent_no", F.explode(F.sequence(F.col("__s"), F.col("__s") + reach)))
        order = Window.partitionBy(*key).orderBy(F.desc("__s"), F.when(F.col("__s") == F.col("sent_no"), F.abs(F.col("__p") - F.col("pos"))).otherwise(-F.col("__p")), F.desc("__p"))
        return triggers.join(offered, ["doc_id", "sent_no"]).withColumn("__r", F.row_number().over(order)).where("__r = 1").select(*key, value)

    dated = nearest(times.where("begins IS NOT NULL"), "begins")
    placed = nearest(places.join(broadcast_if_small(calendar.select("place").distinct()), "place", "left_semi"), "place")
    out = triggers.join(dated, key).join(placed, key).join(broadcast_if_small(calendar), ["place", "season"])
    year = F.year("begins")
    first = F.make_date(year, F.col("first_month"), F.lit(1))
    last = F.make_date(year + F.when(F.col("last_month") < F.col("first_month"), 1).otherwise(0), F.col("last_month"), F.lit(1))
    return out.select(*key, "place", F.add_months(first, F.col("shift")).alias("begins"), F.add_months(last, F.col("shift") + 1).alias("ends"))
