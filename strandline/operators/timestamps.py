"""Mixed timestamp notations and time zones to one UTC instant.

Every value is matched against a closed list of notations. Most notations leave one reading; these leave several:

* ``numeric``: a date such as ``09/01/2015``, day or month first;
* ``number``: a count since 1970, in seconds, milliseconds, microseconds or nanoseconds;
* ``zone:X``: a zone abbreviation that several regions use, such as ``IST``.

Per source the shares of the readings are estimated by expectation-maximisation (:func:`mixture`): each value
contributes its likelihood under every valid reading, a value with one valid reading counts for it alone. The posterior
chooses the reading; a value whose best posterior stays below ``min_posterior`` is reported as ``ambiguous`` with no
instant. What a source states about itself is a prior worth two values, so the values decide where they say anything.

ISO notations, the mass of the values, are parsed in the JVM; only the others go to Python, in Arrow batches.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import broadcast_if_small, cut

# Usual fixed offsets of zone abbreviations.
ZONE_OFFSETS = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00",
    "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00", "EAT": "+03:00", "CAT": "+02:00",
    "SAST": "+02:00", "WAT": "+01:00", "IST": "+05:30", "NPT": "+05:45", "PKT": "+05:00", "SGT": "+08:00", "HKT": "+08:00",
    "AWST": "+08:00", "JST": "+09:00", "KST": "+09:00", "ACST": "+09:30", "ACDT": "+10:30", "AEST": "+10:00", "AEDT": "+11:00",
    "NZST": "+12:00", "NZDT": "+13:00", "CHAST": "+12:45", "CHADT": "+13:45", "NST": "-03:30", "NDT": "-02:30", "AST": "-04:00",
    "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00",
    "PST": "-08:00", "PDT": "-07:00", "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00", "BRT": "-03:00", "ART": "-03:00",
}
# Abbreviations of several regions, with the offsets that are less usual.
SHARED_ZONES = {"AST": ["+03:00"], "BST": ["+06:00"], "CST": ["+08:00"], "EST": ["+10:00"], "IST": ["+01:00", "+02:00"]}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_ZONE = r"([Zz]|[+-]\d\d:?\d\d|\[[A-Za-z]+(?:/[A-Za-z_+-]+)*\]|[A-Z]{1,5})"
ISO = r"^(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d)(?::(\d\d))?(?:[.,](\d+))? ?" + _ZONE + r"?$"
DAY = r"^(\d{4})(?:-(?=\d\d-)|(?=\d{4}$))(\d\d)-?(\d\d)$"
NUMBER = r"^-?\d{1,20}$"
PDF = r"^D:(\d{4})(\d\d)(\d\d)(?:(\d\d)(\d\d)(\d\d)?)?(Z|[+-]\d\d)?(?:'?(\d\d)'?)?$"
RFC = r"^(?:[A-Za-z]{3,9},? )?(\d{1,2})[ -]([A-Za-z]{3,9})\.?[ -](\d{4})(?: (\d\d:\d\d)(:\d\d)? ?" + _ZONE + r"?)?$"
CTIME = r"^[A-Za-z]{3} ([A-Za-z]{3}) +(\d{1,2}) (\d\d:\d\d:\d\d)(?: ([A-Z]{1,5}))? (\d{4})$"
NUMERIC = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})(?:,? +(\d{1,2}):(\d\d)(?::(\d\d))?(?: ?([AaPp])\.?[Mm]\.?)?(?: ?" + _ZONE + r")?)?$"


_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_ISO, _DAY, _NUMBER, _PDF, _RFC, _CTIME, _NUMERIC = map(re.compile, (ISO, DAY, NUMBER, PDF, RFC, CTIME, NUMERIC))
_MONTH_NO = {m: i + 1 for i, m in enumerate(MONTHS)}
_OFFSETS = {k: timezone(timedelta(minutes=(-1 if v[0] == "-" else 1) * (int(v[1:3]) * 60 + int(v[4:])))) for k, v in ZONE_OFFSETS.items()}


@lru_cache(maxsize=4096)
def _zone(raw: str):
    """The zone written as ``raw``; an unknown one raises."""
    if raw[0] in "+-":
        digits = raw[1:].replace(":", "")
        hours, minutes = int(digits[:2]), int(digits[2:] or 0)
        if minutes > 59:
            raise ValueError(raw)
        return timezone(timedelta(minutes=(-1 if raw[0] == "-" else 1) * (hours * 60 + minutes)))
    if raw[0] == "[" or "/" in raw:
        return ZoneInfo(raw.strip("[]"))
    return _OFFSETS[raw.upper()]


def _micros(zone, home, year, month, day, clock=None, fraction=None) -> int | None:
    """Microseconds since 1970 UTC; a date alone is midnight UTC, a clock without any zone is none.

    ``fold=0`` takes the earlier instant of a repeated local time and moves a skipped one forward by the gap.
    """
    if clock is None:
        at = datetime(int(year), int(month), int(day), tzinfo=UTC)
    else:
        zone = zone or home
        if not zone:
            return None
        hour, minute, second = clock
        at = datetime(int(year), int(month), int(day), int(hour), int(minute), int(second or 0), tzinfo=_zone(zone))
    gap = at - _EPOCH if at.tzinfo is UTC else at.replace(tzinfo=None) - at.utcoffset() - _EPOCH.replace(tzinfo=None)
    return (gap.days * 86_400 + gap.seconds) * 1_000_000 + (int(fraction[:6].ljust(6, "0")) if fraction else 0)


def readings(value: str | None, home: str | None) -> tuple[str | None, int | None, int | None]:
    """``(kind, first, second)``: the notation of a value and the instant of each of its readings.

    ``kind`` is None where no notation accepts the value. A ``numeric`` date has a day-first and a month-first
    reading; every other notation has one. An impossible date, clock or zone gives a reading of None.
    """
    if value is None:
        return None, None, None
    v = " ".join(value.split())

    def read(*parts, **more):
        try:
            return _micros(*parts, **more)
        except (ValueError, KeyError, OverflowError, OSError, ZoneInfoNotFoundError):
            return None

    if m := _ISO.match(v):
        return "iso", read(m[8], home, m[1], m[2], m[3], (m[4], m[5], m[6]), m[7]), None
    if m := _DAY.match(v):
        return "day", read(None, home, m[1], m[2], m[3]), None
    if _NUMBER.match(v):
        digits = v.lstrip("-").lstrip("0")
        if not digits:
            return "epoch", None, None
        n, size = int(v), len(digits)
        return "epoch", n * 1_000_000 if size <= 11 else n * 1_000 if size <= 14 else n if size <= 17 else n // 1_000, None
    if m := _NUMERIC.match(v):
        clock = None
        if m[5]:
            hour = int(m[5])
            if m[8]:
                if not 1 <= hour <= 12:
                    return "numeric", None, None
                hour = hour % 12 + (12 if m[8] in "Pp" else 0)
            clock = (hour, m[6], m[7])
        return "numeric", read(m[9], home, m[4], m[3], m[1], clock), read(m[9], home, m[4], m[1], m[3], clock)
    if m := _PDF.match(v):
        zone = m[7] and ("Z" if m[7] == "Z" else m[7] + (m[8] or ""))
        return "pdf", read(zone, home, m[1], m[2], m[3], m[4] and (m[4], m[5], m[6])), None
    if m := _RFC.match(v):
        month = _MONTH_NO.get(m[2][:3].lower(), 0)
        return "rfc", read(m[6], home, m[3], month, m[1], m[4] and (m[4][:2], m[4][3:], m[5] and m[5][1:])), None
    if m := _CTIME.match(v):
        return "ctime", read(m[4], home, m[5], _MONTH_NO.get(m[1].lower(), 0), m[2], m[3].split(":")), None
    return None, None, None


#: Shares of the readings before any value is seen, and how many values that is worth.
UNIT_PRIOR, STRENGTH = [0.25, 0.25, 0.25, 0.25], 2.0
USUAL_ZONE = 0.95
#: Likelihood of a count under a smaller unit than its size implies: the instant then lies within weeks of 1970.
NEAR_1970 = 1e-6
#: Share from which a source writes dates in an order at all.
LEAST_SHARE = 0.01
_UNITS = [1_000_000, 1_000, 1]
_TEXT_ZONE = re.compile(r"(?<![A-Z])(" + "|".join(sorted(SHARED_ZONES)) + r")(?: \d{4})?$")


def _implied_unit(digits: int) -> int:
    """The largest unit in which a count of so many digits lies before the year 2286: 0 seconds to 3 nanoseconds."""
    return 0 if digits <= 10 else 1 if digits <= 13 else 2 if digits <= 16 else 3


def alternatives(value: str | None, home: str | None) -> tuple[str | None, list[int | None], list[float]]:
    """``(group, instants, likelihoods)``: all readings of a value; ``group`` is ``one`` where only one is possible, None where no notation accepts it."""
    kind, first, second = readings(value, home)
    if kind is None:
        return None, [], []
    if kind == "numeric":
        return "numeric", [first, second], [float(first is not None), float(second is not None)]
    v = " ".join(value.split())
    if kind == "epoch":
        n = int(v)
        if not n:
            return None, [], []
        unit = _implied_unit(len(str(abs(n))))
        return "number", [n * u if i >= unit else None for i, u in enumerate(_UNITS)] + [n // 1_000], [0.0 if i < unit else 1.0 if i == unit else NEAR_1970 for i in range(4)]
    m = _TEXT_ZONE.search(v)
    if m and first is not None:
        usual = _OFFSETS[m[1]].utcoffset(None)
        others = [first + (usual - _zone(o).utcoffset(None)) // timedelta(microseconds=1) for o in SHARED_ZONES[m[1]]]
        return f"zone:{m[1]}", [first, *others], [1.0] * (1 + len(others))
    return "one", [first], [1.0]


def _readings_column():
    @F.pandas_udf("group string, at array<bigint>, likelihood array<double>")
    def parse(value: pd.Series, zone: pd.Series) -> pd.DataFrame:
        # values that the JVM has parsed come as null
        rows = [(None, None, None) if v is None else alternatives(v, z) for v, z in zip(value.tolist(), zone.tolist())]
        group, at, weight = zip(*rows) if rows else ((), (), ())
        return pd.DataFrame({"group": pd.Series(group, dtype=object), "at": pd.Series(at, dtype=object), "likelihood": pd.Series(weight, dtype=object)})

    return parse


def mixture(prior: list[float], seen: list[tuple[list[float], int]], rounds: int = 200) -> list[float]:
    """Shares of the readings of one source by expectation-maximisation.

    ``seen`` holds the likelihoods of a value under each reading and how many values have them. The prior counts as
    :data:`STRENGTH` virtual values.
    """
    share = list(prior)
    total = STRENGTH + sum(n for like, n in seen if any(like))
    for _ in range(rounds):
        new = [STRENGTH * p for p in prior]
        for like, n in seen:
            joint = [s * x for s, x in zip(share, like)]
            whole = sum(joint)
            if whole > 0:
                new = [a + n * j / whole for a, j in zip(new, joint)]
        new = [x / total for x in new]
        moved = max(abs(a - b) for a, b in zip(new, share))
        share = new
        if moved < 1e-12:
            break
    return share


def _em(prior_first: float, only_first: int, only_second: int, both: int, rounds: int = 200) -> float:
    """Share of the first of two readings from the values accepted by the first alone, the second alone and both."""
    return mixture([prior_first, 1 - prior_first], [([1.0, 0.0], only_first), ([0.0, 1.0], only_second), ([1.0, 1.0], both)], rounds)[0]


def prior_of(group: str, stated: str | None) -> list[float]:
    """Prior shares of a group; ``stated`` is the order in which the source says it writes dates."""
    if group == "numeric":
        p = {"dmy": 0.999, "mdy": 0.001}.get(stated or "", 0.5)
        return [p, 1 - p]
    if group == "number":
        return UNIT_PRIOR
    others = len(SHARED_ZONES[group.partition(":")[2]])
    return [USUAL_ZONE] + [(1 - USUAL_ZONE) / others] * others


def format_posteriors(counts: DataFrame) -> DataFrame:
    """EM per source and group over ``(source, stated, group, seen array<struct<likelihood array<double>, n bigint>>)``: adds ``shares``.

    The cost depends on the number of sources, not on the number of values.
    """

    def run(batches):
        for b in batches:
            rows = [(r["source"], r["group"], mixture(prior_of(r["group"], r["stated"]), [(x["likelihood"], x["n"]) for x in r["seen"]])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["source", "group", "shares"])

    return counts.select(F.col("source").cast("string").alias("source"), "stated", "group", "seen").mapInArrow(run, "source string, group string, shares array<double>")


def _evidence(base: DataFrame, value_col: str, source_col: str) -> DataFrame:
    """``source, group, likelihood, n``: how many values of a source have which likelihoods, counted in the JVM and combined map-side."""
    # every row meets one pattern; the others are for the rows that can have several readings or show an offset
    some = base.select(F.col(source_col).cast("string").alias("source"), F.trim(F.col(value_col)).alias("v")).where(F.col("v").rlike(r"^-?\d+$|^\d{1,2}[/.-]|[A-Z]{3,4}(?: \d{4})?$|[+-]\d\d:?\d\d$"))
    v, text, tail = F.col("v"), F.col("text"), F.right("v", F.lit(6))
    some = some.withColumn("text", F.regexp_extract(v, r"(?<![A-Z])([A-Z]{3,4})(?: \d{4})?$", 1))
    some = some.withColumn("written", F.when(tail.rlike(r"[+-]\d\d:?\d\d$"), F.concat(F.regexp_replace(tail, r"^[^+-]|\d\d$", ""), F.lit(":"), F.right("v", F.lit(2)))))
    some = some.withColumn("written", F.replace("written", F.lit("::"), F.lit(":")))
    some = some.withColumn("a", F.regexp_extract(v, NUMERIC, 1).try_cast("int")).withColumn("b", F.when(F.col("a").isNotNull(), F.regexp_extract(v, NUMERIC, 3).try_cast("int")))
    some = some.withColumn("digits", F.when(v.rlike(r"^-?\d{1,20}$") & ~v.rlike(r"^\d{8}$"), F.length(F.regexp_replace(v, "^-?0*", ""))))
    a, b, digits, written = (F.col(c) for c in ("a", "b", "digits", "written"))
    fits_first, fits_second = b.between(1, 12) & a.between(1, 31), a.between(1, 12) & b.between(1, 31)
    one = lambda group, *like: F.array(F.struct(F.lit(group).alias("group"), F.array(*[F.lit(x) if isinstance(x, float) else x.cast("double") for x in like]).alias("likelihood")))
    unit = F.when(digits <= 10, 0).when(digits <= 13, 1).when(digits <= 16, 2).otherwise(3)
    zones = F.array(
        *[
            F.when(text == name, F.struct(F.lit(f"zone:{name}").alias("group"), F.array(*[F.lit(1.0)] * (1 + len(others))).alias("likelihood"))).when(
                written.isin(ZONE_OFFSETS[name], *others), F.struct(F.lit(f"zone:{name}").alias("group"), F.array(*[(written == o).cast("double") for o in (ZONE_OFFSETS[name], *others)]).alias("likelihood"))
            )
            for name, others in SHARED_ZONES.items()
        ]
    )
    shared = text.isin(*SHARED_ZONES) | written.isin(*{o for name, others in SHARED_ZONES.items() for o in (ZONE_OFFSETS[name], *others)})
    found = (
        F.when(a.isNotNull(), F.when((a != b) & (fits_first | fits_second), one("numeric", F.coalesce(fits_first, F.lit(False)), F.coalesce(fits_second, F.lit(False)))))
        .when(digits > 0, one("number", *[F.when(unit > i, 0.0).when(unit == i, 1.0).otherwise(NEAR_1970) for i in range(4)]))
        .when(shared, F.filter(zones, lambda z: z.isNotNull()))
    )
    cells = some.select("source", F.explode(found).alias("e"))
    return cells.groupBy("source", "e.group", "e.likelihood").agg(F.count("*").alias("n"))


def _known_zones():
    """A column function: the zone where it is a region that can be computed with, else null."""

    def known(z):
        try:
            return z if z and ZoneInfo(z) is not None else None
        except (ValueError, OSError, ZoneInfoNotFoundError):
            return None

    @F.pandas_udf("string")
    def run(zone: pd.Series) -> pd.Series:
        return pd.Series([known(z) for z in zone.tolist()], dtype=object)

    return run


# ISO notations as the JVM reads them; values outside this pattern go to Python
_JVM_ISO = r"^(?!0000)\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?(?: ?(?:Z|[+-](?:0\d|1[0-7]):?[0-5]\d))?)?$"


def _with_iso(df: DataFrame, v: Column, zone: Column) -> DataFrame:
    """Adds ``__iso``, whether the JVM reads ``v``, and ``__at``, its instant in microseconds: null for an impossible date or clock.

    Each step is a column of its own, so that no pattern is matched twice.
    """
    micros = lambda ntz: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ntz)
    df = df.withColumn("__v", v).withColumn("__iso", F.coalesce(F.col("__v").rlike(_JVM_ISO), F.lit(False)))
    # an offset or Z stands behind the clock, which ends at the 16th character or later
    df = df.withColumn("__off", F.when(F.col("__iso") & (F.length("__v") > 16), F.regexp_extract(F.substring("__v", 17, 99), r"Z$|[+-]\d\d:?\d\d$", 0)).otherwise(""))
    off, text = F.col("__off"), F.col("__v")
    zoned, day = off != "", F.length(text) == 10
    ahead = F.when(off == "Z", 0).otherwise((F.substring(off, 2, 2).try_cast("int") * 3600 + F.right(off, F.lit(2)).try_cast("int") * 60) * F.when(F.left(off, F.lit(1)) == "-", -1).otherwise(1)).cast("bigint") * 1_000_000
    df = df.withColumn("__wall", F.when(F.col("__iso"), F.rtrim(F.left(text, F.length(text) - F.length(off))).try_cast("timestamp_ntz")))
    wall = F.col("__wall")
    return df.withColumn("__at", F.when(day, micros(wall)).when(zoned, micros(wall) - ahead).when(zone.isNotNull(), micros(F.convert_timezone(zone, F.lit("UTC"), wall))))


def normalise(df: DataFrame, value_col: str, source_col: str, teams: DataFrame, min_posterior: float = 0.9, sources_from: DataFrame | None = None) -> DataFrame:
    """Adds ``utc_us`` (bigint) and ``status`` (``ok``, ``ambiguous``, ``unusable``) to every row of ``df``.

    ``teams`` has ``team, zone_id, date_order`` (one row per source). Its ``date_order`` is what the source states
    about itself: a prior worth two values (:data:`STRENGTH`), overruled by values that can be read one way only; a
    source without one starts at one half. Null, empty, blank and unknown texts are ``unusable``. A local time of a
    source without a known zone is ``unusable`` as well: it denotes no instant. Rows are neither dropped nor
    multiplied (``teams`` is reduced to one row per team first); an empty table gives an empty table; columns of
    ``df`` with the helper names keep their values. Two passes: the first only counts values with several readings
    per source (map-side combined, in the JVM), the second is a narrow projection.
    """
    homes = teams.where(F.col("team").isNotNull()).groupBy(F.col("team").alias("__team")).agg(F.min("zone_id").alias("__zone"), F.min(F.lower("date_order")).alias("__order"))
    homes = broadcast_if_small(cut(homes.select("__team", _known_zones()("__zone").alias("__zone"), "__order")))
    counts = _evidence(df if sources_from is None else sources_from, value_col, source_col)
    counts = counts.groupBy("source", "group").agg(F.collect_list(F.struct("likelihood", "n")).alias("seen"))  # a handful of likelihoods each
    counts = counts.join(homes.select(F.col("__team").alias("source"), F.col("__order").alias("stated")), "source", "left")
    shares = format_posteriors(counts).groupBy(F.col("source").alias("__source")).agg(F.map_from_entries(F.collect_list(F.struct("group", "shares"))).alias("__shares"))
    shares = broadcast_if_small(cut(shares))
    out = df.join(homes, F.col(source_col).cast("string") == F.col("__team"), "left").join(shares, F.col(source_col).cast("string").eqNullSafe(F.col("__source")), "left")
    out = _with_iso(out, F.trim(F.col(value_col)), F.col("__zone"))
    out = out.withColumn("__r", _readings_column()(F.when(~F.col("__iso"), F.col(value_col)), F.col("__zone")))
    group, instants = F.col("__r.group"), F.col("__r.at")
    by_default = F.coalesce(*[F.when(group == g, F.array(*map(F.lit, prior_of(g, None)))) for g in ("numeric", "number", *[f"zone:{z}" for z in SHARED_ZONES])])
    share = F.coalesce(F.try_element_at("__shares", group), F.when((group == "numeric") & F.col("__order").isin("dmy", "mdy"), F.when(F.col("__order") == "dmy", F.array(F.lit(0.999), F.lit(0.001))).otherwise(F.array(F.lit(0.001), F.lit(0.999)))), by_default)
    joint = F.zip_with(F.col("__r.likelihood"), share, lambda like, s: like * s)
    out = out.withColumn("__joint", F.when(group != "one", joint)).withColumn("__share", F.when(group != "one", share))
    valid = F.filter(instants, lambda x: x.isNotNull())
    best = F.array_position("__joint", F.array_max("__joint")).cast("int") - 1
    total = F.aggregate("__joint", F.lit(0.0), lambda s, x: s + x)
    same = F.size(F.array_distinct(valid)) == 1
    several = (group != "one") & ~same & (F.size(valid) > 1)
    unsure = F.coalesce(several & (F.array_max("__joint") < min_posterior * total), F.lit(False))
    # the only reading of a date in digits counts only where the source writes dates in that order
    utc = (
        F.when(F.col("__iso"), F.col("__at"))
        .when(group == "one", F.get(instants, F.lit(0)))
        .when(unsure, F.lit(None))
        .when(same & (F.size(valid) > 1), F.get(valid, F.lit(0)))
        .when(several, F.get(instants, best))
        .when(same, F.when((group != "numeric") | (F.get("__share", best) > LEAST_SHARE), F.get(instants, best)))
    )
    out = out.withColumn("utc_us", utc.cast("bigint"))
    status = F.when(F.col("utc_us").isNotNull(), "ok").when(unsure, "ambiguous").otherwise("unusable")
    return out.withColumn("status", status).select(*[F.col(c) for c in df.columns if c not in ("utc_us", "status")], "utc_us", "status")


def found_instants(notices: DataFrame, cdr: DataFrame, teams: DataFrame) -> DataFrame:
    """p6: ``field_name, row_no, utc_us`` of every usable value of the three fields; a team's values of all fields make one mixture."""
    n = notices.select(F.lit("timestamp").alias("field_name"), F.col("delivery_no").alias("row_no"), "team", F.col("timestamp").alias("v"))
    both = F.create_map(F.lit("CreationDate"), F.col("extracted_metadata.CreationDate"), F.lit("ModDate"), F.col("extracted_metadata.ModDate"))
    c = cdr.select(F.explode(both).alias("field_name", "v"), F.col("rec_no").alias("row_no"), "team")
    return normalise(n.unionByName(c), "v", "team", teams).where(F.col("utc_us").isNotNull()).select("field_name", "row_no", "utc_us")
