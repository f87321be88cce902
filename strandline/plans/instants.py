"""The instants of p6 in SQL: every notation has one reading here, the date order being what the team states."""

from __future__ import annotations

from strandline.operators.timestamps import MONTHS, ZONE_OFFSETS

_ZONE = r"(Z|z|[+-]\d\d:?\d\d|\[[A-Za-z]+(?:/[A-Za-z_+-]+)*\]|[A-Z]{1,5})"
_KINDS = {
    "iso": r"^(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d)(?::(\d\d))?(?:[.,](\d+))? ?" + _ZONE + r"?$",
    "day": r"^(\d{4})-?(\d\d)-?(\d\d)$",
    "number": r"^-?\d{1,19}$",
    "numeric": r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?:,? +(\d{1,2}):(\d\d)(?::(\d\d))?(?: ?([AaPp])\.?[Mm]\.?)?(?: ?" + _ZONE + r")?)?$",
    "pdf": r"^D:(\d{4})(\d\d)(\d\d)(?:(\d\d)(\d\d)(\d\d)?)?(Z|[+-]\d\d)?(?:'?(\d\d)'?)?$",
    "rfc": r"^(?:[A-Za-z]{3,9},? )?(\d{1,2})[ -]([A-Za-z]{3,9})\.?[ -](\d{4})(?: (\d\d):(\d\d)(?::(\d\d))? ?" + _ZONE + r"?)?$",
    "ctime": r"^[A-Za-z]{3} ([A-Za-z]{3}) +(\d{1,2}) (\d\d):(\d\d):(\d\d)(?: ([A-Z]{1,5}))? (\d{4})$",
}
#: Where year, month, day, hour, minute, second, fraction and zone stand in each notation; 0 is nowhere.
_PLACES = {"iso": (1, 2, 3, 4, 5, 6, 7, 8), "day": (1, 2, 3, 0, 0, 0, 0, 0), "numeric": (3, 1, 2, 4, 5, 6, 0, 8), "pdf": (1, 2, 3, 4, 5, 6, 0, 7), "rfc": (3, 2, 1, 4, 5, 6, 0, 7), "ctime": (7, 1, 2, 3, 4, 5, 0, 6)}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def instants(values: str) -> str:
    """SQL of ``field_name, row_no, utc_us`` for the values that denote an instant; ``values`` is a query of ``field_name, row_no, team, v``."""
    kind = "CASE " + " ".join(f"WHEN regexp_matches(s, {_text(p)}) THEN '{k}'" for k, p in _KINDS.items()) + " END"
    extracts = []
    for i, name in enumerate(("y", "m", "d", "h", "mi", "sec", "frac", "zone")):
        # a pattern must be constant, so each notation is extracted by a branch of its own
        cases = " ".join(f"WHEN '{k}' THEN regexp_extract(s, {_text(_KINDS[k])}, {places[i]})" for k, places in _PLACES.items() if places[i])
        extracts.append(f"CASE kind {cases} ELSE '' END AS {name}")
    month = "CASE WHEN m = '' THEN NULL WHEN regexp_matches(m, '^\\d+$') THEN m::INT ELSE nullif(list_position([" + ", ".join(f"'{x}'" for x in MONTHS) + "], lower(left(m, 3))), 0) END"
    offsets = "CASE upper(z) " + " ".join(f"WHEN '{k}' THEN {(-1 if o[0] == '-' else 1) * (int(o[1:3]) * 60 + int(o[4:]))}" for k, o in ZONE_OFFSETS.items()) + " END"
    return f"""WITH t AS ({values}), s AS (SELECT field_name, row_no, t.team, trim(regexp_replace(v, '\\s+', ' ', 'g')) AS s FROM t WHERE v IS NOT NULL),
    home AS (SELECT team, min(zone_id) AS home, min(lower(date_order)) AS date_order FROM teams WHERE team IS NOT NULL GROUP BY team),
    k AS (SELECT *, {kind} AS kind FROM s LEFT JOIN home USING (team)),
    p AS (SELECT *, {", ".join(extracts)}, regexp_extract(s, {_text(_KINDS["numeric"])}, 7) AS half, regexp_extract(s, {_text(_KINDS["pdf"])}, 8) AS more FROM k WHERE kind IS NOT NULL),
    q AS (SELECT field_name, row_no, kind, s, home, frac, h <> '' AS clock, y::VARCHAR AS y, CASE WHEN kind = 'numeric' AND date_order = 'dmy' THEN d ELSE {month}::VARCHAR END AS m, CASE WHEN kind = 'numeric' AND date_order = 'dmy' THEN m ELSE d END AS d,
      CASE WHEN h = '' THEN 0 WHEN kind = 'numeric' AND half <> '' THEN CASE WHEN h::INT BETWEEN 1 AND 12 THEN h::INT % 12 + CASE WHEN lower(half) = 'p' THEN 12 ELSE 0 END END ELSE h::INT END AS h, coalesce(nullif(mi, ''), '0') AS mi, coalesce(nullif(sec, ''), '0') AS sec,
      CASE WHEN kind = 'pdf' AND zone NOT IN ('', 'Z') THEN zone || ':' || coalesce(nullif(more, ''), '00') ELSE zone END AS z FROM p),
    w AS (SELECT *, try_cast(printf('%s-%s-%s %s:%s:%s', y, lpad(m, 2, '0'), lpad(d, 2, '0'), lpad(h::VARCHAR, 2, '0'), mi, sec) AS TIMESTAMP) AS wall,
      CASE WHEN NOT clock THEN 0 WHEN z = '' THEN NULL WHEN regexp_matches(z, '^[+-]') THEN CASE WHEN left(z, 1) = '-' THEN -1 ELSE 1 END * (substr(z, 2, 2)::INT * 60 + right(z, 2)::INT) ELSE {offsets} END AS ahead,
      CASE WHEN clock AND z = '' THEN home WHEN clock AND z LIKE '[%' THEN trim(z, '[]') END AS region FROM q WHERE kind <> 'number'),
    r AS (SELECT *, timezone(region, wall) AS instant FROM w WHERE wall IS NOT NULL AND (ahead IS NOT NULL OR region IS NOT NULL)),
    i AS (SELECT field_name, row_no, CASE WHEN region IS NULL THEN epoch_us(wall) - ahead::BIGINT * 60000000 WHEN timezone(region, instant - INTERVAL 1 HOUR) = wall THEN epoch_us(instant) - 3600000000 ELSE epoch_us(instant) END + CASE WHEN frac = '' THEN 0 ELSE rpad(left(frac, 6), 6, '0')::BIGINT END AS utc_us FROM r
      UNION ALL SELECT field_name, row_no, CASE WHEN n <= 10 THEN v * 1000000 WHEN n <= 13 THEN v * 1000 WHEN n <= 16 THEN v ELSE v // 1000 END FROM (SELECT field_name, row_no, s::BIGINT AS v, length(ltrim(ltrim(s, '-'), '0')) AS n FROM q WHERE kind = 'number') WHERE n > 0)
    SELECT field_name, row_no, utc_us::BIGINT AS utc_us FROM i WHERE utc_us IS NOT NULL"""


P6 = instants(
    """SELECT 'timestamp' AS field_name, delivery_no AS row_no, team, "timestamp" AS v FROM notices UNION ALL SELECT 'CreationDate', rec_no, team, extracted_metadata.CreationDate FROM cdr
    UNION ALL SELECT 'ModDate', rec_no, team, extracted_metadata.ModDate FROM cdr"""
)
_COPIES = f"""SELECT delivery_no, count(*) OVER same AS copies, row_number() OVER (same ORDER BY delivery_no) AS nth FROM (SELECT n.delivery_no, lower(regexp_replace(n.document_id, '[-\\s\\x{{a0}}]+', '', 'g')) AS id, i.utc_us
    FROM notices n JOIN ({instants("""SELECT 'timestamp' AS field_name, delivery_no AS row_no, team, "timestamp" AS v FROM notices""")}) i ON i.row_no = n.delivery_no) WHERE id IS NOT NULL WINDOW same AS (PARTITION BY id, utc_us)"""
P4_FOUND = f"SELECT delivery_no FROM ({_COPIES}) WHERE nth > 1"
P4_KEPT = f"SELECT delivery_no, copies FROM ({_COPIES}) WHERE nth = 1"
