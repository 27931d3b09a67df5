"""DuckDB SQL for the mix of ``mixing``."""

from __future__ import annotations

from ledgerloom.llm.mixing import SCHEDULES, _pieces


def _time(demand: str, knots: tuple) -> str:
    found = "1.0"
    for start, length, low, high, before in reversed(_pieces(knots)):
        slope, end = (high - low) / length, before + length * (low + high) / 2
        rest = f"greatest({demand} - {before!r}, 0.0)"
        inside = f"2 * {rest} / ({low!r} + sqrt(greatest({low * low!r} + 2 * {slope!r} * {rest}, 0.0)))"
        found = f"CASE WHEN {demand} <= {end!r} THEN {start!r} + least({inside}, {length!r}) ELSE {found} END"
    return found


def _position(p: int) -> str:
    middle = f"((start + {p} * source_size + taken_{p} / 2.0) / nullif(target, 0.0))"
    cases = " ".join(f"WHEN place % {len(SCHEDULES)} = {i} THEN {_time(middle, k)}" for i, k in enumerate(SCHEDULES))
    return f"CASE WHEN taken_{p} > 0 THEN round(CASE {cases} END, 9) END AS position_{p + 1}"


#: Water-filling by trying each source, in order of cap per weight, as the first below its cap.
MIX = f"""
WITH base AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key, md5(coalesce(text, '')) AS digest,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes),
caps AS (SELECT *, [3.0, 1.0, 2.0][CAST(place % 3 + 1 AS INT)]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM placed),
tried AS (
  SELECT a.place, (1.5 * (SELECT sum(source_size) FROM caps)
      - coalesce(sum(b.cap) FILTER (WHERE b.cap / b.weight < a.cap / a.weight OR (b.cap / b.weight = a.cap / a.weight AND b.place < a.place)), 0))
    / sum(b.weight) FILTER (WHERE NOT (b.cap / b.weight < a.cap / a.weight OR (b.cap / b.weight = a.cap / a.weight AND b.place < a.place))) AS level,
    any_value(a.weight) AS weight, any_value(a.cap) AS cap
  FROM caps a, caps b GROUP BY a.place),
level AS (SELECT max(level) AS level FROM tried WHERE level * weight <= cap),
targets AS (SELECT source, source_size, place, round(least(cap, coalesce((SELECT level FROM level) * weight, cap)), 6) AS target FROM caps),
run AS (
  SELECT base.doc_id, size, source_size, target, place,
         coalesce(sum(size) OVER (PARTITION BY base.source ORDER BY key, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM base JOIN targets ON base.source IS NOT DISTINCT FROM targets.source),
chosen AS (
  SELECT *, {", ".join(f"CAST(least(size, greatest(0, floor(target + 0.5) - start - {p} * source_size)) AS BIGINT) AS taken_{p}" for p in (0, 1))}
  FROM run)
SELECT doc_id, size, source_size, target, taken_0 + taken_1 AS taken, {_position(0)}, {_position(1)} FROM chosen
"""
