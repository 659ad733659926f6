"""SQL fragments shared by the oracle queries (DuckDB dialect).

``det`` numbers the events into frames and slots exactly as the detection
fixture does; ``bst`` / ``mt`` are the brute-force next-frame match used as
the reference for the spatial join.
"""

DET = """det as (
  select (dense_rank() over (order by h) - 1)::bigint as frame,
         (row_number() over (partition by h order by event_id) - 1)::bigint as slot, x, y
  from (select date_trunc('hour', ts) h, event_id, cast(user_id as double) x, value y from events))"""

BEST = """bst as (
  select a.frame, a.slot,
         arg_min(b.slot, (sqrt((a.x-b.x)**2 + (a.y-b.y)**2), b.slot)) nslot,
         min(sqrt((a.x-b.x)**2 + (a.y-b.y)**2)) dist
  from det a join det b on b.frame = a.frame + 1
  where sqrt((a.x-b.x)**2 + (a.y-b.y)**2) < 100 group by 1, 2)"""

MATCHED = """mt as (
  select d.frame, d.slot, d.x, d.y, m.nslot, b.x bx, b.y by_, m.dist
  from det d left join bst m using (frame, slot)
  left join det b on b.frame = d.frame + 1 and b.slot = m.nslot)"""

NFRAMES = "(select max(frame) + 1 from det)"

TRANSITIONS_POSITION = f"""with {DET}, {BEST}, {MATCHED},
o as (select frame, slot, coalesce(bx, 0.0) nx, coalesce(by_, 0.0) ny from mt)
select a.frame, a.slot, a.nx x, a.ny y, b.nx next_x, b.ny next_y
from o a join o b on b.frame = a.frame + 1 and b.slot = a.slot
where a.frame < {NFRAMES} - 5 and abs(b.nx - a.nx) <= 25 and abs(b.ny - a.ny) <= 25"""
