"""SQL of the founder path: blocks of any cuts, classes, the greedy assignment as a recursive query, and the founders' rows.

A recursion goes from block to block. Its row is the list of all founders' copies. Inside a block, a fold over the ranked pairs of classes hands
founders out: ``free`` has the copy in which each founder ends (-1: the reference, -2: handed out, or not taking part). A chromosome of one block has its largest
classes but the first, which stands for the reference there.
"""

from __future__ import annotations

from ..operators import walk

#: From a relation ``cuts`` (chrom, node) to classes; a block lies between neighbouring cuts.
BLOCKS = """
counted as (select chrom, count(*) as n from cuts group by 1),
blocks as (select * from (select e.*, (select count(*) from cuts c where c.chrom = e.chrom and c.node <= e.src) - 1 as block from edges e) x join counted using (chrom) where block >= 0 and block < n - 1),
sigs as (select c.chrom, b.block, c.copy, list_sort(list(distinct c.edge), 'DESC') as sig from carried c join blocks b on b.chrom = c.chrom and b.edge = c.edge group by 1, 2, 3),
every as (select chrom, unnest(range(n - 1)) as block from counted),
grid as (select g.chrom, g.block, c.copy, coalesce(s.sig, []::bigint[]) as sig from every g join copies c on c.chrom = g.chrom left join sigs s on s.chrom = g.chrom and s.block = g.block and s.copy = c.copy),
classes as materialized (select *, dense_rank() over (partition by chrom, block order by sig) - 1 as cls from grid),
history as (select c.chrom, c.block, c.cls, c.copy, coalesce((select list_sort(list(distinct d.edge), 'DESC') from carried d join blocks b on b.chrom = d.chrom and b.edge = d.edge where d.chrom = c.chrom and d.copy = c.copy and b.block < c.block), []::bigint[]) as h from classes c),
reps as materialized (select chrom, block, cls, arg_min(copy, {'h': h, 'c': copy})::bigint as copy from history group by 1, 2, 3)
"""

_STATE = ("free", "row_", "served", "missed", "rem", "res", "did", "stop")


def _state(**new: str) -> str:
    return "{" + ", ".join(f"'{k}': {new.get(k, 's.' + k)}" for k in _STATE) + "}"


def assignments(founders: int) -> str:
    """Relations up to ``assigned`` (chrom, block, founder, copy)."""
    f = founders
    spot = "coalesce(list_position(s.free, x.l), 0)"
    given = {
        "free": f"list_transform(range(1, {f + 1}), lambda j: case when j = {spot} then -2::bigint else s.free[j] end)",
        "row_": f"list_transform(range(1, {f + 1}), lambda j: case when j = {spot} then x.r else s.row_[j] end)",
    }
    served = "list_append(s.served, x.r)"
    fold = f"""case
      when x.k = 0 then {_state(stop="s.stop or (x.round >= 1 and s.rem = 0) or (x.round >= 2 and not s.did)", did="false")}
      when s.stop then {_state()}
      when list_contains(s.served, x.r) then case
        when s.rem > 0 and {spot} > 0 then {_state(**given, rem="s.rem - 1", did="true")}
        when s.rem = 0 and x.round > 0 then {_state(stop="true")}
        else {_state()} end
      when s.res > 0 then case
        when {spot} > 0 then {_state(**given, served=served, res="s.res - 1")}
        else {_state(missed="list_append(s.missed, x.r)", res="s.res - 1")} end
      else {_state()} end"""
    empty = "[]::bigint[]"
    start = f"{{'free': list_transform(c.row_, lambda y: coalesce(y, case when m.block = 1 then -2 else -1 end)::bigint), 'row_': list_transform(range({f}), lambda j: null::bigint), 'served': {empty}, 'missed': {empty}, 'rem': ({f} - least({f}, m.n_right))::bigint, 'res': least({f}, m.n_right)::bigint, 'did': false, 'stop': false}}"
    turns = f"flatten(list_transform(range({f + 3}), lambda i: list_concat([{{'round': i, 'k': 0::bigint, 'l': null::bigint, 'r': null::bigint}}], list_transform(m.pairs, lambda p: {{'round': i, 'k': 1::bigint, 'l': p.l, 'r': p.r}}))))"
    seen = "{'row_': list_append(a.row_, p.l), 'seen': a.seen, 'rem': a.rem - 1, 'res': a.res}"
    new = "{'row_': list_append(a.row_, p.l), 'seen': list_append(a.seen, p.l), 'rem': a.rem, 'res': a.res - 1}"
    same = "{'row_': a.row_, 'seen': a.seen, 'rem': a.rem, 'res': a.res}"
    return f"""
full_ as (select distinct b.chrom, b.block from (select chrom, edge from carried join (select chrom, count(*) as n from copies group by 1) using (chrom) group by 1, 2 having count(distinct copy) = any_value(n)) x join blocks b using (chrom, edge)),
about as (select c.chrom, c.block, max(c.cls) + 1 as n_right, max(c.block) over (partition by c.chrom) as last, any_value(p.block) is null as plain from classes c left join full_ p using (chrom, block) group by c.chrom, c.block),
joined as (select chrom, block, lhs, cls as rhs, count(*) as size from (select *, lag(cls) over (partition by chrom, copy order by block) as lhs from classes) where lhs is not null group by 1, 2, 3, 4),
moves as materialized (select a.chrom, a.block, b.n_right as n_left, a.n_right, coalesce(list({{'l': l.copy, 'r': r.copy}} order by j.size desc, j.rhs desc, j.lhs desc) filter (not (j.lhs = 0 and j.rhs = 0 and a.plain and b.plain)), []) as pairs
  from about a join about b on b.chrom = a.chrom and b.block = a.block - 1 join joined j on j.chrom = a.chrom and j.block = a.block
  join reps l on l.chrom = a.chrom and l.block = a.block - 1 and l.cls = j.lhs join reps r on r.chrom = a.chrom and r.block = a.block and r.cls = j.rhs group by all),
opened as (select chrom, pairs, list_reduce(pairs, lambda a, p: case when list_contains(a.seen, p.l) and a.rem > 0 then {seen} when not list_contains(a.seen, p.l) and a.res > 0 then {new} else {same} end,
  {{'row_': {empty}, 'seen': {empty}, 'rem': ({f} - least({f}, n_left))::bigint, 'res': least({f}, n_left)::bigint}}) as a from moves where block = 1),
firsts as (select chrom, list_resize(list_concat(a.row_, case when len(pairs) = 0 then {empty} else list_transform(range(a.rem), lambda i: pairs[i % len(pairs) + 1].l) end), {f}, null) as row_ from opened),
followed as (select chrom, 0::bigint as block, row_ from firsts union all
  select chrom, block, list_transform(range(1, {f + 1}), lambda j: case when s.free[j] = -2 then s.row_[j]
    when list_position(late, j) <= len(due) then due[list_position(late, j)] when len(pairs) > 0 then pairs[(list_position(late, j) - len(due) - 1) % len(pairs) + 1].r end)
  from (select *, list_filter(s.missed, lambda y, i: list_position(s.missed, y) = i and not list_contains(s.served, y)) as due,
      list_transform(list_sort(list_transform(list_filter(range(1, {f + 1}), lambda j: s.free[j] <> -2), lambda j: {{'n': (s.free[j] = -1)::int, 'c': s.free[j], 'j': j}})), lambda y: y.j) as late
    from (select m.chrom, m.block::bigint as block, m.pairs, list_reduce({turns}, lambda s, x: {fold}, {start}) as s from followed c join moves m on m.chrom = c.chrom and m.block = c.block + 1))),
lone as (select chrom, 0::bigint as block, list_resize(coalesce(list(copy order by size desc, cls desc)[1 : {f}], {empty}), {f}, null) as row_
  from (select c.chrom, c.cls, count(*) as size, any_value(r.copy) as copy from classes c join about a on a.chrom = c.chrom and a.block = c.block and a.last = 0 join reps r on r.chrom = c.chrom and r.block = c.block and r.cls = c.cls group by 1, 2) where cls > 0 group by 1),
assigned as (select chrom, block::int as block, unnest(range({f}))::int as founder, unnest(row_) as copy from (select * from followed union all select * from lone
  union all select chrom, 0, list_transform(range({f}), lambda j: null::bigint) from (select distinct chrom from about where last = 0) where chrom not in (select chrom from lone)))
"""


#: From ``assigned`` to text pieces of each founder; ``taken`` and ``pieces`` must be there.
ROWS = f"""
steps_ as (select a.chrom, a.founder, t.edge from taken t join blocks b on b.chrom = t.chrom and b.edge = t.edge join assigned a on a.chrom = t.chrom and a.block = b.block and a.copy = t.copy),
fown as (select t.chrom, t.founder, e.src, e.dst, e.label, s.aln_pos as aln, d.aln_pos - s.aln_pos as width, (d.bubble - 1) // {walk.BUBBLES} as chunk_no
  from steps_ t join edges e on e.chrom = t.chrom and e.edge = t.edge join aligned s on s.chrom = e.chrom and s.node = e.src join aligned d on d.chrom = e.chrom and d.node = e.dst),
fcovered as (select distinct chrom, founder, unnest(range(src + 1, dst + 1)) as node from fown),
fparts as (select p.chrom, c.founder, p.chunk_no, p.aln, p.width, p.text from pieces p join (select distinct chrom, founder from assigned) c on c.chrom = p.chrom anti join fcovered v on v.chrom = p.chrom and v.founder = c.founder and v.node = p.node
  union all select chrom, founder, chunk_no, aln, width, label from fown union all select chrom, -1, chunk_no, aln, width, text from pieces),
frows as (select chrom, founder, chunk_no, string_agg(text || repeat('-', (width - length(text))::int), '' order by aln, width) as t from fparts group by 1, 2, 3)
"""
ROWS_SELECT = "select chrom, (founder + 1)::int as seq_no, chrom || chr(9) || case when founder < 0 then 'REF' else (founder + 1)::varchar end as seq_id, chunk_no, length(t)::bigint as n_chars, md5(t) as text_md5 from frows"
