"""Queries of problem 4: processing only new or changed records."""

from __future__ import annotations

from codelode.operators.change_capture import next_state, pending_commits
from codelode.session import scratch, table


_TABLES = ("commits", "index_generation", "history_state")


def p4_found(spark, sf_dir):
    """The commits in the sink of the run that is due: planned ahead, written, and read back by key and offset."""
    return pending_commits(*(table(spark, sf_dir, t) for t in _TABLES), scratch(spark, "feed")).select("root_id", "sha")


def p4_state(spark, sf_dir):
    return next_state(*(table(spark, sf_dir, t) for t in _TABLES), scratch(spark, "feed"))


QUERIES = {"p4_found": p4_found, "p4_state": p4_state}

_STATE = """
with run as (
  select root_id, head from (
    select g.root_id, h.head, row_number() over (partition by g.root_id order by g.created_at desc, g.generation_id desc, h.recorded_at desc) rn
    from index_generation g join history_state h on g.root_id = h.root_id and g.generation_id = h.generation_id
    where g.semantic_checksum is not null and h.head is not null and h.unavailable is null) where rn = 1),
state as (select c.root_id, min(c.id) done_to from commits c join run r on c.root_id = r.root_id and c.sha = r.head group by 1),
marked as (select c.*, s.done_to from commits c left join state s using (root_id)),
newest as (
  select root_id, sha, arg_max(row(commit_date, subject, body), id) last_row,
         arg_max(row(commit_date, subject, body), id) filter (where id <= done_to) seen_row,
         max(id) filter (where id <= done_to) seen
  from marked group by 1, 2),
pending as (select root_id, sha from newest where seen is null or last_row is distinct from seen_row)
"""

ORACLE = {
    "p4_found": _STATE + "select root_id, sha from pending",
    "p4_state": _STATE + """
select c.root_id, s.done_to, max(c.id) next_to, arg_max(c.sha, c.id) head,
       (select count(*) from pending p where p.root_id = c.root_id) pending
from commits c left join state s on c.root_id = s.root_id group by c.root_id, s.done_to""",
}
