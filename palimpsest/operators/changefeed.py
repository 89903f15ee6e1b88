"""Problem 2: a feed of inserts, updates and deletes applied to a bucketed table.

Order of two changes of one entry: greater sync_seq; if equal or a revision is missing, the clock that is
nowhere smaller and somewhere greater; failing that, the greater sync_hash (none is lowest).  A delete
removes the entry, an insert sets it, an update sets it unless it stands deleted.  So an entry exists iff
it has no delete or its last insert is later than its last delete, and its last change set it.

The latest of a set is found by knock-out: changes meet in pairs, the later one stays.  A change that is
later than all others wins every knock-out, whatever the pairs, so each task may knock out its own part of
the feed before the shuffle: a hot entry costs at most one change an op and task.  What is left is routed
to the bucket of its key, and the touched buckets, each one file of sorted rows, are merged with their
sorted changes; the last rounds and the meeting with the base row are part of that merge.  A bucket that
no change names is neither read nor written.  If the rules contradict each other (three or more changes
that beat each other in a ring), no change is later than all others and one of the ring is taken.

A removed entry stays as a row with pending_delete, and every row that a feed has named keeps its last
delete and insert, so a feed may come in parts and in any order: the parts together give what the whole
gives (for changes that the rules order without a contradiction).  ``live_rows`` is the table's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import iso_instant
from ..sources.buckets import ROWS_PER_BUCKET, BucketedTable
from ..sources.scratch import new_path
from .current import current_rows

CLOCK = "map<string,bigint>"
PAYLOAD = f"content string, importance double, status string, updated_at string, vector_clock {CLOCK}, pending_delete boolean"
VALUES = ["content", "importance", "status", "updated_at"]  # from the payload of the change that set the row
POSITION = ["sync_seq", "sync_hash", "vector_clock"]  # of the entry's last change
_CHANGE = f"struct<seq:bigint,hash:string,clock:{CLOCK},queue_id:bigint>"
SET_BY, LAST_DELETE, LAST_INSERT = "_set_by", "_last_delete", "_last_insert"
DELETE, INSERT, UPDATE, NOTHING = 0, 1, 2, 3
HELD_ROWS = 100_000  # feed rows that a task reduces at a time
_FEED = f"namespace string, id string, op int, seq bigint, hash string, clock {CLOCK}, queue_id bigint, content string, importance double, status string, updated_at timestamp"
_MAP = pa.map_(pa.string(), pa.int64())


def clock_order(a: Column, b: Column) -> Column:
    """1 if clock a dominates b, -1 if b dominates a, else 0 (equal or concurrent).  Null is the empty clock."""
    empty = F.create_map().cast(CLOCK)
    gap = F.map_values(F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    up, down = F.exists(gap, lambda g: g > 0), F.exists(gap, lambda g: g < 0)
    return F.when(up & ~down, 1).when(down & ~up, -1).otherwise(0)


def queue_changes(queue: DataFrame) -> DataFrame:
    """Feed records as changes with the values of their payload; columns as in ``_FEED``.

    A record whose op names nothing and whose payload does not ask for deletion changes nothing; it is kept
    as NOTHING, so that its entry counts as one with a record.  An unreadable payload is an empty one.  A
    null queue_id counts as 0.
    """
    queue = queue.where("namespace IS NOT NULL AND entry_id IS NOT NULL").select("queue_id", "namespace", "entry_id", "op", "revision", F.from_json("payload", PAYLOAD).alias("p"))
    p, name = F.col("p"), F.lower(F.trim("op"))
    op = F.when((name == "delete") | p["pending_delete"], DELETE).when(name == "insert", INSERT).when(name == "update", UPDATE).otherwise(NOTHING)
    whole = F.col("revision.sync_seq").isNotNull()
    return queue.select(
        "namespace", F.col("entry_id").alias("id"), op.cast("int").alias("op"), F.when(whole, F.col("revision.sync_seq")).alias("seq"),
        F.when(whole, F.col("revision.sync_hash")).alias("hash"), F.coalesce(p["vector_clock"], F.create_map().cast(CLOCK)).alias("clock"), F.coalesce("queue_id", F.lit(0).cast("bigint")).alias("queue_id"),
        p["content"].alias("content"), p["importance"].alias("importance"), p["status"].alias("status"), iso_instant(p["updated_at"]).alias("updated_at"),
    )


class Changes:
    """Changes by index, for comparisons of whole arrays of them."""

    def __init__(self, seq: pa.Array, digest: pa.Array, clock: pa.Array, queue_id: pa.Array, content: pa.Array | None = None):
        self.has_seq = seq.is_valid().to_numpy(zero_copy_only=False)
        self.seq = pc.fill_null(seq, 0).to_numpy(zero_copy_only=False)
        self.no_hash = digest.is_null().to_numpy(zero_copy_only=False)
        self.hash = text_ranks(pc.fill_null(digest, ""))
        self.queue_id = pc.fill_null(queue_id, 0).to_numpy(zero_copy_only=False)
        self.content = None if content is None else text_ranks(pc.fill_null(content, ""))
        self.offsets = clock.offsets.to_numpy(zero_copy_only=False)
        nodes = clock.keys.dictionary_encode()
        self.node, self.n_nodes = nodes.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(nodes.dictionary))
        self.tick = pc.fill_null(clock.items, 0).to_numpy(zero_copy_only=False)
        self.valid_clock = clock.is_valid().to_numpy(zero_copy_only=False)

    def _entries(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair number, place of the entry) of all clock entries of the changes ``of``."""
        size = np.where(self.valid_clock[of], self.offsets[of + 1] - self.offsets[of], 0)
        pair = np.repeat(np.arange(len(of)), size)
        start = np.repeat(self.offsets[of] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(of) else np.empty(0, np.int64)
        return pair, (start + np.arange(len(pair))).astype(np.int64)

    def clocks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a somewhere greater, b somewhere greater, the same entries) for each pair; an absent node counts 0."""
        pa_, ia = self._entries(a)
        pb_, ib = self._entries(b)
        key = np.concatenate([pa_, pb_]) * self.n_nodes + self.node[np.concatenate([ia, ib])]
        gap = np.concatenate([self.tick[ia], -self.tick[ib]])
        side = np.concatenate([np.ones(len(ia), np.int64), -np.ones(len(ib), np.int64)])
        up, down, differs = (np.zeros(len(a), bool) for _ in range(3))
        if len(key):
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
            gaps, sides, pair = np.add.reduceat(gap[order], first), np.add.reduceat(side[order], first), key[first] // self.n_nodes
            up[pair[gaps > 0]] = True
            down[pair[gaps < 0]] = True
            differs[pair[(gaps != 0) | (sides != 0)]] = True
        return up, down, ~differs

    def compare(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a is later, b is later, one and the same change) for each pair."""
        up, down, equal = self.clocks(a, b)
        by_hash = self.hash[a].astype(np.int64) - self.hash[b]
        sign = np.where(up & ~down, 1, np.where(down & ~up, -1, np.sign(by_hash)))
        both = self.has_seq[a] & self.has_seq[b]
        sign = np.where(both & (self.seq[a] != self.seq[b]), np.sign(self.seq[a] - self.seq[b]), sign)
        same = np.where(both, (self.seq[a] == self.seq[b]) & (by_hash == 0) & (self.no_hash[a] == self.no_hash[b]), ~self.has_seq[a] & ~self.has_seq[b] & equal)
        return (sign > 0) & ~same, (sign < 0) & ~same, same

    def champions(self, group: np.ndarray) -> np.ndarray:
        """The latest change of every group; ``group`` is ascending.

        Records of one change are represented by that of the smallest queue_id (then the greatest content).
        """
        alive = np.arange(len(group))
        while True:
            g = group[alive]
            turn = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool)
            place = np.arange(len(g)) - np.maximum.accumulate(np.where(turn, np.arange(len(g)), 0))
            right = np.nonzero(place % 2 == 1)[0]
            if not len(right):
                return alive
            a, b = alive[right - 1], alive[right]
            _, later, same = self.compare(a, b)
            earlier_record = (self.queue_id[b] < self.queue_id[a]) | ((self.queue_id[b] == self.queue_id[a]) & (self.content[b] > self.content[a]) if self.content is not None else False)
            takes = later | (same & earlier_record)
            alive[right - 1] = np.where(takes, b, a)
            alive = np.delete(alive, right)

    def later_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """b where it is later than a, else a; -1 is no change."""
        out = np.where(a < 0, b, a)
        both = np.nonzero((a >= 0) & (b >= 0))[0]
        _, later, _ = self.compare(a[both], b[both])
        out[both] = np.where(later, b[both], a[both])
        return out


def text_ranks(text: pa.Array) -> np.ndarray:
    """Numbers in the order of the texts (by code point), equal for equal texts."""
    coded = text.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    return rank[coded.indices.to_numpy(zero_copy_only=False)] if len(rank) else np.empty(0, np.int64)


def _column(t: pa.Table, name: str, kind: pa.DataType | None = None) -> pa.Array:
    c = t[name].combine_chunks()
    return c if kind is None or c.type == kind else c.cast(kind)


def _feed_changes(t: pa.Table) -> Changes:
    return Changes(_column(t, "seq"), _column(t, "hash"), _column(t, "clock", _MAP), _column(t, "queue_id"), _column(t, "content"))


def latest_changes(feed: pa.Table) -> pa.Table:
    """The latest change of every entry and op."""
    ns, id_ = (feed[c].combine_chunks().dictionary_encode() for c in ("namespace", "id"))
    key = (ns.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(id_.dictionary)) + id_.indices.to_numpy(zero_copy_only=False)) * 4 + feed["op"].to_numpy()
    order = np.argsort(key, kind="stable")
    feed = feed.take(pa.array(order))
    return feed.take(pa.array(_feed_changes(feed).champions(key[order])))


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= HELD_ROWS:
            left = latest_changes(pa.Table.from_batches(held))
            if left.num_rows * 2 > rows:  # little to gain from keeping them
                yield from left.to_batches()
                held, rows = [], 0
            else:
                held, rows = left.to_batches(), left.num_rows
    if rows:
        yield from latest_changes(pa.Table.from_batches(held)).to_batches()


def _pick(parts: list[pa.Array], index: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    return pa.concat_arrays(parts).take(pa.array(index, mask=none))


def merge_bucket(base: pa.Table, changes: pa.Table) -> pa.Table:
    """One bucket's rows after its changes, both sides sorted by key; see ``apply_feed``."""
    nb, nc = base.num_rows, changes.num_rows
    both = [pa.concat_arrays([_column(base, c, pa.string()), _column(changes, c, pa.string())]) for c in ("namespace", "id")]
    ids = text_ranks(both[1])
    keys = text_ranks(both[0]) * (int(ids.max()) + 1 if len(ids) else 1) + ids
    base_key, change_key = keys[:nb], keys[nb:]
    first = np.nonzero(np.concatenate([[True], change_key[1:] != change_key[:-1]]))[0]
    key, m = change_key[first], len(first)
    entry = np.repeat(np.arange(m), np.diff(np.append(first, nc)))
    place = np.searchsorted(base_key, key)
    hit = np.zeros(m, bool)
    hit[place < nb] = base_key[place[place < nb]] == key[place < nb]
    at = pa.array(np.where(hit, place, 0), mask=~hit)
    old = base.take(at)

    # one pool of changes: the feed's, then the base rows as changes, then the deletes and inserts they remember
    own_seq = _column(old, "sync_seq", pa.int64())
    own = [own_seq, pc.if_else(own_seq.is_valid(), _column(old, "sync_hash"), pa.scalar(None, pa.string())), _column(old, "vector_clock", _MAP), pa.array(np.zeros(m, np.int64))]
    remembered = [[_column(old, c).field(f) if f != "clock" else _column(old, c).field(f).cast(_MAP) for f in ("seq", "hash", "clock", "queue_id")] for c in (LAST_DELETE, LAST_INSERT)]
    feed = [_column(changes, "seq"), _column(changes, "hash"), _column(changes, "clock", _MAP), _column(changes, "queue_id")]
    pool_columns = [pa.concat_arrays([f, o, d.cast(f.type), i.cast(f.type)]) for f, o, d, i in zip(feed, own, *remembered)]
    pool = Changes(*pool_columns, content=pa.concat_arrays([_column(changes, "content"), pa.nulls(3 * m, pa.string())]))

    op = changes["op"].to_numpy()
    order = np.argsort(entry * 4 + op, kind="stable")
    winner = order[Changes(*[c.take(pa.array(order)) for c in feed], content=_column(changes, "content").take(pa.array(order))).champions((entry * 4 + op)[order])]
    of_op = np.full((3, m), -1, np.int64)
    for o in (DELETE, INSERT, UPDATE):
        mine = winner[op[winner] == o]
        of_op[o, entry[mine]] = mine
    base_own = np.where(hit, nc + np.arange(m), -1)
    for o in range(3):  # the base row's own change, sent again
        meet = np.nonzero((of_op[o] >= 0) & hit)[0]
        of_op[o, meet[pool.compare(of_op[o, meet], base_own[meet])[2]]] = -1
    named = _column(old, SET_BY).is_valid().to_numpy(zero_copy_only=False)
    gone = pc.fill_null(_column(old, "pending_delete"), False).to_numpy(zero_copy_only=False)
    kept = [_column(old, c).is_valid().to_numpy(zero_copy_only=False) for c in (LAST_DELETE, LAST_INSERT)]
    base_d = np.where(named, np.where(kept[0], nc + m + np.arange(m), -1), np.where(gone, base_own, -1))
    base_i = np.where(named, np.where(kept[1], nc + 2 * m + np.arange(m), -1), np.where(gone, -1, base_own))
    d, i = pool.later_of(base_d, of_op[DELETE]), pool.later_of(base_i, of_op[INSERT])
    last = base_own
    for o in (DELETE, INSERT, UPDATE):
        last = pool.later_of(last, of_op[o])
    present = (last >= 0) & (d < 0)
    race = np.nonzero((last >= 0) & (d >= 0) & (i >= 0))[0]
    present[race] = pool.compare(i[race], d[race])[0]
    moved = (last >= 0) & (last < nc)  # the last change is a new one

    def struct_of(which: np.ndarray) -> pa.Array:
        none = which < 0
        fields = [c.take(pa.array(np.where(none, 0, which), mask=none)) for c in pool_columns]
        return pa.StructArray.from_arrays(fields, names=["seq", "hash", "clock", "queue_id"], mask=pa.array(none))

    def set_column(name: str, source: str) -> pa.Array:
        was = _column(old, name)
        new = _column(changes, source, None)
        new = new if new.type == was.type else new.cast(was.type)
        return _pick([was, new], np.where(moved, m + last, np.arange(m)))

    columns = []
    for f in base.schema:
        if f.name in ("namespace", "id"):
            c = _column(changes, f.name).take(pa.array(first))
        elif f.name in VALUES:
            c = set_column(f.name, f.name)
        elif f.name in POSITION:
            c = set_column(f.name, {"sync_seq": "seq", "sync_hash": "hash", "vector_clock": "clock"}[f.name])
        elif f.name == SET_BY:
            c = pc.fill_null(set_column(SET_BY, "queue_id"), 0)  # a row that still stands by itself is named from now on
        elif f.name == "pending_delete":
            c = pa.array(~present)
        elif f.name in (LAST_DELETE, LAST_INSERT):
            c = struct_of(d if f.name == LAST_DELETE else i)
        else:
            c = _column(old, f.name)
        columns.append(c if c.type == f.type else c.cast(f.type))
    touched = pa.table(columns, schema=base.schema)
    rest = np.ones(nb, bool)
    rest[place[hit]] = False
    # two sorted runs: a stable sort merges them in linear time
    merged = np.argsort(np.concatenate([base_key[rest], key]), kind="stable")
    return pa.concat_tables([base.filter(pa.array(rest)), touched]).combine_chunks().take(pa.array(merged))


def bootstrap(memories: DataFrame, root: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> BucketedTable:
    """The current rows of ``memories`` as version 0 of a bucketed table; no feed has named any yet."""
    cols = [c for c in memories.columns if c not in ("namespace", "id", SET_BY, LAST_DELETE, LAST_INSERT)]
    none = F.lit(None)
    rows = current_rows(memories, ["namespace", "id"], "updated_at", cols).withColumns({SET_BY: none.cast("bigint"), LAST_DELETE: none.cast(_CHANGE), LAST_INSERT: none.cast(_CHANGE)})
    return BucketedTable.create(rows, root or new_path(memories.sparkSession, "entries"), ["namespace", "id"], memories.count(), rows_per_bucket)


def apply_feed(table: BucketedTable, queue: DataFrame) -> BucketedTable:
    """The table's next version after all changes of ``queue``.

    A row that the feed names gets ``_set_by``: the smallest queue_id of the change that set it, 0 if no
    feed did.  A set row takes the payload's values and keeps its other columns (null in a new row); a
    removed one gets pending_delete.  Order of arrival, repeated records and repeated application change
    nothing.  An empty feed commits a version with the same files.  Null namespaces or ids name no entry.
    """
    return table.merge(queue_changes(queue).mapInArrow(_reduced, _FEED), merge_bucket)


def live_rows(table: BucketedTable) -> DataFrame:
    """The rows in force: those not marked as deleted."""
    return table.read().where(~F.coalesce("pending_delete", F.lit(False)))
