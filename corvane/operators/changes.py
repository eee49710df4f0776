"""Problem 1: apply a journal of inserts, updates and deletes that comes repeated and out of order.

Every journal entry is turned into operations on single records. An operation is a function from a record's
state (absent, blocked, or an image with a version) to its next state. Such functions compose associatively,
so a record's history is cut into ranges of the order (record, graph_version, event, position): a range
partitioner balances the ranges, hot records included, each task composes its range into one patch, the
patches of a record that spans several ranges are composed in a tree, and only then applied to the base.

A patch knows the outcome for an absent record, for single incoming versions or runs of them (operations with
an expected version) and for every other version. Runs of versions with one outcome are kept as intervals.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import Workspace
from corvane.sources.versions import commit, current_version

CREATE, CHANGE, REMOVE, REMOVE_AND_BLOCK, SET, SET_BLOCKED = 0, 1, 2, 3, 4, 5

PAYLOAD = (
    "atom struct<id:string,version:bigint>, after struct<id:string,version:bigint>, before struct<id:string>, "
    "tombstone struct<target_ref:string,recreation_policy:string>, "
    "projected_atoms array<struct<id:string,version:bigint,deleted:boolean>>"
)
OPERATION = "struct<id:string,kind:int,version:bigint,pos:int>"

# ------------------------------------------------------------------------------------------------ states
# A state is ABSENT, BLOCKED or (version, event_id). KEEP stands for "as it came in".
ABSENT, BLOCKED, KEEP = "absent", "blocked", "keep"


def step(state, kind: int, version, event: str, expected):
    """The state after one operation. expected: the number the record's version must equal (None: not named)."""
    if kind == SET:  # only ever a record's first operation
        return (version, event)
    if state == BLOCKED or kind == SET_BLOCKED:
        return BLOCKED
    if state == ABSENT:
        return (version, event) if kind == CREATE and (expected is None or expected == 0) else ABSENT
    if kind == CREATE or (expected is not None and expected != state[0]):
        return state
    if kind == CHANGE:
        return (version, event)
    return BLOCKED if kind == REMOVE_AND_BLOCK else ABSENT


class Patch:
    """absent, default: outcomes; points: disjoint (lo, hi, outcome) in order of lo, before default."""

    __slots__ = ("absent", "default", "points")

    def __init__(self, absent=ABSENT, default=KEEP, points=()):
        self.absent, self.default, self.points = absent, default, list(points)

    def __call__(self, state):
        if state == BLOCKED:
            return BLOCKED
        if state == ABSENT:
            return self.absent
        v = state[0]
        if v is not None and self.points:
            i = bisect_right(self.points, v, key=lambda p: p[0]) - 1
            if i >= 0 and v <= self.points[i][1]:
                return self.points[i][2]
        return state if self.default == KEEP else self.default

    def then(self, g: Patch) -> Patch:
        """First this patch, then g; associative."""
        pts = [(lo, hi, g(o)) for lo, hi, o in self.points]
        if self.default == KEEP:
            default = g.default
            for lo, hi, o in g.points:
                at = lo
                for a, b, _ in self.points:
                    if b < at:
                        continue
                    if a > hi:
                        break
                    if a > at:
                        pts.append((at, a - 1, o))
                    at = b + 1
                if at <= hi:
                    pts.append((at, hi, o))
        else:
            default = g(self.default)
        return Patch(g(self.absent), default, merged(pts))


def merged(points: list) -> list:
    """Neighbouring intervals with one outcome become one."""
    out: list = []
    for lo, hi, o in sorted(points, key=lambda p: p[0]):
        if out and out[-1][2] == o and out[-1][1] + 1 == lo:
            out[-1] = (out[-1][0], hi, o)
        else:
            out.append((lo, hi, o))
    return out


class Composer:
    """Composes a run of operations into a patch, each operation touching only the outcomes it can change."""

    def __init__(self):
        self.live: dict = {}  # version -> {event: [keys]}: the outcomes with an image
        self.absent, self.blocked = ["A"], []  # keys whose outcome is no image
        self.seen: set = set()
        self.open = True  # versions without a point of their own pass unchanged

    def _take(self, versions) -> list:
        keys: list = []
        for v in list(versions):
            for ks in self.live.pop(v).values():
                keys = ks + keys if len(ks) > len(keys) else keys + ks
        return keys

    def add(self, kind: int, version, event: str, expected) -> None:
        if kind in (SET, SET_BLOCKED):
            keys = self.absent + self.blocked + self._take(self.live)
            if self.open:
                self.open = False
                keys.append("D")
            self.absent, self.blocked, self.live = [], [], {}
            if kind == SET:
                self.live = {version: {event: keys}}
            else:
                self.blocked = keys
            return
        if kind == CREATE:
            if self.absent and (expected is None or expected == 0):
                self._put(version, event, self.absent)
                self.absent = []
            return
        if expected is None:
            keys = self._take(self.live)
            if self.open:
                self.open = False
                keys.append("D")
        else:
            keys = self._take([expected]) if expected in self.live else []
            if self.open and expected not in self.seen:
                self.seen.add(expected)
                keys.append(expected)
        if not keys:
            return
        if kind == CHANGE:
            self._put(version, event, keys)
        elif kind == REMOVE:
            self.absent = self.absent + keys
        else:
            self.blocked = self.blocked + keys

    def _put(self, version, event: str, keys: list) -> None:
        self.live.setdefault(version, {}).setdefault(event, []).extend(keys)

    def patch(self) -> Patch:
        p, points = Patch(ABSENT, KEEP), []
        found = [(ABSENT, self.absent), (BLOCKED, self.blocked)]
        found += [((v, e), ks) for v, at in self.live.items() for e, ks in at.items()]
        for outcome, keys in found:
            for k in keys:
                if k == "A":
                    p.absent = outcome
                elif k == "D":
                    p.default = outcome
                else:
                    points.append((k, k, outcome))
        p.points = merged(points)
        return p


def compose(operations) -> Patch:
    c = Composer()
    for kind, version, event, expected in operations:
        c.add(kind, version, event, expected)
    return c.patch()


# ------------------------------------------------------------------------------------------------- Spark
def entries(journal: DataFrame) -> DataFrame:
    """(key, entry struct<graph_version, event_id, ops>) of every accepted row; rows of one key are one entry, said again.

    The key is (actor, idempotency_key), or the event where there is none. An entry without event_id or graph_version has no place in the order and does nothing, nor
    does an unparsable payload, a record without id, or an expected version that is null (no number equals it).
    The payload is cut down to ids and versions before anything is shuffled.
    """
    b = F.from_json("payload", PAYLOAD)
    one = lambda ok, i, kind, v, pos: F.when(ok, F.array(F.struct(i.alias("id"), F.lit(kind).alias("kind") if isinstance(kind, int) else kind.alias("kind"), v.alias("version"), F.lit(pos).alias("pos")))).otherwise(F.array().cast(f"array<{OPERATION}>"))
    p = F.col("p")
    policy = p["tombstone"]["recreation_policy"]
    ops = F.concat(
        one(p["atom"].isNotNull(), p["atom"]["id"], CREATE, p["atom"]["version"], 0),
        one(p["after"].isNotNull(), p["after"]["id"], CHANGE, p["after"]["version"], 1),
        one(p["tombstone"].isNotNull(), F.coalesce(p["tombstone"]["target_ref"], p["before"]["id"]), F.when(policy.eqNullSafe("allow_recreate"), REMOVE).otherwise(REMOVE_AND_BLOCK), F.lit(None).cast("bigint"), 2),
        F.coalesce(
            F.transform(
                p["projected_atoms"],
                lambda x, i: F.struct(
                    x["id"].alias("id"),
                    F.when(x["deleted"].eqNullSafe(F.lit(True)), REMOVE).when(x["version"].eqNullSafe(F.lit(1)), CREATE).otherwise(CHANGE).alias("kind"),
                    x["version"].alias("version"),
                    (i + 3).alias("pos"),
                ),
            ),
            F.array().cast(f"array<{OPERATION}>"),
        ),
    )
    named = lambda o: F.map_contains_key(F.coalesce(F.col("expected_versions"), F.create_map().cast("map<string,bigint>")), o["id"])
    ops = F.transform(
        F.filter(ops, lambda o: o["id"].isNotNull()),
        lambda o: F.struct(o["id"].alias("id"), o["kind"].alias("kind"), o["version"].alias("version"), o["pos"].alias("pos"), named(o).alias("named"), F.try_element_at("expected_versions", o["id"]).alias("expected")),
    )
    keyed = F.col("idempotency_key").isNotNull()
    return (
        journal.where((F.col("result_status") == "accepted") & F.col("event_id").isNotNull() & F.col("graph_version").isNotNull())
        .select("event_id", "graph_version", "actor", "idempotency_key", "expected_versions", b.alias("p"))
        .select(
            F.when(keyed, F.concat(F.lit("k"), F.coalesce("actor", F.lit("\x00")), F.lit("\x01"), "idempotency_key")).otherwise(F.concat(F.lit("e"), "event_id")).alias("key"),
            F.struct("graph_version", "event_id", ops.alias("ops")).alias("entry"),
        )
    )


def operations(rows: DataFrame) -> DataFrame:
    """(atom_id, graph_version, event_id, pos, kind, version, expected): what entries() do to records.

    Repeated rows of an event and later uses of an (actor, idempotency_key) count once, at their least graph_version.
    """
    once = rows.groupBy("key").agg(F.min("entry").alias("entry"))
    return (
        once.select("entry.graph_version", "entry.event_id", F.explode("entry.ops").alias("o"))
        .where(~F.col("o.named") | F.col("o.expected").isNotNull())
        .select(F.col("o.id").alias("atom_id"), "graph_version", "event_id", F.col("o.pos").alias("pos"), F.col("o.kind").alias("kind"), F.col("o.version").alias("version"), F.col("o.expected").alias("expected"))
    )


_STATE = "atom_id string, part int, whole boolean, status int, version bigint, event_id string, patch array<struct<lo:bigint,hi:bigint,role:string,status:string,version:bigint,event_id:string>>"
_PATCH = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("role", pa.string()), ("status", pa.string()), ("version", pa.int64()), ("event_id", pa.string())]))
_ARROW = pa.schema([("atom_id", pa.string()), ("part", pa.int32()), ("whole", pa.bool_()), ("status", pa.int32()), ("version", pa.int64()), ("event_id", pa.string()), ("patch", _PATCH)])


def _pack(p: Patch) -> list[dict]:
    def row(lo, hi, role, o):
        image = isinstance(o, tuple)
        return {"lo": lo, "hi": hi, "role": role, "status": "image" if image else o, "version": o[0] if image else None, "event_id": o[1] if image else None}

    return [row(None, None, "absent", p.absent), row(None, None, "default", p.default), *(row(lo, hi, "point", o) for lo, hi, o in p.points)]


def _unpack(rows) -> Patch:
    p = Patch()
    for r in rows:
        o = (r["version"], r["event_id"]) if r["status"] == "image" else r["status"]
        if r["role"] == "point":
            p.points.append((r["lo"], r["hi"], o))
        else:
            setattr(p, r["role"], o)
    return p


def _compose_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range: records that lie inside it are settled, the first and the last may go on next door.

    Only the range's first record can have begun before it, so it alone needs a patch for any incoming state.
    """
    part = TaskContext.get().partitionId()
    out: list[dict] = []
    current, opening, composer, state = None, True, None, ABSENT

    def settle(last: bool) -> None:
        nonlocal opening
        if current is None:
            return
        edge = opening or last
        patch = composer.patch() if opening else Patch(state, KEEP)
        image = not edge and isinstance(state, tuple)
        if edge or state != ABSENT:
            out.append({"atom_id": current, "part": part, "whole": not edge, "status": 1 if image else 2, "version": state[0] if image else None, "event_id": state[1] if image else None, "patch": _pack(patch) if edge else None})
        opening = False

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("atom_id", "kind", "version", "event_id", "expected")]
        for atom, kind, version, event, expected in zip(*cols):
            if atom != current:
                settle(False)
                current, state = atom, ABSENT
                composer = Composer() if opening else None
            if composer is not None:
                composer.add(kind, version, event, expected)
            else:
                state = step(state, kind, version, event, expected)
        if len(out) >= 5000:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
            out = []
    settle(True)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def _in_order(t: pa.Table) -> Iterator[Patch]:
    """The patches of one record, as many as its history spans ranges, in the order of the ranges."""
    for rows in t.sort_by("part").column("patch").to_pylist():
        yield _unpack(rows)


def _compose_patches(t: pa.Table) -> pa.Table:
    """The patches of one record and one block of neighbouring ranges, as one patch."""
    p = Patch()
    for g in _in_order(t):
        p = p.then(g)
    rows = [{"atom_id": t.column("atom_id")[0].as_py(), "part": min(t.column("part").to_pylist()), "patch": _pack(p)}]
    return pa.Table.from_pylist(rows, schema=pa.schema([_ARROW.field(c) for c in ("atom_id", "part", "patch")]))


def _apply_patches(t: pa.Table) -> pa.Table:
    state = ABSENT
    for g in _in_order(t):
        state = g(state)
    image = isinstance(state, tuple)
    rows = [{"atom_id": t.column("atom_id")[0].as_py(), "status": 1 if image else 2, "version": state[0] if image else None, "event_id": state[1] if image else None}] if state != ABSENT else []
    return pa.Table.from_pylist(rows, schema=pa.schema([_ARROW.field(c) for c in ("atom_id", "status", "version", "event_id")]))


def fold(ops: DataFrame, base: DataFrame | None = None, fan_in: int = 32) -> DataFrame:
    """(atom_id, status, version, event_id) of the records that are an image (1) or blocked (2) after the operations.

    base: optional rows (atom_id, version, event_id) and, if it has the column, status: the state before.
    """
    ws = Workspace(ops.sparkSession, "changes")
    if base is not None:
        kind = F.when(F.col("status") == 2, SET_BLOCKED).otherwise(SET) if "status" in base.columns else F.lit(SET)
        none = F.lit(None).cast("bigint")
        ops = ops.unionByName(base.where(F.col("atom_id").isNotNull()).select("atom_id", none.alias("graph_version"), "event_id", F.lit(-1).alias("pos"), kind.alias("kind"), F.col("version").cast("bigint").alias("version"), none.alias("expected")))
    order = ("atom_id", "graph_version", "event_id", "pos")
    ranges = ops.repartitionByRange(*order).sortWithinPartitions(*order).select("atom_id", "kind", "version", "event_id", "expected").mapInArrow(_compose_ranges, _STATE)
    states = ws.save(ranges, "states")
    settled = states.where("whole").select("atom_id", "status", "version", "event_id")
    edges = states.where(~F.col("whole")).select("atom_id", "part", "patch")
    patch_t = _STATE.split("patch ")[1]
    tree = edges.withColumn("node", F.floor(F.col("part") / fan_in)).groupBy("atom_id", "node").applyInArrow(_compose_patches, f"atom_id string, part int, patch {patch_t}")
    spanning = tree.groupBy("atom_id").applyInArrow(_apply_patches, "atom_id string, status int, version bigint, event_id string")
    return settled.unionByName(spanning)


def apply_changes(journal: DataFrame, base: DataFrame | None = None, fan_in: int = 32) -> DataFrame:
    """(atom_id, version, event_id) of every record that exists after the journal is applied to base.

    base: optional rows (atom_id, version, event_id), the state before the journal; an image there counts as an
    entry before all others, and with a column status the blocked records (2) stay blocked. fan_in: how many
    neighbouring ranges one node of the reduction tree composes; two levels serve fan_in ** 2 ranges evenly, beyond
    that only the last node grows.
    An empty journal gives base, extra columns are ignored, an image without a version has a null version and
    equals no expected number.
    """
    return fold(operations(entries(journal)), base, fan_in).where("status = 1").select("atom_id", "version", "event_id")


class ChangeFeed:
    """The state of a journal that arrives in batches, in a folder; rows may come again and late, in any batch.

    Every batch writes the entries it brings and the states it changes, then a marker that makes it count; a batch
    that is run again after a failure is skipped or overwritten. A batch whose entries are all newer than what came
    before is applied to the states of the records it names. If an entry comes late, or one of a key that a later entry
    has used, the records concerned are folded anew from all their entries, so the state is always that of the whole
    journal so far. Every `snapshot_every` batches the states are written whole; readers start from there.
    """

    def __init__(self, spark, root: str, snapshot_every: int = 16):
        self.spark, self.root, self.snapshot_every = spark, root.rstrip("/"), snapshot_every

    def last(self) -> int:
        """The number of the last batch that counts, 0 if there is none."""
        return current_version(self.spark, f"{self.root}/states")

    def _read(self, kind: str, first: int, last: int) -> DataFrame | None:
        paths = [f"{self.root}/{kind}/b{n:08d}" for n in range(first, last + 1)]
        return self.spark.read.parquet(*paths) if paths else None

    def states(self) -> DataFrame:
        """(atom_id, status, version, event_id) of the records that are an image (1) or blocked (2)."""
        last = self.last()
        first = max(1, last - last % self.snapshot_every)
        t = self._read("states", first, last)
        if t is None:
            return self.spark.createDataFrame([], "atom_id string, status int, version bigint, event_id string")
        newest = t.groupBy("atom_id").agg(F.max_by(F.struct("status", "version", "event_id"), "batch").alias("s"))
        return newest.where("s.status > 0").select("atom_id", "s.status", "s.version", "s.event_id")

    def current(self) -> DataFrame:
        """(atom_id, version, event_id) of the records that exist."""
        return self.states().where("status = 1").select("atom_id", "version", "event_id")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Applies batch `number` (1, 2, ...); a number that counts already does nothing."""
        last = self.last()
        if number <= last:
            return
        if number != last + 1:
            raise ValueError(f"batch {number} comes before batch {last + 1}")
        path = f"{self.root}/entries/b{number:08d}"
        entries(batch).distinct().write.mode("overwrite").parquet(path)
        new, old = self.spark.read.parquet(path), self._read("entries", 1, last)
        touched = lambda e: e.select(F.explode("entry.ops").alias("o")).select(F.col("o.id").alias("atom_id")).distinct()
        if old is None:
            atoms, states = touched(new), fold(operations(new))
        else:
            seen = old.groupBy("key").agg(F.min("entry.graph_version").alias("seen"))
            fresh = new.join(seen, "key", "left")
            high = old.agg(F.max("entry.graph_version")).first()[0]
            late = fresh.where((F.col("seen").isNull() & (F.col("entry.graph_version") <= F.lit(high))) | (F.col("entry.graph_version") < F.col("seen")))
            if high is None or late.limit(1).count() == 0:
                added = fresh.where("seen is null").select("key", "entry")
                atoms = touched(added)
                states = fold(operations(added), self.states().join(atoms, "atom_id", "left_semi"))
            else:
                both = old.unionByName(new)
                atoms = touched(both.join(new.select("key").distinct(), "key", "left_semi"))
                states = fold(operations(both).join(atoms, "atom_id", "left_semi"))
        gone = atoms.join(states, "atom_id", "left_anti").select("atom_id", F.lit(0).alias("status"), F.lit(None).cast("bigint").alias("version"), F.lit(None).cast("string").alias("event_id"))
        changed = states.unionByName(gone)
        if number % self.snapshot_every == 0:
            changed = self.states().join(atoms, "atom_id", "left_anti").unionByName(changed.where("status > 0"))
        changed.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.root}/states/b{number:08d}")
        commit(self.spark, f"{self.root}/states", number, f"b{number:08d}")
