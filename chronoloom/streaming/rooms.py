"""Rooms as state: ordered edits of a shared map, counters, badges and presence, kept by Spark's state store.

messages: room, seq, user_id, ts, type, node, ops. A room's messages are numbered from 1 without gaps; they may come in any order and in
any batch. One that comes early is held until those before it are there, and one that comes again is passed over, so what a room
becomes does not depend on how the stream was cut up, nor on restarts. Types: ``hello`` and ``presence`` (a user is at a node), ``op`` (edits:
add, update, remove, move), ``event`` (node names what was explored or done, as ``kind:detail``), ``sync`` (asks for the whole map).

The state of a room is a map of its nodes, one of the children of each, one of what is held, one of its users, one of what they explored
and one of their counters. A batch reads and writes the entries that its messages touch; only ``sync`` reads a whole map. A user who
has not been heard of for a while of event time leaves by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.lexicon import POINTS
from ..operators.activity import BADGES
from ..operators.tree import Document
from ..session import ship

OPS = "array<struct<type:string,id:string,parent_id:string,index:int,text:string,node_type:string>>"
MESSAGES = f"room long, seq long, user_id long, ts timestamp, type string, node string, ops {OPS}"
#: What a room gives out: what is op, node, presence, badge; ord, node and text as the kind has them; version after the message.
OUT = "room long, seq long, version long, what string, user_id long, node string, parent_id string, ord long, text string"
COUNTERS = ["points", "explored", *[k for k in POINTS if k != "node_explored"], "team"]


def _struct(fields: str) -> T.StructType:
    """Of names and simple types; workers have no session that could read DDL."""
    kinds = {"string": T.StringType(), "long": T.LongType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])


class _Held:
    """A map state as a mapping whose entries are read when they are asked for and written back at the end of a batch."""

    def __init__(self, state, read, write):
        self.state, self.read, self.write, self.seen, self.gone = state, read, write, {}, set()

    def get(self, key, other=None):
        if key not in self.seen and key not in self.gone and key is not None and self.state.containsKey((key,)):
            self.seen[key] = self.read(self.state.getValue((key,)))
        return self.seen.get(key, other)

    def __contains__(self, key) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key):
        found = self.get(key)
        if found is None:
            raise KeyError(key)
        return found

    def __setitem__(self, key, value) -> None:
        self.seen[key] = value
        self.gone.discard(key)

    def setdefault(self, key, value):
        if key not in self:
            self[key] = value
        return self[key]

    def pop(self, key, *other):
        found = self.get(key)
        self.seen.pop(key, None)
        self.gone.add(key)
        return found

    def items(self):
        for (key,) in list(self.state.keys()):
            self.get(key)
        return self.seen.items()

    def flush(self) -> None:
        for key, value in self.seen.items():
            self.state.updateValue((key,), self.write(value))
        for key in self.gone:
            if self.state.containsKey((key,)):
                self.state.removeKey((key,))


class Rooms(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = _struct("k string")
        self.handle = handle
        self.place = handle.getValueState("place", _struct("seq long, version long"))
        self.nodes = handle.getMapState("nodes", text, _struct("parent string, type string, text string"))
        self.kids = handle.getMapState("kids", text, _struct("ids string"))
        self.waiting = handle.getMapState("waiting", _struct("seq long"), _struct("user_id long, ts long, type string, node string, ops string"))
        self.users = handle.getMapState("users", _struct("user_id long"), _struct("node string, ts long"))
        self.explored = handle.getMapState("explored", _struct("user_id long, node string"), _struct("n long"))
        self.counters = handle.getMapState("counters", _struct("user_id long, name string"), _struct("n long"))

    def _document(self) -> Document:
        nodes = _Held(self.nodes, lambda r: {"parent": r[0], "type": r[1], "text": r[2]}, lambda n: (n["parent"], n["type"], n["text"]))
        # ids of the children in order; ids hold no line break
        kids = _Held(self.kids, lambda r: r[0].split("\n") if r[0] else [], lambda ids: ("\n".join(ids),))
        return Document(nodes, kids, {})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        document = self._document()
        rows = initialState.sort_values(["ord", "node_id"]).astype(object)
        for r in rows.where(rows.notna(), None).itertuples(index=False):
            document.nodes[r.node_id] = {"parent": r.parent_id, "type": r.type, "text": r.text}
            if r.parent_id is not None:
                document.kids.setdefault(r.parent_id, []).append(r.node_id)
        self._flush(document)

    def _flush(self, document: Document) -> None:
        document.nodes.flush()
        document.kids.flush()

    def _count(self, user: int, name: str, n: int = 1) -> int:
        key = (user, name)
        n += self.counters.getValue(key)[0] if self.counters.containsKey(key) else 0
        self.counters.updateValue(key, (n,))
        return n

    def _read(self, user: int, name: str) -> int:
        return self.counters.getValue((user, name))[0] if self.counters.containsKey((user, name)) else 0

    def record(self, user: int, kind: str, detail: str | None) -> list[str]:
        """Counts an event; the badges that it earns."""
        held = lambda name: self._read(user, "node_added") + self._read(user, "node_edited") if name == "built" else self._read(user, name)
        before = {b for b, name, n in BADGES if held(name) >= n}
        if kind == "node_explored":
            if not detail or self.explored.containsKey((user, detail)):
                return []
            self.explored.updateValue((user, detail), (1,))
            self._count(user, "explored")
        elif kind == "team":
            if not self._read(user, "team"):
                self._count(user, "team")
        elif kind in POINTS:
            self._count(user, kind)
        if kind in POINTS:
            self._count(user, "points", POINTS[kind])
        return [b for b, name, n in BADGES if b not in before and held(name) >= n]

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import json

        import pandas as pd

        seq, version = self.place.get() if self.place.exists() else (0, 0)
        for batch in rows:
            for r in batch.itertuples(index=False):
                if r.seq > seq:
                    ops = [] if r.ops is None else [o.asDict() if hasattr(o, "asDict") else dict(o) for o in r.ops]
                    node = None if r.node is None or r.node != r.node else r.node
                    self.waiting.updateValue((int(r.seq),), (int(r.user_id), int(r.ts.timestamp() * 1000), r.type, node, json.dumps(ops)))
        document, out = self._document(), []
        while self.waiting.containsKey((seq + 1,)):
            seq += 1
            user, ts, kind, node, ops = self.waiting.getValue((seq,))
            self.waiting.removeKey((seq,))
            badges: list[str] = []
            if kind in ("hello", "presence"):
                if not self.users.containsKey((user,)) or self.users.getValue((user,))[0] != node:
                    out.append((seq, version, "presence", user, node, None, None, None))
                self.users.updateValue((user,), (node, ts))
                self.handle.registerTimer(ts + self.idle)
                here = [u for (u,) in self.users.keys()] if kind == "hello" else []
                for u in here if len(here) > 1 else []:
                    out += [(seq, version, "badge", u, b, None, None, None) for b in self.record(u, "team", None)]
            elif kind == "op":
                done = [(op, document.apply(op)) for op in json.loads(ops)]
                done = [op for op, back in done if back is not None]
                version += bool(done)
                for k, op in enumerate(done):
                    out.append((seq, version, "op", user, op["id"], op.get("parent_id"), k, op["type"]))
                    badges += self.record(user, "node_added" if op["type"] == "add" else "node_edited", None)
            elif kind == "event":
                name, _, detail = (node or "").partition(":")
                badges = self.record(user, name, detail)
            elif kind == "sync":
                place = {c: j for _, ids in document.kids.items() for j, c in enumerate(ids)}
                out += [(seq, version, "node", user, k, n["parent"], place.get(k, 0), n["text"]) for k, n in document.nodes.items()]
            out += [(seq, version, "badge", user, b, None, None, None) for b in badges]
        self._flush(document)
        self.place.update((seq, version))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now = expiredTimerInfo.getExpiryTimeInMs()
        seq, version = self.place.get() if self.place.exists() else (0, 0)
        out = []
        for (user,) in list(self.users.keys()):
            _, ts = self.users.getValue((user,))
            if ts + self.idle <= now:
                self.users.removeKey((user,))
                out.append((seq, version, "presence", user, None, None, None, "left"))
        yield self._frame(key, out)

    @staticmethod
    def _frame(key, out):
        import pandas as pd

        names = [f.name for f in _struct(OUT)]
        return pd.DataFrame([(key[0], *r) for r in out], columns=names).astype({"ord": "Int64", "user_id": "Int64"})

    def close(self) -> None:
        pass


def rooms(messages: DataFrame, nodes: DataFrame | None = None, idle: int = 60, late: str = "10 minutes") -> DataFrame:
    """What the rooms give out (OUT) as messages come. nodes (room, node_id, parent_id, ord, type, text): the maps that rooms begin with.
    idle: seconds after which a silent user leaves; late: how far behind the newest one a message may come, which Spark drops beyond that."""
    ship(messages.sparkSession)
    held = messages.withWatermark("ts", late).groupBy("room")
    start = None if nodes is None else nodes.select("room", "node_id", "parent_id", "ord", "type", "text").groupBy("room")
    return held.transformWithStateInPandas(Rooms(1000 * idle), OUT, "Append", "EventTime", initialState=start)
