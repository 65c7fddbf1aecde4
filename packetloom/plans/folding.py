"""The open incidents of one correlation key: the only order-dependent state in the library."""

from __future__ import annotations

import hashlib
import json
from collections import deque
from datetime import datetime, timezone

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def incident_id(first_us: int, alert_id: str) -> str:
    """Deterministic id from the incident's first alert (see `incidents.incident_id`)."""
    day = datetime.fromtimestamp(first_us // 1_000_000, tz=timezone.utc).strftime("%Y%m%d")
    return f"INC-{day}-{hashlib.md5(alert_id.encode()).hexdigest().upper()}"


def _grown(held, x):
    """`held` with `x`: a few entities are a tuple, which takes a quarter of a set's memory."""
    if x in held:
        return held
    if isinstance(held, set):
        held.add(x)
        return held
    return (*held, x) if len(held) < 8 else {*held, x}


class Incident:
    """An incident that can still take an alert. `turn` grows with each alert it takes; `older` and `newer` are its neighbours as touched."""

    __slots__ = ("id", "kind", "last", "sources", "targets", "ports", "active", "turn", "older", "newer")

    def __init__(self, id, kind, last, sources=(), targets=(), ports=(), active=True, turn=0):
        self.id, self.kind, self.last, self.active, self.turn = id, kind, last, active, turn
        self.sources, self.targets, self.ports = (tuple(dict.fromkeys(x)) if len(x) <= 8 else set(x) for x in (sources, targets, ports))
        self.older = self.newer = None

    def record(self) -> list:
        """All but the turn, in a form that equal incidents share."""
        return [self.id, self.kind, self.last, sorted(self.sources), sorted(self.targets), sorted(self.ports), self.active]


class Filed:
    """Incidents by pair. While a source has few, they are one list under it and no pair that names it is stored, and a pair
    of one incident holds the incident itself: most incidents have a source of their own and few pairs that others share."""

    def __init__(self, few: int = 16):
        self.few = few
        self.of_source: dict[str, list[Incident] | None] = {}  # None: too many, under their pairs
        self.held: dict[tuple, Incident | dict[str, Incident]] = {}

    def _listed(self, pair: tuple) -> bool:
        return self.few > 0 and pair[0] in _OF_SOURCE and self.of_source.get(pair[1], ()) is not None

    def get(self, pair: tuple, default=None):
        if self._listed(pair):
            what, source, x = pair
            found = {one.id: one for one in self.of_source.get(source, ()) if (
                one.kind == x if what == "sk" else x in one.targets if what == "sd" else x and x in one.ports)}  # port 0 is no pair
            return found or default
        held = self.held.get(pair)
        return default if held is None else {held.id: held} if isinstance(held, Incident) else held

    def put(self, pair: tuple, one: Incident) -> None:
        if self._listed(pair):
            own = self.of_source.setdefault(pair[1], [])
            if one in own:
                return
            own.append(one)
            if len(own) <= self.few:
                return
            self.of_source[pair[1]] = None
            for x in own:
                for p in OpenIncidents._pairs_of(x):
                    if p[0] in _OF_SOURCE and p[1] == pair[1]:
                        self.put(p, x)
            return
        held = self.held.get(pair)
        if held is None:
            self.held[pair] = one
        elif not isinstance(held, Incident):
            held[one.id] = one
        elif held is not one:
            self.held[pair] = {held.id: held, one.id: one}

    def drop(self, pair: tuple, name: str) -> None:
        if self._listed(pair):
            own = self.of_source.get(pair[1])
            if own:
                own[:] = [x for x in own if x.id != name]
                if not own:
                    del self.of_source[pair[1]]
            return
        held = self.held.get(pair)
        if isinstance(held, Incident):
            if held.id == name:
                del self.held[pair]
        elif held and held.pop(name, None) and not held:
            del self.held[pair]

    def __len__(self) -> int:
        return len(self.held) + len({p for own in self.of_source.values() for x in own or () for p in OpenIncidents._pairs_of(x) if p[0] in _OF_SOURCE})


_OF_SOURCE = ("sk", "sd", "sp")


class OpenIncidents:
    """Incidents that can still take an alert, found by pairs of what an alert must share with them.

    An alert joins an incident with which it shares its source and one of type, destination and port, or its destination
    and type or port, or its type and port. So every incident is filed under such pairs, and an alert looks up at most six.

    What an alert looks at does not grow with the other sources' incidents. One with a source finds incidents of that source under the
    pairs that name it; under the other pairs it can only join incidents that have no source yet, which are filed once more in
    `plain`. One without a source may join any: where many are filed under its pairs, all incidents are walked from the last touched
    backwards, and the first that fits is the one wanted.
    """

    def __init__(self, window_us: int, saved: str | None = None, few: int = 16):
        self.window, self.turn = window_us, 0
        self.pairs = Filed(few)
        self.plain = Filed(0)  # of those the incidents without a source
        self.by_id: dict[str, Incident] = {}
        self.last_touched: Incident | None = None
        self.newest, self.ordered = None, True  # as long as times do not fall, the last touched is the newest
        self.touched: deque[tuple[int, Incident]] = deque()  # time and incident of each alert, oldest first
        for record in json.loads(saved) if saved else ():
            self.resume(Incident(*record))

    def in_order(self) -> list[Incident]:
        return sorted(self.by_id.values(), key=lambda x: (x.last, x.turn))

    def dump(self) -> str:
        return json.dumps([x.record() for x in self.in_order()])

    def close(self) -> list[Incident]:
        """The incidents in order; the state holds nothing any more."""
        rows = self.in_order()
        for x in rows:
            x.older = x.newer = None
        self.__init__(self.window)
        return rows

    def resume(self, one: Incident) -> None:
        """Takes up an incident that was open before; in order."""
        self._file(one)

    def _file(self, one: Incident) -> None:
        self.turn += 1
        one.turn = self.turn
        self._touch(one)
        self.by_id[one.id] = one
        for pair in self._pairs_of(one):
            self._put(pair, one)

    def _touch(self, one: Incident) -> None:
        if self.newest is not None and one.last < self.newest:
            self.ordered = False
        self.newest = one.last if self.newest is None else max(self.newest, one.last)
        self.touched.append((one.last, one))
        if self.last_touched is not one:
            self._unlink(one)
            one.older = self.last_touched
            if one.older:
                one.older.newer = one
            self.last_touched = one

    def _unlink(self, one: Incident) -> None:
        if one.newer:
            one.newer.older = one.older
        if one.older:
            one.older.newer = one.newer
        if self.last_touched is one:
            self.last_touched = one.older
        one.older = one.newer = None

    def _put(self, pair: tuple, one: Incident) -> None:
        self.pairs.put(pair, one)
        if not one.sources:
            self.plain.put(pair, one)

    @staticmethod
    def _drop(filed: Filed, pairs, name: str) -> None:
        for pair in pairs:
            filed.drop(pair, name)

    @staticmethod
    def _pairs_of(one: Incident):
        yield from (("sk", s, one.kind) for s in one.sources)
        yield from (("sd", s, d) for s in one.sources for d in one.targets)
        yield from (("sp", s, p) for s in one.sources for p in one.ports if p)
        yield from (("dk", d, one.kind) for d in one.targets)
        yield from (("dp", d, p) for d in one.targets for p in one.ports if p)
        yield from (("kp", one.kind, p) for p in one.ports if p)

    def forget(self, before: int) -> None:
        """Drops incidents last seen before a time from which no alert can reach them."""
        while self.touched and self.touched[0][0] < before:
            _, one = self.touched.popleft()
            if one.last < before and self.by_id.pop(one.id, None):
                self._unlink(one)
                self._drop(self.pairs, self._pairs_of(one), one.id)
                if not one.sources:
                    self._drop(self.plain, self._pairs_of(one), one.id)

    @staticmethod
    def _wanted(kind: str, src, dst, port) -> list[tuple]:
        """The pairs of which an alert must share one with an incident."""
        wanted = []
        if src:
            wanted += [("sk", src, kind), ("sd", src, dst), ("sp", src, port)]
        if dst:
            wanted += [("dk", dst, kind), ("dp", dst, port)]
        if port:
            wanted.append(("kp", kind, port))
        return wanted

    def _best(self, first: int, kind: str, src, dst, port) -> Incident | None:
        """The incident last touched of those that an alert at `first` can join."""
        wanted = self._wanted(kind, src, dst, port)
        filed = [self.pairs.get(p) if not src or p[0] in ("sk", "sd", "sp") else self.plain.get(p) for p in wanted]
        filed = [x for x in filed if x]
        if not src and self.ordered and sum(map(len, filed)) ** 2 > len(self.by_id):
            one = self.last_touched
            while one and one.last >= first - self.window:
                if one.active and one.last - first <= self.window and any(one.id in x for x in filed):
                    return one
                one = one.older
            return None
        best = None
        for held in filed:
            for one in held.values():
                if not one.active or abs(first - one.last) > self.window or (src and one.sources and src not in one.sources):
                    continue
                if best is None or (one.last, one.turn) > (best.last, best.turn):
                    best = one
        return best

    def take(self, first: int, last: int, alert_id: str, kind: str, src, dst, port) -> str:
        """Incident of an alert, or of a burst of equal alerts from `first` to `last`."""
        best = self._best(first, kind, src, dst, port)
        one = best or Incident(incident_id(first, alert_id), kind, last)
        one.last = last
        known = best is not None and (not src or src in one.sources) and (not dst or dst in one.targets) and (
            port is None or port in one.ports)
        if src and not one.sources and best is not None:
            self._drop(self.plain, list(self._pairs_of(one)), one.id)
        if src:
            one.sources = _grown(one.sources, src)
        if dst:
            one.targets = _grown(one.targets, dst)
        if port is not None:
            one.ports = _grown(one.ports, port)
        if known:  # filed under all its pairs already
            self.turn += 1
            one.turn = self.turn
            self._touch(one)
        else:
            self._file(one)
        return one.id

    def set_active(self, incident: str, active: bool) -> None:
        if incident in self.by_id:
            self.by_id[incident].active = active
