"""Open incidents of one stream key, read from and written to map states piece by piece."""

from __future__ import annotations

import json

from packetloom.plans.folding import Incident, OpenIncidents


class HeldIncidents(OpenIncidents):
    """The open incidents that a batch's alerts can meet: an alert reads the at most six pairs it must share, and the incidents filed
    there. Written back are the heads (type, last time, turn) of incidents that took an alert, the entity sets of those that
    grew, and the pairs that are new: never what the batch has not touched.

    A batch that covers more time than the window also begins incidents that are over before it ends. Only rows older than the batch
    could still join them, so these are not filed piece by piece: `listed` returns them, to be stored in bulk, and `reopen` takes
    them up again should rows come that can reach them. So are the open ones of a key that has no more than `few`. An incident
    without any pair cannot be found again and is not kept. `blank` says that the key has no state yet.
    """

    def __init__(self, window_us: int, heads, sets, pairs, turn: int, blank: bool = False, few: int = 0):
        super().__init__(window_us, few=0)
        self.few = few
        self.ordered, self.blank = False, blank  # incidents come from the state as they are asked for, not as they were touched
        self.turn, self.heads, self.sets, self.stored = turn, heads, sets, pairs
        self.asked: set[tuple] = set()
        self.filed: dict[str, set[tuple]] = {}
        self.touched_ids: set[str] = set()
        self.fresh: dict[tuple, list[str]] = {}
        self.born: list[Incident] = []

    def _stored_ids(self, pair: tuple) -> list[str]:
        held = self.stored.getValue((json.dumps(pair),))
        return json.loads(held[0]) if held else []

    def _load(self, name: str) -> Incident | None:
        head = self.heads.getValue((name,))
        if head is None:
            return None
        kind, last, turn, active = head
        one = Incident(name, kind, last, *json.loads(self.sets.getValue((name,))[0]), active, turn)
        self.by_id[name], self.filed[name] = one, set(self._pairs_of(one))
        return one

    def _touch(self, one: Incident) -> None:
        self.newest = one.last if self.newest is None else max(self.newest, one.last)
        self.touched.append((one.last, one))

    def forget(self, before: int) -> None:
        """Incidents from before a time are not looked at any more; what is to be written of them stays."""
        while self.touched and self.touched[0][0] < before:
            _, one = self.touched.popleft()
            if one.last < before:
                self._drop(self.pairs, self.filed[one.id], one.id)
                self._drop(self.plain, self.filed[one.id], one.id)

    def _fetch(self, pair: tuple) -> None:
        if pair in self.asked:
            return
        self.asked.add(pair)
        if self.blank:
            return
        for name in self._stored_ids(pair):
            one = self.by_id.get(name) or self._load(name)
            if one:
                self._put(pair, one)

    def _file(self, one: Incident) -> None:
        self.turn += 1
        one.turn = self.turn
        if one.id not in self.by_id:
            self.by_id[one.id] = one
            self.born.append(one)
        self._touch(one)
        self._file_pairs(one)

    def _file_pairs(self, one: Incident) -> None:
        old = self.filed.setdefault(one.id, set())
        for pair in set(self._pairs_of(one)) - old:
            old.add(pair)
            self._put(pair, one)
            self.fresh.setdefault(pair, []).append(one.id)

    def take(self, first: int, last: int, alert_id: str, kind: str, src, dst, port) -> str:
        self.forget(first - self.window)
        for pair in self._wanted(kind, src, dst, port):
            self._fetch(pair)
        name = super().take(first, last, alert_id, kind, src, dst, port)
        self.touched_ids.add(name)
        return name

    def add(self, one: Incident) -> None:
        """An incident that was open before the stream began."""
        self._file(one)
        self.touched_ids.add(one.id)

    def reopen(self, records) -> None:
        """Incidents that `listed` returned earlier."""
        for name, kind, last, sources, targets, ports, active, turn in sorted(records, key=lambda r: (r[2], r[-1])):
            one = Incident(name, kind, last, sources, targets, ports, active, turn)
            self.by_id[name] = one
            self.born.append(one)
            self._touch(one)
            self._file_pairs(one)

    def lasting(self) -> list[Incident]:
        """Incidents to be filed, of those that began in this batch or were reopened by it."""
        open_ = [x for x in self.born if self.filed[x.id] and not (self.newest is not None and x.last < self.newest - self.window)]
        return open_ if len(open_) > self.few else []

    def listed(self, before: int = 0) -> list[tuple]:
        """The others, apart from those last seen before a time from which no alert can reach them."""
        lasting = {x.id for x in self.lasting()}
        return [(x.id, x.kind, x.last, sorted(x.sources), sorted(x.targets), sorted(x.ports), x.active, x.turn)
                for x in self.born if self.filed[x.id] and x.id not in lasting and x.last >= before]

    def save(self) -> None:
        """Writes what the batch has touched, apart from what is listed."""
        lasting = {x.id for x in self.lasting()}
        left_out = {x.id for x in self.born} - lasting
        grown = {name for names in self.fresh.values() for name in names}
        for name in (self.touched_ids | lasting) - left_out:
            one = self.by_id[name]
            self.heads.updateValue((name,), (one.kind, one.last, one.turn, one.active))
            if name in grown or name in lasting:
                self.sets.updateValue((name,), (json.dumps([sorted(one.sources), sorted(one.targets), sorted(one.ports)]),))
        for pair, names in self.fresh.items():
            names = [x for x in names if x not in left_out]
            if names:
                self.stored.updateValue((json.dumps(pair),), (json.dumps(([] if self.blank else self._stored_ids(pair)) + names),))

    def remove(self, name: str) -> None:
        one = self._load(name)
        if one is None:
            return
        for pair in self.filed[name]:
            left = [x for x in self._stored_ids(pair) if x != name]
            if left:
                self.stored.updateValue((json.dumps(pair),), (json.dumps(left),))
            else:
                self.stored.removeKey((json.dumps(pair),))
        self.heads.removeKey((name,))
        self.sets.removeKey((name,))
