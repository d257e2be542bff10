"""Following a view from elsewhere: a snapshot, then changes in an unbroken sequence."""

from __future__ import annotations

import hashlib
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.changes import replayed
from millrace.streaming.views import View


class SequenceGap(RuntimeError):
    """A batch is missing; the subscriber must start from a new snapshot."""


def fingerprint(schema: T.StructType, key: list[str]) -> str:
    """Names, types, nesting and key of a view, as a short digest."""
    return hashlib.sha256(f"{schema.simpleString()}|{','.join(key)}".encode()).hexdigest()[:16]


@dataclass
class Publisher:
    """Numbers the changes of a view within an epoch; batches without a change to it get no number.

    The last ``keep`` batches are held for those who catch up; who is further
    behind starts from a new snapshot.
    """

    view: View
    epoch: int = 0
    seq: int = 0
    keep: int = 64
    queue: deque[tuple[int, int, DataFrame]] = field(default_factory=deque)

    def __post_init__(self) -> None:
        self.queue = deque(self.queue, self.keep)
        self.view.listeners.append(self._changed)

    def _changed(self, delta: DataFrame | None) -> None:
        if delta is not None and delta.limit(1).count():
            self.seq += 1
            self.queue.append((self.epoch, self.seq, delta))

    def hello(self, chunk_rows: int | None = None) -> dict:
        """What a subscriber needs to begin: epoch, position, digest and the snapshot.

        With ``chunk_rows`` the snapshot comes as ``chunks``, frames of about so
        many rows each, dealt by key; all are of this position, whatever happens
        to the view meanwhile.
        """
        rows, key = self.view.snapshot, self.view.key
        out = {"epoch": self.epoch, "seq": self.seq, "fingerprint": fingerprint(rows.schema, key)}
        if chunk_rows is None:
            return {**out, "snapshot": rows}
        n = max(1, -(-rows.count() // chunk_rows))
        part = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in key)), F.lit(n)) if key else F.lit(0)
        return {**out, "schema": rows.schema, "chunks": [rows.where(part == i) for i in range(n)]}

    def since(self, epoch: int, seq: int) -> list[tuple[int, int, DataFrame]]:
        """The batches after a position."""
        first = self.queue[0][1] if self.queue else self.seq + 1
        if epoch != self.epoch or not first - 1 <= seq <= self.seq:
            raise SequenceGap(f"{epoch}/{seq} isn't between {self.epoch}/{first - 1} and {self.epoch}/{self.seq}")
        return [x for x in self.queue if x[1] > seq]

    def renew(self, chunk_rows: int | None = None) -> dict:
        """Begin a new epoch."""
        self.epoch, self.seq = self.epoch + 1, 0
        self.queue.clear()
        return self.hello(chunk_rows)


class Subscriber:
    """A copy of a view that follows its publisher."""

    def __init__(self, hello: dict, key: list[str]):
        self.key = key
        self.start(hello)

    def start(self, hello: dict) -> None:
        """Take a snapshot, after the first one or a gap; one in chunks is whole once :meth:`chunk` has had them all."""
        whole = "snapshot" in hello
        if fingerprint(hello["snapshot"].schema if whole else hello["schema"], self.key) != hello["fingerprint"]:
            raise SequenceGap("the snapshot isn't of the view that was announced")
        self.epoch, self.seq, self.rows = hello["epoch"], hello["seq"], hello.get("snapshot")
        self.missing = set() if whole else set(range(len(hello["chunks"])))

    def chunk(self, epoch: int, i: int, rows: DataFrame) -> bool:
        """Take a chunk of the snapshot; one that came already is left out (False)."""
        if epoch != self.epoch:
            raise SequenceGap(f"a chunk of epoch {epoch}, not {self.epoch}")
        if i not in self.missing:
            return False
        self.rows = rows if self.rows is None else self.rows.unionByName(rows)
        self.missing.discard(i)
        return True

    def take(self, epoch: int, seq: int, delta: DataFrame) -> bool:
        """Make a batch's changes; one that came already is left out (False)."""
        if self.missing:
            raise SequenceGap(f"{len(self.missing)} chunks of the snapshot are missing")
        if epoch != self.epoch or seq > self.seq + 1:
            raise SequenceGap(f"expected {self.epoch}/{self.seq + 1}, got {epoch}/{seq}")
        if seq <= self.seq:
            return False
        self.rows, self.seq = replayed(self.rows, delta, self.key), seq
        return True
