"""Hierarchical packing of documents into windows of several sizes.

A document's full-length stretches become windows of their own; what is left
is routed to the smallest tier that holds it. Tiers are packed from the longest
window to the shortest by best fit; gaps in long windows are filled with pieces
of shorter tiers, the last of which is cut to fit, so a finished window is full.
What remains when a partition ends is laid in a row and cut at powers of two,
so no window needs padding. Finished windows of a tier are dealt to step groups
of the same number of tokens, evening out the cost of attention.

Each partition is packed on its own, in one pass and in bounded memory.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellumine.llm.common import arrow_type, partition_id, small_batches, text_input
from vellumine.llm.vocabulary import WordEncoder, encoder

#: Pieces that wait in all tiers before they are packed.
POOL_PIECES = 2048
#: Tokens of a step group, and how many groups windows are dealt to at a time.
STEP_TOKENS, STEP_GROUPS = 1 << 16, 4


@dataclass(slots=True)
class Piece:
    """A stretch of a document: ``length`` ids from ``start`` on."""

    row: tuple
    ids: bytes
    start: int
    length: int

    def split(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.row, self.ids, self.start, at), Piece(self.row, self.ids, self.start + at, self.length - at)


class Packer:
    """Takes documents, gives back (tier size, pieces) for each finished window."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers = sorted(tiers)
        if any(x & (x - 1) for x in self.tiers):
            raise ValueError("window sizes must be powers of two")
        self.pools: list[list[Piece]] = [[] for _ in self.tiers]
        self.done: list[tuple[int, list[Piece]]] = []

    def route(self, piece: Piece) -> None:
        if piece.length:
            self.pools[bisect.bisect_left(self.tiers, piece.length)].append(piece)

    def add(self, row: tuple, ids: bytes) -> None:
        rest, most = Piece(row, ids, 0, len(ids) // 4), self.tiers[-1]
        while rest.length >= most:
            full, rest = rest.split(most)
            self.done.append((most, [full]))
        self.route(rest)
        if sum(map(len, self.pools)) >= POOL_PIECES:
            self.pack()

    def pack(self) -> None:
        for tier in range(len(self.tiers) - 1, -1, -1):
            self._pack_tier(tier)

    def _pack_tier(self, tier: int) -> None:
        size, pieces = self.tiers[tier], sorted(self.pools[tier], key=lambda x: x.length)
        self.pools[tier] = []
        gaps: list[tuple[int, int]] = []  # (gap, window), ascending
        windows: list[list[Piece]] = []
        while pieces:
            piece = pieces.pop()
            at = bisect.bisect_left(gaps, (piece.length, -1))
            if at < len(gaps):
                gap, window = gaps.pop(at)
                windows[window].append(piece)
            else:
                gap, window = size, len(windows)
                windows.append([piece])
            bisect.insort(gaps, (gap - piece.length, window))
        for pool in self.pools[:tier]:
            pool.sort(key=lambda x: x.length)
        for number, (gap, window) in enumerate(gaps):
            while gap:
                piece = self._shorter(tier, gap)
                if piece is None:
                    break
                if piece.length > gap:
                    piece, rest = piece.split(gap)
                    self.route(rest)
                windows[window].append(piece)
                gap -= piece.length
            if gap:  # nothing shorter is left: fill windows from windows
                self._merge(tier, [windows[w] for _, w in gaps[number:]])
                break
            self.done.append((size, windows[window]))

    def _shorter(self, tier: int, gap: int) -> Piece | None:
        """The longest piece of shorter tiers that fits, or else the shortest of them."""
        for pool in reversed(self.pools[:tier]):
            if pool and pool[0].length <= gap:
                at = bisect.bisect_right(pool, gap, key=lambda x: x.length)
                return pool.pop(at - 1)
        return next((pool.pop(0) for pool in self.pools[:tier] if pool), None)

    def _merge(self, tier: int, windows: list[list[Piece]]) -> None:
        """Lay windows with gaps in a row, finish the full ones, route the rest again."""
        size, own, filled = self.tiers[tier], [], 0
        for piece in (x for window in windows for x in window):
            while filled + piece.length >= size:
                head, piece = piece.split(size - filled)
                self.done.append((size, [*own, head]))
                own, filled = [], 0
            if piece.length:
                own.append(piece)
                filled += piece.length
        self.pools[tier] += own

    def finish(self) -> None:
        self.pack()
        left = [x for pool in reversed(self.pools) for x in pool]
        self.pools = [[] for _ in self.tiers]
        total, at = sum(x.length for x in left), 0
        sizes = [self.tiers[-1]] * (total // self.tiers[-1])
        sizes += [1 << b for b in range(self.tiers[-1].bit_length() - 1, -1, -1) if (total % self.tiers[-1]) >> b & 1]
        for size in sizes:
            own, gap = [], size
            while gap:
                piece = left[at]
                if piece.length > gap:
                    piece, left[at] = piece.split(gap)
                else:
                    at += 1
                own.append(piece)
                gap -= piece.length
            self.done.append((size, own))


class Steps:
    """Deals finished windows of a size to step groups of ``STEP_TOKENS`` tokens."""

    def __init__(self, first: int) -> None:
        self.next_window = self.next_step = first
        self.waiting: dict[int, list[list[Piece]]] = {}

    def deal(self, done: list[tuple[int, list[Piece]]], last: bool) -> Iterator[tuple[int, int, int, list[Piece]]]:
        """(size, window, step group, pieces) of each window of full groups."""
        for size, pieces in done:
            self.waiting.setdefault(size, []).append(pieces)
        for size, windows in self.waiting.items():
            each = max(1, STEP_TOKENS // size)
            block = each * STEP_GROUPS
            whole = len(windows) if last else len(windows) - len(windows) % block
            for i in range(0, whole, block):
                own = sorted(windows[i : min(whole, i + block)], key=lambda x: -sum(p.length**2 for p in x))
                groups = -(-len(own) // each)
                for k, pieces in enumerate(own):
                    turn, at = divmod(k, groups)
                    yield size, self.next_window, self.next_step + (at if turn % 2 == 0 else groups - 1 - at), pieces
                    self.next_window += 1
                self.next_step += groups
            self.waiting[size] = windows[whole:]


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, tiers: tuple[int, ...] = (512, 1024, 2048, 4096), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, add ``end_id`` to each, and pack them.

    Returns a row per piece: the id, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``, ``window`` (its sequence's
    size) and ``step_group``. A null or empty text is one piece of the end id.
    Rows that repeat an id are packed each on their own. Other columns are
    ignored; an empty table gives no sequence.
    """
    small_batches(docs.sparkSession)
    rows = text_input(docs, id_col, text_col)
    kind = rows.schema["id"].dataType
    arrow_kind, end = arrow_type(kind), end_id.to_bytes(4, "little")
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(x, T.LongType()) for x in longs), T.StructField("window", T.IntegerType()), T.StructField("step_group", T.LongType())])
    kinds = [arrow_kind, *[pa.int64()] * 6, pa.int32(), pa.int64()]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, steps = encoder(WordEncoder, vocabulary), Packer(tiers), Steps(partition_id() << 36)

        def give(last: bool) -> pa.RecordBatch:
            out = []
            for size, window, group, pieces in steps.deal(packer.done, last):
                offset = 0
                for x in pieces:
                    crc = zlib.crc32(memoryview(x.ids)[4 * x.start : 4 * (x.start + x.length)])
                    out.append((*x.row, x.start, x.length, crc, len(x.ids) // 4, window, offset, size, group))
                    offset += x.length
            packer.done = []
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(columns, kinds, strict=True)], schema.names)

        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for at, ids in zip(batch.column("id").to_pylist(), encode.ids(texts), strict=True):
                packer.add((at,), ids + end)
            yield give(last=False)
        packer.finish()
        yield give(last=True)

    return rows.mapInArrow(step, schema)
