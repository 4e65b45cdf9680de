"""Token counts by a compiled transducer over text segments.

No piece of the vocabulary holds a space mark after another character, so no
merge ever crosses the place where a space mark follows something else: there
the tokenizer is back in its start state. Between two such places lies one
segment (space marks, then other characters). The compiled table is a
deterministic transducer that reads one segment per transition and emits the
number of its tokens; a transition is compiled when its segment is first met,
by merging the segment's characters.

A chunk of text is a map from the state before it (an open segment) to the
state behind it and a count. It is kept as (head, count, tail): what comes
before its first boundary, the tokens of its whole segments, what comes after
its last one. Such maps compose associatively, so a long text is mapped chunk
by chunk and composed pairwise, level by level.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patchlake.llm.common import slices

MARK = "▁"
CHUNK_CHARS = 1 << 16
# Compiled transitions a worker holds; beyond that those not met lately go.
TABLE_SEGMENTS = 400_000
TABLE_CHARS = 16 << 20
# Segments above this length are merged with a queue.
LONG_SEGMENT = 48
_NONE = float("-inf")

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=2)
def transducer(model_path: str) -> "Transducer":
    """One table per worker process: compiled transitions outlive the task."""
    return Transducer(model_path)


_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_BOUNDARY = re.compile(f"(?<=[^{MARK}]){MARK}")


class Chunk(NamedTuple):
    """The state map of a chunk; ``count`` is None while it holds no boundary (all of it is head)."""

    head: str
    count: int | None
    tail: str


class Transducer(dict):
    """segment -> number of emitted tokens, compiled on demand from a piece model."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.score = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        }
        if any(_BOUNDARY.search(piece) for piece in self.score):
            raise ValueError("a piece crosses a segment boundary; this vocabulary has no start state there")
        self.older: dict[str, int] = {}
        self.held = 0

    def __missing__(self, segment: str) -> int:
        if len(self) >= TABLE_SEGMENTS or self.held >= TABLE_CHARS:
            self.older = dict(self)
            self.clear()
            self.held = 0
        count = self.older.get(segment)
        if count is None:
            count = self.emitted(segment)
        self[segment] = count
        self.held += len(segment)
        return count

    def emitted(self, segment: str) -> int:
        """Tokens of one segment: the best-scored neighbours merge first, the leftmost of equal ones."""
        score = self.score
        if len(segment) > LONG_SEGMENT:
            parts = self.merged_by_queue(segment)
        else:
            parts, get = list(segment), score.get
            gains = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
            while gains and (best := max(gains)) != _NONE:
                i = gains.index(best)
                parts[i] += parts.pop(i + 1)
                del gains[i]
                if i:
                    gains[i - 1] = get(parts[i - 1] + parts[i], _NONE)
                if i < len(gains):
                    gains[i] = get(parts[i] + parts[i + 1], _NONE)
        # What is no piece falls back to its bytes.
        return len(parts) + sum([len(p.encode("utf-8", "surrogatepass")) - 1 for p in parts if p not in score])

    def merged_by_queue(self, segment: str) -> list[str]:
        """The same merges for a long segment, in n log n steps."""
        parts: list[str | None] = list(segment)
        n, score = len(parts), self.score
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            joined = parts[i] + parts[j]
            if joined in score:
                heapq.heappush(queue, (-score[joined], i, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, joined = heapq.heappop(queue)
            if parts[i] is None or (j := after[i]) >= n or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def chunk(self, text: str) -> Chunk:
        """The state map of one chunk."""
        first = _BOUNDARY.search(text)
        if first is None:
            return Chunk(text, None, "")
        segments = _SEGMENT.findall(text, first.start())
        tail = segments.pop()
        return Chunk(text[: first.start()], sum(map(self.__getitem__, segments)), tail)

    def compose(self, left: Chunk, right: Chunk) -> Chunk:
        """The map of two neighbouring chunks."""
        if not left.head and left.count is None:
            return right
        if not right.head and right.count is None:
            return left
        seam = self.chunk((left.head if left.count is None else left.tail) + right.head)
        head, count, tail = seam
        if left.count is not None:
            count = left.count + (0 if count is None else self[head] + count)
            tail = head if seam.count is None else tail
            head = left.head
        if right.count is None:
            return Chunk(head, count, tail)
        if count is None:
            return Chunk(head, right.count, right.tail)
        return Chunk(head, count + self[tail] + right.count, right.tail)

    def finish(self, whole: Chunk) -> int:
        return sum(self[part] for part in (whole.head, whole.tail) if part) + (whole.count or 0)

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        """Tokens of a text; an empty text has none."""
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        maps = [self.chunk(text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)]
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = pairs + maps[len(pairs) * 2 :]
        return self.finish(maps[0])


def token_counts(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row, repeated ones too.

    ``model_path`` names a sentencepiece BPE model with byte fallback on every
    executor. Null and empty texts have no bytes and no tokens. Begin, end and
    other special tokens are not added; their strings in a text are ordinary
    text. One narrow pass, no shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([machine.count(t) for t in texts], pa.int64()),
                ],
                schema=_OUT,
            )

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
