"""SentencePiece encoding with the n best segmentations of the piece lattice, and decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recallgrid.llm.common import batch_of, bounded_batches, give_back, slices, texts

#: Distinct chunks that a task remembers.
REMEMBERED = 200_000
#: Bytes of text that are segmented together, and cells of the lattices that are held at once.
TOGETHER = 1 << 20
CELLS = 300_000
#: Longer chunks are segmented one by one and not remembered.
LONG_CHUNK = 48
#: Below the lowest score of the model by this much: a character that no piece covers.
UNKNOWN_PENALTY = 10.0

# No piece holds a line break, nor a blank behind another character: chunks are independent.
_CHUNK = re.compile(r" *[^ \n]+|\n| +")
_PRIME = np.uint64(0x100000001B3)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_PRIME) + ord(c) + 1) & (2**64 - 1)
    return h


class Pieces:
    """The pieces of a model file and the lattice that they span.

    Blanks stand in the pieces as blanks, so a text's own U+2581 is an
    ordinary character; what no piece covers becomes the pieces of its bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.of_byte = np.zeros(256, np.int32)
        self.bytes_of: list[bytes] = [b""] * n
        self.score: dict[str, tuple[float, int]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.of_byte[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace("▁", " ")
                self.bytes_of[i] = piece.encode()
                self.score[piece] = (model.get_score(i), i)
        if any(" " in p.lstrip(" ") or (" " in p[1:] and p.strip(" ")) or "\n" in p for p in self.score):
            raise ValueError("a piece holds a line break or a blank behind another character")
        self.longest = max(map(len, self.score), default=1)
        self.unknown = min((s for s, _ in self.score.values()), default=0.0) - UNKNOWN_PENALTY
        hashes = np.array([_hash(p) for p in self.score], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        # By the upper bits of a hash: may a piece have it? Most substrings are none.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[hashes >> np.uint64(44)] = True
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")
        self.scores = np.array([s for s, _ in self.score.values()])[order]
        self.ids = np.array([i for _, i in self.score.values()], np.int32)[order]
        self.clear()

    # -- one chunk ---------------------------------------------------------

    def edges(self, chunk: str, end: int) -> Iterator[tuple[int, float, int]]:
        """(start, score, id) of the pieces that end at a position; id -1 is an unknown character."""
        for start in range(max(0, end - self.longest), end):
            found = self.score.get(chunk[start:end])
            if found:
                yield start, *found
            elif start == end - 1:
                yield start, self.unknown, -1

    def forward(self, chunk: str) -> tuple[list[float], list[tuple[int, int]]]:
        """Viterbi: best score up to each position, and the last edge of the best way there."""
        best, last = [0.0] + [-np.inf] * len(chunk), [(0, -1)] * (len(chunk) + 1)
        for end in range(1, len(chunk) + 1):
            for start, score, piece in self.edges(chunk, end):
                if best[start] + score > best[end]:
                    best[end], last[end] = best[start] + score, (start, piece)
        return best, last

    def nbest(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations, best first.

        A-star from the end of the lattice: the Viterbi score up to a position
        is exactly what remains, so complete ways come off the queue in order
        and nothing beside the n best is expanded; of equal ones the one
        nearest to the start goes first.
        """
        best, _ = self.forward(chunk)
        queue, made, out = [(-best[-1], len(chunk), 0, 0.0, None)], 0, []
        while queue and len(out) < n:
            _, at, _, behind, way = heapq.heappop(queue)
            if at == 0:
                ids = []
                while way:
                    start, end, piece, way = way
                    ids += self.spelt(chunk[start:end]) if piece < 0 else [piece]
                out.append((behind, ids))
                continue
            for start, score, piece in self.edges(chunk, at):
                made += 1
                heapq.heappush(queue, (-(best[start] + score + behind), start, made, behind + score, (start, at, piece, way)))
        return out

    def spelt(self, text: str) -> list[int]:
        return self.of_byte[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tolist()

    # -- many chunks -------------------------------------------------------

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.best, self.gap = np.zeros(1 << 12), np.zeros(1 << 12)

    def _keep(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray, best: np.ndarray, gap: np.ndarray) -> None:
        """Add chunks: their ids one after the other, how many each has, best scores and gaps."""
        k, n = len(self.index), len(chunks)
        for name, values in (("sizes", sizes), ("best", best), ("gap", gap), ("starts", self.used + np.cumsum(sizes) - sizes)):
            held = getattr(self, name)
            if k + n > len(held):
                held = np.concatenate([held, np.zeros(max(len(held), n), held.dtype)])
                setattr(self, name, held)
            held[k : k + n] = values
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.index.update(zip(chunks, range(k, k + n), strict=True))

    def learn(self, chunks: list[str]) -> None:
        """Segment new chunks: those of one length together, long ones alone."""
        by: dict[int, list[str]] = {}
        for c in chunks:
            if len(c) <= LONG_CHUNK:
                by.setdefault(len(c), []).append(c)
            else:
                two = self.nbest(c, 2)
                gap = two[0][0] - two[1][0] if len(two) > 1 else np.inf
                self._keep([c], np.array(two[0][1]), np.array([len(two[0][1])]), np.array([two[0][0]]), np.array([gap]))
        for length, group in by.items():
            step = max(1, CELLS // (length * self.longest))
            for at in range(0, len(group), step):
                self._together(group[at : at + step], length)

    def _together(self, chunks: list[str], length: int) -> None:
        """Forward and backward Viterbi over chunks of one length; a way's gap is what the second best one loses."""
        n, most = len(chunks), min(self.longest, length)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).astype(np.uint64) + np.uint64(1)
        score = np.full((most + 1, length, n), -np.inf)  # by piece length and start
        piece = np.full((most + 1, length, n), -1, np.int32)
        h = np.zeros((n, length), np.uint64)
        for size in range(1, most + 1):
            h = h[:, : length - size + 1] * _PRIME + codes[:, size - 1 :]
            row, start = np.nonzero(self.maybe[h >> np.uint64(44)])
            wanted = h[row, start]
            at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
            hit = self.hashes[at] == wanted
            row, start, at = row[hit], start[hit], at[hit]
            if size == 1:
                score[1] = self.unknown
            score[size, start, row] = self.scores[at]
            piece[size, start, row] = self.ids[at]
        ahead, last = np.full((length + 1, n), -np.inf), np.zeros((length + 1, n), np.int64)
        ahead[0] = 0.0
        for end in range(1, length + 1):
            # Longest piece first, as the single-chunk search takes the leftmost start on a tie.
            for size in range(min(most, end), 0, -1):
                new = ahead[end - size] + score[size, end - size]
                better = new > ahead[end]
                ahead[end] = np.where(better, new, ahead[end])
                last[end] = np.where(better, size, last[end])
        behind = np.full((length + 1, n), -np.inf)
        behind[length] = 0.0
        for start in range(length - 1, -1, -1):
            for size in range(1, min(most, length - start) + 1):
                behind[start] = np.maximum(behind[start], score[size, start] + behind[start + size])
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, rows = np.full(n, length), np.arange(n)
        while len(rows):
            size = last[at[rows], rows]
            start = at[rows] - size
            steps.append((rows, start, piece[size, start, rows]))
            score[size, start, rows] = -np.inf  # what is left are the edges off the best way
            at[rows] = start
            rows = rows[start > 0]
        second = np.full(n, -np.inf)
        for size in range(1, most + 1):
            for start in range(length - size + 1):
                np.maximum(second, ahead[start] + score[size, start] + behind[start + size], out=second)
        rows, starts, ids = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((starts, rows))
        rows, starts, ids = rows[order], starts[order], ids[order]
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            # A character without a piece gives the pieces of its bytes.
            spelt = [self.spelt(chunks[r][s]) for r, s in zip(rows[bare].tolist(), starts[bare].tolist(), strict=True)]
            times = np.ones(len(ids), np.int64)
            times[bare] = [len(x) for x in spelt]
            rows, ids = np.repeat(rows, times), np.repeat(ids, times)
            ids[ids < 0] = [b for x in spelt for b in x]
        self._keep(chunks, ids, np.bincount(rows, minlength=n), ahead[length], ahead[length] - second)

    # -- texts -------------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        """The text behind the blank that marks its start, cut where no piece crosses."""
        return _CHUNK.findall(" " + text) if text else []

    def encode(self, batch: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """Chunks, their numbers and the ids of each text."""
        cut = [self.chunks(x) for x in batch]
        new = [c for c in {c for x in cut for c in x} if c not in self.index]
        if len(self.index) + len(new) > REMEMBERED:
            self.clear()
            new = list({c for x in cut for c in x})
        self.learn(new)
        out = []
        for x in cut:
            k = np.fromiter(map(self.index.__getitem__, x), np.int64, len(x))
            sizes = self.sizes[k]
            total = int(sizes.sum())
            places = np.repeat(self.starts[k] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
            out.append((x, k, self.flat[places]))
        return out

    def alternatives(self, cut: list[str], k: np.ndarray, n: int) -> list[tuple[float, list]]:
        """The n best segmentations of a text, given its chunks and their numbers: score, and edits (token, tokens replaced, ids) of the best one.

        The best ways of a text differ from the best one in the chunks with
        the smallest gaps, at most n - 1 of them; these get an A-star search,
        and their choices are added up.
        """
        total = float(self.best[k].sum())
        found: list[tuple[float, list]] = [(0.0, [])]
        gaps = self.gap[k]
        some = np.argsort(gaps, kind="stable")[: n - 1] if len(k) <= n else np.argpartition(gaps, n - 1)[: n - 1]
        first = np.cumsum(self.sizes[k]) - self.sizes[k]
        for c in sorted(some.tolist()):
            if np.isfinite(gaps[c]):
                ways = self.nbest(cut[c], n)
                top = ways[0][0]
                size = int(self.sizes[k[c]])
                choices = [(0.0, [])] + [(s - top, [(int(first[c]), size, ids)]) for s, ids in ways[1:]]
                found = sorted(((a + b, x + y) for a, x in found for b, y in choices), key=lambda w: -w[0])[:n]
        return [(total + d, edits) for d, edits in found]

    def decode(self, ids) -> bytes:
        """The text's UTF-8 bytes; the blank that marks its start is taken off."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data[1:] if data[:1] == b" " else data


_HELD: dict[str, Pieces] = {}


def held(path: str) -> Pieces:
    """The pieces of this Python worker, kept from task to task."""
    if path not in _HELD:
        _HELD[path] = Pieces(path)
    return _HELD[path]


_EDIT = pa.struct([("token", pa.int32()), ("replaced", pa.int32()), ("ids", pa.list_(pa.int32()))])
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids", pa.list_(pa.int32())),
        ("score", pa.float64()),
        ("alternatives", pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))]))),
        ("round_trip", pa.bool_()),
    ]
)
_COLUMNS = (
    "doc_id long, n_tokens long, ids array<int>, score double, "
    "alternatives array<struct<score:double, edits:array<struct<token:int, replaced:int, ids:array<int>>>>>, round_trip boolean"
)


def encoded(model: Pieces, batch: pa.RecordBatch, n: int) -> pa.RecordBatch:
    strings = [x.decode("utf-8", "replace") for x in texts(batch)]
    coded = model.encode(strings)
    ranked = [model.alternatives(cut, k, n) for cut, k, _ in coded]
    offsets = np.concatenate([[0], np.cumsum([len(ids) for *_, ids in coded])]).astype(np.int32)
    values = np.concatenate([ids for *_, ids in coded])
    same = [model.decode(ids.tolist()) == s.encode("utf-8") for s, (*_, ids) in zip(strings, coded, strict=True)]
    others = [
        [{"score": s, "edits": [{"token": t, "replaced": r, "ids": i} for t, r, i in edits]} for s, edits in x[1:]]
        for x in ranked
    ]
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    return batch_of(_SCHEMA, [batch.column(0), np.diff(offsets), ids, [x[0][0] for x in ranked], others, same])


def _encode(path: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from recallgrid.llm import pieces

        model = pieces.held(path)
        try:
            for batch in slices(batches, TOGETHER):
                yield pieces.encoded(model, batch, n)
        finally:
            # The chunks of a task are let go, so that an idle worker holds little.
            model.clear()
            give_back()

    return run


def encode(docs: DataFrame, model_path: str, n: int = 3) -> DataFrame:
    """The n best segmentations of each document's whole text into pieces.

    docs: doc_id long, text string; other columns are not read. Scores are
    those of the model file, added up over the pieces of a way through the
    lattice. ids and score are the best way; alternatives are the next n - 1,
    best first, each as its score and its edits of ids (at `token`, `replaced`
    ids give way to `ids`). Texts are cut where no piece crosses; the distinct
    chunks of a batch are segmented together by forward Viterbi, and the few
    chunks in which the best ways of a text differ by A-star search with these
    scores as exact heuristics. round_trip: the decoded ids are the text.

    Null or empty text: no ids, score 0, no alternatives. What no piece covers
    becomes byte pieces. Repeated rows: one row each. Null doc_id: kept. Empty
    table: no rows. model_path must exist on the executors.
    """
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encode(model_path, n), _COLUMNS)


def _decode(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from recallgrid.llm import pieces

        model = pieces.held(path)
        for batch in batches:
            rows = [model.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield batch_of(schema, [batch.column(0), rows])

    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with ids; null or no ids give an empty text."""
    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model_path), "doc_id long, text string")
