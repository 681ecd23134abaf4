"""SentencePiece encoding and decoding by a streaming Viterbi search.

A lattice has a node at every boundary between characters and an edge for every piece. The search
goes through the text once and keeps, for every boundary, its best edge back. Only the last boundaries, as
many as the longest piece is long, can still be extended, so only they carry surviving paths; when all of those paths run
through one boundary, the ids before it are final and are given out. What is held in memory
is that window and the part of the text whose paths have not met yet.

For unigram models an edge counts its piece's score and the best sum wins. Models of merges (BPE) define
their result by the order of merges instead; there an edge is open only if merging its piece next to
the last piece of its start leaves both as they are. A text is its merge result exactly if all
neighbours agree so, and one path per boundary is open: the search finds it without merging the
text. Tests hold both against plain versions, and the second against the sentencepiece library.

If no piece spans the gap before a space, paths always meet there, so words are encoded once and
remembered (``MEMORY`` words of up to ``LONG`` characters, then the memory starts anew).

Defined results: null counts as empty; an empty text has no ids; characters without a piece become their
bytes' ids, or the unknown id if the model has none; the mark U+2581 in a text is a space to the
model and is decoded as one. Repeated rows get the same ids each.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typetrace.llm import textbytes as tb

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MEMORY, LONG = 200_000, 64
SPACE = "▁"
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
_NO_PIECE = -10.0  # what an unknown character costs below the worst piece


def _fields(buffer: bytes):
    """Field numbers and values of a protocol buffer message; groups do not occur in model files."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buffer[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(buffer):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, buffer[at:at + size]
            at += size


@dataclass
class Model:
    """Pieces of a model. ``merges``: it is defined by merges, not by sums of scores."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    merges: bool
    prefix: bool = True
    squeeze: bool = False
    ids: dict[str, int] = field(default_factory=dict)
    lengths: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        by_end: dict[str, set[int]] = {}
        for p in self.ids:
            by_end.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {end: tuple(sorted(n)) for end, n in by_end.items() if len(end) == 3}
        # Neighbouring characters that some piece holds together; between any others all paths meet.
        self.gaps = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == _UNKNOWN), 0)
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) + _NO_PIECE
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.agree: dict[int, bool] = {}
        self.reachable: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}  # ids of words that follow one space
        self.parts: dict[str, bytes] = {}  # ids of parts of words between sure boundaries
        self.spelt = [self._spelling(i) for i in range(len(self.pieces))]

    def _spelling(self, i: int) -> bytes:
        if self.kinds[i] == _BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == _NORMAL:
            return self.pieces[i].replace(SPACE, " ").encode()
        return " ⁇ ".encode() if self.kinds[i] == _UNKNOWN else b""

    def __getstate__(self):
        return (self.pieces, self.scores, self.kinds, self.merges, self.prefix, self.squeeze)

    def __setstate__(self, state):
        self.__init__(*state)

    def merged(self, text: str) -> list[str]:
        """Merge a short text: always the best-scored pair that is a piece, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and self.scores[i] > best:
                    best, at = self.scores[i], k
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def stands(self, piece: int) -> bool:
        """Whether merging a piece's own characters gives the piece."""
        if piece not in self.reachable:
            self.reachable[piece] = len(self.merged(self.pieces[piece])) == 1
        return self.reachable[piece]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether two pieces stay apart, and whole, when their text is merged. An unknown character (-1) merges with nothing."""
        if left < 0:
            return self.stands(right)
        key = left << 32 | right
        if key not in self.agree:
            if len(self.agree) > 4 * MEMORY:
                self.agree.clear()
            a, b = self.pieces[left], self.pieces[right]
            self.agree[key] = self.merged(a + b) == [a, b]
        return self.agree[key]


class StreamingViterbi:
    """Feed a text in parts; ids come back as soon as they are final."""

    def __init__(self, model: Model):
        self.model = model
        self.text = ""  # from the last final boundary, or as far back as a piece may reach
        self.lead = 0  # characters of ``text`` that are final already
        self.last = -1 if not model.merges else None  # piece before the first boundary; None: start of text
        self.sums, self.backs, self.edges = [0.0], [0], [self.last]
        self.widest = 0  # most characters held at once, for tests

    def feed(self, part: str) -> list[int]:
        out: list[int] = []
        step = 4 * self.model.longest
        for at in range(0, len(part), step):
            self._extend(part[at:at + step])
            out += self._commit(self._meeting())
        return out

    def finish(self) -> list[int]:
        return self._commit(len(self.sums) - 1)

    def _extend(self, part: str) -> None:
        model, sums, backs, edges = self.model, self.sums, self.backs, self.edges
        ids, scores, lengths, merges = model.ids, model.scores, model.lengths, model.merges
        agree = model.agree

        def open_edge(left, piece):
            if left is None or left < 0:
                return model.stands(piece)
            known = agree.get(left << 32 | piece)
            return model.neighbours(left, piece) if known is None else known

        text = self.text = self.text + part
        self.widest = max(self.widest, len(text))
        for end in range(len(sums), len(text) + 1):
            if merges:
                # Exactly one piece fits; a single character does if no longer one is open.
                width, best = 1, 0.0
                edge = -1
                if end > 1:
                    piece = ids.get(text[end - 2:end])
                    if piece is not None and open_edge(edges[end - 2], piece):
                        width, edge = 2, piece
                    elif end > 2:
                        for n in lengths.get(text[end - 3:end], ()):
                            if n > end:
                                break
                            piece = ids.get(text[end - n:end])
                            if piece is not None and open_edge(edges[end - n], piece):
                                width, edge = n, piece
                                break
                if edge < 0:
                    edge = ids.get(text[end - 1], -1)
            else:
                edge = ids.get(text[end - 1], -1)
                width, best = 1, sums[end - 1] + (scores[edge] if edge >= 0 else model.worst)
                for n in (2, *lengths.get(text[end - 3:end], ())) if end > 1 else ():
                    if n > end:
                        break
                    piece = ids.get(text[end - n:end])
                    if piece is not None and sums[end - n] + scores[piece] > best:
                        best, width, edge = sums[end - n] + scores[piece], n, piece
            sums.append(best)
            backs.append(width)
            edges.append(edge)

    def _meeting(self) -> int:
        """The last boundary that all paths that can still be extended run through."""
        end = len(self.sums) - 1
        # Pieces of the next characters begin at one of these boundaries.
        live = set(range(max(0, end - self.model.longest + 1), end + 1))
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(far - self.backs[far])
        return live.pop()

    def _commit(self, boundary: int) -> list[int]:
        model, out, at = self.model, [], boundary
        if not boundary:
            return out
        while at > 0:
            piece = self.edges[at]
            if piece >= 0:
                out.append(piece)
            else:
                char = self.text[at - 1]
                out += [model.bytes[b] for b in reversed(char.encode())] if model.bytes else [model.unknown]
            at -= self.backs[at]
        base = self.sums[boundary]
        self.text = self.text[boundary:]
        self.sums = [s - base for s in self.sums[boundary:]]
        self.backs = [0, *self.backs[boundary + 1:]]
        self.edges = self.edges[boundary:]
        out.reverse()
        return out


def search(model: Model, text: str) -> list[int]:
    """Ids of a text in the model's own spelling."""
    stream = StreamingViterbi(model)
    if len(text) <= 4 * model.longest:  # all of it is within the first window
        stream._extend(text)
        return stream.finish()
    return stream.feed(text) + stream.finish()


def _unit(model: Model, unit: str) -> bytes:
    """Ids of a unit, put together from its parts between sure boundaries."""
    gaps, out, begin = model.gaps, [], 0
    if len(model.parts) >= MEMORY:
        model.parts.clear()
    for k in range(1, len(unit) + 1):
        if k == len(unit) or unit[k - 1:k + 1] not in gaps:
            part = unit[begin:k]
            got = model.parts.get(part)
            if got is None:
                got = array("i", search(model, part)).tobytes()
                if len(part) <= LONG:
                    model.parts[part] = got
            out.append(got)
            begin = k
    return b"".join(out)


def _word(model: Model, word: str) -> bytes:
    if len(model.words) >= MEMORY:
        model.words.clear()
    got = _unit(model, SPACE + word)
    if len(word) <= LONG:
        model.words[word] = got
    return got


_RUN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def encode(model: Model, text: str) -> np.ndarray:
    """Ids of a whole text."""
    if model.squeeze:
        text = re.sub(" +", " ", text).strip(" ")
    if not text:
        return np.zeros(0, np.int32)
    if not model.by_words:
        return np.array(search(model, (SPACE if model.prefix else "") + text.replace(" ", SPACE)), np.int32)
    if model.prefix:
        words, known = text.replace(SPACE, " ").split(" "), model.words
        if "" not in words:
            return np.frombuffer(b"".join([known.get(w) or _word(model, w) for w in words]), np.int32)
    runs = _RUN.findall((SPACE if model.prefix else "") + text.replace(" ", SPACE))
    return np.frombuffer(b"".join([_unit(model, run) for run in runs]), np.int32)


def decode(model: Model, ids) -> str:
    """Text of ids; bytes that are no UTF-8 become replacement characters."""
    spelt = model.spelt
    text = b"".join([spelt[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


def read_model(path: str = MODEL) -> Model:
    """Model of a SentencePiece file that leaves its text as it is, but for spaces."""
    with open(path, "rb") as f:
        message = list(_fields(f.read()))
    pieces, scores, kinds = [], [], []
    for number, value in message:
        if number == 1:
            got = dict(_fields(value))
            pieces.append(got[1].decode())
            scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
            kinds.append(got.get(3, _NORMAL))
    trainer, normal = (dict(_fields(next((v for n, v in message if n == k), b""))) for k in (2, 3))
    if normal.get(2):
        raise ValueError(f"{path}: models with a character map are not supported")
    return Model(pieces, scores, kinds, trainer.get(3, 1) == 2, bool(normal.get(3, 1)), bool(normal.get(4, 1)))


def encode_texts(docs: DataFrame, model: Model, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts as an array in the column ``ids_col``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != ids_col]

    def run(batches):
        for rows, _, _ in tb.slices(batches, text_col):
            ids = [encode(shared.value, t or "") for t in rows.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], _arrow_ids(ids)], [*kept, ids_col])

    rows = docs.select(*kept)
    return rows.mapInArrow(run, _schema(rows, ids_col, "array<int>"))


def decode_ids(encoded: DataFrame, model: Model, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in the column ``text_col``; null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in encoded.columns if c != text_col]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                texts = [decode(shared.value, ids.values.to_numpy().tolist() if ids.is_valid else ()) for ids in rows.column(ids_col)]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, text_col])

    rows = encoded.select(*kept)
    return rows.mapInArrow(run, _schema(rows, text_col, "string"))


def _arrow_ids(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))


def _schema(rows: DataFrame, name: str, kind: str):
    from pyspark.sql.types import _parse_datatype_string

    return type(rows.schema)([*rows.schema.fields]).add(name, _parse_datatype_string(kind))


def encoded_and_decoded(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_ids``, ``ids``, ``decoded_sha256`` and ``exact`` (the ids give the text back) of every row.

    Both ways in one pass, over slices of a few megabytes, so a task holds one worker and little text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for rows, _, _ in tb.slices(batches):
            texts = [t or "" for t in rows.column("text").to_pylist()]
            ids = [encode(m, t) for t in texts]
            back = [decode(m, i.tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), _arrow_ids(ids),
                 pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()), pa.array([b == t for b, t in zip(back, texts)], pa.bool_())],
                ["doc_id", "n_ids", "ids", "decoded_sha256", "exact"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n_ids long, ids array<int>, decoded_sha256 string, exact boolean")
