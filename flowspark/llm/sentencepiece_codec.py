"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The search keeps the best way to reach each of the last positions (as many as the longest piece has
characters) and commits ids as soon as all surviving back pointers lead through one boundary. Unigram models
maximise the sum of scores. In merge (BPE) models a path survives only if each two neighbouring pieces
are what merging their joint text gives; that leaves one path per position, which is the model's own
result: merges inside two neighbours happen in the same order whatever surrounds them.
"""

from __future__ import annotations

from array import array
from functools import lru_cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from flowspark.llm.common import add_columns

SPACE = "▁"
UNIGRAM, BPE = 1, 2
CACHED = 1 << 20  # remembered word parts and merges per task process
LONGEST_CACHED = 64


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at:at + size]
            at += size


class PieceModel:
    """Pieces, scores and kinds of a model file."""

    def __init__(self, data: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        top = {n: v for n, v in _fields(data) if n in (2, 3)}
        self.kind = dict(_fields(top.get(2, b""))).get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models are known")
        norm = dict(_fields(top.get(3, b"")))
        # an identity normaliser changes nothing but blanks, which encode() then does itself
        self.plain = not norm.get(2) and norm.get(4, 1) == 0 and norm.get(5, 1) == 1
        self.prefix = norm.get(3, 1) == 1
        self.normalizer = None if self.plain else sentencepiece.SentencePieceNormalizer(model_proto=data)
        sp, n = self.library, self.library.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.bytes = {int(self.texts[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        skip = (sp.is_byte, sp.is_control, sp.is_unknown, sp.is_unused)
        self.scores = {p: sp.get_score(i) for i, p in enumerate(self.texts) if not any(f(i) for f in skip)}
        self.longest = max(map(len, self.scores), default=1)
        self.unknown_score = min(self.scores.values(), default=0.0) - 10
        self._history: dict[int, list[tuple[float, str, str]]] = {}
        self._pairs: dict[int, bool] = {}
        self._parts: dict[str, bytes] = {}
        # in merge models only pieces that their own characters merge to
        self.ids = {p: i for i, p in enumerate(self.texts)
                    if p in self.scores and (self.kind == UNIGRAM or len(p) == 1 or self._merges(p))}
        # texts may be cut before a space mark that follows another character if no piece reaches across
        self.cuttable = not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        self.inner = {p[i:i + 2] for p in self.scores for i in range(len(p) - 1)}
        self.out = []
        for i, p in enumerate(self.texts):
            self.out.append(bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i)
                            else b" \xe2\x81\x87 " if i == self.unknown else p.replace(SPACE, " ").encode())

    def _merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """(score, first, last symbol) at first and after each merge; None if the end isn't the piece."""
        seq, steps = list(piece), [(0.0, piece[0], piece[-1])]
        while len(seq) > 1:
            found = [(self.scores[m], -i) for i in range(len(seq) - 1) if (m := seq[i] + seq[i + 1]) in self.scores]
            if not found:
                return None
            score, i = max(found)  # the best, leftmost first
            seq[-i:2 - i] = [seq[-i] + seq[1 - i]]
            steps.append((score, seq[0], seq[-1]))
        return steps

    def _name(self, no: int) -> str:
        """Characters without a piece are numbered after the pieces."""
        return self.texts[no] if no < len(self.texts) else chr(no - len(self.texts))

    def _steps(self, no: int) -> list[tuple[float, str, str]]:
        if no not in self._history:
            self._history[no] = self._merges(self._name(no))
        return self._history[no]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the joint text of two pieces gives them again: no merge across comes up before they end."""
        a, b, i, j, fits = self._steps(left), self._steps(right), 0, 0, True
        none = float("-inf")
        while fits:
            across = self.scores.get(a[i][2] + b[j][1])
            own = a[i + 1][0] if i + 1 < len(a) else none
            other = b[j + 1][0] if j + 1 < len(b) else none
            if across is not None and across > own and across >= other:  # ties go to the left
                fits = False
            elif own == none and other == none:
                break
            elif own >= other:
                i += 1
            else:
                j += 1
        if len(self._pairs) < 2 * CACHED:
            self._pairs[left << 21 | right] = fits
        return fits

    def search(self, text: str):
        """Numbers of the pieces of normalised text, in order, committed as the search goes."""
        longest, ids, known, fits, unknown = self.longest, self.ids.get, self._pairs.get, self._fits, len(self.texts)
        merged, scores = self.kind == BPE, self.scores
        done = 0                      # everything before is committed
        last, starts, best = [-1], [0], [0.0]  # of the best path to done + k: last piece, its start, score
        for end in range(1, len(text) + 1):
            low = end - longest if end - done > longest else done
            if merged:
                for start in range(low, end):
                    no = ids(text[start:end])
                    if no is None:
                        if start < end - 1:
                            continue
                        no = unknown + ord(text[start])
                    before = last[start - done]
                    if before < 0 or (ok := known(before << 21 | no)) or ok is None and fits(before, no):
                        break
            else:
                top, no, start = float("-inf"), -1, low
                for at in range(low, end):
                    piece = text[at:end]
                    s = scores.get(piece, self.unknown_score if at == end - 1 else None)
                    if s is not None and best[at - done] + s > top:
                        top, no, start = best[at - done] + s, ids(piece, unknown + ord(piece[0])), at
                best.append(top)
            last.append(no)
            starts.append(start)
            if end - done >= 4 * longest:
                # the boundary that all positions a piece can still start from lead through
                alive = set(range(end - longest + 1, end + 1))
                while len(alive) > 1:
                    far = max(alive)
                    alive.discard(far)
                    alive.add(starts[far - done] if far > done else done)
                common = alive.pop()
                if common > done:
                    yield from self._path(last, starts, done, common)
                    del last[:common - done], starts[:common - done], best[:common - done]
                    done = common
        yield from self._path(last, starts, done, len(text))

    @staticmethod
    def _path(last: list[int], starts: list[int], done: int, end: int) -> list[int]:
        path = []
        while end > done:
            path.append(last[end - done])
            end = starts[end - done]
        return path[::-1]

    def numbers(self, found) -> list[int]:
        """Ids of searched pieces; characters without a piece as bytes, or as the unknown id, joined."""
        ids, size = [], len(self.texts)
        for no in found:
            if no < size:
                ids.append(no)
            elif self.bytes:
                ids += [self.bytes[b] for b in chr(no - size).encode("utf-8", "surrogatepass")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def _part(self, part: str) -> bytes:
        """Ids of a part. Where two characters are in no piece together all paths meet, and it is cut."""
        cuts = [i for i in range(1, len(part)) if part[i - 1:i + 1] not in self.inner]
        if cuts:
            made = b"".join(self._parts.get(p) or self._piece_part(p)
                            for p in (part[i:j] for i, j in zip([0, *cuts], [*cuts, len(part)])))
            return self._remember(part, made)
        return self._piece_part(part)

    def _piece_part(self, part: str) -> bytes:
        return self._remember(part, array("i", self.numbers(self.search(part))).tobytes())

    def _remember(self, part: str, made: bytes) -> bytes:
        if len(part) <= LONGEST_CACHED:
            if len(self._parts) >= CACHED:  # forget the older half
                self._parts = dict(islice(self._parts.items(), CACHED // 2, None))
            self._parts[part] = made
        return made

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        if self.plain:
            text = text.replace(" ", SPACE)
            text = SPACE + text if self.prefix and text else text
        else:
            text = self.normalizer.normalize(text)
        if not self.cuttable or not self.bytes:
            return np.array(self.numbers(self.search(text)), np.int32).tobytes()
        # space marks belong to what follows; a run of them stays whole
        parts, run = [], ""
        for k, part in enumerate(text.split(SPACE)):
            if k:
                run += SPACE
            if part:
                parts.append(run + part)
                run = ""
        if run:
            parts.append(run)
        known = list(map(self._parts.get, parts))
        if None in known:
            known = [self._part(p) if k is None else k for p, k in zip(parts, known)]
        return b"".join(known)

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def _encoded(path: str):
    model = load(path)

    def work(texts):
        made = [model.encode(t or "") for t in texts]
        ends = np.cumsum([0] + [len(m) // 4 for m in made], dtype=np.int64).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), np.int32)))]
    return work


def _decoded(path: str):
    model = load(path)
    return lambda rows: [[model.decode(ids or ()) for ids in rows]]


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids``, array<int>. Null and empty texts have no ids. ``path`` is the model file, on every executor."""
    return add_columns(df, text, "ids array<int>", partial(_encoded, path))


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of an id column; null or no ids give ''."""
    return add_columns(df, ids, f"`{name}` string", partial(_decoded, path))


def _checked(path: str):
    model = load(path)

    def work(texts):
        made = [model.encode(t or "") for t in texts]
        ends = np.cumsum([0] + [len(m) // 4 for m in made], dtype=np.int64).astype(np.int32)
        flat = np.frombuffer(b"".join(made), np.int32)
        values = flat.tolist()
        back = [model.decode(values[a:b]) for a, b in zip(ends, ends[1:])]
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), (ends[1:] - ends[:-1]).tolist(), back]
    return work


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids``, ``n_tokens``, ``decoded`` and ``round_trip``: whether decoding gives the text again."""
    made = add_columns(df, text, "ids array<int>, n_tokens long, decoded string", partial(_checked, path))
    return made.withColumn("round_trip", F.col("decoded") == F.coalesce(text, F.lit("")))
