"""SentencePiece encoding and decoding that keeps offsets into the original text.

A text is normalised by the model's compiled character map: at every place the
longest source prefix that the map's double-array trie holds is replaced, and
every byte of the result remembers the source byte it came from. The result is
split where no piece of the vocabulary can reach across, every part is merged by
the scores of the pieces, and pieces are projected to byte spans of the original
text. Parts repeat, so each task keeps those it has met lately; the new ones of a
batch of texts are merged together, as arrays, a pair of each part at a time.

Models of the byte-pair kind are read, with or without byte fallback. Models with
user-defined or unused pieces, white space as suffix, or another kind raise.

Defined results: null counts as the empty text, whose ids are the begin and end
ids alone; a byte that comes from no source, such as the space put in front, has
an empty span at its place; rows and ids may repeat.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import model_file, release, sliced

SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts of at most so many characters are kept, in two generations of at most so many each.
KEPT_CHARS, KEPT_PARTS = 48, 200_000
#: Bytes of texts that are encoded together: what Python holds of them on the way is about thirty times as much.
TOGETHER = 256 << 10
#: Parts of at most so many characters are merged together with others.
SHORT = 64
#: The score of two neighbours that make up no piece.
NEVER = -(1 << 62)


class CharacterMap:
    """A compiled map: a little-endian size, a trie of 32-bit units of that many bytes, and replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest prefix of data[at:] that the trie holds, and its replacement."""
        units, found = self.units, None
        node = self._child(0, units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node = self._child(node, unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.texts[start : self.texts.index(0, start)]

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ (unit >> 10) << ((unit & 0x200) >> 6)


class Normalizer:
    """The model's normalisation, with the source byte of every byte of the result."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool = True):
        self.map = CharacterMap(charsmap) if charsmap else None
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze
        self.space = SPACE.encode() if escape else b" "

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and their end, a source offset. data is valid UTF-8."""
        out, source, at, n = bytearray(), [], 0, len(data)
        steps = []
        while at < n:
            hit = self.map.longest(data, at) if self.map else None
            length, new = hit or (1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0), None)
            steps.append((at, data[at : at + length] if new is None else new))
            at += length
        if self.squeeze:
            while steps and steps[0][1] == b" ":
                steps.pop(0)
        begin = steps[0][0] if steps else n
        if not steps:
            return b"", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out += self.space
            source += [begin] * len(self.space)
        after_space = self.squeeze
        for at, new in steps:
            if self.squeeze and after_space:
                new = new.lstrip(b" ")
            if new:
                for byte in new:
                    if byte == 32:
                        out += self.space
                        source += [at] * len(self.space)
                    else:
                        out.append(byte)
                        source.append(at)
                after_space = new.endswith(b" ")
            if not self.squeeze:
                after_space = False
        end = n
        if self.squeeze:
            while out.endswith(self.space):
                end = source[-1]
                del out[-len(self.space) :], source[-len(self.space) :]
        return bytes(out), np.array([*source, end], np.int64)


class Codec:
    """Encoder and decoder of one model; parts are merged at most once while they are kept."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(model_file(path), "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        kinds = [p.type for p in model.pieces]
        if model.trainer_spec.model_type != 2 or {USER_DEFINED, UNUSED} & set(kinds) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only plain byte-pair models are read")
        spec = model.normalizer_spec
        self.plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        self.dummy_prefix = spec.add_dummy_prefix
        self.strip_first = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.known = {p: (i, len(p.encode())) for p, i in self.ids.items()}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_ids = {b: i for i, b in self.bytes.items()} if model.trainer_spec.byte_fallback else {}
        self.unknown = kinds.index(UNKNOWN)
        self.begin, self.end = (next(i for i, p in enumerate(model.pieces) if p.piece == s) for s in ("<s>", "</s>"))
        surface = {UNKNOWN: model.trainer_spec.unk_surface or UNKNOWN_SURFACE, CONTROL: ""}
        self.surfaces = [
            bytes([self.bytes[i]]) if p.type == BYTE else surface.get(p.type, p.piece.replace(SPACE, " ")).encode()
            for i, p in enumerate(model.pieces)
        ]
        self.opens = [p.type == NORMAL and p.piece.startswith(SPACE) for p in model.pieces]
        self.pairs = {x + y for p in self.ids for x, y in zip(p, p[1:])}
        self._tables()
        # no piece holds a line break or goes on with a space after something else: most parts end there
        inner = any(x != SPACE and y == SPACE for x, y in self.pairs) or any("\n" in p and len(p) > 1 for p in self.ids)
        self.parts = re.compile("(?s).+" if inner else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        self.new, self.old = {}, {}

    def _tables(self) -> None:
        """Pieces and characters as numbers, and what two of them make up: sorted codes, ranks of scores, results."""
        names = dict.fromkeys([*self.ids, *(c for p in self.ids for c in p)])
        number = {p: i for i, p in enumerate(names)}
        self.size = len(number)
        ranks = {score: i for i, score in enumerate(sorted(set(self.scores.values())))}
        rows = [
            (number[p[:i]] * self.size + number[p[i:]], ranks[self.scores[p]], number[p])
            for p in self.ids
            for i in range(1, len(p))
            if p[:i] in number and p[i:] in number
        ]
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.codes, self.ranks, self.joined = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()
        single = sorted((ord(p), i) for p, i in number.items() if len(p) == 1)
        self.points, self.point_numbers = (np.array([x[k] for x in single], np.int64) for k in (0, 1))
        self.id_of = np.array([self.ids.get(p, -1) for p in names], np.int64)
        self.bytes_of = np.array([len(p.encode()) for p in names], np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        return np.where(hit, self.ranks[at], NEVER), self.joined[at]

    def _merged(self, sym: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all parts, whose characters have the numbers sym, and the part that each is in.

        In each round every part merges its best pair, of equal ones the leftmost, as merge() does."""
        done: list[tuple[np.ndarray, np.ndarray]] = [(sym[:0], part[:0])]
        score, joined = np.full(len(sym), NEVER), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(part[1:] == part[:-1])
        score[inner], joined[inner] = self._pairs(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            best = np.maximum.reduceat(score, starts)
            best = np.repeat(best, np.diff(np.append(starts, len(sym))))
            on = best > NEVER
            if not on.all():
                done.append((sym[~on], part[~on]))
                sym, part, score, joined, best = sym[on], part[on], score[on], joined[on], best[on]
            at = np.flatnonzero(score == best)
            at = at[np.concatenate([[True], part[at[1:]] != part[at[:-1]]])[: len(at)]]
            sym[at] = joined[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, part, score, joined = sym[keep], part[keep], score[keep], joined[keep]
            at -= np.arange(len(at))
            for i in (at[at > 0] - 1, at):
                score[i] = NEVER
                i = i[i + 1 < len(sym)]
                i = i[part[i] == part[i + 1]]
                score[i], joined[i] = self._pairs(sym[i], sym[i + 1])
        sym, part = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(part, kind="stable")
        return sym[order], part[order]

    def learn(self, texts: list[str]) -> dict[str, bytes]:
        """Ids, each with its length in bytes of the normalised text, of parts; both as 32-bit integers."""
        short = [x for x in texts if len(x) <= SHORT]
        found = {}
        if short:
            points = np.frombuffer("".join(short).encode("utf-32-le"), np.uint32).astype(np.int64)
            at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
            known = self.points[at] == points
            part = np.repeat(np.arange(len(short)), np.fromiter(map(len, short), np.int64, len(short)))
            odd = np.zeros(len(short), bool)
            odd[part[~known]] = True
            plain = ~odd[part]
            sym, part = self._merged(self.point_numbers[at[plain]], part[plain])
            ids = self.id_of[sym]
            odd[part[ids < 0]] = True
            ends = 8 * np.searchsorted(part, np.arange(len(short)), side="right")
            data = np.stack([ids, self.bytes_of[sym]], axis=1).astype("<u4").tobytes()
            low = 0
            for x, high, is_odd in zip(short, ends.tolist(), odd.tolist()):
                if not is_odd:
                    found[x] = data[low:high]
                low = high
        for x in texts:
            if x not in found:  # long, or with characters that are no piece
                found[x] = self._numbers(merge(x, self.scores))
        for x, got in found.items():
            self._keep(x, got)
        return found

    def _keep(self, text: str, got: bytes) -> None:
        if len(text) <= KEPT_CHARS:
            if len(self.new) >= KEPT_PARTS:
                self.new, self.old = {}, self.new
            self.new[text] = got

    def _numbers(self, pieces: list[str]) -> bytes:
        ids, lengths = [], []
        for p in pieces:
            known = self.known.get(p)
            if known is not None:
                ids.append(known[0])
                lengths.append(known[1])
            elif self.byte_ids:
                data = p.encode()
                ids += [self.byte_ids[b] for b in data]
                lengths += [0] * (len(data) - 1) + [len(data)]  # the character's last byte carries its span
            else:
                ids.append(self.unknown)
                lengths.append(len(p.encode()))
        return np.array([ids, lengths], "<u4").T.tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids without begin and end, and for each the end of its byte span; the spans of a text follow one another."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """encode() of each text. Distinct parts are looked up once, and laid out for all texts as arrays."""
        prepared = [self._normal(text) for text in texts]
        parts = [self.parts.findall(norm) for norm, _ in prepared]
        which, distinct = pd.factorize(np.array([p for own in parts for p in own], object))
        new, old = self.new, self.old
        more = self.learn([p for p in distinct if p not in new and p not in old])
        got = [new.get(p) or more.get(p) or old[p] for p in distinct]
        sizes = np.array([len(x) // 8 for x in got], np.int64)
        each = sizes[which]
        upto = np.cumsum(each)
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - (upto - each), each) + np.arange(int(each.sum()))
        known = np.frombuffer(b"".join(got), "<u4").reshape(-1, 2)
        all_ids, all_ends = known[at, 0], np.cumsum(known[at, 1], dtype=np.int64)
        out, low = [], 0
        for text, (norm, source), high in zip(texts, prepared, np.append(0, upto)[np.cumsum([len(own) for own in parts])].tolist()):
            ids, ends = all_ids[low:high], all_ends[low:high] - (all_ends[low - 1] if low else 0)
            low = high
            if not self.byte_ids and len(ids):  # the library gives a run of unknown characters one id
                keep = np.append((ids[1:] != self.unknown) | (ids[:-1] != self.unknown), True)
                ids, ends = ids[keep], ends[keep]
            if text and len(ends):
                ends = source[ends] if source is not None else self._plain_ends(text, norm, ends)
            out.append((ids, ends))
        return out

    def _normal(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normal form, and the source of its bytes where the model has a character map."""
        if not text:
            return "", None
        if self.plain:  # the map is empty: every byte stays or becomes the space sign
            return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE), None
        data, source = self.normalize(text.encode())
        return data.decode(), source

    def _plain_ends(self, text: str, norm: str, ends: np.ndarray) -> np.ndarray:
        """Offsets in text for offsets in its plain form, in which spaces are two bytes longer and one may stand in front."""
        raw = np.frombuffer(norm.encode(), np.uint8)
        sign = np.frombuffer(SPACE.encode(), np.uint8)
        starts = np.flatnonzero((raw[:-2] == sign[0]) & (raw[1:-1] == sign[1]) & (raw[2:] == sign[2]))
        if SPACE in text:  # such a sign in the text itself is no shorter there
            own = [i for i, c in enumerate(text) if c in " " + SPACE]
            width = np.array([1 if text[i] == " " else 3 for i in own])
            saved = 3 - np.concatenate([[0] * self.dummy_prefix, width]).astype(np.int64)
        else:
            saved = np.full(len(starts), 2, np.int64)
            saved[:1] += self.dummy_prefix
        before = np.concatenate([[0], np.cumsum(saved)])
        return ends - before[np.searchsorted(starts, ends)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes that don't make up characters each become U+FFFD."""
        numbers = ids.tolist()
        if not numbers:
            return ""
        first = next((i for i in numbers if self.surfaces[i]), numbers[0])
        data = b"".join(map(self.surfaces.__getitem__, numbers))
        if self.strip_first and self.opens[first]:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return re.sub("[\udc80-\udcff]", "�", data.decode(errors="surrogateescape"))


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """text's characters, merged pair by pair: the pair with the highest score first, of equal ones the leftmost."""
    if len(text) > 200:
        return _merge_long(text, scores)
    parts, low = list(text), float("-inf")
    get = scores.get
    marks = [get(a + b, low) for a, b in zip(parts, parts[1:])]
    while marks:
        best = max(marks)
        if best == low:
            break
        i = marks.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del marks[i]
        if i:
            marks[i - 1] = get(parts[i - 1] + parts[i], low)
        if i < len(marks):
            marks[i] = get(parts[i] + parts[i + 1], low)
    return parts


def _merge_long(text: str, scores: dict[str, float]) -> list[str]:
    """The same by a heap and linked neighbours, in n log n steps."""
    parts: list[str | None] = list(text)
    n = len(parts)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(-scores[a + b], i, a + b) for i, (a, b) in enumerate(zip(text, text[1:])) if a + b in scores]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = right[i] if parts[i] is not None else -1
        if j < 0 or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j] = joined, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0 and (pair := parts[a] + parts[b]) in scores:
                heapq.heappush(heap, (-scores[pair], a, pair))
    return [p for p in parts if p is not None]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _spans(ends: np.ndarray) -> np.ndarray:
    """The ends of a text's pieces, with those of begin and end, which cover nothing."""
    return np.concatenate([[0], ends, ends[-1:] if len(ends) else [0]]).astype(np.int64)


def _encoder(path: str, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in sliced(batches, TOGETHER):
            ids, ends = [], []
            for i, e in c.encode_all([text or "" for text in batch.column(batch.num_columns - 1).to_pylist()]):
                ids.append(np.concatenate([[c.begin], i, [c.end]]).astype(np.int32))
                ends.append(_spans(e))
            arrays = [_lists(ids, pa.int32())] + ([_lists(ends, pa.int64())] if spans else [])
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            names = [*batch.schema.names[:-1], "ids", "ends"][: len(kept) + len(arrays)]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], names)
        c.forget()
        release()

    return run


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, []]).astype(kind.to_pandas_dtype()), kind))


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids with begin and end, ends: piece k of a text covers the bytes from ends[k-1], or 0, to ends[k]."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encoder(model, True), f"doc_id {kind}, ids array<int>, ends array<bigint>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows of doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in sliced(batches, TOGETHER):
            texts = [c.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def _digests(c: Codec, texts: list[str | None], with_ids: bool) -> list[pa.Array]:
    """n_tokens, ids_sha256, decoded_sha256, covered_bytes of texts; with ids and ends before them if asked."""
    every, spans, out = [], [], ([], [], [], [])
    for ids, ends in c.encode_all([text or "" for text in texts]):
        whole = np.concatenate([[c.begin], ids, [c.end]]).astype("<u4")
        decoded = c.decode(whole).encode()
        digests = hashlib.sha256(whole.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()
        for column, value in zip(out, (len(whole), *digests, int(ends[-1]) if len(ends) else 0)):
            column.append(value)
        if with_ids:
            every.append(whole.astype(np.int32))
            spans.append(_spans(ends))
    arrays = list(map(pa.array, out, (pa.int64(), pa.string(), pa.string(), pa.int64())))
    return [_lists(every, pa.int32()), _lists(spans, pa.int64()), *arrays] if with_ids else arrays


def _with_digests(rows: DataFrame, model: str, with_ids: bool) -> DataFrame:
    """rows with their last column, the text, replaced by what _digests gives."""
    names = ["ids", "ends"] * with_ids + ["n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"]
    types = ["array<int>", "array<bigint>"] * with_ids + ["bigint", "string", "string", "bigint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in sliced(batches, TOGETHER):
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            texts = batch.column(batch.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*kept, *_digests(c, texts, with_ids)], [*batch.schema.names[:-1], *names])
        c.forget()
        release()

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join(kinds + [f"{n} {t}" for n, t in zip(names, types)]))


def digest_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes (the end of the last span): encoded and
    decoded in one pass, so that the ids themselves need not leave the task."""
    return _with_digests(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, False)


def encode_rows(docs: DataFrame, model: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs, then ids, ends and the columns of digest_documents, for every row."""
    return _with_digests(docs.select(*keep, F.col(text_col).alias("text")), model, True)
