"""SentencePiece encoding with the source bytes of every piece, and decoding.

Normalisation is done here, not by the library: the model's compiled character map, a double-array
trie of source strings, is matched by longest prefix, and every normalised character keeps the
source offset of the match that made it.  Pieces are then spans of normalised characters, and so
spans of source bytes.  Segmentation merges by score within segments that begin at word starts, which no
piece of the model crosses: of some million characters at a time, every different segment is merged
once, thousands of them together in array operations.  Nothing is kept from one batch to the next.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

#: The visible space, and the piece types of model files.
VISIBLE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SHORT = 48
NEVER = float("inf")
NO_RANK = np.iinfo(np.int32).max
AT_ONCE = 1 << 21
TOGETHER = 1 << 13


class CharMap:
    """A compiled character map: longest prefix of source bytes -> normalised text."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """(bytes matched, their replacement) for the longest source string that data has at `at`."""
        units, best = self.units, None
        node = self._base(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._base(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)].decode()
        return best

    @staticmethod
    def _base(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


def byte_offsets(text: str) -> np.ndarray:
    """The UTF-8 offset of every character, and of the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.zeros(len(codes) + 1, dtype=np.int32)
    np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), out=out[1:], dtype=np.int32)
    return out


class Normalizer:
    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool):
        self.map = CharMap(charsmap) if charsmap else None
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze

    def mapped(self, text: str) -> tuple[str, np.ndarray]:
        """The text with replacements made; the source offset of each character of it, and of the end."""
        offsets = byte_offsets(text)
        if not self.map:
            return text, offsets
        data, out, starts, at = text.encode("utf-8", "replace"), [], [], 0
        for i, char in enumerate(text):
            if offsets[i] < at:  # inside a match
                continue
            found = self.map.longest(data, at)
            used, new = found or (len(char.encode("utf-8", "replace")), char)
            out.append(new)
            starts += [at] * len(new)
            at += used
        return "".join(out), np.array([*starts, len(data)], dtype=np.int32)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        new, starts = self.mapped(text)
        if self.squeeze and new:
            keep = np.array([c != " " for c in new])
            keep[1:] |= keep[:-1]  # a space after another character stays, at the end it doesn't
            keep[0] = new[0] != " "
            end = len(new.rstrip(" " + VISIBLE))
            keep[end:] = False
            new = "".join(c for c, k in zip(new, keep, strict=True) if k)
            starts = np.append(starts[:-1][keep], starts[end])
        if not new:
            return "", starts[-1:]
        if self.dummy_prefix:
            new, starts = " " + new, np.insert(starts, 0, starts[0])
        return new.replace(" ", VISIBLE), starts


class Merger:
    """Byte-pair merging of many short segments at once.

    A segment is a row of piece numbers.  In each round every row that still can merges its best
    pair, the leftmost of equals, and closes up; ranks are looked up only beside the merge.
    """

    def __init__(self, ids: dict[str, int], scores: dict[str, float]):
        order = {score: i for i, score in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {(ids[p[:i]], ids[p[i:]]): p for p in ids for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids}
        self.width = max(ids.values()) + 1
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full((1 << self.bits, 2), NO_RANK, dtype=np.int32)
        for (a, b), p in pairs.items():  # an open table: the next free place after the hash
            key = a * self.width + b
            at = int(self._hash(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = at + 1 & len(self.keys) - 1
            self.keys[at], self.values[at] = key, (order[scores[p]], ids[p])
        self.of_char = -2 - np.arange(0x110000, dtype=np.int32)  # a character that is no piece: its code below -1
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(rank, piece) of each pair; a rank of NO_RANK where it makes none."""
        wanted = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.width + b, -2)
        at = self._hash(wanted)
        held = self.keys[at]
        other = np.flatnonzero((held != wanted) & (held >= 0))
        while len(other):
            at.flat[other] = at.flat[other] + 1 & len(self.keys) - 1
            held.flat[other] = self.keys[at.flat[other]]
            other = other[(held.flat[other] != wanted.flat[other]) & (held.flat[other] >= 0)]
        found = self.values[at]
        found[held != wanted] = NO_RANK
        return found

    def __call__(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece numbers of all segments in a row, how many each has); -2 less its code for a character that is no piece."""
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        n, wide = len(segments), int(sizes.max())
        places = np.arange(wide)
        here = places < sizes[:, None]
        rows = np.full((n, wide), -1, dtype=np.int32)
        rows[here] = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        ranks = np.full((n, wide), NO_RANK, dtype=np.int32)
        ranks[:, :-1] = self._find(rows[:, :-1], rows[:, 1:])[..., 0]
        out, left = rows, np.arange(n)
        while len(left):
            at = ranks.argmin(axis=1)
            going = ranks[np.arange(len(left)), at] < NO_RANK
            if not going.all():
                out[left[~going]] = rows[~going]
                left, rows, ranks, at = left[going], rows[going], ranks[going], at[going]
                if not len(left):
                    break
            each = np.arange(len(left))
            merged = self._find(rows[each, at], rows[each, at + 1])[:, 1]
            closer = np.minimum(places + (places > at[:, None]), wide - 1)
            rows, ranks = np.take_along_axis(rows, closer, 1), np.take_along_axis(ranks, closer, 1)
            rows[:, -1], ranks[:, -1] = -1, NO_RANK
            rows[each, at] = merged
            before = np.maximum(at - 1, 0)
            ranks[each, at] = np.where(at + 1 < wide, self._find(merged, rows[each, np.minimum(at + 1, wide - 1)])[:, 0], NO_RANK)
            ranks[each, before] = np.where(at > 0, self._find(rows[each, before], merged)[:, 0], ranks[each, before])
            sizes[left] -= 1
        return out[places < sizes[:, None]], sizes


class Codec:
    """A BPE model: its normalisation, segmentation and decoding."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        rules, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != trainer.BPE or any(p.type in (USER, UNUSED) for p in model.pieces):
            raise ValueError("only BPE models without user-defined or unused pieces can be compiled")
        if any(VISIBLE in p.piece.lstrip(VISIBLE) for p in model.pieces):
            raise ValueError("a piece of this model crosses a word's start")
        self.normalize = Normalizer(rules.precompiled_charsmap, rules.add_dummy_prefix, rules.remove_extra_whitespaces)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_ids = np.array([self.bytes.get(b, 0) for b in range(256)], dtype=np.int32)
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.surface = [(p.piece.replace(VISIBLE, " ") if p.type == NORMAL else trainer.unk_surface if p.type == UNKNOWN else "") for p in model.pieces]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.strip = rules.add_dummy_prefix
        self.merger = Merger(self.ids, {p: -c for p, c in self.cost.items()})
        self.chars = np.ones(len(model.pieces), dtype=np.int32)
        for p, i in self.ids.items():
            self.chars[i] = len(p)
        self.older: dict[str, tuple[bytes, bytes, str]] = {}
        self.parts: dict[str, tuple[bytes, bytes, str]] = {}
        self.find = re.compile(f"{VISIBLE}*[^{VISIBLE}]+|{VISIBLE}+").findall

    def merge(self, text: str) -> list[str]:
        """Pieces: the neighbours with the best score join first, the leftmost of equals."""
        if len(text) > SHORT:
            return self._merge_long(text)
        parts, cost = list(text), self.cost.get
        costs = [cost(text[i : i + 2], NEVER) for i in range(len(text) - 1)]
        while costs and (best := min(costs)) < NEVER:
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], NEVER)
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], NEVER)
        return parts

    def _merge_long(self, text: str) -> list[str]:
        """The same by a queue, in time that hardly grows faster than the text."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (cost := self.cost.get(joined := parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (cost, i, joined))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, joined = heapq.heappop(queue)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def split(self, segment: str) -> tuple[list[int], list[int]]:
        """Ids of one segment, and the characters of each: a character outside the vocabulary belongs to the last of its bytes."""
        ids, lengths = [], []
        for piece in self.merge(segment):
            if (known := self.ids.get(piece)) is not None:
                ids.append(known)
                lengths.append(len(piece))
            elif self.bytes:
                raw = piece.encode("utf-8", "replace")
                ids += [self.bytes[b] for b in raw]
                lengths += [0] * (len(raw) - 1) + [1]
            else:
                ids.append(self.unknown)
                lengths.append(len(piece))
        return ids, lengths

    def _spelled(self, pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, characters of each, ids of each segment) with characters outside the vocabulary spelled by their UTF-8 bytes, or unknown."""
        out = pieces < 0
        if not out.any():
            return pieces, self.chars[pieces], sizes
        if not self.bytes:
            return np.where(out, self.unknown, pieces), np.where(out, 1, self.chars[np.where(out, 0, pieces)]), sizes
        code = np.where(out, -2 - pieces, 0)
        n = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=n, minlength=len(sizes)).astype(np.int64)
        pieces, code, out, each = (np.repeat(v, n) for v in (pieces, code, out, n))
        k = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)  # which byte of its character
        byte = code >> 6 * (each - 1 - k)
        byte = np.where(k > 0, byte & 0x3F | 0x80, byte | np.array([0, 0, 0xC0, 0xE0, 0xF0])[each])
        ids = np.where(out, self.byte_ids[np.where(out, byte, 0)], pieces)
        return ids.astype(np.int32), np.where(out, k == each - 1, self.chars[np.where(out, 0, pieces)]).astype(np.int32), sizes

    def split_all(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(ids, characters of each id, ids of each segment, what each segment decodes to) of segments in order of length."""
        ids, lengths, counts, decoded = [], [], [], [s.replace(VISIBLE, " ") for s in segments]
        short = bisect_right(segments, SHORT, key=len)
        for i in range(0, short, TOGETHER):
            some = segments[i : min(short, i + TOGETHER)]
            pieces, sizes = self.merger(some)
            if (pieces < 0).any() and not self.bytes:
                for k in np.unique(np.repeat(np.arange(len(some)), sizes)[pieces < 0]).tolist():
                    decoded[i + k] = self.joined(self.split(some[k])[0])
            pieces, chars, sizes = self._spelled(pieces, sizes)
            ids.append(pieces)
            lengths.append(chars)
            counts.append(sizes)
        for k in range(short, len(segments)):
            own, of = self.split(segments[k])
            decoded[k] = self.joined(own)
            ids.append(np.array(own, np.int32))
            lengths.append(np.array(of, np.int32))
            counts.append(np.array([len(own)]))
        return np.concatenate(ids), np.concatenate(lengths), np.concatenate(counts), decoded

    def joined(self, ids: list[int]) -> str:
        out, raw = [], b""
        for i in ids:
            if i in self.byte_of:
                raw += bytes([self.byte_of[i]])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = b""
            out.append(self.surface[i])
        return "".join(out) + raw.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self._bare(self.joined(ids))

    def _bare(self, text: str) -> str:
        return text[1:] if self.strip and text.startswith(" ") else text

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """(ids, first bytes, end bytes, decoded text); spans are of the source's UTF-8."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """encode of each text; some are taken together, so that their new segments are merged at once."""
        held, size = [], 0
        for text in texts:
            normal, starts = self.normalize(text or "")
            held.append((self.find(normal), starts))
            size += len(normal)
            if size > AT_ONCE:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list[tuple[list[str], np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """Each different segment is split once; texts then take theirs by number."""
        distinct = sorted(set(chain.from_iterable(segments for segments, _ in held)), key=len)
        if distinct:
            ids, lengths, counts, decoded = self.split_all(distinct)
            offsets = np.cumsum(counts) - counts
            number = dict(zip(distinct, range(len(distinct)), strict=True))
        for segments, starts in held:
            if not segments:
                yield np.zeros(0, np.int32), starts[:0], starts[:0], ""
                continue
            which = [number[s] for s in segments]
            own = np.array(which)
            sizes = counts[own]
            upto = np.cumsum(sizes)
            places = np.repeat(offsets[own] - upto + sizes, sizes) + np.arange(upto[-1])
            ends = np.cumsum(lengths[places])
            begins = np.concatenate(([0], ends[:-1]))
            yield ids[places], starts[begins], starts[ends], self._bare("".join([decoded[i] for i in which]))


@lru_cache(2)
def compiled(proto: bytes) -> Codec:
    """One compiled model for each Python worker."""
    return Codec(proto)


_ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("begins", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def encoded(text: Column, path: str) -> Column:
    """struct(ids, begins, ends, decoded) of each whole text; null is encoded as the empty text, which has no pieces.

    begins and ends are byte offsets into the text: piece i is made of bytes begins[i] up to ends[i].
    Neighbouring spans meet, the first begins at 0 and the last ends with the text, so no byte is
    lost.  Of the bytes that stand in for a character outside the vocabulary, the last has its span.
    The model file (a fixed few MB) is read here, on the driver, and goes with the function.
    """
    with open(path, "rb") as f:
        proto = f.read()

    @F.arrow_udf(_ENCODED)
    def run(texts: pa.Array) -> pa.Array:
        codec = compiled(proto)
        rows = list(codec.encode_all(t.as_py() for t in texts))
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(r[0]) for r in rows]))).astype(np.int32))
        flat = [pa.array(np.concatenate([np.zeros(0, np.int32), *(r[k] for r in rows)])) for k in range(3)]
        lists = [pa.ListArray.from_arrays(offsets, values) for values in flat]
        return pa.StructArray.from_arrays([*lists, pa.array([r[3] for r in rows], type=pa.string())], names=["ids", "begins", "ends", "decoded"])

    return run(text)
