"""SentencePiece encoding that keeps offsets, and decoding.

Texts are normalised here, by longest prefixes through the model's compiled character map (a double array over UTF-8), and
every normalised byte records the source byte it came from. All characters of a chunk walk down the map together; a model
without a map has nothing to walk, but goes the same way. The normalised text is cut in front of each run of space marks (no
piece crosses such a cut, which is checked per model), equal segments are segmented once by the library's own model without a
normaliser, and each piece is projected through the alignment to the byte span of its source.

Defined cases: a null text counts as empty; an empty text has only the begin and end ids asked for. Bytes that are not UTF-8
count as U+FFFD, and spans then refer to the text with U+FFFD. Texts of any length are encoded whole. Repeated rows are
encoded one by one. Columns of the input other than those named are carried along only when asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, column_bytes, fields_of, held, ranges, runs
from .common import pieces as parts_of

MARK = "▁"
SPACE_RUN = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")
MOST_WORDS = 100_000
#: Bytes of text that a worker encodes at a time.
CHUNK = 1 << 18


class CharacterMap:
    """The compiled map: a double array of 32-bit units, then the replacement strings, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little")
        self.array = np.frombuffer(blob[4 : 4 + n], "<u4")
        self.units = self.array.tolist()
        self.strings = blob[4 + n :]
        self.bytes = np.frombuffer(self.strings, np.uint8)
        self.ends = np.flatnonzero(self.bytes == 0)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at a byte."""
        units, node, found = self.units, 0, None
        node = self._child(units[0], node)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node = self._child(unit, node)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end]

    def matches(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest keys that start at some places (`end`: where their texts end): those with one, its length, and where its
        replacement begins."""
        units, size, value = self.array, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        lane = np.arange(len(at))
        node = np.full(len(at), self._child(int(units[0]), 0), np.int64)
        step = 0
        while len(lane):
            byte = data[at[lane] + step].astype(np.int64)
            node ^= byte
            unit = np.where(node < len(units), units[np.minimum(node, len(units) - 1)], 0).astype(np.int64)
            good = (node < len(units)) & (unit & 0x800000FF == byte)
            lane, node, unit = lane[good], node[good], unit[good]
            node = node ^ (unit >> 10) << ((unit & 0x200) >> 6)
            step += 1
            leaf = (unit >> 8 & 1).astype(bool)
            size[lane[leaf]], value[lane[leaf]] = step, units[node[leaf]].astype(np.int64) & 0x7FFFFFFF
            more = at[lane] + step < end[lane]
            lane, node = lane[more], node[more]
        hit = np.flatnonzero(size)
        return at[hit], size[hit], value[hit]

    @staticmethod
    def _child(unit: int, node: int) -> int:
        return node ^ (unit >> 10) << ((unit & 0x200) >> 6)


class Codec:
    """A model with its normaliser replaced by ours. model: the bytes of a .model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.full = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        own = [p.piece for p in proto.pieces if p.type == pb.ModelProto.SentencePiece.USER_DEFINED]
        self.own = re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True))).encode()) if own else None
        crossing = any(a != MARK and b == MARK for p in proto.pieces for a, b in zip(p.piece, p.piece[1:]))
        self.cut = not (crossing or self.suffix or own) and self.escape
        self.one_by_one = bool(own) or self.suffix  # rare kinds of models
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        byte = pb.ModelProto.SentencePiece.BYTE
        self.width = np.array([1 if p.type == byte else len(p.piece.encode()) for p in proto.pieces], np.int32)
        self.unk = self.full.unk_id()
        self.forget()

    def forget(self) -> None:
        """Empties the memory of segments: their numbers, and ids and widths one after the other."""
        self.known: dict[str, int] = {}
        self.pool, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte it stands for: step by step."""
        out, origin, at, n = bytearray(), [], 0, len(data)
        mark = MARK.encode() if self.escape else b" "
        if self.squeeze:
            while at < n and (step := self._step(data, at))[1] == b" ":
                at += step[0]
        if at >= n:
            return b"", np.array([at if n else 0], np.int64)

        def put(piece: bytes, where: int) -> None:
            out.extend(piece)
            origin.extend([where] * len(piece))

        if self.prefix and not self.suffix:
            put(mark, at)
        after_space = self.squeeze
        while at < n:
            size, text = self._step(data, at)
            if after_space:
                text = text.lstrip(b" ")
            if text:
                put(text.replace(b" ", mark), at)
                after_space = text.endswith(b" ")
            at += size
            after_space = after_space and self.squeeze
        if self.squeeze:
            while out.endswith(mark):
                at = origin[len(out) - len(mark)]
                del out[-len(mark) :], origin[len(out) :]
        if self.prefix and self.suffix:
            put(mark, at)
        return bytes(out), np.array([*origin, at], np.int64)

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        if self.own and (hit := self.own.match(data, at)):
            return len(hit[0]), hit[0]
        if self.map and (hit := self.map.longest(data, at)):
            return hit
        size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return size, data[at : at + size]

    def normalise_all(self, texts: Sequence[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """`normalise` of many texts at once: the normalised texts, one after the other, their offsets, and the alignment, which
        has one entry more than bytes for each text."""
        if self.one_by_one:
            found = [self.normalise(t) for t in texts]
            return b"".join(n for n, _ in found), runs(np.array([len(n) for n, _ in found], np.int64)), np.concatenate([o for _, o in found]) if found else np.zeros(0, np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        first, joined = runs(sizes), b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        start = np.arange(len(data))  # of the character that a byte is in
        if not joined.isascii():
            start[data & 0xC0 == 0x80] = 0
            np.maximum.accumulate(start, out=start)
        norm, origin, at, firm, base = data, start, first, None, None
        if self.map:
            here = np.flatnonzero(start == np.arange(len(data)))
            hit, size, value = self.map.matches(data, here, np.repeat(first[1:], sizes)[here])
            if (hit[1:] < (hit + size)[:-1]).any():  # keys of several characters hide those that start within
                end, keep = 0, []
                for i, (a, b) in enumerate(zip(hit.tolist(), (hit + size).tolist())):
                    if a >= end:
                        keep.append(i)
                        end = b
                hit, size, value = hit[keep], size[keep], value[keep]
            if len(hit):
                length = self.map.ends[np.searchsorted(self.map.ends, value)] - value
                pool = np.concatenate([data, self.map.bytes])
                source, lengths = np.zeros(2 * len(hit) + 1, np.int64), np.zeros(2 * len(hit) + 1, np.int64)
                source[2::2] = hit + size
                source[1::2] = len(data) + value
                lengths[0::2] = np.append(hit, len(data)) - source[0::2]
                lengths[1::2] = length
                index = ranges(source, lengths)
                norm, place = pool[index], runs(lengths)
                replaced = np.repeat(np.arange(len(lengths)) % 2 == 1, lengths)
                origin = np.where(replaced, 0, start[np.minimum(index, max(0, len(data) - 1))])
                origin[replaced] = np.repeat(hit, length)
                at = first + np.concatenate([[0], np.cumsum(length - size)])[np.searchsorted(hit, first)]
                if self.squeeze and len(odd := np.flatnonzero(length > 1)):  # only the spaces that lead a replacement may go
                    firm, base = np.zeros(len(norm), bool), np.arange(len(norm))
                    for i in odd[[32 in norm[place[2 * i + 1] : place[2 * i + 2]] for i in odd]]:
                        a, b = place[2 * i + 1], place[2 * i + 2]
                        lead = len(piece := norm[a:b].tobytes()) - len(piece.lstrip(b" "))
                        base[a : a + lead], firm[a + lead : b] = a, True
        space = norm == 32
        lead_at = np.zeros(len(texts), np.int64)  # where a text begins for the prefix
        if self.squeeze and len(norm):
            before = np.concatenate([[True], space[:-1]])
            before[at[:-1][at[:-1] < len(norm)]] = True
            gone = space & (before if base is None else before[base] & ~firm)
            for i in np.flatnonzero((np.diff(at) > 0) & space[np.minimum(at[:-1], len(norm) - 1)]):
                while lead_at[i] < sizes[i] and (step := self._step(texts[i], int(lead_at[i])))[1] == b" ":
                    lead_at[i] += step[0]
            there = ~gone
            at = np.concatenate([[0], np.cumsum(there)])[at]
            norm, origin, space = norm[there], origin[there], space[there]
        mark = np.frombuffer(MARK.encode() if self.escape else b" ", np.uint8)
        width = np.where(space, len(mark), 1)
        lead = np.where(lead_at < sizes, len(mark) if self.prefix else 0, 0)
        count = np.diff(at)
        dest = runs(width)
        new_at = runs(np.diff(dest[at]) + lead)
        out, aligned = np.zeros(new_at[-1], np.uint8), np.zeros(new_at[-1] + len(texts), np.int64)
        owner = np.repeat(np.arange(len(texts)), count)
        dest = dest[:-1] + np.cumsum(lead)[owner]
        relative = origin - first[:-1][owner]
        out[dest] = norm
        aligned[dest + owner] = relative
        for j in range(len(mark)):
            out[dest[space] + j] = mark[j]
            aligned[dest[space] + j + owner[space]] = relative[space]
            some = np.flatnonzero(lead)
            out[new_at[some] + j] = mark[j]
            aligned[new_at[some] + j + some] = lead_at[some]
        aligned[new_at[1:] + np.arange(len(texts))] = sizes
        if self.squeeze:
            return self._without_ends(out.tobytes(), new_at, aligned, mark.tobytes())
        return out.tobytes(), new_at, aligned

    @staticmethod
    def _without_ends(out: bytes, at: np.ndarray, origin: np.ndarray, mark: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Without the space marks that end a text; its end is then where the first of them came from."""
        parts, aligned = [], []
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            end = b
            while end > a and out.endswith(mark, a, end):
                end -= len(mark)
            parts.append(out[a:end])
            aligned.append(origin[a + i : end + i + 1])
        return b"".join(parts), runs(np.array([len(x) for x in parts], np.int64)), np.concatenate(aligned) if aligned else origin

    def segments(self, text: str) -> list[str]:
        """Segments of a normalised text."""
        if not text:
            return []
        if not self.cut:
            return [text]
        if text[0] != MARK or MARK * 2 in text or text[-1] == MARK:
            return SPACE_RUN.findall(text)
        return [MARK + w for w in text[1:].split(MARK)]

    def learn(self, words: set[str]) -> None:
        """Segments words that are not known, in one call."""
        new = list(words)
        ids = self.bare.encode(new, num_threads=1)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))
        sizes = self.width[flat]
        if (flat == self.unk).any():  # an unknown piece is as long as its text
            named = chain.from_iterable(self.bare.encode(new, out_type=str, num_threads=1))
            sizes = np.array([1 if self.full.is_byte(i) else len(p.encode()) for i, p in zip(flat.tolist(), named)], np.int32)
        self.known.update(zip(new, range(len(self.count), len(self.count) + len(new))))
        self.start = np.concatenate([self.start, len(self.pool) + runs(count)[:-1]])
        self.count, self.pool, self.sizes = np.concatenate([self.count, count]), np.concatenate([self.pool, flat]), np.concatenate([self.sizes, sizes])

    def encode(self, texts: Sequence[bytes], bos: bool, eos: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and ends of all texts (valid UTF-8), one after the other, and the offsets of each text in them."""
        text, where, origin = self.normalise_all(texts)
        cut = [self.segments(text[a:b].decode()) for a, b in zip(where[:-1].tolist(), where[1:].tolist())]
        words = list(chain.from_iterable(cut))
        missing = set(words).difference(self.known)
        if len(self.known) + len(missing) > MOST_WORDS:
            self.forget()
            missing = set(words)
        if missing:
            self.learn(missing)
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        per_word = self.count[which]
        at = ranges(self.start[which], per_word)
        ids, norm = self.pool[at], runs(self.sizes[at])
        per_text = np.diff(runs(per_word)[runs(np.array([len(w) for w in cut], np.int64))])
        shift = np.repeat(np.arange(len(cut)), per_text)  # each alignment has one entry more than its text has bytes
        begins, ends = origin[norm[:-1] + shift], origin[norm[1:] + shift]
        out, where = runs(per_text + bos + eos), np.arange(len(ids)) + shift * (bos + eos) + bos
        made = [np.zeros(out[-1], np.int32) for _ in range(3)]
        for target, values in zip(made, (ids, begins, ends)):
            target[where] = values
        if bos:
            made[0][out[:-1]] = self.full.bos_id()
        if eos:
            made[0][out[1:] - 1] = self.full.eos_id()
            made[1][out[1:] - 1] = made[2][out[1:] - 1] = [len(t) for t in texts]
        return *made, out

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        flat = ids.tolist()
        return self.full.decode([flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], num_threads=1) if len(at) > 1 else []


def codec(model: bytes) -> Codec:
    """One codec per worker and model."""
    return held("sentencepiece-" + hashlib.sha256(model).hexdigest(), lambda: Codec(model))


def valid(texts: Sequence[bytes | None]) -> list[bytes]:
    """The texts as valid UTF-8."""
    texts = [t or b"" for t in texts]
    try:
        b"\n".join(texts).decode()
        return texts
    except UnicodeDecodeError:
        return [t.decode("utf-8", "replace").encode() for t in texts]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(df: DataFrame, model_path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), bos: bool = True, eos: bool = True, packed: bool = False) -> DataFrame:
    """Encodes every text and decodes the ids again.

    Returns keep, `ids` array<int>, `begins` and `ends` array<int> (byte offsets in the source, end exclusive; a space mark
    begins at its space; the begin and end ids have empty spans) and `decoded` string. With `packed` the three lists are
    binary, as little-endian unsigned 32-bit integers, the form of token files. The model (some 0.5 MB) goes to the workers
    by value; `model_path` need exist on the driver only.
    """
    model = model_bytes(model_path)
    taken, carry, read = carried(df, keep, text)
    kind = "binary" if packed else "array<int>"
    names = [*carry, "ids", "begins", "ends", "decoded"]
    schema = ", ".join([*fields_of(taken, carry), f"ids {kind}", f"begins {kind}", f"ends {kind}", "decoded string"])

    def run(batches):
        own = codec(model)
        for whole in batches:
            for batch in parts_of(whole, read, CHUNK):
                texts = valid(column_bytes(batch.column(read)))
                *lists, at = own.encode(texts, bos, eos)
                if packed:
                    offsets = pa.array((4 * at).astype(np.int32)).buffers()[1]
                    lists_ = [pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, pa.py_buffer(v.astype("<u4").tobytes())]) for v in lists]
                else:
                    lists_ = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for v in lists]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in carry), *lists_, pa.array(own.decode(lists[0], at), pa.string())], names=names)

    return taken.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names[-4:])


def digests(encoded: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """n_tokens, ids_sha256 (of the packed ids), decoded_sha256 and spans_sha256 (of the packed begins, then the packed ends) of
    documents encoded with `packed`."""
    return encoded.select(*keep, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"))
