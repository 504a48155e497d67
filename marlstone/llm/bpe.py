"""BPE encoding and decoding: a segment tree over adjacent pair ranks.

The leaves of a piece's tree hold rank * width + place of the pair that starts there, so that the root is the
leftmost lowest-rank merge. A merge changes at most three leaves, each followed to the root in log2(width) steps; the
piece is done when the root holds no mergeable pair. Pieces of about one length are worked off together, one numpy
row for each tree.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import release, slices
from marlstone.llm.parts import Parts

#: Size of a worker's table of parts and their ids: 2**BITS slots, at most half of them in use.
BITS = 21
_NONE = np.int64(2**62)
def byte_letters() -> list[str]:
    """The printable letter of each byte in vocabularies of this kind: printable bytes as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class SegmentTreeBpe:
    """Encodes and decodes as a byte-level BPE vocabulary file (JSON) says."""

    #: The split before the merges, as the vocabulary's kind fixes it.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = model["vocab"]
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.letter_ids = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.pattern = regex.compile(self.PATTERN)
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.parts = Parts(self._learn, self._whole, list(self.special), BITS)

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """rank * width + place of each pair, or _NONE."""
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = (self.keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at] * width + place, _NONE)

    def _trees(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids (unsigned 32-bit) of pieces of 2 to ``width`` bytes; width is a power of two."""
        rows = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, rows)
        ids = np.full((rows, width), -1, np.int64)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        inside = np.arange(width) < sizes[:, None]
        ids[inside] = self.letter_ids[flat]
        before = np.broadcast_to(np.arange(-1, width - 1), (rows, width)).copy()
        after = np.where(np.arange(1, width + 1) < sizes[:, None], np.arange(1, width + 1), -1)
        tree = np.full((rows, 2 * width), _NONE, np.int64)
        tree[:, width : 2 * width - 1] = self._leaf(ids[:, :-1], ids[:, 1:], np.arange(width - 1), width)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        active = np.flatnonzero(tree[:, 1] < _NONE)
        while len(active):
            root = tree[active, 1]
            at, rank = root % width, root // width
            right = after[active, at]
            far = after[active, right]
            ids[active, at] = self.made[rank]
            ids[active, right] = -1
            after[active, at] = far
            has = far >= 0
            before[active[has], far[has]] = at[has]
            near = before[active, at]
            had = near >= 0
            here = np.where(has, self._leaf(ids[active, at], ids[active, np.maximum(far, 0)], at, width), _NONE)
            left = np.where(had, self._leaf(ids[active, np.maximum(near, 0)], ids[active, at], np.maximum(near, 0), width), _NONE)
            for leaf, value, rows_ in ((at, here, slice(None)), (right, np.full(len(at), _NONE), slice(None)), (near, left, had)):
                r, node = active[rows_], leaf[rows_] + width
                tree[r, node] = value[rows_]
                while node.size and node[0] > 1:
                    node = node >> 1
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            active = active[tree[active, 1] < _NONE]
        kept = ids >= 0
        flat_ids, cuts = ids[kept].astype("<u4").tobytes(), (np.cumsum(kept.sum(1)) * 4).tolist()
        return [flat_ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each distinct piece, by trees of one width together (about 256 K leaves at once)."""
        out: dict[str, bytes] = {}
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if len(raw) < 2:
                out[piece] = self.letter_ids[list(raw)].astype("<u4").tobytes()
            else:
                groups.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, members in groups.items():
            step = max(1, (1 << 18) // width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                out.update(zip((p for p, _ in part), self._trees([raw for _, raw in part], width), strict=True))
        return out

    def _learn(self, parts: list[str]) -> list[np.ndarray]:
        pieces = [self.pattern.findall(p) for p in parts]
        ids = self.encode_pieces(list({x for found in pieces for x in found}))
        return [np.frombuffer(ids[found[0]] if len(found) == 1 else b"".join([ids[x] for x in found]), "<u4") for found in pieces]

    def _whole(self, text: str) -> np.ndarray:
        """Texts with special tokens or white space beyond ASCII: split at the tokens, then by the pattern."""
        runs = self.marks.split(text) if self.marks else [text]
        pieces = [x for k, run in enumerate(runs) for x in ([run] if k % 2 else self.pattern.findall(run))]
        ids = self.encode_pieces(list({x for x in pieces if x not in self.special}))
        return np.frombuffer(b"".join([np.array([self.special[x]], "<u4").tobytes() if x in self.special else ids[x] for x in pieces]), "<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, unsigned 32-bit; number of ids of each); nulls count as empty."""
        return self.parts.encode_texts(texts)

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 are replaced."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> SegmentTreeBpe:
    return SegmentTreeBpe(path)


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds ``ids`` (array of int): the whole text's token ids; special tokens in the text become their ids.

    decoded: also adds a column of that name with the text decoded from the ids.

    A null text counts as empty and gives an empty array. Repeated rows, ties and extra columns stay as they are; a
    column already named ``ids`` is replaced. An empty table gives an empty table.
    """
    keep = [c for c in df.columns if c not in (ids, decoded)]
    df = df.select(*(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    at, names = keep.index(text), schema.names

    def run(batches):
        coder = codec(path)
        for batch in batches:
            for part in slices(batch, at):
                flat, counts = coder.encode(part.column(at))
                cuts = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                back = [pa.array([coder.decode(flat[a:b].tolist()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(cuts, flat.astype(np.int32)), *back], names=names)
        release()

    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``: the ids' bytes as UTF-8, malformed bytes replaced; null or empty ids give an empty text."""
    keep = [c for c in df.columns if c != text]
    df = df.select(*(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])
    at = keep.index(ids)

    def run(batches):
        coder = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [coder.decode(x.values.to_pylist() if x.is_valid else []) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*keep, text])

    return df.mapInArrow(run, schema)


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``bpe_encode`` and then the text decoded from the ids, in one pass."""
    return bpe_encode(df, path, text, ids, decoded)
