"""Byte-level BPE by replaying merges over a corpus of distinct words.

An inverted index leads from the token that a pair makes to the positions of such pairs in all words at once. Merges are
taken in rank order; each rewrites its positions and looks anew only at the neighbours it touched. A task replays the
words that it has not met before, then texts are put together from words.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from saccade.llm.common import bounded, id_and_text
from saccade.llm.words import WordCoder

_NONE = np.int32(2**31 - 1)


class Merges:
    """The pairs of a rank file: a pair merges into the token of its joined bytes, the lowest rank first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        codes, made = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    codes.append(left << 32 | right)
                    made.append(rank)
        order = np.argsort(np.array(codes, np.int64))
        self.codes, self.made = np.array(codes, np.int64)[order], np.array(made, np.int32)[order]
        top = max(ranks.values()) + 1
        tokens = [b""] * top
        for token, rank in ranks.items():
            tokens[rank] = token
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    @staticmethod
    def read(path: str) -> Merges:
        with open(path, "rb") as lines:
            return Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or ``_NONE``."""
        code = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.made[at], _NONE)

    def replay(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each word has."""
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        token = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(token)
        ends = np.cumsum(length)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = length > 0
        after[ends[full] - 1] = -1
        before[(ends - length)[full]] = -1
        makes = np.full(n, _NONE, np.int32)
        paired = np.flatnonzero(after >= 0)
        makes[paired] = self.join(token[paired], token[after[paired]])
        index: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def enter(places: np.ndarray) -> None:
            made = makes[places]
            if len(places) > 1:
                order = np.argsort(made, kind="stable")
                places, made = places[order], made[order]
            upto = int(np.searchsorted(made, _NONE))
            if not upto:
                return
            cuts = np.flatnonzero(made[1:upto] != made[:upto - 1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), upto], strict=True):
                rank = int(made[a])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(ranks, rank)
                index[rank].append(places[a:b])

        enter(paired)
        while ranks:
            rank = heapq.heappop(ranks)
            listed = index.pop(rank)
            at = listed[0] if len(listed) == 1 else np.concatenate(listed)
            at = at[makes[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
            other = after[at]
            if len(at) > 1 and (overlap := other[:-1] == at[1:]).any():
                # Of pairs that share a token the leftmost merges, then every second one.
                run_start = np.concatenate([[True], ~overlap])
                first = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
                chosen = (np.arange(len(at)) - first) % 2 == 0
                at, other = at[chosen], other[chosen]
            token[at] = rank
            token[other] = -1
            makes[other] = _NONE
            follow = after[other]
            after[at] = follow
            inner = follow >= 0
            before[follow[inner]] = at[inner]
            makes[at[~inner]] = _NONE
            left = before[at]
            touched = np.concatenate([at[inner], left[left >= 0]])
            if len(touched):
                makes[touched] = self.join(token[touched], token[after[touched]])
                enter(touched)
        alive = token >= 0
        count = np.concatenate([[0], np.cumsum(alive)])
        return token[alive], count[ends] - count[ends - length]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens, and where each token's bytes begin and the last end."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.first[ids] - ends[:-1], size)
        place += np.arange(ends[-1])
        return self.data[place], ends


@lru_cache(maxsize=2)
def _coder(path: str) -> tuple[Merges, WordCoder]:
    merges = Merges.read(path)
    return merges, WordCoder(merges.replay)


def encode(docs: DataFrame, rank_file: str) -> DataFrame:
    """doc_id and ids (unsigned 32-bit, little endian) of every whole text; a null or empty text has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, coder = _coder(rank_file)
        for batch in bounded(batches, limit=2 << 20):
            ids, upto = coder.encode(batch.column("text").to_pylist())
            raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "ids"])
    rows = id_and_text(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with n_tokens, ids_sha256 and the decoded bytes' decoded_sha256, and the bytes as ``decoded``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, _ = _coder(rank_file)
        for batch in bounded(batches, "ids", 2 << 20):
            raw = [v or b"" for v in batch.column("ids").to_pylist()]
            ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
            upto = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int64)
            data, ends = merges.decode(ids)
            data = data.tobytes()
            texts = [data[a:b] for a, b in zip(ends[upto[:-1]].tolist(), ends[upto[1:]].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(upto)), pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary())], names)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"]
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded binary")
