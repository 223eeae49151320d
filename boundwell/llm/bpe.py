"""Byte-level BPE encoding by tree concatenation, and decoding.

A text between special tokens that is longer than two LEAFs is halved again and again, wherever its middle falls; the leaves of
very long texts are encoded by several threads, and the halves are joined bottom-up.  (A Codec may be told to cut a text first
where no token can cross, before a space that stands between two non-spaces, so that only text without such places is halved.)  At a join the text of a window of tokens on both sides is encoded anew.  A window is good when it agrees
with the left half on AGREE whole tokens inside its start and with the right half on AGREE inside its end; otherwise the side that does
not agree grows to twice its tokens, at most to the half's edge, where there is nothing left to agree with.  A byte-pair
encoding is right when all its neighbouring pairs are; each pair of the joined sequence stands in a half or in the window, so
the result is the encoding of the whole.

The vocabulary comes from a tokenizers JSON file, whose path is a parameter. Its merge order is its id order, which is checked, so
the ranks can be used by the faster of the two public BPE libraries; with other files the tokenizers library encodes.

Defined results: null text counts as empty (no tokens); a special token's string in a text is that token, as the library has
it by default; repeated rows each get a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts beyond twice as many characters are halved.
LEAF = 1 << 12
#: Leaves of a text from which they are encoded by several threads.
PARALLEL_LEAVES = 64
#: Tokens that a window has on each side of a join at first, and those that it must share with each half.
WINDOW = 16
AGREE = 4


@cache
def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW, threads: int = 2, safe_cuts: bool = True) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.leaf, self.window, self.threads, self.safe_cuts = leaf, window, threads, safe_cuts
        self.joins = 0
        self.special = {x["content"]: x["id"] for x in data["added_tokens"] if x["special"]}
        chars = byte_of_char()
        special_ids = set(self.special.values())
        vocab = {t: i for t, i in data["model"]["vocab"].items() if i not in special_ids}
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *special_ids]))
        for t, i in vocab.items():
            self.bytes[i] = bytes(chars[c] for c in t)
        self.sizes = np.array([len(b) for b in self.bytes])
        merges = data["model"]["merges"]
        ranked = all(vocab.get("".join(m if isinstance(m, list) else m.split(" "))) == 256 + i for i, m in enumerate(merges))
        pre, decoder = data["pre_tokenizer"], data["decoder"]
        plain = data["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and decoder["type"] == "ByteLevel"
        if not plain:
            raise ValueError("only byte-level vocabularies without normalizer are supported")
        self.encode_leaf = self._ranked() if ranked else self._library(path)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()

    def _ranked(self) -> Callable[[str], np.ndarray]:
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the public byte-level split
        ranks = {b: i for i, b in enumerate(self.bytes) if b}
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: coder.encode_to_numpy(text, disallowed_special=())

    def _library(self, path: str) -> Callable[[str], np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        coder.no_truncation()
        coder.no_padding()
        return lambda text: np.array(coder.encode(text, add_special_tokens=False).ids, np.uint32)

    def _parts(self, text: str) -> list[str | int]:
        """The text between special tokens, and their ids."""
        parts: list[str | int] = [text]
        for s, i in self.special.items():
            if s in text:
                nxt: list[str | int] = []
                for p in parts:
                    if isinstance(p, int) or s not in p:
                        nxt.append(p)
                        continue
                    for k, piece in enumerate(p.split(s)):
                        nxt += [i] * (k > 0) + [piece] * bool(piece)
                parts = nxt
        return parts

    def _chunks(self, text: str) -> list[str]:
        """Pieces that no token crosses, of about leaf characters where the text allows it; without safe cuts the text."""
        out, start = [], 0
        while self.safe_cuts and len(text) - start > 2 * self.leaf:
            at = start + self.leaf
            while at < len(text) - 1 and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()):
                at = text.find(" ", at + 1)
                if at < 0:
                    at = len(text)
            if at >= len(text) - 1:
                break
            out.append(text[start:at])
            start = at
        out.append(text[start:])
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        plans, leaves, parts = [], [], []

        def tree(text: str, part: bool):
            if len(text) <= 2 * self.leaf:
                leaves.append(text)
                if part:
                    parts.append(len(leaves) - 1)
                return len(leaves) - 1, text
            half = len(text) // 2
            return tree(text[:half], part), tree(text[half:], part), text

        for text in texts:
            plans.append([p if isinstance(p, int) else tree(c, len(c) > PARALLEL_LEAVES * self.leaf) for p in self._parts(text) for c in ([None] if isinstance(p, int) else self._chunks(p))])
        # A very long text would keep its task waiting; the library encodes outside of the interpreter's lock.
        done: list[np.ndarray | None] = [None] * len(leaves)
        if parts and self.threads > 1:
            with ThreadPoolExecutor(self.threads) as pool:
                for k, ids in zip(parts, pool.map(self.encode_leaf, [leaves[k] for k in parts]), strict=True):
                    done[k] = ids
        for k, text in enumerate(leaves):
            if done[k] is None:
                done[k] = self.encode_leaf(text)

        def ids(node) -> np.ndarray:
            if isinstance(node, int):
                return np.array([node], np.uint32)
            if len(node) == 2:
                return done[node[0]]
            return self.join(ids(node[0]), ids(node[1]), node[2])

        return [np.concatenate(x) if len(x := [ids(p) for p in plan]) > 1 else x[0] if x else np.zeros(0, np.uint32) for plan in plans]

    def join(self, left: np.ndarray, right: np.ndarray, text: str) -> np.ndarray:
        """The encoding of a text whose halves have these encodings."""
        self.joins += 1
        data = text.encode()
        a, b = np.concatenate(([0], np.cumsum(self.sizes[left]))), np.concatenate(([0], np.cumsum(self.sizes[right])))
        middle = int(a[-1])
        cut = lambda at: at == len(data) or data[at] & 0xC0 != 0x80  # noqa: E731  a character begins here
        n, m = self.window, self.window
        while True:
            i, j = max(0, len(left) - n), min(len(right), m)
            while i > 0 and not cut(int(a[i])):
                i -= 1
            while j < len(right) and not cut(middle + int(b[j])):
                j += 1
            window = self.encode_leaf(data[a[i] : middle + b[j]].decode())
            ends = np.concatenate(([0], np.cumsum(self.sizes[window]))) + int(a[i])
            whole_left, whole_right = i == 0, j == len(right)
            x = 0 if whole_left else self._shared(window, ends, left[i:], a[i:])
            y = len(window) if whole_right else self._shared_end(window, ends, right[:j], b[: j + 1] + middle)
            if x is not None and y is not None and (whole_left or whole_right or x <= y):
                # x, y: from which token of the window, and up to which, the window's own tokens are taken.
                before = left[: i + self._at(a[i:], ends[x])]
                after = right[self._at(b + middle, ends[y]) :]
                return np.concatenate((before, window[x:y], after))
            n, m = (2 * n if x is None or (y is not None and x > y) else n), (2 * m if y is None or (x is not None and x > y) else m)

    @staticmethod
    def _at(ends: np.ndarray, value: int) -> int:
        return int(np.searchsorted(ends, value))

    @staticmethod
    def _shared(window: np.ndarray, ends: np.ndarray, half: np.ndarray, half_ends: np.ndarray) -> int | None:
        """The end of the first AGREE tokens in a row that the window and the left half both have at the same places."""
        run = 0
        for k in range(min(len(window), 4 * len(half))):
            at = int(np.searchsorted(half_ends, ends[k]))
            same = at < len(half) and half_ends[at] == ends[k] and half[at] == window[k]
            run = run + 1 if same else 0
            if run == AGREE:
                return k + 1
        return None

    @staticmethod
    def _shared_end(window: np.ndarray, ends: np.ndarray, half: np.ndarray, half_ends: np.ndarray) -> int | None:
        """The start of the last AGREE tokens in a row that the window and the right half both have at the same places."""
        run = 0
        for k in range(len(window) - 1, -1, -1):
            at = int(np.searchsorted(half_ends, ends[k]))
            same = at < len(half) and half_ends[at] == ends[k] and half[at] == window[k]
            run = run + 1 if same else 0
            if run == AGREE:
                return k
        return None

    def decode_bytes(self, ids) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])

    def decode(self, ids) -> str:
        """The text; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    """One codec for each worker process and file; it halves every long text."""
    return Codec(path, safe_cuts=False)


def _batches(batch: pa.RecordBatch, column: str, size: int = 1 << 22) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch's texts of about size characters, with the place of the first."""
    texts, first, total = [], 0, 0
    for i, x in enumerate(batch.column(column)):
        text = x.as_py() or ""
        texts.append(text)
        total += len(text)
        if total >= size:
            yield first, texts
            texts, first, total = [], i + 1, 0
    if texts:
        yield first, texts


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for first, texts in _batches(batch, "text"):
                ids = coder.encode_batch(texts)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row of ids; null ids count as none."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = [coder.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else ()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, so that the ids never leave the worker."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        names = [str(i) for i in range(len(coder.bytes))]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for first, texts in _batches(batch, "text"):
                n, a, b = [], [], []
                for ids in coder.encode_batch(texts):
                    ids = ids.tolist()
                    n.append(len(ids))
                    a.append(sha(",".join([names[i] for i in ids]).encode()))
                    b.append(sha(coder.decode(ids).encode()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
