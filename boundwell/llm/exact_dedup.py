"""Exact deduplication with a sharded cuckoo-filter index of live digests.

Each document is reduced to the SHA-256 of its text without the white space ``[\\x20\\x09-\\x0D]``.
Digests are inserted into a cuckoo filter; a filter hit is verified against the full digests that the
two candidate buckets point to, and an insertion that finds no room after MAX_KICKS evictions doubles the
filter, which is refilled from the stored keys.  The index runs twice: on the map side it folds the copies that
one task sees into one entry, so that a digest of any frequency sends at most a row per task, and after the shuffle each
shard of the digest space has the final index.  Both hand an index on when it is full, so that a task's memory has a bound.

Defined results: null text counts as empty; empty texts are equal to each other; of equal texts the one with the most code
points stays, then the smallest id (null ids last), then, for repeated rows, the first row; an empty table gives an empty
result; columns other than the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwell.llm.runtime import cut, fresh

SLOTS = 4
MAX_KICKS = 200
#: Entries that a task's index holds before it hands them on.
TASK_ENTRIES = 200_000
WHITE = " \t\n\x0b\x0c\r"
ENTRY = "digest binary, n long, best_len long, best_id long, best_row long"


def _rank(length: int, doc_id: int | None, row: int) -> tuple:
    """Order of the rows of one digest, the best first."""
    return -length, doc_id is None, doc_id or 0, row


class CuckooIndex:
    """Live digests with their number of copies and their best row.

    A slot has a 16-bit fingerprint and the number of its entry; entries keep the whole digest, so a fingerprint
    alone never decides.
    """

    def __init__(self, capacity: int = 1024) -> None:
        self.digests: list[bytes | None] = []
        self.count, self.best_len, self.best_row = (array("q") for _ in range(3))
        self.best_id: list[int | None] = []
        self.free: list[int] = []
        self.resizes = 0
        self._allot(max(8, 1 << (capacity * 5 // 4 // SLOTS).bit_length()))

    def __len__(self) -> int:
        return len(self.digests) - len(self.free)

    def _allot(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.entry = array("q", bytes(8 * SLOTS * buckets))

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        """Fingerprint and the two buckets."""
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 + 0x1B873593)) & self.mask

    def find(self, digest: bytes) -> int:
        """The verified slot of a digest, or -1."""
        mark, first, second = self._place(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.digests[self.entry[slot]] == digest:
                    return slot
        return -1

    def __contains__(self, digest: bytes) -> bool:
        return self.find(digest) >= 0

    def insert(self, digest: bytes, n: int = 1, length: int = 0, doc_id: int | None = 0, row: int = 0) -> bool:
        """Add n copies, the best of which is (length, doc_id, row); True if the digest was not live."""
        slot = self.find(digest)
        if slot >= 0:
            e = self.entry[slot]
            self.count[e] += n
            if _rank(length, doc_id, row) < _rank(self.best_len[e], self.best_id[e], self.best_row[e]):
                self.best_len[e], self.best_id[e], self.best_row[e] = length, doc_id, row
            return False
        if self.free:
            e = self.free.pop()
            self.digests[e] = digest
            self.count[e], self.best_len[e], self.best_id[e], self.best_row[e] = n, length, doc_id, row
        else:
            e = len(self.digests)
            self.digests.append(digest)
            for column, value in zip((self.count, self.best_len, self.best_id, self.best_row), (n, length, doc_id, row), strict=True):
                column.append(value)
        if not self._settle(digest, e):
            self._resize()
        return True

    def delete(self, digest: bytes, n: int = 1) -> bool:
        """Take n copies away; the digest leaves the index with its last copy. False if it was not live."""
        slot = self.find(digest)
        if slot < 0:
            return False
        e = self.entry[slot]
        self.count[e] -= n
        if self.count[e] <= 0:
            self.prints[slot] = 0
            self.digests[e] = None
            self.free.append(e)
        return True

    def _settle(self, digest: bytes, e: int) -> bool:
        mark, first, second = self._place(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entry[slot] = mark, e
                    return True
        bucket = second
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + mark) % SLOTS
            self.prints[slot], mark, self.entry[slot], e = mark, self.prints[slot], e, self.entry[slot]
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entry[slot] = mark, e
                    return True
        return False

    def _resize(self) -> None:
        """Double the filter until every stored key has a slot."""
        while True:
            self.resizes += 1
            self._allot(2 * (self.mask + 1))
            if all(self._settle(d, e) for e, d in enumerate(self.digests) if d is not None):
                return

    def rows(self) -> pa.RecordBatch:
        live = [e for e, d in enumerate(self.digests) if d is not None]
        pick = lambda column: pa.array([column[e] for e in live], pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([self.digests[e] for e in live], pa.binary()), *map(pick, (self.count, self.best_len, self.best_id, self.best_row))],
            ["digest", "n", "best_len", "best_id", "best_row"],
        )


def _fold(limit: int, ordered: bool):
    """mapInArrow function: run a task's rows through an index, and hand it on whenever it has limit entries.

    Where all rows of a digest must meet, they come in order of their first two bytes, and an index is handed on between two of these.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = CuckooIndex(), b""
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if len(index) >= limit and not (ordered and row[0][:2] == last):
                    yield index.rows()
                    index = CuckooIndex()
                index.insert(*row)
                last = row[0][:2]
        if len(index):
            yield index.rows()

    return fold


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space, as binary; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, "").cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, digest, n, best_len, best_id, best_row) for each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        text_digest(text).alias("digest"),
        F.lit(1).cast("long").alias("n"),
        F.length(text).cast("long").alias("best_len"),
        F.col(id_col).cast("long").alias("best_id"),
        F.monotonically_increasing_id().alias("best_row"),
    )


def build_index(entries: DataFrame) -> DataFrame:
    """The live index, sharded by digest: ENTRY rows, one for each digest. entries has ENTRY's columns and any number of rows for a digest."""
    cols = entries.select("digest", "n", "best_len", "best_id", "best_row")
    return _sharded(cols.mapInArrow(_fold(TASK_ENTRIES, False), ENTRY)).mapInArrow(_fold(TASK_ENTRIES, True), ENTRY)


def _sharded(entries: DataFrame) -> DataFrame:
    """Dealt by digest and, within a task, in order of its first two bytes, so that a task's memory doesn't grow with its shard."""
    return entries.repartition("digest").sortWithinPartitions(F.substring("digest", 1, 2))


def insert_into(index: DataFrame, entries: DataFrame) -> DataFrame:
    """The index with further entries: both are ENTRY rows."""
    return build_index(index.unionByName(entries.select(index.columns)))


def delete_from(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the copies in gone (digest binary, n long); digests without a copy leave it.

    A digest that isn't live is ignored. The best row of a digest that stays live is kept as it was.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, away, last = CuckooIndex(), [], b""

        def handed_on() -> Iterator[pa.RecordBatch]:
            for digest, n in away:
                live.delete(digest, n)
            if len(live):
                yield live.rows()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if len(live) + len(away) >= TASK_ENTRIES and row[0][:2] != last:
                    yield from handed_on()
                    live, away = CuckooIndex(), []
                if row[1] >= 0:
                    live.insert(*row)
                else:
                    away.append((row[0], -row[1]))
                last = row[0][:2]
        yield from handed_on()

    less = gone.groupBy("digest").agg((-F.sum("n")).alias("n")).select("digest", "n", *(F.lit(0).cast("long").alias(c) for c in ("best_len", "best_id", "best_row")))
    return _sharded(index.unionByName(less)).mapInArrow(take, ENTRY)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The join that brings a group's verdict back to its rows is a plain equi-join, which adaptive execution splits where one
    digest has a large part of all rows.
    """
    rows = cut(digests(docs, id_col, text_col))
    groups = build_index(rows).select(F.col("digest").alias("_digest"), F.col("n").alias("group_size"), F.col("best_id").alias("_id"), F.col("best_row").alias("_row"))
    return rows.join(groups.hint("shuffle_merge"), F.col("digest") == F.col("_digest")).select(
        "doc_id",
        F.col("_id").alias("keep_id"),
        "group_size",
        (F.col("best_row") == F.col("_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that exact_dedup keeps, with all their columns; of repeated rows one stays.

    The texts are moved once: a keeper is looked up by its digest, length and id, and rows that share these are told apart where
    they have met. A group's other copies have other ids or lengths, so that they are dealt to many tasks.
    """
    digest, length, named = fresh(docs, "digest"), fresh(docs, "length"), fresh(docs, "named")
    id_text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    stays = build_index(cut(digests(docs, id_col, text_col))).select(F.col("digest").alias("_digest"), id_text(F.col("best_id")).alias("_id"), F.col("best_len").alias("_len"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = docs.withColumns({digest: text_digest(text), length: F.length(text).cast("long"), named: id_text(F.col(id_col).cast("long"))})
    same = (full[digest] == stays["_digest"]) & (full[named] == stays["_id"]) & (full[length] == stays["_len"])
    return full.join(stays.hint("shuffle_merge"), same, "left_semi").dropDuplicates([digest, named, length]).select(docs.columns)
