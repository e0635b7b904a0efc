"""Best-fit packing of token sequences, improved by swaps.

Texts become token ids; a document longer than a sequence is cut into pieces.  Pieces are dealt by
hash to groups of about ``GROUP``, whatever document they come from, and packed group by group: best fit in
order of length, then a local search that takes the emptiest bin and moves its documents, or swaps one or two
of them for one of another bin, whenever that increases the sum of squared fills, until bins are empty.
Bins that stay clearly underfull are taken apart and packed again with those of other groups, in
ever fewer groups, until one group is left.

Token ids of a text are the ids of its parts between blanks: the tokenizer drops white space and never joins
across it.  Parts are looked up in a table of bounded size that the tokenizer and its merges fill.

Defined results: a null text is an empty one, whose only token is the separator; an empty table
gives an empty table; repeated rows are packed each by itself; ties are broken by row number;
other columns of the input are not looked at.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from weftline.llm.common import text_or_empty, tokenizer_path
from weftline.session import stored

CAPACITY = 2048
SEPARATOR = 0
VOCABULARY = "word_bpe_49k.json"
#: pieces packed together in one task, about
GROUP = 8192
#: swap searches in one group for each of its bins, at most
SEARCHES_PER_BIN = 16
#: a bin with less than this share filled is packed again in the next round
UNDERFULL = 0.97
#: parts of texts whose ids are kept in each half of a task's table, and their longest length
KEPT_PARTS = 200_000
LONGEST_PART = 64
#: characters of texts that are coded together, about
CHARACTERS = 4_000_000
#: what may stand behind a word and is one unit of the tokenizer
MARKS = string.punctuation
#: letters from here on may be split differently by different versions of the character tables
FIRST_ODD_LETTER = "\u0250"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary, by the rule of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class PartCodes:
    """Token ids of texts as little-endian unsigned 32-bit numbers.

    A part that is a word of letters, as most are, is one unit of the tokenizer: its merges are applied to it directly.  Marks
    behind a word are one more unit, looked up by themselves.  Everything else goes through the whole tokenizer.
    Known parts are kept in two halves: when the newer one is full the older one is dropped, and a part
    that is met again moves to the newer one.  So what is frequent stays, and memory is bounded.
    """

    def __init__(self, path: str, kept: int = KEPT_PARTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.kept = kept
        self.marks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def each(self, parts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def word(self, base: str) -> bytes | None:
        """The code of a word of letters; None where it is no single unit of plain letters once it is normalised.

        It is kept under the normalised word, for all its spellings.
        """
        if base.isascii():
            unit = base.lower()
        else:
            unit = unicodedata.normalize("NFC", base).lower()
            if max(unit) >= FIRST_ODD_LETTER or not unit.isalpha():
                return None
        code = self.known.get(unit) or self.older.get(unit)
        if code is None:
            bare = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters)
            code = array("I", [t.id for t in self.merges(bare)]).tobytes()
            if len(unit) <= LONGEST_PART:
                self.known[unit] = code
        return code

    def learn(self, missing: list[str]) -> None:
        """Codes of parts that are not known yet."""
        others = []
        for part in missing:
            base = part.rstrip(MARKS)
            code = self.word(base) if base.isalpha() else None
            if code is None:
                others.append(part)
                continue
            mark = part[len(base) :]
            if mark:
                if mark not in self.marks:
                    (self.marks[mark],) = self.each([mark])
                code += self.marks[mark]
            self.known[part] = code
        self.known.update(zip(others, self.each(others), strict=True))

    def coded(self, parts: list[str]) -> list[bytes]:
        """Codes of different parts."""
        if len(self.known) > self.kept:
            self.older, self.known, self.marks = self.known, {"": b""}, {}
        known, older = self.known, self.older
        found = list(map(known.get, parts))
        missing = [part for part, code in zip(parts, found) if code is None]
        for part in missing:
            if part in older:
                known[part] = older.pop(part)
        self.learn([part for part in missing if part not in known])
        found = [known[part] if code is None else code for part, code in zip(parts, found)]
        for part in missing:
            if len(part) > LONGEST_PART:
                known.pop(part, None)
        return found

    def codes(self, texts: list[str]) -> list[bytes]:
        """Codes of texts: each different part is looked up once, and the ids of all are gathered together."""
        spaced = pc.replace_substring(pa.array(texts, pa.string()), "\n", " ")
        split = pc.split_pattern(spaced, " ")
        parts = split.values.dictionary_encode()
        found = self.coded(parts.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        which = parts.indices.to_numpy()
        own = sizes[which]
        ends = np.cumsum(own, dtype=np.int32)
        starts = (np.cumsum(sizes, dtype=np.int32) - sizes)[which]
        # the place of every token: from where its part's ids start, on
        places = np.repeat(starts - ends + own, own)
        places += np.arange(len(places), dtype=np.int32)
        whole = ids[places].tobytes()
        cuts = [4 * end for end in np.concatenate([[0], ends])[split.offsets.to_numpy()].tolist()]
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids)``, one row per piece; ``ids`` only on demand."""
    path = vocabulary or tokenizer_path(VOCABULARY)
    kind = df.schema[doc_id].dataType.simpleString()
    end = np.array([SEPARATOR], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own_codes = PartCodes(path).codes
        for batch in batches:
            rows = []
            # so many characters at a time, so that memory does not follow the batch
            volume = batch["text"].str.len().cumsum() // CHARACTERS
            for _, part in batch.groupby(volume, sort=False):
                for own, code in zip(part["doc_id"], own_codes(list(part["text"])), strict=True):
                    code += end
                    for n, start in enumerate(range(0, len(code), 4 * capacity)):
                        ids = code[start : start + 4 * capacity]
                        rows.append(
                            (own, n, start // 4, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None)
                        )
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            out["doc_id"] = pd.Series([r[0] for r in rows], dtype=batch["doc_id"].dtype)
            yield out
            pa.default_memory_pool().release_unused()  # a worker outlives its task

    narrow = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return narrow.mapInPandas(cut, PIECES.format(id=kind))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of item places: each item, longest first, into the fullest bin it fits in."""
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit c: some bin has c free
    for i in order.tolist():
        length = int(lengths[i])
        fitting = mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            own = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
            bins[own].append(i)
        else:
            free, own = capacity, len(bins)
            bins.append([i])
        left = free - length
        if left:
            by_free[left].append(own)
            mask |= 1 << left
    return bins


def swap_search(
    bins: list[list[int]], lengths: np.ndarray, capacity: int, steps: int | None = None
) -> list[list[int]]:
    """Empty the emptiest bins by moves and swaps that increase the sum of squared fills.

    A step takes one or two documents of the emptiest bin and gives them to another bin, for nothing
    (a move) or for one of its documents; the best such step is made.
    """
    if steps is None:
        steps = SEARCHES_PER_BIN * len(bins)
    fill = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)
    of = np.empty(len(lengths), dtype=np.int64)
    for n, b in enumerate(bins):
        of[b] = n
    members = [set(b) for b in bins]
    least = -(-int(lengths.sum()) // capacity)
    alive = int((fill > 0).sum())
    stuck = np.zeros(len(bins), dtype=bool)
    while steps > 0 and alive > least:
        open_bins = np.flatnonzero((fill > 0) & ~stuck & (fill < capacity))
        if len(open_bins) < 2:
            break
        donor = int(open_bins[np.argmin(fill[open_bins])])
        own = sorted(members[donor])
        offers = [(x,) for x in own]
        # of a bin with many documents the pairs of its longest are tried
        longest = sorted(own, key=lambda i: -int(lengths[i]))[:8]
        offers += [(x, y) for k, x in enumerate(longest) for y in longest[k + 1 :]]
        free = capacity - fill
        free[donor] = -1
        free[fill == 0] = -1
        best = (0, None, None, None)
        for offer in offers:
            steps -= 1
            size = int(sum(lengths[i] for i in offer))
            room = np.flatnonzero(free >= size)
            if len(room):
                other = int(room[np.argmax(fill[room])])
                gain = 2 * size * (int(fill[other]) - int(fill[donor]) + size)
                if gain > best[0]:
                    best = (gain, offer, None, other)
            more = size - lengths
            able = np.flatnonzero((more > 0) & (more <= free[of]))
            if len(able):
                d = more[able]
                gains = 2 * d * (fill[of[able]] - fill[donor] + d)
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (int(gains[k]), offer, int(able[k]), int(of[able[k]]))
        gain, offer, back, other = best
        if not gain:
            stuck[donor] = True
            continue
        for i in offer:
            members[donor].remove(i)
            members[other].add(i)
            of[i] = other
        moved = int(sum(lengths[i] for i in offer))
        if back is not None:
            members[other].remove(back)
            members[donor].add(back)
            of[back] = donor
            moved -= int(lengths[back])
        fill[donor] -= moved
        fill[other] += moved
        if fill[donor] == 0:
            alive -= 1
    return [sorted(m) for m in members if m]


def packed_group(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return swap_search(best_fit(lengths, capacity), lengths, capacity)


def group_packer(capacity: int, last: bool):
    """Function that packs one group; in the ``last`` round every bin counts as full."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_uid", ignore_index=True)
        lengths = pdf["length"].to_numpy(dtype=np.int64)
        uids = pdf["_uid"].to_numpy()
        rows = []
        for members in packed_group(lengths, capacity):
            fill, name = 0, int(uids[members[0]])
            full = last or int(lengths[members].sum()) >= UNDERFULL * capacity
            for i in members:
                rows.append((int(uids[i]), int(lengths[i]), name, fill, full))
                fill += int(lengths[i])
        return pd.DataFrame(rows, columns=["_uid", "length", "bin", "offset", "full"])

    return pack


def packed_pieces(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces with a ``length``."""
    numbered = stored(cut.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    open_pieces = numbered.filter(F.col("length") < capacity).select("_uid", "length")
    n = open_pieces.count()
    schema = "_uid long, length long, bin long, offset long, full boolean"
    done: list[DataFrame] = []
    level, before = 0, None
    while n:
        groups = max(1, -(-n // group))
        last = groups == 1

        own_group = F.pmod(F.xxhash64("_uid", F.lit(level)), F.lit(groups))
        tried = (
            open_pieces.withColumn("_group", own_group)
            .groupBy("_group")
            .applyInPandas(group_packer(capacity, last), schema)
        )
        tried = stored(tried, "packed")
        done.append(tried.filter("full").select("_uid", "bin", "offset"))
        open_pieces = tried.filter("NOT full").select("_uid", "length")
        # every bin has one piece at its beginning
        begins = F.col("offset") == 0
        left, made, underfull = tried.agg(
            F.count_if(~F.col("full")), F.count_if(begins), F.count_if(begins & ~F.col("full"))
        ).first()
        # a round that saves less than one bin for each of its groups is the last: larger groups save no more
        if not last and before is not None and before - made < groups:
            done.append(tried.filter("NOT full").select("_uid", "bin", "offset"))
            break
        n, before, level = left, underfull, level + 1
    whole = numbered.filter(F.col("length") >= capacity).select(
        "_uid", F.col("_uid").alias("bin"), F.lit(0).cast("long").alias("offset")
    )
    places = whole
    for part in done:
        places = places.unionByName(part)
    return numbered.join(places, "_uid").withColumnRenamed("bin", "sequence_id").drop("_uid")


def packed(df: DataFrame, **options) -> DataFrame:
    """Pieces of all documents with their sequences: see :func:`pieces` and :func:`packed_pieces`."""
    capacity = options.get("capacity", CAPACITY)
    return packed_pieces(pieces(df, **options), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves: ``(sequence_id, ids)`` from pieces that carry their ids.

    A group is one sequence, at most its capacity in tokens.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.aggregate(ordered, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )
