"""Best-fit decreasing packing of tokenised documents into sequences.

Longest first, each piece goes to the open sequence with the least room that
still takes it. Lengths are whole numbers up to the capacity, so the packing of
any number of pieces follows from how many there are of each length: at most
one count per length reaches the driver. There a segment tree over remaining
capacities finds the tightest open sequences in logarithmic time, for all
pieces of a length that meet the same room at once. Every piece then finds its
own place from its rank among those of its length, in parallel.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nomenlink.llm.scratch import Scratch, giving_back

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
# Units of words whose tokens a task remembers: the last ones, up to twice as many.
_REMEMBERED = 150_000
_TEXTS = 64


class _Remembered(dict):
    """Values worked out when first asked for; the ones not asked for lately are forgotten."""

    def __init__(self, work: Callable[[str], bytes]):
        super().__init__()
        self.work, self.former = work, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= _REMEMBERED:
            self.former = dict(self)
            self.clear()
        value = self.former.get(key)
        if value is None:
            value = self.work(key)
        self[key] = value
        return value


class _Words:
    """Token ids of a text as little-endian bytes, unit by unit.

    A text of plain Latin letters, digits and punctuation is cut into the
    tokenizer's units here; the vocabulary takes each directly, once as long as
    it is remembered. The tokenizer never joins what white space separates, so
    of another text only the words with other characters go through all of it.
    """

    _plain = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ‘’“”–—…€]*")
    # --- fixed value: the units of the tokenizer's file, for plain characters
    _units = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0x80, 0x2100) if self._plain.fullmatch(chr(c))]
        self.as_bytes = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in letters}
        self.unit = _Remembered(self._direct).__getitem__
        self.direct = True
        self.direct = self._checked()

    def _checked(self) -> bool:
        """Whether words cut here equal the whole tokenizer's on a few of them."""
        sample = ["Hello,", "Éclair...", "straße", "über!!", "ÀÖØÞ%%%", "a", "Naïve;", "don't", "x'sy", "!'s", "4é2", "“a”–b…€7", "l’été"]
        return all(self._plainly(w) == self._through(w) for w in sample)

    def _through(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _direct(self, unit: str) -> bytes:
        mapped = unit if unit.isascii() else unit.translate(self.as_bytes)
        return array("I", [token.id for token in self.model.tokenize(mapped)]).tobytes()

    def _plainly(self, text: str) -> bytes | None:
        """Ids of a plain text, None for another; "<|" may open a special token."""
        if self.direct and "<|" not in text and self._plain.fullmatch(text):
            return b"".join(map(self.unit, self._units.findall(text.lower())))
        return None

    def encode(self, text: str) -> bytes:
        whole = self._plainly(text)
        if whole is not None:
            return whole
        parts = []
        for word in text.replace("\n", " ").split(" "):
            ids = self._plainly(word)
            parts.append(self._through(word) if ids is None else ids)
        return b"".join(parts)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    words = _Words(path)
    end = np.array([END_ID], dtype="<u4").tobytes()
    task = TaskContext.get().partitionId()
    ranks = [0] * (capacity + 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", *(["ids"] if keep_ids else [])]
    for batch in batches:
        for begin in range(0, batch.num_rows, _TEXTS):
            part = batch.slice(begin, _TEXTS)
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = words.encode(text) + end
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - start)
                    cut = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, piece, start, length, zlib.crc32(cut), task, ranks[length])
                    rows.append((*row, np.frombuffer(cut, dtype="<u4").astype(np.int32)) if keep_ids else row)
                    ranks[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            kinds += [pa.list_(pa.int32())] if keep_ids else []
            columns = zip(*rows, strict=True)
            arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


class Rooms:
    """Segment tree that knows which remaining capacities occur among open sequences."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)

    def mark(self, room: int, some: bool) -> None:
        node = room + self.leaves
        self.some[node] = some
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """Smallest room of at least ``least`` that occurs."""
        node = least + self.leaves
        if self.some[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing of ``counts[length]`` pieces, as runs of equal placements.

    Columns: length, first rank, first sequence, pieces per sequence, offset.
    A run reaches to the next one of its length. Equal pieces fill a sequence
    before the next is touched, as its room stays the tightest.
    """
    rooms = Rooms(capacity)
    open_at: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    runs, sequences = [], 0

    def put(room: int, first: int, number: int) -> None:
        if number and room:
            if not open_at[room]:
                rooms.mark(room, True)
            open_at[room].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, first = capacity, sequences
                number = -(-left // (capacity // length))
                sequences += number
            else:
                first, number = open_at[room].pop()
                if not open_at[room]:
                    rooms.mark(room, False)
            each = room // length
            full = min(number, left // each)
            rest = min(left - full * each, each) if full < number else 0
            runs.append((length, rank, first, each, capacity - room))
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), number - full - bool(rest))
            rank += full * each + rest
            left -= full * each + rest
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def _placed(batches: Iterator[pa.RecordBatch], plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    keys = (plan[:, 0] << 48) | plan[:, 1]
    for batch in batches:
        length = np.asarray(batch.column("length"))
        rank = np.asarray(batch.column("rank")) + np.asarray(batch.column("base"))
        run = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
        within = rank - plan[run, 1]
        sequence = plan[run, 2] + within // plan[run, 3]
        offset = plan[run, 4] + within % plan[run, 3] * length
        kept = [n for n in batch.schema.names if n not in ("rank", "base", "task")]
        columns = [batch.column(n) for n in kept]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"]
        )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Where each piece of each document lies in sequences of at most ``capacity`` tokens.

    Reads ``doc_id`` and ``text``; other columns are ignored, whatever their
    names. ``vocabulary`` is the path of a tokenizer file, the same on every
    executor. A document is its token ids and a closing id 0; only longer ones
    are cut, into pieces of ``capacity``. Returns ``doc_id``, ``piece``,
    ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, and the
    token ids themselves as ``ids`` if ``keep_ids`` is set.

    A null or empty text is the closing id alone. A null ``doc_id`` stays null.
    Rows that repeat are packed each; equal lengths are placed in the order in
    which tasks read them. Long texts are tokenised whole. No rows give none.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    schema += ", ids array<int>" if keep_ids else ""
    pieces = scratch.keep(source.mapInArrow(giving_back(lambda b: _pieces(b, vocabulary, capacity, keep_ids)), schema), "pieces")

    # Ranks count from zero in each task; what came before is added per task.
    here = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    bases = scratch.keep(here.withColumn("base", before), "bases")
    counts = bases.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    plan = best_fit({row["length"]: row["n"] for row in counts}, capacity)

    ranked = pieces.join(bases.drop("n"), ["length", "task"])
    columns = [c for c in pieces.columns if c not in ("task", "rank")]
    kinds = dict(pieces.dtypes)
    out = ", ".join([*(f"{c} {kinds[c]}" for c in columns), "sequence_id long", "offset long"])
    return ranked.select(*columns, "task", "rank", "base").mapInArrow(giving_back(lambda b: _placed(b, plan)), out)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path(VOCABULARY), CAPACITY)
