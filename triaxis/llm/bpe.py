"""BPE encoding and decoding through a table of distinct words.

Texts are split into words once. Texts of about `VOLUME` bytes make a volume, whose words become numbers of its own
list of distinct words. The table of distinct words is dealt out by ranges of the words' hashes: each volume sends
one block of its list to each range, where every distinct word is encoded once. A block's ids go back to its volume in
the order of the block, so they join the numbers by position, and the texts' numbers are replaced by them. What is
shuffled are compressed lists of distinct words, never the words of the texts; the most frequent word stands once a
volume. Decoding joins each id with the vocabulary's table of pieces, which has one row an id and goes to all workers.

Null text: no ids. Empty text: no ids. Repeated rows and repeated or null keys: each row has its result. Extra
columns are passed through; one named like an added column gets underscores at its end. An empty table gives an
empty table.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import chunks, clear, expected_bytes, forget, materialize, once, ready, text_buffer, trim, word_hashes

#: Bytes of text whose words share a list, volumes for each range of hashes, ranges at least and most, and words
#: or tokens put together at once.
VOLUME, VOLUMES, RANGES, DECODED = 16 << 20, 4, (32, 1 << 16), 1 << 20
#: Endings that the tokenizer's pattern parts from the word before them.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

class Splitter:
    """Splits a text into the words that the tokenizer of `config` (its JSON) encodes one by one."""

    #: Characters for which Python and the tokenizer's own engine agree on classes, case and normal forms, whatever
    #: stands beside them: Latin, Cyrillic, Hebrew and Arabic letters, punctuation, currencies, kana, Han, Hangul.
    SAFE = "\t-\r -~\u00a1-\u012f\u0131-\u024f\u0400-\u0482\u048a-\u052f\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fef\uac00-\ud7a3"
    BLANK, LETTER, NUMBER, OTHER, UNSAFE = range(5)

    def __init__(self, config: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would keep memory of their own
        from tokenizers import Tokenizer

        model = json.loads(config)
        self.special = [x["content"] for x in model["added_tokens"]]
        if not model["model"]["vocab"]:
            config = json.dumps(model | {"added_tokens": []})
        self.tokenizer = Tokenizer.from_str(config)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.kind = np.full(0xD7A5, self.UNSAFE, np.uint8)  # the last stands for all characters beyond
        for c in regex.findall(f"[{self.SAFE}]", "".join(map(chr, range(0xD7A4)))):
            self.kind[ord(c)] = self.BLANK if c.isspace() else {"L": self.LETTER, "N": self.NUMBER}.get(unicodedata.category(c)[0], self.OTHER)
        for c in regex.findall(f"[{self.SAFE}]", "".join(map(chr, range(0x530)))):  # small letters may lie beyond
            if len(c.lower()) == 1 and self.kind[ord(c)] == self.LETTER:
                self.kind[ord(c.lower())] = self.LETTER

    @staticmethod
    def of(config: str) -> "Splitter":
        return once("bpe splitter", config, lambda: Splitter(config))

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts in order, special tokens among them, and how many each text has."""
        if not texts:
            return pa.array([], pa.string()), np.zeros(0, np.int64)
        joined = "\n".join(texts)
        if self.safe(joined):
            return self.cut(joined.lower(), texts)
        found, counts, run = [], [], []

        def flush() -> None:
            if run:
                words, count = self.cut("\n".join(run).lower(), run)
                found.append(words)
                counts.append(count)
                run.clear()

        for t in texts:
            if self.safe(t):
                run.append(t)
            elif not self.by_special.search(t) and self.safe(normal := self.tokenizer.normalizer.normalize_str(t)):
                run.append(normal)
            else:
                flush()
                words = self.words(t)
                found.append(pa.array(words, pa.string()))
                counts.append(np.array([len(words)]))
        flush()
        return pa.concat_arrays(found), np.concatenate(counts)

    def safe(self, text: str) -> bool:
        if "<" in text and self.by_special.search(text):
            return False
        return not (self.kinds(text) == self.UNSAFE).any()

    def kinds(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.kind[np.minimum(points, len(self.kind) - 1)]

    def cut(self, joined: str, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """split() of safe texts, from their small letters joined by line feeds: a word ends where the kind of
        character changes, every digit is a word, and an apostrophe that stands alone takes some endings."""
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        edge = np.ones(len(points) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == self.NUMBER)
        after = np.append(points, [0, 0, 0]).astype(np.uint32)
        alone = np.flatnonzero((points == ord("'")) & edge[:-1] & edge[1:])
        one = alone[np.isin(after[alone + 1], list(map(ord, ONE_LETTER)))]
        two = alone[np.any([(after[alone + 1] == ord(a)) & (after[alone + 2] == ord(b)) for a, b in TWO_LETTERS], axis=0)]
        edge[np.concatenate([one, two]) + 1] = False
        edge[np.concatenate([one + 2, two + 3])] = True
        at = np.flatnonzero(edge)
        lo, hi = at[:-1], at[1:]
        word = kind[lo] != self.BLANK
        lo, hi = lo[word], hi[word]
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        counts = np.diff(np.searchsorted(lo, starts))
        raw = np.frombuffer(joined.encode(), np.uint8)
        size = hi - lo
        if len(raw) != len(points):
            place = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800).astype(np.int64))])
            size = place[hi] - place[lo]
        raw = raw[(raw != 32) & ((raw < 9) | (raw > 13))]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))), counts

    def words(self, text: str) -> list[str]:
        """The words of one text by the tokenizer's own steps."""
        out, at = [], 0
        for m in self.by_special.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.plain(text[at:])

    def plain(self, text: str) -> list[str]:
        text = self.tokenizer.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        found = self.tokenizer.encode_batch(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]


def read_config(spark, path: str) -> str:
    """The tokenizer's JSON, read once by the driver (its size is that of a vocabulary file)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def without_model(config: str) -> str:
    """A tokenizer's JSON with all that splits texts but without its vocabulary, which takes most of its memory."""
    own = json.loads(config)
    return json.dumps(own | {"model": own["model"] | {"vocab": {}, "merges": []}})


def press(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, compressed byte by byte."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpress(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def list_of(rows: pa.Array) -> pa.Array:
    """One list of all rows."""
    return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)


def volumes(docs: DataFrame, text: str, config, ranges: int) -> DataFrame:
    """A table of volumes: volume (its number), kept (rows without their texts), counts (words of each text), codes
    (the words' numbers), ranks (place of each number in the order of ranges, then names) and size (distinct words); and of
    the blocks of their lists: volume, range (null for a volume's own row) and words."""
    others = [c for c in docs.columns if c != text]
    own = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.lit(True).alias("one")).alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("whole"))

    kind = T.StructType([T.StructField("volume", T.LongType()), T.StructField("kept", T.ArrayType(own.schema["kept"].dataType)), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType()), T.StructField("ranks", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("range", T.IntegerType()), T.StructField("words", T.BinaryType())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = Splitter.of(config.value), TaskContext.get().partitionId() << 32
        kept, counts, found, held = [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            coded = pa.concat_arrays(found).dictionary_encode()
            words, codes = coded.dictionary, coded.indices.to_numpy()
            often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent words have small numbers
            words, codes = words.take(pa.array(often)), np.argsort(often)[codes]
            by_name = pc.sort_indices(words).to_numpy()  # names in order compress well
            words = words.take(pa.array(by_name))
            at = (hashes(words) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            order = np.argsort(at, kind="stable")  # by range, then by name
            words, at = words.take(pa.array(order)), at[order]
            ranks = np.empty(len(words), np.int64)
            ranks[by_name[order]] = np.arange(len(words))
            yield batch(1, volume=pa.array([number]), kept=list_of(pa.concat_arrays(kept)), counts=list_of(pa.array(np.concatenate(counts))), codes=pa.array([press(codes)], pa.binary()), ranks=pa.array([press(ranks)], pa.binary()), size=pa.array([len(words)], pa.int32()))
            cut = np.searchsorted(at, np.arange(ranges + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut))
            lists = ["\n".join(words.slice(cut[r], cut[r + 1] - cut[r]).to_pylist()).encode() for r in full.tolist()]  # no word holds a line feed
            shrink = zstandard.ZstdCompressor(level=3).compress
            yield batch(len(full), volume=pa.array(np.full(len(full), number)), range=pa.array(full.astype(np.int32)), words=pa.array([shrink(x) for x in lists], pa.binary()))

        def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, to_arrow_type(f.dataType)) for f in kind], names=kind.names)

        for part, data, _ in chunks(batches, "whole"):
            words, count = own.split(part.column(1).to_pylist())
            kept.append(part.column(0))
            counts.append(count)
            found.append(words)
            held += len(data) + 64 * part.num_rows
            if held >= VOLUME:
                yield from out()
                kept, counts, found, held, number = [], [], [], 0, number + 1
        if kept:
            yield from out()

    return materialize(own.mapInArrow(build, kind))


def hashes(words: pa.Array) -> np.ndarray:
    data, off = text_buffer(words)
    return word_hashes(data, off[:-1], off[1:])


def encoded(blocks: DataFrame, config, ranges: int) -> DataFrame:
    """(of, range, sizes, ids): for each volume and range of hashes the ids of its words, in the order of the block,
    and how many each has."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, expand = Splitter.of(config.value), zstandard.ZstdDecompressor().decompress
        known: dict[str, np.ndarray] = {}
        current = None
        for batch in batches:
            out = []
            for r, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if r != current:
                    known, current = {}, r
                words = expand(data).decode().split("\n")
                new = [w for w in words if w not in known]
                known.update(zip(new, own.encode(new)))
                found = [known[w] for w in words]
                out.append((press(np.array([len(x) // 4 for x in found])), press(np.frombuffer(b"".join(found), "<u4"))))
            sizes, ids = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["of", "range", "sizes", "ids"])
        known, own = {}, None
        forget()

    dealt = blocks.repartition(ranges, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(encode, "of long, range int, sizes binary, ids binary")


def runs(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of every pair, end to end."""
    total = np.cumsum(size)
    return values[np.repeat(start - total + size, size) + np.arange(total[-1] if len(total) else 0)]


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All integers of a column of ids, and where each row's begin (nulls have none)."""
    column = column.fill_null(b"") if column.null_count else column
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view("<u4") if data is not None else np.zeros(0, np.uint32), (off - off[0]) // 4


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Adds `ids` (binary: little-endian unsigned 32-bit integers) to every row; `text` is left out."""
    spark = docs.sparkSession
    ready(spark)
    full = read_config(spark, tokenizer_path)
    config, light = spark.sparkContext.broadcast(full), spark.sparkContext.broadcast(without_model(full))
    others = clear(docs.select([c for c in docs.columns if c != text]), "ids").columns
    ranges = min(RANGES[1], max(RANGES[0], expected_bytes(docs) // (VOLUMES * VOLUME)))
    table = volumes(docs, text, light, ranges)
    held = table.where("range is null").drop("range", "words")
    blocks = table.where("range is not null").select(F.col("volume").alias("of"), "range", "words")

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        forget()
        parts, right = [], right.sort_by("range")
        many = np.concatenate([np.zeros(0, np.uint32), *[unpress(x) for x in right["sizes"].to_pylist()]]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, np.uint32), *[unpress(x) for x in right["ids"].to_pylist()]])
        first = np.cumsum(many) - many
        for i in range(left.num_rows):
            if len(many) != left["size"][i].as_py():
                raise ValueError("words without ids")
            codes, rank, counts = unpress(left["codes"][i].as_py()), unpress(left["ranks"][i].as_py()), left["counts"][i].values.to_numpy()
            ends = np.concatenate([[0], np.cumsum(counts)])
            lo = 0
            while lo < len(counts):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + DECODED, "right")) - 1)
                at = rank[codes[ends[lo] : ends[hi]]]
                size = many[at]
                cut = np.concatenate([[0], np.cumsum(size)])[ends[lo : hi + 1] - ends[lo]]
                out = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(runs(ids, first[at], size))])
                parts.append(pa.table({"kept": left["kept"][i].values.slice(lo, hi - lo), "ids": out}))
                lo = hi
        trim()
        return pa.concat_tables(parts)

    # both sides by volume: a task holds one volume and the ids of its list
    both = held.groupBy("volume").cogroup(encoded(blocks, config, ranges).groupBy("of"))
    out = both.applyInArrow(back, T.StructType([T.StructField("kept", held.schema["kept"].dataType.elementType), T.StructField("ids", T.BinaryType())]))
    return out.select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(others)], "ids")


def piece_table(config: str) -> pa.Array:
    """The piece of each id, by id."""
    from tokenizers import Tokenizer

    by_id = {i: p for p, i in Tokenizer.from_str(config).get_vocab(with_added_tokens=True).items()}
    return pa.array([by_id.get(i) for i in range(max(by_id, default=-1) + 1)], pa.string())


def decode(rows: DataFrame, tokenizer_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Replaces `ids` by the text of its pieces, one blank between two; special tokens are kept."""
    spark = rows.sparkSession
    ready(spark)
    table = spark.sparkContext.broadcast(piece_table(read_config(spark, tokenizer_path)))
    others = [c for c in rows.columns if c != ids]
    names = clear(rows.select(others), to).columns

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        piece = table.value
        for batch in batches:
            every, first = binary_parts(batch.column(1))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + DECODED, "right")) - 1)
                said = piece.take(pa.array(every[first[lo] : first[hi]].astype(np.int64)))
                if said.null_count:
                    raise ValueError("an id without a piece")
                lists = pa.ListArray.from_arrays(pa.array((first[lo : hi + 1] - first[lo]).astype(np.int32)), said)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pc.binary_join(lists, " ")], names=["kept", "said"])
                lo = hi
        trim()

    own = rows.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.lit(True).alias("one")).alias("kept"), ids)
    out = own.mapInArrow(pieces, T.StructType([own.schema["kept"], T.StructField("said", T.StringType())]))
    return out.select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(names)], F.col("said").alias(to))
