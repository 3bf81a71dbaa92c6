"""Token ids in files of fixed-width bits: write in id order, read back with numpy, seek to any block.

File layout, little-endian: a header (magic, bits per id, ids per block, number of documents, of ids, of blocks), the
document ids and lengths (int64 each), the byte offset of every block (int64, from the start of the payload), and the
payload. Each block starts on a byte, so any id range can be read from its blocks alone.
"""

import os
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsieve.llm.work import new_folder, shared_folder

HEADER = struct.Struct("<8sIIQQQ")
MAGIC = b"LSPACK01"
NO_ID = -(1 << 63)  # stands for a null document id, and sorts before all others


def bits_for(vocabulary: int) -> int:
    """The least number of bits that holds every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits per id, lowest first, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat.reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


def to_bytes(doc_ids: list[int], documents: list[np.ndarray], bits: int, block: int) -> bytes:
    """One file of whole documents."""
    lengths = np.array([len(d) for d in documents], "<i8")
    ids = np.concatenate(documents) if documents else np.zeros(0, "<u4")
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<i8")[:-1]
    head = HEADER.pack(MAGIC, bits, block, len(documents), len(ids), len(blocks))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), lengths.tobytes(), offsets.tobytes(), *blocks])


class Packed:
    """A file's bytes, read by document or by id range without touching other blocks."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, self.block, docs, self.n_ids, blocks = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = HEADER.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.lengths = np.frombuffer(data, "<i8", docs, at + 8 * docs)
        self.offsets = np.frombuffer(data, "<i8", blocks, at + 16 * docs)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self._payload = memoryview(data)[at + 16 * docs + 8 * blocks :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        count = min((last + 1) * self.block, self.n_ids) - first * self.block
        if self.block * self.bits % 8 == 0:  # blocks follow each other without filling
            data = self._payload[self.offsets[first] :]
            found = unpack(data[: (count * self.bits + 7) // 8], count, self.bits)
        else:
            parts = [self._one(k) for k in range(first, last + 1)]
            found = np.concatenate(parts)
        return found[start - first * self.block : stop - first * self.block]

    def _one(self, k: int) -> np.ndarray:
        count = min(self.block, self.n_ids - k * self.block)
        return unpack(self._payload[self.offsets[k] :][: (count * self.bits + 7) // 8], count, self.bits)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others in order
    from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Values by key, made when first asked for; once ``most`` are kept, further ones are made again each time."""

    def __init__(self, make: Callable, most: int) -> None:
        super().__init__()
        self._make, self._most = make, most

    def __missing__(self, key: object) -> bytes:
        value = self._make(key)
        if len(self) < self._most:
            self[key] = value
        return value


class WordEncoder:
    """Ids of whole texts, word by word, with bounded caches of words and of their pieces.

    The tokenizer drops white space and treats each run of letters by itself, so a text's ids are those of its words in
    order. A word that ends in full stops or commas after a letter or digit is two pieces. Pieces of plain Latin letters
    go to the vocabulary's merges directly, in lower case and spelled as byte letters; all others take the tokenizer's
    whole path. Loading compares both ways on some words and keeps to the whole path if they differ. ``tokenizer`` loads
    the tokenizer: it takes no arguments and runs where the texts are.
    """

    PROBE = ["a", "Words", "stra\u00dfe", "\u00c9t\u00e9", "\u00f1and\u00fa", "abcdefghijklmnopqrstuvwxyz", "\u0160koda"]

    def __init__(self, tokenizer: Callable[[], object], most_words: int = 250_000, most_pieces: int = 350_000) -> None:
        self._tokenizer = tokenizer()
        self._merge = self._tokenizer.model.tokenize
        self._words, self._pieces = _Known(self._word, most_words), _Known(self._piece, most_pieces)
        self._letters = _byte_letters()
        self._direct = all(self._merged(p) == self._whole(p) for p in self.PROBE)

    def _whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _merged(self, piece: str) -> list[int]:
        letters = piece.lower()
        if not letters.isascii():  # an ASCII letter is its own byte letter
            letters = letters.encode().decode("latin-1").translate(self._letters)
        return [t.id for t in self._merge(letters)]

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        # below U+0250 letters are in normal form, and lower case is letter by letter but for the dotted I
        plain = self._direct and text.isalpha() and (text.isascii() or max(text) < "\u0250" and "\u0130" not in text)
        return array("I", self._merged(text) if plain else self._whole(text)).tobytes()

    def _word(self, word: bytes) -> bytes:
        stem = word.rstrip(b".,")
        if len(stem) < len(word) and stem and (stem[-1:].isalnum() or stem[-1] >= 0x80 and stem.decode()[-1].isalnum()):
            return self._pieces[stem] + self._pieces[word[len(stem) :]]
        return self._pieces[word]

    def encode(self, text: str) -> np.ndarray:
        data = text.encode()
        if self._direct and b"<|" not in data:  # A-Z alone, so that words of either case share an entry; special tokens keep theirs
            data = data.lower()
        # bytes split at ASCII white space alone
        return np.frombuffer(b"".join(map(self._words.__getitem__, data.split())), np.uint32)


_encoders: dict = {}


def _encoder(key: object, tokenizer: Callable[[], object]) -> WordEncoder:
    """One encoder per worker process: what it has learned serves the next task too."""
    if key not in _encoders:
        _encoders[key] = WordEncoder(tokenizer)
    return _encoders[key]


def from_file(path: str) -> Callable[[], object]:
    """Loads a tokenizer file on the executor; a missing library or file is an error there."""

    def load() -> object:
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return load


def _save(uri: str, name: str, data: bytes) -> None:
    """A file appears whole or not at all, and a repeated task replaces it by the same bytes."""
    system, folder = shared_folder(uri)
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, f"{folder}/{name}")


def _writer(uri: str, vocabulary_file: str, end_id: int, bits: int, block: int, ids_per_file: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary_file, from_file(vocabulary_file))
        shard, part, docs, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def save() -> pa.RecordBatch:
            name = f"ids-{shard:06d}-{part:06d}.bin"
            _save(uri, name, to_bytes(docs, ids, bits, block))
            return pa.RecordBatch.from_pydict({"file": [name], "docs": [len(docs)], "ids": [held]})

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for key, text in zip(keys, texts):
                docs.append(key)
                ids.append(np.append(encoder.encode(text), np.uint32(end_id)))
                held += len(ids[-1])
                if held >= ids_per_file:
                    yield save()
                    part, docs, ids, held = part + 1, [], [], 0
        if docs:
            yield save()

    return write


def write_ids(
    docs: DataFrame,
    folder: str,
    vocabulary_file: str,
    vocabulary: int,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = 4096,
    ids_per_file: int = 4_000_000,
    shards: int | None = None,
) -> DataFrame:
    """Encode whole texts and write them below ``folder``; one row per file: file, docs, ids, start.

    Texts are dealt by ranges of the id, so files in order of their names hold documents in ascending id. A file is
    closed at the first document that fills it. ``start`` is the number of ids in all files before it. Documents with
    one id lie together; among them the order is that of their texts. The listing is written as Parquet beside the
    files before anything is read, so a later read of it never encodes again.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    dealt = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    writer = _writer(folder, vocabulary_file, end_id, bits_for(vocabulary), block, ids_per_file)
    listing = f"{folder}/listing"
    dealt.mapInArrow(writer, "file string, docs long, ids long").write.parquet(listing)
    files = spark.read.schema("file string, docs long, ids long").parquet(listing)
    # one row per file: few, whatever the number of documents
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _encoders.clear()  # the files are written: a worker that is used again need not keep the words
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            file = Packed(data.as_py())
            ids = [file.ids(a, a + n) for a, n in zip(file.starts.tolist(), file.lengths.tolist())]
            keys = pa.array(file.doc_ids.tolist(), pa.int64(), mask=file.doc_ids == NO_ID)
            yield pa.RecordBatch.from_pydict(
                {
                    "file": [os.path.basename(path)] * len(ids),
                    "doc_id": keys,
                    "at": pa.array(file.starts.tolist(), pa.int64()),
                    "ids": pa.array([x.tobytes() for x in ids], pa.binary()),
                }
            )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: file, doc_id, at (first id within its file), ids (little-endian uint32 bytes)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(folder)
    return files.select("path", "content").mapInArrow(_reader, "file string, doc_id long, at long, ids binary")


def round_trip(docs: DataFrame, vocabulary_file: str, vocabulary: int, end_id: int, **options: int | str) -> DataFrame:
    """Write ``docs`` as packed ids and report from the files, per document: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone. A null id comes before all others and stays null. Repeated rows are
    written as often as they come. With no documents there are no files, and the result is empty. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "ids")
    files = write_ids(docs, folder, vocabulary_file, vocabulary, end_id, **options)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = read_ids(spark, folder).join(files.select("file", "start"), "file")
    return found.select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
