"""Token ids in binary files, each document compressed on its own with a shared zstandard dictionary.

A file holds a contiguous range of documents in ascending doc_id order (nulls first; repeated ids by text):

    head    8 bytes magic, 4 bytes id width (2 or 4), 32 bytes SHA-256 of the dictionary (of nothing: no dictionary)
    frames  one zstandard frame per document over its little-endian ids
    index   per document: doc_id int64, has id uint8, offset uint64, ids uint32
    tail    offset of the index and number of documents, uint64 each, 8 bytes magic

A short document is read with one look at the index and one small read. The dictionary is trained on the id arrays of a
bounded sample (``SAMPLE_DOCS`` documents with the smallest hash of their id, of each at most ``SAMPLE_IDS`` ids in
``SAMPLE_PIECES`` pieces spread evenly from its start to its end); all documents are written whole. Files go to the shared folder under a temporary name and are renamed when whole, so a
repeated task replaces its own file with the same bytes.

Encoding splits a text at ASCII blanks, which this tokenizer drops, and encodes each distinct word once per worker
(a bounded cache): the ids are those of the whole text. A text with the start of a special token is encoded whole.

A null or empty text has the end id alone. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"GWIDS\x00\x00\x01"
HEAD, TAIL = "<8sI32s", "<QQ8s"
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("ids", "<u4")])
SAMPLE_DOCS, SAMPLE_IDS, SAMPLE_PIECES, DICTIONARY_BYTES = 512, 4096, 8, 32768
LEVEL = 3
#: Words a worker remembers before it forgets all but those in use, and bytes of text that are split into words at once.
CACHE_WORDS, SLICE_BYTES = 400_000, 8_000_000
#: Punctuation that may be cut off the end of a word: a new token starts there in any case.
ENDINGS = '.,!%&$#*|;:?"()'


class WordEncoder:
    """Ids of texts by way of their distinct words. What is remembered are words without the punctuation behind them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.separator, self.separator_id = max(added.items(), key=lambda x: x[1])
        self.special = os.path.commonprefix(list(added))
        self.known = kernels.WordTable()
        self.known.add([""], np.empty(0, np.int64), np.zeros(1, np.int64))

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = texts.fill_null("")
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES)))
            yield from self._slice(texts.slice(at, end - at))
            at = end

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        odd = pc.match_substring(texts, self.special).to_numpy(zero_copy_only=False) if self.special else np.zeros(len(texts), bool)
        whole = {i: texts[i].as_py() for i in np.flatnonzero(odd).tolist()}
        if whole:
            texts = pc.if_else(pa.array(odd), "", texts)
        # Cuts at runs of ASCII blanks; at the ends of a text it may leave empty words, which have no ids.
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        core, tail = self._codes(words.dictionary.to_pylist())
        # Every word is its core and then what follows it.
        at = words.indices.to_numpy()
        code = np.stack([core[at], tail[at]], axis=1).reshape(-1)
        ids = self.known.of(code).astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(self.known.length[code])])
        cuts = ends[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())]
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if i in whole:
                yield np.array(self.tokenizer.encode(whole[i], add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[a:b]

    def _codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each word's core and of the punctuation behind it, after learning those that are new."""
        cores, tails = [], []
        for w in words:
            # Lower case is a matter of the tokenizer; for ASCII it can come first and makes fewer words.
            low = w.lower() if w.isascii() else w
            core = low.rstrip(ENDINGS)
            if len(core) == len(low) or not core or not ("a" <= core[-1] <= "z" or "A" <= core[-1] <= "Z"):
                core, tail = low, ""
            else:
                tail = low[len(core) :]
            cores.append(core)
            tails.append(tail)
        if len(self.known) > CACHE_WORDS:
            self.known = self.known.only([w for w in {*cores, *tails, ""} if w in self.known.code])
        if new := self.known.unknown(cores + tails):
            for i in range(0, len(new), 20_000):
                self.known.add(new[i : i + 20_000], *self._encoded(new[i : i + 20_000]))
        find = self.known.code.__getitem__
        return tuple(np.fromiter(map(find, x), np.int64, len(x)) for x in (cores, tails))

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of many words from few calls, with a special token between them."""
        joined = [self.separator.join(words[i : i + 500]) for i in range(0, len(words), 500)]
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        flat = np.concatenate([np.array([*e.ids, self.separator_id], np.int64) for e in found])
        marks = np.flatnonzero(flat == self.separator_id)
        return flat[flat != self.separator_id], np.diff(np.concatenate([[-1], marks])) - 1


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 65536 else 4


def _encoder(path: str) -> WordEncoder:
    return kernels.kept(f"word encoder {path}", lambda: WordEncoder(path))


def _serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def spread(ids: np.ndarray) -> np.ndarray:
    """Pieces from all over a document, in order; all of it where it is no longer than the sample."""
    if len(ids) < SAMPLE_IDS:
        return ids
    size = (SAMPLE_IDS - 1) // SAMPLE_PIECES
    starts = np.linspace(0, len(ids) - size, SAMPLE_PIECES).astype(np.int64)
    return ids[(starts[:, None] + np.arange(size)).ravel()]


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """The dictionary's bytes; empty where the sample is too small to train one."""
    width = id_width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = []
        for batch in batches:
            for ids in _encoder(path)(batch.column(0)):
                samples.append(_serialized(np.append(spread(ids), end_id), width))
        try:
            found = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if samples else b""
        except zstandard.ZstdError:
            found = b""
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["dictionary"])

    order = [F.xxhash64("doc_id"), "doc_id", "text"]
    sample = docs.select("doc_id", "text").orderBy(*order).limit(SAMPLE_DOCS).select("text").coalesce(1)
    rows = sample.mapInArrow(run, "dictionary binary").collect()
    return bytes(rows[0]["dictionary"]) if rows else b""


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


FILES = "file string, part int, docs long, ids long"


def write_files(docs: DataFrame, folder: str, path: str, end_id: int) -> DataFrame:
    """Write all documents' ids under ``folder``; a row per file: file, part, docs, ids. Lazy: save it once."""
    width, dictionary = id_width(path), train_dictionary(docs, path, end_id)
    mark = hashlib.sha256(dictionary).digest()
    where, base = _place(folder)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/dictionary-{mark.hex()[:16]}") as out:
        out.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _place(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        packer = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        index, total, offset = [], 0, struct.calcsize(HEAD)
        with fs.open_output_stream(f"{at}/_part-{part:06d}-{attempt}") as out:
            out.write(struct.pack(HEAD, MAGIC, width, mark))
            for batch in batches:
                for name, ids in zip(batch.column(0).to_pylist(), _encoder(path)(batch.column(1))):
                    ids = np.append(ids, np.uint32(end_id))
                    frame = packer.compress(_serialized(ids, width))
                    out.write(frame)
                    index.append((name or 0, name is not None, offset, len(ids)))
                    offset += len(frame)
                    total += len(ids)
            out.write(np.array(index, dtype=INDEX).tobytes())
            out.write(struct.pack(TAIL, offset, len(index), MAGIC))
        if index:
            fs.move(f"{at}/_part-{part:06d}-{attempt}", f"{at}/part-{part:06d}")
            row = [[f"{folder}/part-{part:06d}"], [part], [len(index)], [total]]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["file", "part", "docs", "ids"])
        else:
            fs.delete_file(f"{at}/_part-{part:06d}-{attempt}")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The number of ranges follows spark.sql.shuffle.partitions.
    ordered = texts.repartitionByRange(common.partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, FILES)


class TokenFile:
    """Reads one file: ``index`` and the ids of any document by its place."""

    def __init__(self, uri: str):
        fs, at = _place(uri)
        self.file = fs.open_input_file(at)
        magic, self.width, mark = struct.unpack(HEAD, self.file.read_at(struct.calcsize(HEAD), 0))
        size = self.file.size()
        offset, count, end = struct.unpack(TAIL, self.file.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{uri} is no whole token file")
        self.index = np.frombuffer(self.file.read_at(count * INDEX.itemsize, offset), INDEX)
        self.ends = np.append(self.index["offset"][1:], np.uint64(offset)).astype(np.int64)
        with fs.open_input_stream(f"{at.rsplit('/', 1)[0]}/dictionary-{mark.hex()[:16]}") as shared:
            dictionary = shared.read()
        if hashlib.sha256(dictionary).digest() != mark:
            raise ValueError(f"{uri} was written with another dictionary")
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> np.ndarray:
        start = int(self.index["offset"][i])
        raw = self.unpacker.decompress(self.file.read_at(int(self.ends[i]) - start, start))
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray:
        """Ids of one document, by binary search in the index."""
        first = int((self.index["has_id"] == 0).sum())
        i = first + int(np.searchsorted(self.index["doc_id"][first:], doc_id))
        if i == len(self.index) or self.index["doc_id"][i] != doc_id:
            raise KeyError(doc_id)
        return self.ids(i)


def _read(files: DataFrame, schema: str, value) -> DataFrame:
    """A row per document of the files: doc_id, start (ids of all documents before it), then what ``value`` makes of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source = TokenFile(name)
                ids = source.index["ids"].astype(np.int64)
                begins = start + np.cumsum(ids) - ids
                for i in range(0, len(ids), 1000):
                    part = source.index[i : i + 1000]
                    values = [value(source.ids(j)) for j in range(i, i + len(part))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part["doc_id"].copy(), mask=part["has_id"] == 0),
                            pa.array(begins[i : i + 1000]),
                            pa.array(ids[i : i + 1000]),
                            pa.array(values),
                        ],
                        ["doc_id", "start", "n_tokens", "value"],
                    )

    from pyspark.sql import Window

    # One row per file, so this window is over as many rows as the write had partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    return placed.repartition(common.partitions(files.sparkSession)).mapInArrow(run, schema)


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, value (the ids) of every document in the files."""
    return _read(files, "doc_id long, start long, n_tokens long, value array<long>", lambda ids: ids.astype(np.int64))


def read_checksums(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    schema = "doc_id long, start long, n_tokens long, value long"
    return _read(files, schema, lambda ids: zlib.crc32(ids.tobytes())).withColumnRenamed("value", "ids_crc32")


def written_files(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write the files to a fresh place in the shared folder; a row per file."""
    scratch = common.Scratch(docs.sparkSession, "token-files")
    return scratch.write(write_files(docs, f"{scratch.root}/ids", path, end_id), "files")
