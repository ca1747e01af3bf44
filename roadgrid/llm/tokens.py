"""Token-id output: patched frame-of-reference blocks in files of consecutive documents."""

from __future__ import annotations

import itertools
import json
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrid.llm.store import mapped, written
from roadgrid.worker import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK = 4096
#: The share of a block's ids that fit its packed width; the others are exceptions.
PERCENTILE = 95.0
MAGIC = b"RGTI"
#: Ids a file holds at most, but for its last document.
FILE_IDS = 1 << 20
#: Bytes of words whose ids a Python worker remembers, from task to task.
CACHE_BYTES = 48 << 20
#: Characters that are tokenized at once.
PIECE_CHARS = 1 << 19


# --- file format -----------------------------------------------------------
# magic, then as little-endian u32: number of ids, ids a block, blocks; then the
# start of each block (u64, from the end of the index); then the blocks:
# u32 minimum, u8 width, u32 exceptions; packed offsets; exception places (u16)
# and offsets (u32).


def pack(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    if width in (8, 16):  # the same bytes
        return values.astype(f"<u{width // 8}").tobytes()
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    if width in (8, 16):
        return data.view(f"<u{width // 8}").astype(np.uint32)
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    return bits @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    least = int(ids.min())
    off = (ids - np.uint32(least)).astype(np.uint32)
    kth = int(np.ceil(len(off) * percentile / 100)) - 1
    width = int(np.partition(off, kth)[kth]).bit_length()
    out = np.flatnonzero(off >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    head = np.array([least], "<u4").tobytes() + bytes([width]) + np.array([len(out)], "<u4").tobytes()
    body = off & np.uint32((1 << width) - 1)
    return head + pack(body, width) + out.astype("<u2").tobytes() + off[out].astype("<u4").tobytes()


def decode_block(data: bytes, at: int, n: int) -> np.ndarray:
    least, width = int.from_bytes(data[at : at + 4], "little"), data[at + 4]
    k = int.from_bytes(data[at + 5 : at + 9], "little")
    at, size = at + 9, (n * width + 7) // 8
    off = unpack(np.frombuffer(data, np.uint8, size, at), n, width).astype(np.uint32)
    if k:
        off[np.frombuffer(data, "<u2", k, at + size)] = np.frombuffer(data, "<u4", k, at + size + 2 * k)
    return off + np.uint32(least)


def encode_ids(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The file of these ids."""
    blocks = [encode_block(ids[k : k + block], percentile) for k in range(0, len(ids), block)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else []
    return MAGIC + np.array([len(ids), block, len(blocks)], "<u4").tobytes() + np.array(starts, "<u8").tobytes() + b"".join(blocks)


def decode_ids(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first to last of a file; only the blocks that hold them are read."""
    if data[:4] != MAGIC:
        raise ValueError("not a token-id file")
    n, block, blocks = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
    last = n if last is None else min(last, n)
    starts = np.frombuffer(data, "<u8", blocks, 16)
    if last <= first:
        return np.empty(0, np.uint32)
    base, b0, b1 = 16 + 8 * blocks, first // block, -(-last // block)
    ids = np.concatenate([decode_block(data, base + int(starts[b]), min(block, n - b * block)) for b in range(b0, b1)])
    return ids[first - b0 * block : last - b0 * block]


# --- tokenizing --------------------------------------------------------------


_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_DIGITS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SYMBOLS = r"\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7"
#: The vocabulary's splitter on Latin-1 text: each match is a piece that is encoded by itself.
PIECE = re.compile(rf"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_SYMBOLS}]+|[{_DIGITS}]")
#: Text that isn't split by PIECE: beyond Latin-1, controls, or with what may be a special token.
OTHER = re.compile(r"[^\x09\x0a\x0d\x20-\x7e\xa0-\xff]|<\|")


#: What keeps text from being words with single full stops and commas.
NOT_PROSE = re.compile(r"[^A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff \n.,]|[.,][.,]")


# The normalizer and splitter, as vocabulary files state them, that pieces() follows.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
KNOWN_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": KNOWN_SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def cuts_as_known(spec: dict) -> bool:
    """Whether texts of a vocabulary file may be cut by pieces(): its own cutting is known and no added token crosses a cut."""
    added = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    return added and spec["normalizer"] == KNOWN_NORMALIZER and spec["pre_tokenizer"] == KNOWN_SPLITTER and spec["model"].get("end_of_word_suffix") == "</w>"


def pieces(text: str) -> list:
    """Parts of the text whose ids, in order, are the text's.

    Latin-1 letters have one composed and one lower form, so pieces of such text
    can be cut out and lower-cased first. Other text is cut at spaces and line
    feeds only: nothing of the normalizer and splitter reaches across them.
    """
    if not NOT_PROSE.search(text):
        return text.lower().replace(".", " . ").replace(",", " , ").split()
    return text.replace("\n", " ").split(" ") if OTHER.search(text) else PIECE.findall(text.lower())


class WholeTexts:
    """Ids of whole texts by the library of the vocabulary file: tokenizers, tiktoken or sentencepiece."""

    def __init__(self, encode):
        self._encode = encode

    def encode(self, texts: list) -> list:
        return [np.array(ids, np.uint32) for ids in self._encode(texts)]


class Encoder(dict):
    """Ids of whole texts by the tokenizers library, which sees each different word once.

    The vocabulary's normalizer and splitter never join characters across a
    space or line feed and keep nothing of them, so the ids of a text are those
    of its words, in order. The dict has a number for each word.
    """

    def __init__(self, tokenizer, closes: np.ndarray):
        self.tokenizer, self.closes = tokenizer, closes
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list = []
        self.held = 0
        self.lengths, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        self.held += 200 + len(word)  # with the entry, its number and ids
        return n

    def learn(self) -> None:
        """Adds the ids of the fresh words.

        Words of a single piece, whose last id alone closes a word, are encoded
        as one text.
        """
        plain = np.array([PIECE.fullmatch(w) is not None for w in self.fresh], bool)
        words = [w for w, p in zip(self.fresh, plain) if p]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):
            plain[:], words, ids, ends = False, [], ids[:0], ends[:0]
        lengths = np.zeros(len(plain), np.int64)
        own = np.diff(ends, prepend=0)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w for w, p in zip(self.fresh, plain) if not p], add_special_tokens=False)]
        others = np.fromiter(map(len, found), np.int64, len(found))
        lengths[plain], lengths[~plain] = own, others
        parts = np.concatenate((ids, np.fromiter((i for x in found for i in x), np.uint32, int(others.sum()))))
        starts = np.zeros(len(plain), np.int64)
        starts[plain], starts[~plain] = ends - own, len(ids) + np.cumsum(others) - others
        self.lengths = np.concatenate((self.lengths, lengths))
        self.starts = np.concatenate((self.starts, starts + len(self.flat)))
        self.flat = np.concatenate((self.flat, parts))
        self.fresh = []

    def encode(self, texts: list) -> list:
        """One array of ids a text."""
        if self.held > CACHE_BYTES:
            self.forget()
        split = [pieces(t) for t in texts]
        sizes = [len(x) for x in split]
        at = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(split)), np.int64, sum(sizes))
        if self.fresh:
            self.learn()
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[at] - (ends - lengths), lengths)
        return np.split(self.flat[place], np.concatenate(([0], ends))[np.cumsum(sizes)[:-1]])


def _loaded(path: str) -> tuple:
    """(what encodes, None), or for a vocabulary that pieces() knows (its tokenizer, whether an id closes a word)."""
    import os

    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [own.encode_ordinary(t) for t in texts], None
    if path.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: own.encode(texts, num_threads=1), None
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    own = Tokenizer.from_file(path)
    if not cuts_as_known(spec):
        return lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)], None
    vocabulary = own.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, bool)
    closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
    return own, closes


def encoder(path: str):
    """What encodes lists of texts by a vocabulary file. A worker has one, with the words that it has learnt."""
    loaded = kept("vocabularies")
    if path not in loaded:
        loaded.clear()
        own, closes = _loaded(path)
        loaded[path] = WholeTexts(own) if closes is None else Encoder(own, closes)
    return loaded[path]


def vocabulary_path(vocabulary: str) -> str:
    """A vocabulary file by its path, or by its name among the installed public ones."""
    import os

    if os.path.exists(vocabulary):
        return vocabulary
    import public_tokenizers

    return str(public_tokenizers.path(vocabulary))


FILES = "part int, seq int, first_doc long, n_docs long, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary"
_FILES = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def _writer(vocabulary: str, end_id: int, block: int, percentile: float):
    def write(batches):
        from pyspark import TaskContext

        part, seq, ids, docs, held = TaskContext.get().partitionId(), 0, [], [], 0
        enc = encoder(vocabulary_path(vocabulary))
        end = np.array([end_id], np.uint32)

        def file():
            data = encode_ids(np.concatenate(ids), block, percentile)
            row = [part, seq, docs[0], len(docs), held, docs, [len(x) for x in ids], data]
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _FILES)], schema=_FILES)

        for batch in batches:
            names, column, row = batch.column(0).to_pylist(), batch.column(1), 0
            while row < len(names):
                texts, chars = [], 0
                while row + len(texts) < len(names) and (not texts or chars < PIECE_CHARS):
                    texts.append(column[row + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                for name, own in zip(names[row : row + len(texts)], enc.encode(texts)):
                    if docs and held + len(own) + 1 > FILE_IDS:
                        yield file()
                        seq, ids, docs, held = seq + 1, [], [], 0
                    ids.append(np.concatenate((own, end)))
                    docs.append(name)
                    held += len(own) + 1
                row += len(texts)
        if docs:
            yield file()

    return write


def write_ids(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, block: int = BLOCK, percentile: float = PERCENTILE) -> DataFrame:
    """Writes docs(doc_id, text) as token-id files; the table of files, read back from shared storage.

    Documents are in ascending doc_id order over part, seq and place in the file
    (null first; rows with one doc_id by text). Each text is encoded whole, null
    as empty, and ends with end_id. A file is the payload of a row of a Parquet
    table, so that it reaches any storage Spark reaches and is committed with
    its task; part and seq order the files (export_files() writes them out). An
    empty table gives no files. A text is held whole with its ids, however long.
    Texts of vocabularies whose cutting isn't known go to their library whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(mapped(ranged, _writer(vocabulary, end_id, block, percentile), FILES), "token-ids")


def export_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes the files of write_ids() as files of their own; path, part, seq, first_doc, n_docs, n_ids of each.

    folder is a path or URI that every executor reaches by Arrow's filesystems
    (file, hdfs, s3, gs). A file is written aside and then moved to its name, so
    a task that is run again leaves the same files.
    """
    from pyspark import TaskContext

    def export(batches):
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        target.create_dir(base, recursive=True)
        for batch in batches:
            paths = []
            for part, seq, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(5)):
                paths.append(f"{base}/{part:06d}-{seq:06d}.rgti")
                aside = f"{paths[-1]}.{TaskContext.get().taskAttemptId()}"
                with target.open_output_stream(aside) as out:
                    out.write(data.as_py())
                target.move(aside, paths[-1])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *batch.columns[:5]], names=["path", "part", "seq", "first_doc", "n_docs", "n_ids"])

    rows = files.select("part", "seq", "first_doc", "n_docs", "n_ids", "payload")
    return written(rows.mapInArrow(export, "path string, part int, seq int, first_doc long, n_docs long, n_ids long"), "token-files")


def _reader(batches):
    out = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for row in range(batch.num_rows):
            part, seq, names, lengths, data = (batch.column(k)[row] for k in range(5))
            ids = decode_ids(data.as_py()).astype("<u4")
            lengths = np.array(lengths.as_py(), np.int64)
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), lengths.tolist())]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), names.values, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], schema=out
            )


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, decoded from the files.

    Starts are sums over files, in order: first over the files of a part, then
    over parts, whose number is the writer's. Rows that share a doc_id, or have
    none, are read one by one, in the order in which they were written. Without
    files there are no rows; a file is decoded whole, and holds FILE_IDS ids at
    most or one document.
    """
    from pyspark.sql import Window

    heads = files.select("part", "seq", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))
    whole = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = heads.withColumn("inner", F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    starts = within.join(whole, "part").select("part", "seq", (F.col("before") + F.col("inner")).alias("base"))
    each = files.select("part", "seq", "doc_ids", "doc_lengths", "payload").mapInArrow(_reader, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return each.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
