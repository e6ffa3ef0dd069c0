"""Token ids as length-delimited binary records, with an offset index.

File format (little endian): a frame is u64 payload length, u32 masked crc32 of
those 8 bytes, payload, u32 masked crc32 of the payload. Payload: a byte 1 if the
document id is not NULL, a byte with the width of a token id (2 if the vocabulary
has at most 65,536, else 4), i64 document id, then the token ids. A frame of length 0 ends a block and holds nothing. The mask is that of the usual
record format: rotate right by 15 bits and add 0xA282EAD8.

Spark's own text writer commits the files: a row is a block of whole frames as
raw bytes, and the line separator is the empty frame. So tasks that are lost or
run twice leave no trace, on any file system that Spark writes to. Files follow
the id order by the number in their name.
"""

from __future__ import annotations

import array
import json
import os
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.session import run_dir, ship_package

BLOCK_BYTES = 1 << 20       # frames are gathered to blocks of about this size
GROUP_CHARS = 2 << 20       # of texts encoded together
FILE_BYTES = 16 << 20       # text bytes a file is made from
TABLE_BYTES = 120 << 20     # of the pieces a worker remembers, twice
ENTRY_BYTES = 180           # of a piece besides its characters and ids

#: Characters beside which a blank is no sure cut: white space of any kind, and
#: characters that regular expression libraries disagree on.
_ODD = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029,
                         0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
_ODD_ASCII = [c for c in _ODD if c.isascii()]
#: The splitter takes a run of these behind a letter by itself (an apostrophe may begin a word's ending).
_ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return n + struct.pack("<I", masked(n)) + payload + struct.pack("<I", masked(payload))


def frames(data: bytes, at: int = 0, end: int | None = None):
    """(offset, length, payload) of the frames in data[at:end], checked; a
    damaged or cut frame raises ValueError."""
    end = len(data) if end is None else end
    while at < end:
        head = data[at:at + 12]
        if len(head) < 12 or struct.unpack_from("<I", head, 8)[0] != masked(head[:8]):
            raise ValueError(f"damaged length at byte {at}")
        n = struct.unpack_from("<Q", head)[0]
        payload, tail = data[at + 12:at + 12 + n], data[at + 12 + n:at + 16 + n]
        if len(payload) < n or len(tail) < 4 or struct.unpack("<I", tail)[0] != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        if n:
            yield at, n + 16, payload
        at += n + 16


def record(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<?Bq", doc_id is not None, width, doc_id or 0) + ids


def fields(payload: bytes):
    """(document id, token ids as an array of unsigned 32-bit integers)."""
    import numpy as np

    there, width, doc_id = struct.unpack_from("<?Bq", payload)
    return (doc_id if there else None), np.frombuffer(payload, dtype=f"<u{width}", offset=10).astype("<u4")


class Pieces(dict):
    """Ids of pieces: a word behind a blank, or a line feed and the word behind
    it. What is missing is encoded when it is first asked for. There are two
    generations, so that pieces in use survive when the table is turned over."""

    def __init__(self, encoder: Encoder, older: dict):
        super().__init__()
        self.encoder, self.older, self.bytes = encoder, older, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encoder.piece(piece)
        self[piece] = ids
        self.bytes += len(piece) + len(ids) + ENTRY_BYTES
        return ids


class Encoder:
    """Token ids of whole texts, as bytes of integers of ``width`` bytes.

    The vocabulary's splitter never joins across a blank or a line feed that has
    a plain character on either side, nor a run of ASCII punctuation without an
    apostrophe behind a letter with that letter. So such texts are encoded by pieces, each distinct piece
    once by the library, and Latin words, which the splitter takes whole, by the
    library's model alone; other texts go to it whole, as do those that hold the
    string of an added token, which is that one id, and all texts if the vocabulary
    has another splitter. A test holds all equal.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        how = json.loads(self.tokenizer.to_str())
        splitter, model = how["pre_tokenizer"] or {}, how["model"]
        self.by_pieces = (how["normalizer"] is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True)
                          and not splitter.get("add_prefix_space") and model["type"] == "BPE"
                          and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")))
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        # the byte-level alphabet: printable Latin-1 stands for itself, the other
        # bytes for the characters from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.alphabet = {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}
        self.blank = chr(self.alphabet[32])
        self.feed = self.whole(["\n"])[0] if self.by_pieces else b""
        self.ends: dict[str, bytes] = {}                    # runs of punctuation behind a word
        self.pieces = Pieces(self, {})

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array.array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def piece(self, piece: str) -> bytes:
        stem = piece.rstrip(_ENDS)
        line = piece[0] == "\n"
        word = stem[1:] if line else stem
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0250"):
            return self.feed + self.whole([piece[1:]])[0] if line else self.whole([" " + piece])[0]
        if len(stem) < len(piece):              # the word is known, or will be, without its ends
            end = piece[len(stem):]
            if end not in self.ends:
                self.ends[end] = self.whole([end])[0]
            return self.pieces[stem] + self.ends[end]
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        if line:
            return self.feed + array.array(self.kind, [t.id for t in self.tokenize(word)]).tobytes()
        return array.array(self.kind, [t.id for t in self.tokenize(self.blank + word)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_pieces:
            return self.whole(texts)
        if self.pieces.bytes > TABLE_BYTES:
            self.pieces, self.ends = Pieces(self, dict(self.pieces)), {}
        plain = [self.plain(t) for t in texts]
        odd = iter(self.whole([t for t, p in zip(texts, plain) if not p]))
        known = iter(self.by_words([t for t, p in zip(texts, plain) if p]))
        return [next(known if p else odd) for p in plain]

    def plain(self, t: str) -> bool:
        return not (not t or "  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[0] in " \n" or t[-1] in " \n"
                    or any(c in t for c in (_ODD_ASCII if t.isascii() else _ODD)) or any(a in t for a in self.added))

    def by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: Arrow cuts them to pieces, each distinct piece is looked up once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = [t.replace("\n", " \n").partition(" ") for t in texts]
        out = self.whole([head for head, _, _ in cut])
        more = [i for i, (_, _, rest) in enumerate(cut) if rest]
        if not more:
            return out
        words = pc.split_pattern(pa.array([cut[i][2] for i in more], pa.large_string()), " ")
        pieces = words.values.dictionary_encode()
        ids = pa.array(list(map(self.pieces.__getitem__, pieces.dictionary.to_pylist())), pa.large_binary()).take(pieces.indices)
        _, at, data = ids.buffers()
        ends = np.frombuffer(at, dtype=np.int64)[words.offsets.to_numpy()].tolist()
        data = memoryview(data)
        for i, a, b in zip(more, ends, ends[1:]):
            out[i] += data[a:b]
        return out


_ENCODERS: dict[str, Encoder] = {}


def _groups(texts: list[str | None]):
    """(from, to) of texts that are encoded together: of GROUP_CHARS, or one."""
    a = size = 0
    for z, t in enumerate(texts, 1):
        size += len(t or "") + 64
        if size >= GROUP_CHARS or z == len(texts):
            yield a, z
            a, size = z, 0


def _writer(path: str, end_id: int):
    def run(batches):
        import pyarrow as pa

        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        end = end_id.to_bytes(encoder.width, "little")
        block, size = [], 0
        for b in batches:
            ids, texts = (c.to_pylist() for c in b.columns)
            for a, z in _groups(texts):
                for doc_id, x in zip(ids[a:z], encoder.encode([t or "" for t in texts[a:z]])):
                    block.append(frame(record(doc_id, x + end, encoder.width)))
                    size += len(block[-1])
                    if size >= BLOCK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(block)])], ["block"])
                        block, size = [], 0
        if block:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(block)])], ["block"])
    return run


def write_records(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 0,
                  id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write all of ``docs`` in ascending id order (NULL ids first; rows of one id
    in the order of their text's hash) and return the folder. NULL and empty texts
    are a record of the end id alone; an empty table is a folder without frames.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = path or run_dir(spark, "token-records")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    ordered = rows.repartitionByRange(max(1, -(-total // FILE_BYTES)), F.col("id").asc_nulls_first()) \
        .sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    blocks = ordered.mapInArrow(_writer(tokenizer_path, end_id), "block binary")
    empty = frame(b"").decode("latin-1")
    (blocks.select(F.col("block").cast("string").alias("value")).write
     .option("lineSep", empty).option("encoding", "ISO-8859-1").option("compression", "none").text(path))
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def _per_frame(make):
    """A mapInArrow function: rows (file, content) to what ``make`` gives for each frame."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for file, content in zip(b.column(0), b.column(1)):
                data = memoryview(content.as_buffer())
                rows = [(file.as_py(), at, n, *make(bytes(payload))) for at, n, payload in frames(data)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string())] + [
                    pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6)],
                    ["file", "offset", "length", "doc_id", "n_tokens", "ids_crc32"])
    return run


def _summary(payload: bytes):
    doc_id, ids = fields(payload)
    return doc_id, len(ids), zlib.crc32(ids.tobytes())


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """Read every file back, check its frames, and write the offset index beside
    them (folder path + '-index'): file, offset, length, doc_id, n_tokens,
    ids_crc32 and start, the ids of all records before. Returns the index."""
    ship_package(spark)
    files = _files(spark, path).select("path", "content")
    kinds = "file string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long"
    raw = files.mapInArrow(_per_frame(_summary), kinds)
    raw.write.parquet(f"{path}-scan")
    raw = spark.read.parquet(f"{path}-scan")
    # one row a file: the ids of the files before, then those before in the file
    # Spark pads part numbers to five digits only, so names sort by their number
    name = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")
    per_file = raw.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    per_file = per_file.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    index = raw.join(per_file, "file").select(
        *raw.columns, (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"))
    index.write.parquet(f"{path}-index")
    return spark.read.parquet(f"{path}-index")


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int = 0) -> DataFrame:
    """(position, doc_id, ids) in an order drawn by ``seed``: the index rows are
    given random positions, and each record is cut out of its file by offset."""
    ship_package(spark)
    draw = F.xxhash64("file", "offset", F.lit(seed))

    def take(_, wanted, content):
        import pandas as pd

        if not len(wanted):
            return pd.DataFrame({"position": [], "doc_id": [], "ids": []})
        data = content["content"].iloc[0]
        rows = []
        for at, n, position in zip(wanted["offset"], wanted["length"], wanted["position"]):
            (_, _, payload), = frames(data, int(at), int(at + n))
            doc_id, ids = fields(payload)
            rows.append((position, doc_id, ids.astype("int64")))
        out = pd.DataFrame(rows, columns=["position", "doc_id", "ids"])
        return out.astype({"doc_id": "Int64"})

    wanted = index.select("file", "offset", "length", draw.alias("position"))
    content = _files(spark, path).select(F.col("path").alias("file"), "content")
    return (wanted.groupBy("file").cogroup(content.groupBy("file"))
            .applyInPandas(take, "position long, doc_id long, ids array<long>").orderBy("position"))
