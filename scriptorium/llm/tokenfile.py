"""Token files: independent zstandard frames with a seek table.

A file holds the ids of a run of documents, in id order, as little-endian 16- or
32-bit integers.  They lie in frames of at most FRAME_IDS ids or one longer
document, each compressed on its own.  Two skippable frames end the file: an
index (per document: id, number of ids, whether it opens a frame) and the seek
table of the public zstandard seekable format: per frame its compressed size,
size and the low half of the XXH64 of its content, then the number of frames and
the format's mark.  A reader fetches the tail, then only the frames it wants, and
checks each.

Files are written to the shared folder under the name of their attempt, and only
those named in the manifest count, so a task that runs twice leaves no doubt.
Null texts are empty and hold the end id alone.  Null ids come first; repeated ids
keep all their rows, in the order of a hash of their texts, which is the same in
every run.  Ids are integers; others are refused.  Texts of any length are encoded
whole.  An empty table gives no documents; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from scriptorium.llm.arrays import NOT_BLANK, Words, chunks
from scriptorium.llm.cache import WordMemory
from scriptorium.llm.shared import Workspace, file_system, partitions, ranges

FRAME_IDS = 65_536
#: Bytes of text that go into a file.
FILE_BYTES = 128 << 20
LEVEL = 1
# fixed values of the seekable format
_SKIPPABLE, _SEEK_SKIPPABLE, _SEEKABLE_MAGIC, _CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_FOOT = struct.Struct("<IBI")
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4"), ("opens", "u1")])
_HEAD = struct.Struct("<QIB")  # of the index: documents, bytes of the packed index, bytes of an id


class TokenFileWriter:
    """Takes documents one by one; close() ends the file."""

    def __init__(self, sink, wide: bool):
        self.sink, self.dtype = sink, np.dtype("<u4" if wide else "<u2")
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.docs: list[np.ndarray] = []
        self.frames: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> None:
        """Documents with their ids (masked where null), numbers of tokens, and tokens end to end."""
        at = 0
        for i, n in zip(ids, counts.tolist(), strict=True):
            opens = self.size == 0 or self.size + n > FRAME_IDS
            if opens:
                self._flush()
            self.docs.append(np.array([(i or 0, i is None, n, opens)], _DOC))
            self.held.append(tokens[at : at + n])
            self.size += n
            at += n

    def _flush(self) -> None:
        if self.held:
            raw = np.concatenate(self.held).astype(self.dtype).tobytes()
            packed = self.packer.compress(raw)
            self.sink.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, _DOC)
        index = self.packer.compress(docs.tobytes())
        body = _HEAD.pack(len(docs), len(index), self.dtype.itemsize) + index
        seek = np.array(self.frames, _ENTRY).tobytes() + _FOOT.pack(len(self.frames), _CHECKSUMS, _SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)
        self.sink.write(struct.pack("<II", _SEEK_SKIPPABLE, len(seek)) + seek)


class TokenFileReader:
    """Random access to the documents of a file."""

    def __init__(self, source, size: int):
        self.source = source
        tail = self._read(size - _FOOT.size, _FOOT.size)
        count, kind, magic = _FOOT.unpack(tail)
        if magic != _SEEKABLE_MAGIC or not kind & _CHECKSUMS:
            raise ValueError("no seek table with checksums")
        seek = size - _FOOT.size - count * _ENTRY.itemsize
        self.frames = np.frombuffer(self._read(seek, count * _ENTRY.itemsize), _ENTRY)
        self.at = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        body = self._read(int(self.at[-1]), seek - 8 - int(self.at[-1]))[8:]
        n, packed, width = _HEAD.unpack_from(body)
        self.dtype = np.dtype(f"<u{width}")
        raw = zstandard.ZstdDecompressor().decompress(body[_HEAD.size : _HEAD.size + packed], max_output_size=max(1, n * _DOC.itemsize))
        self.docs = np.frombuffer(raw, _DOC)
        self.frame_of = np.cumsum(self.docs["opens"]) - 1
        ends = np.cumsum(self.docs["n"], dtype=np.int64)
        self.first = ends - self.docs["n"]
        opening = self.first[self.docs["opens"] == 1]
        self.within = self.first - opening[self.frame_of] if len(self.docs) else self.first

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        """The ids of a frame, checked."""
        entry = self.frames[k]
        raw = zstandard.ZstdDecompressor().decompress(self._read(int(self.at[k]), int(entry["packed"])), max_output_size=max(1, int(entry["size"])))
        if len(raw) != entry["size"] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, self.dtype)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; only its frame is read."""
        return self.frame(int(self.frame_of[k]))[int(self.within[k]) : int(self.within[k]) + int(self.docs["n"][k])]

    def all(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, ids before it in this file, ids) of every document."""
        open_frame, ids = -1, None
        for k, doc in enumerate(self.docs):
            if self.frame_of[k] != open_frame:
                open_frame = int(self.frame_of[k])
                ids = self.frame(open_frame)
            a = int(self.within[k])
            yield (None if doc["null"] else int(doc["id"])), int(self.first[k]), ids[a : a + int(doc["n"])]


# fixed values: what a tokenizer file may have and still code words apart by white space one by one
_PLAIN_NORMALIZERS = frozenset({"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"})
_SPLITS_AT_BLANKS = frozenset({"Whitespace", "WhitespaceSplit", "BertPreTokenizer"})
_KEEPS_BLANKS_OUT = frozenset({"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"})
_WITHIN_WORDS = frozenset({"Digits", "Punctuation", "UnicodeScripts"})


def codes_by_word(told: dict) -> bool:
    """Whether a tokenizer file says that a text's ids are those of its words, one after the other.

    Its normalizers must not look beyond a word, its first pre-tokenizer must drop white
    space, no token that is added may take or hold any, and nothing may be drawn.  Whatever
    is not known to be so is coded as whole texts.
    """
    blank = re.compile(r"[\x20\x09-\x0D]")

    def parts(one: dict | None, name: str) -> list[dict]:
        return [] if one is None else [x for y in one[name] for x in parts(y, name)] if one["type"] == "Sequence" else [one]

    def plain(one: dict) -> bool:
        if one["type"] != "Replace":
            return one["type"] in _PLAIN_NORMALIZERS
        pattern = one["pattern"]
        return pattern == {"Regex": r"\s+"} and one["content"] == " " or "String" in pattern and not blank.search(pattern["String"] + one["content"])

    def within(one: dict) -> bool:
        return one["type"] in _WITHIN_WORDS or one["type"] == "ByteLevel" and not one["add_prefix_space"] and not one["use_regex"]

    first, *rest = parts(told.get("pre_tokenizer"), "pretokenizers") or [{"type": "none"}]
    dropped = first["type"] in _SPLITS_AT_BLANKS or first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") in _KEEPS_BLANKS_OUT
    added = all(not (t["lstrip"] or t["rstrip"] or blank.search(t["content"])) for t in told.get("added_tokens") or [])
    model = told["model"]
    return dropped and all(map(within, rest)) and all(map(plain, parts(told.get("normalizer"), "normalizers"))) and added and model.get("type") in ("BPE", "WordPiece", "WordLevel") and not model.get("dropout") and (told.get("post_processor") or {"type": "ByteLevel"})["type"] in ("ByteLevel", "TemplateProcessing")


@lru_cache(2)
def _encoder(path: str):
    """The library's tokenizer, a memory of words, and whether it codes words one by one."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as told:
        return tokenizer, WordMemory(), codes_by_word(json.load(told))


def encode_chunk(path: str, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a chunk's texts, end to end, and the n + 1 places where texts begin."""
    tokenizer, memory, by_word = _encoder(path)
    if not by_word:
        whole = [e.ids for e in tokenizer.encode_batch_fast([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs, offs[1:], strict=False)], add_special_tokens=False)]
        return np.fromiter((x for ids in whole for x in ids), np.int32), np.concatenate([[0], np.cumsum([len(x) for x in whole], dtype=np.int64)])
    words = Words(data, offs, NOT_BLANK, lower=False)

    def fresh(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast([words.text(i).decode("utf-8", "replace") for i in places], add_special_tokens=False)]
        return np.fromiter((x for ids in found for x in ids), np.int32), np.array([len(x) for x in found], np.int32)

    flat, count = memory.expand(words.hash, fresh)
    return flat, np.concatenate([[0], np.cumsum(count, dtype=np.int64)])[words.rows]


def write_token_files(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files, in id order; returns their manifest: part, file, n_docs, n_ids, start (ids in all files before), first_id and last_id."""
    spark = docs.sparkSession
    space = Workspace(spark, "tokens")
    folder = f"{space.path}/files"
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"ids must be integers: {id_col}")
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the text's hash splits a hot id; the texts themselves order what is left
    dealt = given.withColumn("h", F.xxhash64("text")).repartitionByRange(ranges(docs, text_col, FILE_BYTES), "id", "h").sortWithinPartitions("id", "h", "text")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("first_id", T.LongType()), T.StructField("last_id", T.LongType())])

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        wide = max(_encoder(path)[0].get_vocab_size(with_added_tokens=True), end_id + 1) > 65_536
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name, docs_n, ids_n, names = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst", 0, 0, []
        with fs.open_output_stream(f"{root}/{name}", compression=None) as sink:
            writer = TokenFileWriter(sink, wide)
            for rows, data, offs in chunks(batches, "text"):
                flat, at = encode_chunk(path, data, offs)
                flat = np.insert(flat, at[1:], end_id)
                counts = np.diff(at) + 1
                writer.add(rows.column(0).to_pylist(), counts, flat)
                known = pc.min_max(rows.column(0)).as_py()
                names += [x for x in known.values() if x is not None]
                docs_n += len(counts)
                ids_n += len(flat)
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([docs_n], pa.int64()), pa.array([ids_n], pa.int64()), pa.array([min(names, default=None)], pa.int64()), pa.array([max(names, default=None)], pa.int64())], names=schema.names)

    manifest = space.write(dealt.select("id", "text").mapInArrow(run, schema), "manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    started = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return started.select("part", F.concat(F.lit(f"{folder}/"), "file").alias("file"), "n_docs", "n_ids", "start", "first_id", "last_id")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, where = file_system(uri)
                with fs.open_input_file(where) as source:
                    rows = [(i, start + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, first, ids in TokenFileReader(source, source.size()).all()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    dealt = manifest.select("file", "start").repartition(max(partitions(manifest.sparkSession), manifest.count()), "file")
    return dealt.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def find_documents(manifest: DataFrame, wanted: list[int], id_col: str = "doc_id") -> DataFrame:
    """id and ids (array) of the documents asked for; of files that can hold them, their tails and frames alone are read."""
    asked = np.unique(np.array(wanted, np.int64))

    def run(batches):
        for batch in batches:
            for uri, first, last in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not ((asked >= first) & (asked <= last)).any():
                    continue
                fs, where = file_system(uri)
                with fs.open_input_file(where) as source:
                    reader = TokenFileReader(source, source.size())
                    places = np.flatnonzero(np.isin(reader.docs["id"], asked) & (reader.docs["null"] == 0))
                    found = [(int(reader.docs["id"][k]), reader.document(k).tolist()) for k in places]
                if found:
                    ids, tokens = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=[id_col, "ids"])

    files = manifest.where("first_id IS NOT NULL").select("file", "first_id", "last_id")
    return files.repartition(partitions(manifest.sparkSession), "file").mapInArrow(run, f"`{id_col}` long, ids array<long>")


def documents_of(data: bytes) -> list[tuple[int | None, int, np.ndarray]]:
    """All documents of a file held in memory."""
    return list(TokenFileReader(io.BytesIO(data), len(data)).all())
