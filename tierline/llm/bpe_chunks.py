"""BPE encoding and decoding with content-defined chunk reuse.

A text's bytes are cut where a rolling (gear) hash of the last 16 bytes has its low bits 0, so equal passages are cut
alike wherever they stand. A chunk's inside, from its first to its last blank, is encoded once: the chunks that most
documents share are found over the whole corpus, encoded once for all (``common_chunks``) and sent to every task; any
other chunk is encoded once in a task and reused by its later documents. At each chunk join the pieces before and after
it are put together and re-encoded, growing over further chunks until both ends lie at a blank.

A blank is where both encodings agree exactly: the tokenizer's rules (NFC, white space to one blank, lower case, split
into words that hold no white space) never look across ASCII white space, so a text's ids are the ids of its
blank-separated words in a row. Nor do they look from a Latin letter to an ASCII mark after it (but an apostrophe), and
they lower A to Z first, so words are remembered without case and such marks. ``agrees`` tests this against the library.

Defined results: a null text is empty, with no ids; special tokens' strings in a text are encoded as the library does
by default. Equal texts and repeated rows get equal results. Very long words go to the library as one piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

VOCABULARY = "word_bpe_49k.json"
#: A cut where these low bits of the rolling hash are 0: chunks of 256 bytes on average.
CUT_BITS = 8
#: Chunks encoded once for the whole corpus: those in most documents. Further ones are shared within each task.
COMMON_CHUNKS = 8192
#: Chunks that a task remembers, words that a worker remembers, chunk digests that a task counts before it passes them on.
CHUNK_MEMO, WORD_MEMO, COUNTED = 1 << 15, 1 << 19, 1 << 17
BLANKS = b" \t\n\r\x0b\x0c"
_GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def cuts(data: bytes, bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks of ``data``, the last one included."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):  # sums of 1, 2, 4, 8, 16 shifted bytes
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
    # the high bits hold all 16 bytes
    at = np.flatnonzero((h >> np.uint64(8)) & np.uint64((1 << bits) - 1) == 0) + 1
    ends = at.tolist()
    return ends if ends and ends[-1] == len(data) else [*ends, len(data)]


def inside(chunk: bytes) -> tuple[int, int]:
    """From after the first blank to before the last one; (0, 0) if there are not two."""
    first = min((i for i in map(chunk.find, _EACH) if i >= 0), default=-1)
    last = max(map(chunk.rfind, _EACH))
    return (first, last) if 0 <= first < last else (0, 0)


_EACH = [bytes([b]) for b in BLANKS]

#: What is kept of an encoded piece: the ids in decimal and the decoded text, a blank after each id and word.
Piece = tuple[bytes, bytes]
#: An ASCII mark that is no apostrophe, after a letter (a to z, or of Latin-1 beyond ASCII).
_MARK = re.compile(rb"([!-&(-/:-@\[-`{-~])(?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")


class Words(dict):
    """The piece of each word, encoded by the library at first sight; the first ``WORD_MEMO`` words are remembered."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __missing__(self, word: bytes) -> Piece:
        ids = self.tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
        piece = (b"", b"")
        if ids:
            text = self.tokenizer.decode(ids, skip_special_tokens=False).encode()
            piece = ((" ".join(map(str, ids)) + " ").encode(), text + b" ")
        if len(word) <= 64 and len(self) < WORD_MEMO:
            self[word] = piece
        return piece


#: The words of this worker, by vocabulary: tasks that follow each other share them.
_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def join_pieces(pieces: list[Piece]) -> Piece:
    return b"".join([p[0] for p in pieces]), b"".join([p[1] for p in pieces])


class Encoder:
    def __init__(self, path: str, common: dict[bytes, Piece] | None = None, bits: int = CUT_BITS):
        self.words, self.common, self.bits = words_of(path), common or {}, bits
        self.memo: dict[bytes, tuple[int, int, Piece]] = {}
        self.encoded = self.reused = 0

    def piece(self, data: bytes) -> Piece:
        """Encode blank-separated text afresh."""
        if b"<|" not in data:  # no special token's string
            data = _MARK.sub(rb" \1", data.lower())
        words = self.words
        return join_pieces([words[w] for w in data.split()])

    def chunk(self, chunk: bytes) -> tuple[int, int, Piece]:
        """(first, last, piece of what is between): from the store, or encoded now."""
        if (known := self.memo.get(chunk)) is not None:
            self.reused += 1
            return known
        first, last = inside(chunk)
        if (piece := self.common.get(xxhash.xxh3_128_digest(chunk))) is None:
            self.encoded += 1
            piece = self.piece(chunk[first:last])
        else:
            self.reused += 1
        if len(self.memo) >= CHUNK_MEMO:
            self.memo.clear()
        if len(chunk) <= 4096:
            self.memo[chunk] = (first, last, piece)
        return first, last, piece

    def encode(self, text: str | None) -> Piece:
        """The ids in decimal and the decoded text, joined by single blanks."""
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if not data:
            return b"", b""
        pieces, at, join = [], 0, b""
        for end in cuts(data, self.bits):
            chunk = data[at:end]
            at = end
            first, last, piece = self.chunk(chunk)
            if not last:  # no room between blanks: the join goes on
                join += chunk
                continue
            pieces += [self.piece(join + chunk[:first]), piece]
            join = chunk[last:]
        ids, text = join_pieces([*pieces, self.piece(join)])
        return ids[:-1], text[:-1]


def count_ids(ids: bytes) -> int:
    return ids.count(b" ") + 1 if ids else 0


def id_lists(texts: list[bytes]) -> pa.ListArray:
    """The ids of each text as a list, parsed all at once."""
    joined = b" ".join([t for t in texts if t])
    ids = np.fromstring(joined, np.int32, sep=" ") if joined else np.zeros(0, np.int32)
    ends = np.cumsum([0, *map(count_ids, texts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def agrees(path: str, text: str, bits: int = CUT_BITS) -> bool:
    """Whether the chunked ids and decoded text equal the library's own for the whole text."""
    encoder = Encoder(path, bits=bits)
    ids = encoder.words.tokenizer.encode(text, add_special_tokens=False).ids
    decoded = encoder.words.tokenizer.decode(ids, skip_special_tokens=False)
    return encoder.encode(text) == (" ".join(map(str, ids)).encode(), decoded.encode())


def common_chunks(docs: DataFrame, path: str, most: int = COMMON_CHUNKS, bits: int = CUT_BITS) -> dict[bytes, Piece]:
    """Digest -> piece of the ``most`` chunks that most texts share, each encoded once; ``most`` bounds what is sent.

    Chunks of at most 4096 bytes are counted, over all texts: only 16-byte digests and counts are shuffled.
    """

    def digests(batches):
        held: dict[bytes, int] = {}
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for d in set(_digests(text, bits)):
                    held[d] = held.get(d, 0) + 1
            if len(held) > COUNTED:
                yield _counted(held)
                held = {}
        if held:
            yield _counted(held)

    counted = docs.select("text").mapInArrow(digests, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    top = counted.where("n > 1").orderBy(F.desc("n"), "digest").limit(most).select("digest").collect()
    wanted = docs.sparkSession.sparkContext.broadcast({bytes(r.digest) for r in top})

    def pick(batches):
        seen: set[bytes] = set()
        for batch in slices(batches):
            new: dict[bytes, bytes] = {}
            for text in batch.column(0).to_pylist():
                for d, chunk in _digests(text, bits).items():
                    if d in wanted.value and d not in seen:
                        seen.add(d)
                        new[d] = chunk
            if new:
                yield pa.RecordBatch.from_pydict({"digest": pa.array(new.keys(), pa.binary()), "chunk": pa.array(new.values(), pa.binary())})

    def encode(batches):
        words = Encoder(path, bits=bits)
        for batch in batches:
            pieces = [words.piece(c[slice(*inside(c))]) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "digest": batch.column(0),
                    "ids": pa.array([p[0] for p in pieces], pa.binary()),
                    "text": pa.array([p[1] for p in pieces], pa.binary()),
                }
            )

    chunks = docs.select("text").mapInArrow(pick, "digest binary, chunk binary").groupBy("digest").agg(F.first("chunk").alias("chunk"))
    rows = chunks.mapInArrow(encode, "digest binary, ids binary, text binary").collect()
    return {bytes(r.digest): (bytes(r.ids), bytes(r.text)) for r in rows}


def _digests(text: str | None, bits: int) -> dict[bytes, bytes]:
    data, at, out = text.encode("utf-8", "surrogatepass") if text else b"", 0, {}
    for end in cuts(data, bits) if data else ():
        if end - at <= 4096:
            out[xxhash.xxh3_128_digest(data[at:end])] = data[at:end]
        at = end
    return out


def _counted(held: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"digest": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())})


def encode(docs: DataFrame, path: str, most: int = COMMON_CHUNKS, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs`` (doc_id, text), and with_ids the ``ids``."""
    sent = docs.sparkSession.sparkContext.broadcast(common_chunks(docs, path, most))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, sent.value)
        for batch in slices(batches):
            pieces = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            columns = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array([count_ids(p[0]) for p in pieces], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(p[0]).hexdigest() for p in pieces], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(p[1]).hexdigest() for p in pieces], pa.string()),
            }
            if with_ids:
                columns["ids"] = id_lists([p[0] for p in pieces])
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the library's text of each row's ``ids``; null ids give null."""

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            texts = [None if i is None else tokenizer.decode(i, skip_special_tokens=False) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
