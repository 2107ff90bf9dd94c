"""Byte-pair encoding with content-defined chunk reuse, and decoding.

A rolling hash of the last 32 bytes cuts texts into chunks, so passages that documents share become equal
chunks wherever they stand. Chunks that occur more than once are encoded once, whoever holds them;
others are encoded where they are. A chunk's ids are right inside it but not at its ends, where the
word that crosses the cut was encoded in two halves. Joins are repaired: from the start of the left
chunk's last word the text is split into words again, until a word start is also one of the right
chunk's own. From there on both agree for good, because the word pattern never looks back; the stretch
between is encoded anew.

Which chunks occur more than once is told to the tasks by a Bloom filter of fixed size. A false answer
only sends one chunk more through the shared way; no result depends on it.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_map, texts
from gridspark.llm.tokens import byte_encoder
from gridspark.session import materialise

# Word pattern of the byte-level vocabulary, its white space being Unicode's; fixed value.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

# Characters the word pattern looks at beyond a word's end, at most; words that end nearer may still change.
LOOK_AHEAD = 3

# Characters of one kind after which a word's end no longer depends on where they began, and the kinds.
RUN = 64
KINDS = [regex.compile(kind) for kind in (r"\p{L}+", r"\p{N}+", r"[^\p{White_Space}\p{L}\p{N}]+", r"\p{White_Space}+")]

CHUNK_BITS = 10  # a cut every 1,024 bytes on average
LEAST_CHUNK = 256
WINDOW_STEPS = 5  # 2 ** 5 bytes feed the rolling hash
BLOOM_BITS = 1 << 26  # 8 MB, whatever the size of the input
BLOOM_HASHES = 4


@functools.cache
def gear() -> np.ndarray:
    return np.random.default_rng(20_011).integers(0, 1 << 32, 256, np.uint32)


def cut_places(data: bytes) -> list[int]:
    """Ends of the chunks of data, the last one its length; never inside a code point."""
    n = len(data)
    if n <= LEAST_CHUNK:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = gear()[raw]
    for step in range(WINDOW_STEPS):
        width = 1 << step
        h[width:] += h[:-width] << np.uint32(width)
    found = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    out, last = [], 0
    for place in found.tolist():
        while place < n and 0x80 <= data[place] < 0xC0:
            place += 1
        if place - last >= LEAST_CHUNK and place < n:
            out.append(place)
            last = place
    return [*out, n]


def chunk_key(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


def bloom_places(keys: np.ndarray) -> np.ndarray:
    """Bit numbers, BLOOM_HASHES for each of the (n, 16) byte keys."""
    halves = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
    steps = np.arange(BLOOM_HASHES, dtype=np.uint64)
    return (halves[:, :1] + steps * halves[:, 1:]) % np.uint64(BLOOM_BITS)


class Chunks:
    """Ids of chunks encoded on their own, with the place and the ids of the last word."""

    def __init__(self, path: str):
        self.encoder = byte_encoder(path)
        tokenizer = self.encoder.tokenizer
        n = tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special.values())) + ")") if self.special else None
        alphabet = byte_alphabet()
        names = [tokenizer.id_to_token(i) or "" for i in range(n)]
        self.bytes_of = [
            self.special[i].encode() if i in self.special else bytes(alphabet[c] for c in name)
            for i, name in enumerate(names)
        ]
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.decimal = [str(i) for i in range(n)]

    def parts(self, text: str) -> list[str]:
        """The text between special tokens, and these themselves at odd places."""
        return self.split.split(text) if self.split else [text]

    def encode(self, chunks: list[str]) -> list[bytes]:
        return self.encoder.encode(chunks)

    def join(self, chunks: list[str], ids: list[np.ndarray]) -> np.ndarray:
        """Ids of the joined chunks, from the ids of each."""
        out: list[np.ndarray] = []
        waiting: list[str] = []  # text before the next chunk whose ids may change
        carry = ""  # its end, as far as the words of what follows depend on it
        for n, (chunk, own) in enumerate(zip(chunks, ids)):
            head = 0  # characters of the chunk that the repair takes
            if carry:
                head, agreed = self.agreement(carry, chunk)
                if not agreed:
                    # No agreement inside this chunk: it waits too and is encoded with what precedes it, once.
                    waiting.append(chunk)
                    carry = self.needed(carry + chunk)
                    continue
                out.append(self.words_before("".join(waiting) + chunk[:head], chunk[head:head + LOOK_AHEAD]))
                own = own[self.tokens_in(own, len(chunk[:head].encode())):]
            rest = chunk[head:]
            if n == len(chunks) - 1:
                out.append(own)
                return np.concatenate(out)
            tail = self.last_word(rest)
            waiting = [rest[tail:]]
            carry = self.needed(rest[tail:])
            out.append(own[:self.tokens_in(own, len(rest[:tail].encode()))])
        if waiting:
            out.append(self.words_before("".join(waiting), ""))
        return np.concatenate(out) if out else np.zeros(0, self.encoder.dtype)

    def words_before(self, text: str, following: str) -> np.ndarray:
        """Ids of the words of text, which ends where a word does if `following` stands behind it."""
        words = [m[0] for m in WORDS.finditer(text + following) if m.end() <= len(text)]
        return np.frombuffer(b"".join(self.encode(words)), self.encoder.dtype)

    def needed(self, carry: str) -> str:
        """An end of carry with which the words of what follows are the same. Characters of one kind in a row lie in one word,
        or in a contraction and the word after it, however many they are; else what follows the last sure start does."""
        if len(carry) > RUN and any(kind.fullmatch(carry, len(carry) - RUN) for kind in KINDS):
            return carry[-RUN:]
        return carry[self.last_word(carry):]

    def agreement(self, carry: str, chunk: str) -> tuple[int, bool]:
        """Place in chunk from which on its own words and those of carry + chunk agree, and whether there is one."""
        look = 64
        while True:
            head = chunk[:look]
            own = {m.end() for m in WORDS.finditer(head)}
            for m in WORDS.finditer(carry + head):
                place = m.end() - len(carry)
                if 0 <= place <= len(head) - LOOK_AHEAD and (place == 0 or place in own):
                    return place, True
            if look >= len(chunk):
                return len(chunk), False
            look *= 4

    def last_word(self, text: str) -> int:
        """Start of the last word, of a text that starts at a word start, which no following text can move."""
        # A blank between two characters that are no white space always starts a word.
        look = 64
        while look < len(text):
            back = len(text) - look
            gap = GAP.search(text, back)
            if gap:
                return gap.start() + self.last_sure_start(text[gap.start():])
            look *= 4
        return self.last_sure_start(text)

    def last_sure_start(self, text: str) -> int:
        return max((m.start() for m in WORDS.finditer(text) if m.start() <= len(text) - LOOK_AHEAD), default=0)

    def tokens_in(self, ids: np.ndarray, size: int) -> int:
        """Number of ids that hold the first `size` bytes, a place between two ids."""
        if not size:
            return 0
        total = int(self.length_of[ids].sum())
        if size * 2 <= total:
            guess = min(len(ids), size)
            return int(np.searchsorted(np.cumsum(self.length_of[ids[:guess]]), size)) + 1
        return len(ids) - int(np.searchsorted(np.cumsum(self.length_of[ids[::-1][:total - size]]), total - size)) - (
            total > size)

    def digest(self, parts: list[np.ndarray]) -> tuple[int, str, str]:
        ids = np.concatenate(parts).tolist() if parts else []
        decoded = b"".join(map(self.bytes_of.__getitem__, ids))
        return (
            len(ids), hashlib.sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())


GAP = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte: itself where it prints, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, free = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            table[chr(free)] = b
            free += 1
    return table


@functools.cache
def chunks_of(path: str) -> Chunks:
    return Chunks(path)


def text_chunks(coder: Chunks, text: str) -> list[list[bytes]]:
    """Chunks of each part of a text between special tokens; a special token is a part of one chunk."""
    out = []
    for part in coder.parts(text):
        data = part.encode("utf-8", "surrogatepass")
        ends = cut_places(data) if part not in coder.special.values() else [len(data)]
        out.append([data[a:b] for a, b in zip([0, *ends], ends)])
    return out


def bloom_filter(spark: SparkSession, shared: DataFrame):
    """Broadcast bit field of the keys in shared (key binary): at most BLOOM_BITS, so of fixed size."""

    def bits(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(-1, 16)
        places = np.unique(bloom_places(keys))
        word, at = np.unique(places >> np.uint64(6), return_index=True)
        value = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), at) if len(word) else places
        return pa.RecordBatch.from_arrays(
            [pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"])

    words = arrow_map(shared.select("key"), bits, "word long, bits long").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toPandas()
    field = np.zeros(BLOOM_BITS // 64, np.uint64)
    field[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(field)


def in_bloom(field: np.ndarray, keys: list[bytes]) -> np.ndarray:
    if not keys:
        return np.zeros(0, bool)
    places = bloom_places(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16))
    return ((field[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)).all(axis=1)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no tokens. Null and repeated doc_ids stay as they are, other columns of docs
    are ignored, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = chunks_of(path)
        found = [chunk_key(c) for t in texts(batch) for part in text_chunks(coder, t) for c in part]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["key"])

    shared = materialise(
        arrow_map(docs, keys, "key binary").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    field = bloom_filter(spark, shared)

    def shared_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = chunks_of(path)
        data = list({c for t in texts(batch) for part in text_chunks(coder, t) for c in part})
        found = [chunk_key(c) for c in data]
        hit = np.flatnonzero(in_bloom(field.value, found)).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([found[i] for i in hit], pa.binary()), pa.array([data[i] for i in hit], pa.binary())],
            names=["key", "chunk"])

    def encode_once(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = chunks_of(path)
        encoded = coder.encode([c.decode("utf-8", "surrogatepass") for c in batch.column("chunk").to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(encoded, pa.binary())], names=["key", "ids"])

    once = arrow_map(docs, shared_texts, "key binary, chunk binary").groupBy("key").agg(
        F.any_value("chunk").alias("chunk"))
    encoded = materialise(arrow_map(once, encode_once, "key binary, ids binary"))

    def encode_own(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Finish the documents without shared chunks; hand on the others, compressed, with their keys."""
        import zstandard

        coder, pack = chunks_of(path), zstandard.ZstdCompressor(3)
        rows, packed, wanted = [], [], []
        all_texts = texts(batch)
        pieces = [text_chunks(coder, t) for t in all_texts]
        own: list[str] = []
        for text, parts in zip(all_texts, pieces):
            found = [chunk_key(c) for part in parts for c in part]
            hit = in_bloom(field.value, found)
            if hit.any():
                packed.append(pack.compress(text.encode("utf-8", "surrogatepass")))
                wanted.append([k for k, h in zip(found, hit) if h])
                rows.append(None)
            else:
                packed.append(None)
                wanted.append([])
                rows.append([len(own), len(found)])
                own += [c.decode("utf-8", "surrogatepass") for part in parts for c in part]
        ids = [np.frombuffer(b, coder.encoder.dtype) for b in coder.encode(own)]
        done = []
        for row, parts in zip(rows, pieces):
            if row is None:
                done.append((None, None, None))
                continue
            at, joined = row[0], []
            for part in parts:
                joined.append(coder.join([c.decode("utf-8", "surrogatepass") for c in part], ids[at:at + len(part)]))
                at += len(part)
            done.append(coder.digest(joined))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()),
             pa.array([d[2] for d in done], pa.string()), pa.array(packed, pa.binary()),
             pa.array(wanted, pa.list_(pa.binary()))],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "packed", "keys"])

    own = materialise(arrow_map(
        docs, encode_own, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, packed binary,"
        " keys array<binary>").withColumn("row", F.monotonically_increasing_id()))
    waiting = own.where("packed is not null")
    wanted = waiting.select("row", F.explode(F.array_distinct("keys")).alias("key"))
    parts = wanted.join(encoded, "key").groupBy("row").agg(F.collect_list(F.struct("key", "ids")).alias("parts"))

    def assemble(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        coder, unpack = chunks_of(path), zstandard.ZstdDecompressor()
        done = []
        for packed, known in zip(batch.column("packed").to_pylist(), batch.column("parts").to_pylist()):
            text = unpack.decompress(packed).decode("utf-8", "surrogatepass")
            shared_ids = {p["key"]: p["ids"] for p in known}
            pieces = text_chunks(coder, text)
            flat = [c for part in pieces for c in part]
            found = [shared_ids.get(chunk_key(c)) for c in flat]
            strings = [c.decode("utf-8", "surrogatepass") for c in flat]
            rest = iter(coder.encode([s for s, f in zip(strings, found) if f is None]))
            ids = [np.frombuffer(next(rest) if f is None else f, coder.encoder.dtype) for f in found]
            at, joined = 0, []
            for part in pieces:
                joined.append(coder.join(strings[at:at + len(part)], ids[at:at + len(part)]))
                at += len(part)
            done.append(coder.digest(joined))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done]),
             pa.array([d[2] for d in done])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rest = arrow_map(waiting.select("row", "doc_id", "packed").join(parts, "row"), assemble,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return own.where("packed is null").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").union(rest)
