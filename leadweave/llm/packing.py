"""Packing: minimum bin slack over the multiset of piece lengths.

A document is tokenised once, closed by the end id and cut into full windows; what is
left over is one shorter piece. Pieces are dealt by a hash to groups that are bounded by
their texts' bytes, and so by tokens, and each group fills its windows one pattern at a
time: the longest piece left, then the multiset of lengths that comes closest to the
capacity. Reachable sums are the bits of one integer (bitset subset-sum dynamic
programming), counts come from walking the steps back, and a pattern is used as often as its
lengths last.

Only lengths and checksums need to travel; ids go with them where the caller wants them.

Null or empty text: a document of just the end id. Null doc_id: packed as any other.
Repeated rows: each row is a document of its own; the hash counts in the task and a row's
number among equal ones of a batch, so that they spread over all groups. Very long texts:
one full window after the other, each in a group of its own hash, then the rest. Ties
between equal lengths go by doc_id, then start. Further columns, also of clashing names, are
passed over. Empty table: empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm.common import batch_slices, give_back, pick

CAPACITY, END_ID = 2048, 1
BYTES_A_GROUP = {True: 8 << 20, False: 64 << 20}  # of texts; with ids, and without
CACHED_WORDS, CACHED_CHARS = 100_000, 48


#: How a vocabulary cuts texts for which words are tokenised here.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters at a word's end that are no letters or digits.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters that NFC keeps, whose lower case is one character, and that are no white space.
PLAIN_WORD = r"[\x21-\x7e\u00a1-\u012f\u0131-\u024f]+"


class WordTokenizer:
    """Ids of whole texts, kept for each word between white space.

    For a vocabulary that drops white space and never merges over it, the ids of a text
    are those of its words in order. ASCII white space is white space to it, so texts are
    cut there. A new word of plain characters is cut into its parts here and each part
    goes to the merge model; any other word goes through the whole tokenizer. The caches
    are bounded and just forget.
    """

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words, self.parts = Tokenizer.from_file(path), _Words(self), {}
        made = json.loads(self.tokenizer.to_str())
        cut, bytewise = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])[:2]
        kinds = tuple(n["type"] for n in (made.get("normalizer") or {}).get("normalizers", []))
        self.special = [t["content"] for t in made["added_tokens"]]
        self.simple = kinds == NORMALIZERS and cut.get("pattern") == {"Regex": WORD_PARTS} and cut.get("invert") is True and bytewise.get("type") == "ByteLevel" and not bytewise["use_regex"]
        self.cut, self.plain = regex.compile(WORD_PARTS).findall, regex.compile(PLAIN_WORD).fullmatch
        self.as_bytes, self.merge = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str, self.tokenizer.model.tokenize

    def _cut(self, word: str) -> list[str]:
        """Parts of a plain word, lower case; most are letters with some marks at the end."""
        word = word.lower()
        core = word.rstrip(MARKS)
        if core.isalpha():
            return [core, word[len(core) :]] if len(core) < len(word) else [core]
        return self.cut(word)

    def ids(self, raw: bytes) -> bytes:
        """Ids of one word."""
        word = raw.decode()
        if not self.simple or not self.plain(word) or ("<" in word and any(t in word for t in self.special)):
            return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        out = b""
        for part in self._cut(word):
            known = self.parts.get(part)
            if known is None:
                text = part if part.isascii() else self.as_bytes(part)[0][0]
                known = b"".join([t.id.to_bytes(4, "little") for t in self.merge(text)])
                if len(part) <= CACHED_CHARS:
                    self.parts[part] = known
            out += known
        return out

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()
        if len(self.words) > CACHED_WORDS:
            self.words.age()
        known = self.words.__getitem__
        for t in texts:
            yield b"".join(map(known, t.split()))


class _Words(dict):
    """Ids by word. When it has grown, only the words that are asked for again stay."""

    def __init__(self, tokenizer: WordTokenizer) -> None:
        super().__init__()
        self.make, self.old = tokenizer.ids, {}

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= CACHED_CHARS:
            self[word] = ids
        return ids


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, so that later tasks find its words."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, salt, and ids if asked for, of every piece.

    salt: the task, and the row's number among equal ones of its batch; the same whenever the
    task runs again.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, task = word_tokenizer(tokenizer_path), TaskContext.get().partitionId() << 32
        for b in batch_slices(batches, 1, 1 << 20):
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            doc, start, length, crc, total, salt, ids = [], [], [], [], [], [], []
            seen: dict[tuple, int] = defaultdict(int)
            for d, raw in zip(b.column(0).to_pylist(), tokenize(texts)):
                raw += end
                whole = zlib.crc32(raw)
                number = seen[d, whole]
                seen[d, whole] = number + 1
                for s in range(0, len(raw), step):
                    piece = raw[s : s + step]
                    doc.append(d)
                    start.append(s // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(raw) // 4)
                    salt.append(task | number)
                    if with_ids:
                        ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
            cols = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total, salt)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long" + ", ids array<int>" * with_ids
    return pick(docs, "doc_id", "text").mapInArrow(cut, schema)


def best_fill(lengths: list[int], left: dict[int, int], space: int) -> dict[int, int]:
    """How many pieces of each length come closest to space from below.

    lengths: in falling order; left: how many there are. Ends at the first exact fill.
    """
    if space <= 0:
        return {}
    mask, reach, steps = (1 << (space + 1)) - 1, 1, []
    for n in lengths:
        if n > space or not left[n]:
            continue
        steps.append((n, reach))
        most, take = min(left[n], space // n), 1
        while most:  # 1, 2, 4, ... and the rest make up any count
            take = min(take, most)
            reach |= reach << (n * take)
            most -= take
            take *= 2
        reach &= mask
        if reach >> space & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for n, before in reversed(steps):
        k = 0
        while not before >> at & 1:
            at -= n
            k += 1
        if k:
            used[n] = k
    return used


def patterns(left: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Fills for all of these lengths: each with the number of windows that use it."""
    left = {n: c for n, c in left.items() if c}
    lengths = sorted(left, reverse=True)
    while lengths:
        top = lengths[0]
        left[top] -= 1
        used = best_fill(lengths, left, capacity - top)
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
        if any(not left[n] for n in used):
            lengths = [n for n in lengths if left[n]]
        yield used, times


def _place(t: pa.Table, capacity: int) -> pa.Table:
    """sequence_id and offset for the pieces of one group."""
    group = t.column("pack_group")[0].as_py()
    length = t.column("length").to_numpy()
    doc = t.column("doc_id").fill_null(0).to_numpy()
    order = np.lexsort((t.column("ids_crc32").to_numpy(), t.column("start").to_numpy(), doc, length))
    queue = defaultdict(list)
    for i in order[::-1].tolist():
        queue[int(length[i])].append(i)
    sequence, offset, window = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64), 0
    for used, times in patterns({n: len(q) for n, q in queue.items()}, capacity):
        slots = [n for n in sorted(used, reverse=True) for _ in range(used[n])]
        for _ in range(times):
            at = 0
            for n in slots:
                i = queue[n].pop()
                sequence[i], offset[i] = (group << 32) + window, at
                at += n
            window += 1
    t = t.drop_columns(["pack_group"])
    return t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, groups: int | None = None) -> DataFrame:
    """Every piece with its sequence_id and its offset there; ids too, if asked for."""
    if groups is None:
        size = pick(docs, "text").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
        groups = max(1, -(-size // BYTES_A_GROUP[with_ids]))
    cut = pieces(docs, tokenizer_path, capacity, end_id, with_ids)
    cut = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(groups))).drop("salt")
    names = [f.name for f in cut.schema if f.name != "pack_group"]
    schema = ", ".join(f"{n} {cut.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"

    def place(t: pa.Table) -> pa.Table:
        if _tokenizers:  # a worker that has cut texts before needs their words no more
            _tokenizers.clear()
            give_back()
        return _place(t, capacity)

    return cut.groupBy("pack_group").applyInArrow(place, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
