"""BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word there is one last token in its encoding.  An automaton over the vocabulary
gives all tokens that are suffixes of the prefix; of these the one is right that is compatible with the
last token of what precedes it, that is, whose pair BPE itself would leave as it is.  The last tokens
are stored and followed back from the end.  A word of n bytes takes O(n) steps, whatever it holds.

The operator maps documents batch by batch: no shuffle.  A batch's texts are split at white space, each distinct
chunk is encoded once, and the ids of all chunks are taken from these; ids are decoded by taking the tokens' texts.
Encodings of chunks are kept in a bounded table in each Python worker.  The vocabulary's path is a parameter and must
exist on every executor.

Null and empty texts have no ids and decode to the empty string.  Texts are whole, however long; repeated rows get
equal results.  Empty tables give empty ones.  Other columns may have any name but those made here.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textops
from scanloom.llm.shared import positional

#: White space in the sense of Unicode.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MARK = 0x1000
KEPT_CHUNKS, KEPT_WORDS = 60_000, 250_000
KEPT_LENGTH = 64
#: Text that is split at once: the more, the fewer chunks are new.
SLICE_BYTES = 4 << 20


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _keep(table: dict, key: str, value: bytes, most: int) -> None:
    """Long keys are not kept; a full table starts anew."""
    if len(key) <= KEPT_LENGTH:
        if len(table) >= most:
            table.clear()
        table[key] = value


class PrefixBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or spec["decoder"] is not None:
            raise ValueError("only BPE files with the word end </w> and no decoder are known")
        self.suffix = "</w>"
        vocab = model["vocab"]
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: pair of ids -> rank of its merge; id -> its two parts and that rank
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            if whole in self.parts:
                raise ValueError("two merges make one token")
            self.pairs[pair], self.parts[whole] = rank, (*pair, rank)
        reached: set[int] = set()
        self.automaton = ahocorasick.Automaton()
        for i in sorted(vocab.values(), key=lambda i: self.parts[i][2] if i in self.parts else -1):
            if i in self.parts:
                a, b, rank = self.parts[i]
                if not (a in reached and b in reached and self._apart(a, b, rank)):
                    continue  # BPE never makes it
            reached.add(i)
            unit = self._units(self.strings[i])
            self.automaton.add_word(unit, (len(unit), i))
        self.automaton.make_automaton()
        self.letters = byte_letters()
        self.compatible = functools.lru_cache(1 << 18)(self._compatible)
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+").findall
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.space = regex.compile(f"[{SPACE}]+")
        self.odd = regex.compile("[\\x1c-\\x1f]")
        #: By id, what a token reads, with a space after it.
        self.spoken = pa.array([self.strings.get(i, "") + " " for i in range(max(self.strings) + 1)], pa.large_string())
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _units(self, token: str) -> str:
        """One character a byte; the last of a word is marked."""
        if not token.endswith(self.suffix):
            return token
        core = token[: -len(self.suffix)]
        return core[:-1] + chr(ord(core[-1]) + MARK)

    def _apart(self, a: int, b: int, before: int) -> bool:
        """No merge across the border of a and b comes up before that rank, while the two are built."""
        end = before
        while True:
            crossing = self.pairs.get((a, b))
            if crossing is not None and crossing < end:
                return False
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                return True
            # Undo the later of the merges that made the two border symbols. A merge on the left with the
            # crossing pair's own rank goes first, one on the right does not.
            if right is None or (left is not None and left[2] > right[2]):
                a, end = left[1], left[2]
            else:
                b, end = right[0], right[2] + 1

    def _compatible(self, a: int, b: int) -> bool:
        return self._apart(a, b, 1 << 40)

    def word_ids(self, units: str) -> list[int]:
        n, compatible = len(units), self.compatible
        if units in self.automaton:
            return [self.automaton.get(units)[1]]
        # For each prefix, size and id of its last token. Matches come by their ends, longer ones first.
        size_of, last = [0] * (n + 1), [-1] * (n + 1)
        for end, (size, token) in self.automaton.iter(units):
            end += 1
            if last[end] < 0:
                before = last[end - size]
                if size == end or (before >= 0 and compatible(before, token)):
                    size_of[end], last[end] = size, token
        out, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError("the vocabulary does not cover the text")
            out.append(last[at])
            at -= size_of[at]
        return out[::-1]

    def word(self, word: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        found = self.words.get(word)
        if found is None:
            if word.isascii() and word.isprintable():  # such bytes are their own letters
                units = word[:-1] + chr(ord(word[-1]) + MARK)
            else:
                letters = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
                units = "".join(letters[:-1]) + chr(ord(letters[-1]) + MARK)
            ids = self.word_ids(units)
            found = struct.pack(f"<{len(ids)}I", *ids)
            _keep(self.words, word, found, KEPT_WORDS)
        return found

    def chunk(self, chunk: str) -> bytes:
        """The same for text without white space."""
        if chunk.isascii() and chunk.isalpha():
            return self.word(chunk)
        found = self.known.get(chunk)
        if found is None:
            found = b"".join([self.word(w) for w in self.split(chunk)])
            _keep(self.known, chunk, found, KEPT_CHUNKS)
        return found

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter: no final sigma
        return text.lower()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, special tokens and all."""
        parts = self.specials.split(text) if self.specials and "<" in text else [text]
        found = []
        for k, part in enumerate(parts):
            if k % 2:
                found.append(struct.pack("<I", self.special[part]))
            else:
                found += [self.chunk(w) for w in self.space.split(self.normal(part)) if w]
        return b"".join(found)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The same for many texts: each distinct chunk is looked up once."""
        # Arrow splits at four control characters more than Unicode has as white space.
        alone = [bool(self.odd.search(t) or ("<" in t and self.specials and self.specials.search(t))) for t in texts]
        lists = pc.utf8_split_whitespace(pa.array([self.normal(t) for t, a in zip(texts, alone) if not a], pa.large_string()))
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        chunks = lists.values.dictionary_encode()
        coded = pa.array([self.chunk(w) for w in chunks.dictionary.to_pylist()], pa.large_binary()).take(chunks.indices)
        bounds = np.frombuffer(coded.buffers()[1], np.int64, len(coded) + 1)[lists.offsets.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(len(lists) + 1, np.int64)
        data = memoryview(coded.buffers()[2]) if len(coded) and bounds[-1] else memoryview(b"")
        many = iter([bytes(data[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())])
        return [self.encode(t) if a else next(many) for t, a in zip(texts, alone)]

    def decode_all(self, coded: list[bytes]) -> list[str]:
        """What ids read: the tokens' texts with spaces between them."""
        ids = np.frombuffer(b"".join(coded), "<u4")
        said = self.spoken.take(pa.array(ids.astype(np.int64)))
        first = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int64)
        bounds = np.frombuffer(said.buffers()[1], np.int64, len(said) + 1)[first] if len(said) else first
        data = memoryview(said.buffers()[2]) if len(said) else memoryview(b"")
        return [str(data[a : max(a, b - 1)], "utf-8") for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


@functools.lru_cache(2)
def loaded(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode(docs: DataFrame, vocabulary: str, column: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """The columns keep (default: all), with n_tokens, ids (binary: little-endian 32-bit) and decoded (string), decoded from the ids.

    With digests, n_tokens, ids_sha256 and decoded_sha256 instead, so that the ids need not leave the worker.
    Columns of the new names must not be kept.
    """
    keep = docs.columns if keep is None else keep
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    if clash := {*keep} & {*made}:
        raise ValueError(f"columns {sorted(clash)} are in the way")
    source = positional(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`")))
    *own, raw = source.columns
    schema = source.drop(raw).schema.add("n_tokens", "long")
    schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string") if digests else schema.add("ids", "binary").add("decoded", "string")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for whole in batches:
            for batch in textops.slices(whole, raw, SLICE_BYTES):
                ids = bpe.encode_all([t or "" for t in batch[raw].to_pylist()])
                said = bpe.decode_all(ids)
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64())]
                if digests:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said])]
                else:
                    columns += [pa.array(ids, pa.binary()), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in own], *columns], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from coded(batches)
        textops.release()

    return source.mapInArrow(run, schema).toDF(*keep, *made)


def decode(encoded: DataFrame, vocabulary: str, column: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds decoded: the text of binary ids; null stays null. A column of that name is replaced."""

    @F.pandas_udf("string")
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(vocabulary)
        for batch in batches:
            yield pd.Series(bpe.decode_all([bytes(x or b"") for x in batch]), dtype=object).where(batch.notna().to_numpy(), None)

    return encoded.withColumn(decoded, said(F.col(f"`{column}`")))
