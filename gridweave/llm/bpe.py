"""BPE encoding by forced boundaries, and decoding.

A byte pair that stands inside no vocabulary token can never be merged over, so it marks a certain cut: the
fragments on both sides are encoded independently and their ids concatenated. The cuts are taken in two
steps. A single space (or line feed) between two other characters is such a cut, and one where the
tokenizer's own splitting rule always begins anew; it parts a text into pieces. Within a piece, the parts of
the splitting rule are cut at every pair that occurs in no token. Pieces and fragments repeat, so each is
encoded once per worker and kept in a table of bounded size; very long ones are encoded each time.

Vocabularies come from a tokenizer file in the JSON form of the ``tokenizers`` library; for a file whose
splitting rule is not one of the two known here, texts are encoded by the library as a whole.

Defined results: a NULL text counts as an empty one, which has no ids; the strings of special tokens get
their ids, as in the library; texts are never cut short; repeated rows stay repeated; other columns are not
looked at.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import Rows, texts_of, tidy
from .registry import query

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries that a table of pieces or fragments holds at most, and bytes for each on average; beyond, it starts anew.
#: Vocabularies with word ends have fewer tables, which may be larger. An entry counts for its letters, its ids and
#: what Python adds.
TABLE_LIMIT, WORD_TABLE_LIMIT = 200_000, 400_000
ENTRY_BYTES, MEAN_BYTES = 250, 320
#: Longer pieces hardly repeat and are not kept.
KEPT_LETTERS = 256

# Letters of ASCII and Latin-1: for texts of these and other visible ASCII, the splitting rules need no
# Unicode tables, so they can be applied here; other pieces go through the library's own rule.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(f"[\x21-\x7e{LETTERS}]+")
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PARTS = re.compile(f"{ENDINGS}| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s{LETTERS}0-9]+")
WORD_PARTS = re.compile(f"{ENDINGS}|[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+")
LINE_CUT = re.compile(r"(?<=\S)\n(?=\S)")
SPACE_CUT = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: visible bytes stand for themselves,
    the others are numbered from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Table(dict):
    """A cache of bounded size filled by a function."""

    def __init__(self, make: Callable[[str], bytes], limit: int) -> None:
        self.make, self.limit, self.bytes = make, limit, 0

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= KEPT_LETTERS:
            # a letter takes up to four bytes
            self.bytes += ENTRY_BYTES + 4 * len(key) + len(value) if not key.isascii() else ENTRY_BYTES + len(value)
            if len(self) >= self.limit or self.bytes > self.limit * MEAN_BYTES:
                self.clear()
                self.bytes = 0
            self[key] = value
        return value


class Encoder:
    """Ids of whole texts as little-endian integers of ``width`` bytes."""

    def __init__(self, tokenizer_json: str, width: int = 4) -> None:
        from tokenizers import Tokenizer
        spec = json.loads(tokenizer_json)
        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.width = self.library.model, width
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        suffix = spec["model"].get("end_of_word_suffix") or ""
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.specials = {s: self.pack([i]) for s, i in specials.items()}
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        self.letter_of = str.maketrans({chr(b): c for b, c in enumerate(letters)})
        self.inner = np.zeros((256, 256), bool)  # which byte pairs stand inside a token
        self.plain_tokens: list[bytes] = []
        self.token_bytes: dict[int, bytes] = {i: s.encode() for s, i in specials.items()}
        for token, i in spec["model"]["vocab"].items():
            plain = token[:-len(suffix)] if suffix and token.endswith(suffix) else token
            raw = bytes(of_letter[c] for c in plain) if all(c in of_letter for c in plain) else plain.encode()
            self.plain_tokens.append(raw)
            self.token_bytes.setdefault(i, raw + (b" " if plain != token else b""))
            pairs = np.frombuffer(raw, np.uint8)
            self.inner[pairs[:-1], pairs[1:]] = True
        self.kind = self._kind(spec)
        limit = WORD_TABLE_LIMIT if self.kind == "words" else TABLE_LIMIT
        self.whole = Table(self._piece, limit)  # a piece at the start of a line, or of words
        self.spaced = Table(lambda piece: self._piece(" " + piece), limit)
        self.fragments = Table(self._fragment, limit)

    def _kind(self, spec: dict) -> str:
        before = spec.get("pre_tokenizer") or {}
        steps = before.get("pretokenizers", [])
        simple = not any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        added = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens") or [])
        # No token may hold a space or line feed after another character than white space.
        parted = not any(re.search(r"\S[ \n]", raw.decode("utf-8", "replace")) for raw in self.plain_tokens
                         if b" " in raw[1:] or b"\n" in raw[1:])
        if not (simple and added and parted):
            return "library"
        if spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            return "bytes"
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        rule = steps[0].get("pattern", {}).get("Regex", "") if len(steps) == 2 else ""
        if normal == ["NFC", "Replace", "Lowercase"] and rule == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            return "words"
        return "library"

    def pack(self, ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(self.width, "little") for i in ids)

    def _fragment(self, letters: str) -> bytes:
        return self.pack([t.id for t in self.model.tokenize(letters)])

    def _piece(self, piece: str) -> bytes:
        if self.kind == "bytes":
            if PLAIN.fullmatch(piece, piece.startswith(" ")):
                parts = BYTE_PARTS.findall(piece)
            else:
                return b"".join(self._cut_letters(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(piece))
        elif PLAIN.fullmatch(piece):
            parts = WORD_PARTS.findall(piece.lower())
        else:
            return self.pack(self.library.encode(piece, add_special_tokens=False).ids)
        return b"".join(map(self._cut, parts))

    def _cut(self, part: str) -> bytes:
        return self._cut_letters(part.encode().decode("latin-1").translate(self.letter_of))

    def _cut_letters(self, letters: str) -> bytes:
        """Cut one part of the splitting rule at the forced boundaries and encode the fragments one by one.

        A vocabulary with a mark for word ends merges the last byte differently, so there a part stays whole.
        """
        if self.kind == "words" or len(letters) < 2:
            return self.fragments[letters]
        of = self._byte_of
        raw = [of[c] for c in letters]
        cuts = [i for i in range(1, len(raw)) if not self.inner[raw[i - 1], raw[i]]]
        if not cuts:
            return self.fragments[letters]
        return b"".join(self.fragments[letters[a:b]] for a, b in zip([0, *cuts], [*cuts, len(letters)], strict=True))

    @functools.cached_property
    def _byte_of(self) -> dict[str, int]:
        return {c: b for b, c in enumerate(byte_letters())}

    def _section(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if self.kind == "words":
            return b"".join(map(self.whole.__getitem__, text.replace("\n", " ").split(" ")))
        out: list[bytes] = []
        for i, line in enumerate(LINE_CUT.split(text)):
            if i:
                out.append(self.whole["\n"])
            pieces = line.split(" ")
            if "" in pieces or not line.isprintable():
                pieces = SPACE_CUT.split(line)
            out.append(self.whole[pieces[0]])
            out.extend(map(self.spaced.__getitem__, pieces[1:]))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.kind == "library":
            return self.pack(self.library.encode(text, add_special_tokens=False).ids)
        if self.special is None or not self.special.search(text):
            return self._section(text)
        return b"".join(self.specials[s] if i % 2 else self._section(s) for i, s in enumerate(self.special.split(text)))

    def decode(self, ids: bytes) -> str:
        values = np.frombuffer(ids, f"<u{self.width}").tolist()
        return b"".join(map(self.token_bytes.__getitem__, values)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(tokenizer_json: str, width: int = 4) -> Encoder:
    """One encoder per worker, kept between tasks."""
    return Encoder(tokenizer_json, width)


def tokenizer_text(path: str) -> str:
    """The tokenizer file, read on the driver and shipped to the tasks (a few MB, whatever the data)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])


def encode_documents(docs: DataFrame, tokenizer_path: str, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text as little-endian unsigned integers of ``width`` bytes."""
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows = encoder(shipped.value, width).encode, Rows(ENCODED)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                ids = encode(text)
                rows.add((doc_id, ids), len(ids))
                if rows.full():
                    yield rows.take()
        yield from rows.rest()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(run), "doc_id bigint, ids binary")


def decode_documents(encoded: DataFrame, tokenizer_path: str, width: int = 4) -> DataFrame:
    """``doc_id, ids, text``: the texts that the ids stand for."""
    shipped = encoded.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, rows = encoder(shipped.value, width).decode, Rows(DECODED)
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                text = decode(ids)
                rows.add((doc_id, ids, text), len(ids) + len(text))
                if rows.full():
                    yield rows.take()
        yield from rows.rest()

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id bigint, ids binary, text string")


def round_trip_documents(docs: DataFrame, tokenizer_path: str, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, text``: encode every whole text and decode the ids again, in one pass with one worker a task."""
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = encoder(shipped.value, width), Rows(DECODED)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                ids = own.encode(text)
                rows.add((doc_id, ids, own.decode(ids)), len(ids) + len(text))
                if rows.full():
                    yield rows.take()
        yield from rows.rest()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(run), "doc_id bigint, ids binary, text string")


@query("op9_bpe_round_trip")
def op9_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return round_trip_documents(docs, path).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
