"""SentencePiece (merge type) encoding by backtracking, and decoding.

A merge-type tokenizer replaces, again and again, the best-scored adjacent pair whose
concatenation is a piece.  The result is the only sequence of pieces that spells the text and in
which every two neighbours are *compatible*: merging their joint string again gives the same two
pieces.  So it can be found from left to right.  An Aho-Corasick automaton gives the longest match
at each position that is reached; where a piece does not fit its left neighbour the next shorter one is
tried, then the previous piece is taken back; a bitfield remembers positions from which no
continuation exists, so each is tried once.

A merge never crosses a place at which no piece continues: before a run of spaces that follows
another character (no piece holds a space after another character; this is checked when the model
is loaded), around line ends (checked alike) and around characters that are in no piece.  Texts are
cut there, and the encodings of the parts are kept in caches bounded by bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"


def read_model(path: str) -> dict:
    """The tables of a model file, small enough to broadcast (one row for each piece of the vocabulary)."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
        raise ValueError("a merge-type model with byte fallback is needed")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("a model without normalisation rules is needed")
    plain = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
    if any(p.type in (4, 5) for p in model.pieces):
        raise ValueError("user-defined and unused pieces aren't supported")
    if any(SPACE in p.lstrip(SPACE) for p in plain):
        raise ValueError("a piece holds a space after another character")
    if any("\n" in p and p != "\n" for p in plain):
        raise ValueError("a piece holds a line end beside another character")
    return {
        "plain": plain,
        "bytes": [next(i for i, p in enumerate(model.pieces) if p.type == 6 and p.piece == f"<0x{b:02X}>") for b in range(256)],
        "unknown": next((i for i, p in enumerate(model.pieces) if p.type == 2), 0),
        "prefix": bool(norm.add_dummy_prefix),
    }


class _Kept(dict):
    """A cache of a function, bounded by bytes.

    It has two generations: when the young one is full it becomes the old one, from which values
    that are asked for again are taken back.  Long keys aren't kept.
    """

    def __init__(self, fn, limit: int, longest: int = 256):
        super().__init__()
        self.fn, self.limit, self.longest = fn, limit, longest
        self.old: dict = {}
        self.held = 0

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.fn(key)
            if len(key) > self.longest:
                return value
        self.held += 200 + len(key) + (sum(map(len, value)) if isinstance(value, tuple) else 100)
        if self.held > self.limit:
            self.old = self.copy()
            self.clear()
            self.held = 0
        self[key] = value
        return value


class Encoder:
    """Encodes and decodes texts with the tables of ``read_model``."""

    def __init__(self, model: dict, cache: int = 1 << 26):
        """``cache``: bytes of a generation of each cache."""
        self.plain, self.byte_ids, self.prefix = model["plain"], model["bytes"], model["prefix"]
        known = sorted({c for p in self.plain for c in p})
        self.unknown = re.compile(f"[^{re.escape(''.join(known))}]").search
        self.id_of = {p: str(i) for p, (i, _) in self.plain.items()}
        self.automaton = ahocorasick.Automaton()
        for piece in self.plain:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.plain), default=1)
        self.pieces = {i: p for p, (i, _) in self.plain.items()}
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.fits = _Kept(lambda pair: self.merged(pair[0] + pair[1]) == [*pair], cache)
        # Ids joined by commas and the text they are decoded to: of a part, and of a word after one space.
        self.encoded = _Kept(self._round_trip, cache // 4)
        self.spaced = _Kept(lambda word: self._round_trip(" " + word), cache)

    def merged(self, s: str) -> list[str]:
        """The pieces of a short string by merging; it decides whether two pieces are compatible."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.plain.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pieces_of(self, s: str) -> list[str]:
        """The pieces of a string of known characters, by backtracking."""
        plain, fits, longest, at_most = self.plain, self.fits, self.automaton.longest_prefix, self.longest
        out: list[str] = []
        failed = 0  # bit p: no continuation from position p
        pos, size = 0, len(s)
        # The automaton gives the longest way from a position along its pieces; the longest piece is no longer.
        n = longest(s[:at_most])
        while pos < size:
            while n:
                end = pos + n
                piece = s[pos:end]
                if piece in plain and not failed >> end & 1:
                    if fits[out[-1], piece] if out else (end < size or self.merged(piece) == [piece]):
                        break
                n -= 1
            if n:
                out.append(piece)
                pos = end
                n = longest(s[pos : pos + at_most]) if pos < size else 0
            else:
                if not out:
                    raise ValueError(f"no encoding of {s!r}")
                failed |= 1 << pos
                n = len(out.pop())
                pos -= n
                n -= 1
        return out

    def _ids_of_part(self, part: str) -> str:
        part = part.replace(" ", SPACE)
        if not self.unknown(part):
            return ",".join(map(self.id_of.__getitem__, self.pieces_of(part)))
        ids: list[str] = []
        at = 0
        for i, c in enumerate(part):
            if self.unknown(c):
                ids += map(self.id_of.__getitem__, self.pieces_of(part[at:i]))
                ids += [str(self.byte_ids[b]) for b in c.encode("utf-8", "replace")]
                at = i + 1
        return ",".join([*ids, *map(self.id_of.__getitem__, self.pieces_of(part[at:]))])

    def _round_trip(self, part: str) -> tuple[str, str]:
        ids = self._ids_of_part(part)
        return ids, self._text(map(int, ids.split(",")))

    def _text(self, ids: Iterable[int]) -> str:
        out, held, pieces = [], bytearray(), self.pieces
        for i in ids:
            if i in pieces:
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(pieces[i])
            elif i in self.byte_of:
                held.append(self.byte_of[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    _parts = re.compile(r" *[^ \n]+| +|\n").findall

    def encode_parts(self, text: str | None) -> list[tuple[str, str]]:
        """The ids of each part of a text, joined by commas, with the text they are decoded to."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        out: list[tuple[str, str]] = []
        encoded, spaced = self.encoded.__getitem__, self.spaced.__getitem__
        for k, line in enumerate((" " + text if self.prefix else text).split("\n")):
            if k:
                out.append(encoded("\n"))
            words = line.split(" ")
            first = words[0]
            words[0] = "x"
            if "" in words:  # a run of spaces
                out += map(encoded, self._parts(line))
                continue
            if first:
                out.append(encoded(first))
            del words[0]
            out += map(spaced, words)
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for ids, _ in self.encode_parts(text) for x in ids.split(",")]

    def decode(self, ids: Iterable[int]) -> str:
        text = self._text(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text

    def decode_parts(self, parts: list[tuple[str, str]]) -> str:
        """``decode`` of the ids of all parts: a part begins and ends between characters, so each stands alone."""
        text = "".join([t for _, t in parts])
        return text[1:] if self.prefix and text.startswith(" ") else text


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, held) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(held.value)
    return _encoders[path]


def encode_documents(
    docs: DataFrame, path: str, text: str = "text", out_ids: str | None = "ids", out_digests: bool = True
) -> DataFrame:
    """Encode ``docs[text]`` with the model at ``path`` (read on the driver; its tables are broadcast) and decode again.

    Adds ``ids`` (array of int, unless ``out_ids`` is None) and, with ``out_digests``, ``n_tokens``,
    ``ids_sha256`` and ``decoded_sha256``; a column of ``docs`` with such a name is replaced.  A null or empty text has no ids.  There is
    no shuffle; a lost task is run again from its input.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_model(path))
    added = ([(out_ids, pa.list_(pa.int32()), "array<int>")] if out_ids else []) + (
        [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
        if out_digests
        else []
    )
    keep = [c for c in docs.columns if c not in {a[0] for a in added}]
    source = "__piece_text"
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"`{a[0]}` {a[2]}" for a in added)])

    def run(batches):
        encoder = _encoder(path, held)
        sha = hashlib.sha256
        for batch in batches:
            ids, counts, id_sums, text_sums = [], [], [], []
            for t in batch.column(source).to_pylist():
                parts = encoder.encode_parts(t)
                joined = ",".join([i for i, _ in parts])
                if out_ids:
                    ids.append([int(x) for x in joined.split(",")] if joined else [])
                if out_digests:
                    counts.append(joined.count(",") + 1 if joined else 0)
                    id_sums.append(sha(joined.encode()).hexdigest())
                    text_sums.append(sha(encoder.decode_parts(parts).encode("utf-8", "replace")).hexdigest())
            columns = [batch.column(c) for c in keep] + ([pa.array(ids, added[0][1])] if out_ids else [])
            if out_digests:
                columns += [pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(a[0] for a in added)])

    return docs.select(*keep, F.col(f"`{text}`").cast("string").alias(source)).mapInArrow(run, schema)
