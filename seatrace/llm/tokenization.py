"""Fast exact use of the public BPE vocabularies inside tasks.

The tokenizers library encodes a text as a run of separate pieces: no merge crosses from a character
that is no white space to white space. So a text is cut there, and pieces seen before are looked up
in a bounded cache of the worker; the library encodes only new ones. Texts are cut only where the cut
is provably a piece boundary of the vocabulary's own pattern; other texts (or vocabularies of another
make) go to the library whole. Results equal the library's on the whole text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

#: Entries a worker's cache of pieces holds before it is emptied, and its cache of marks.
PIECES, MARKS = 1_000_000, 100_000
#: White space other than the space and the line end, and what only Python takes for white space.
SEPARATORS = re.compile("[\x1c-\x1f]")
ODD = re.compile("[\0\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A piece of letters up to U+00FF, with the white space before and the ASCII marks after it.
SIMPLE = re.compile("([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")

#: What sentencepiece writes for a space; where a text is cut into chunks, and where a long one into parts.
SPACE = "\u2581"
CHUNKS = re.compile(r"(?<=\S)(?=[ \n])")
BOUNDARY = re.compile(r"\S(?=[ \n])")


class Cache(dict):
    """Keeps what ``make`` gave for each key, up to ``most`` keys; then starts anew."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class PieceEncoder:
    """Encodes texts to ids packed as unsigned 16- or 32-bit integers (``typecode`` H or I).

    With ``special``, strings of special tokens in a text get the tokens' ids, as by the library's default;
    else they are text."""

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.typecode = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        spec = json.loads(self.library.to_str())
        self.kind = _kind(spec)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)") if special else None
        self.pieces = Cache(self._piece, PIECES)
        self.marks = Cache(self._library, MARKS)
        self.letters = _byte_letters()

    def encode(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            return self._library(text)
        if self.kind == "words" and not SEPARATORS.search(text):
            pieces = text.split()
        elif self.kind == "pieces" and _single_spaced(text):
            pieces = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        elif self.kind == "pieces" and not SEPARATORS.search(text):
            pieces = re.findall(r"\s*\S+|\s+$", text)
        else:
            return self._library(text)
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece not seen yet; one with marks is made of the piece without them."""
        core = piece.removeprefix(" ")
        if core.isascii() and core.isalpha():
            space, letters, marks = piece[: len(piece) - len(core)], core, ""
        elif found := SIMPLE.fullmatch(piece):
            space, letters, marks = found.groups()
        else:
            return self._library(piece)
        if self.kind == "words":
            space, letters = "", letters.lower()
        if space == "\n":
            ids = self.marks["\n"] + self.pieces[letters]
        elif space + letters == piece:
            return self._part(piece)
        else:
            ids = self.pieces[space + letters]
        return ids + self.marks[marks] if marks else ids

    def _part(self, part: str) -> bytes:
        letters = self.letters
        spelt = part.replace(" ", letters[32]) if part.isascii() else "".join([letters[b] for b in part.encode()])
        return array(self.typecode, [t.id for t in self.library.model.tokenize(spelt)]).tobytes()

    def _library(self, text: str) -> bytes:
        return array(self.typecode, self.library.encode(text, add_special_tokens=False).ids).tobytes()


def _single_spaced(text: str) -> bool:
    """Its only white space are single spaces and line ends between other characters."""
    if ODD.search(text) or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
        return text == ""
    return not any(two in text for two in ("  ", "\n\n", " \n", "\n "))


def _kind(spec: dict) -> str:
    """pieces: byte-level, white space before a word belongs to it; words: white space is dropped."""
    before = spec["pre_tokenizer"] or {}
    if any(spec.get(k) for k in ("truncation", "padding")) or any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        return "whole"
    if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not spec["normalizer"]:
        return "pieces"
    kinds = [x["type"] for x in before.get("pretokenizers", [])]
    normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    if kinds == ["Split", "ByteLevel"] and before["pretokenizers"][0]["invert"] and normal == ["NFC", "Replace", "Lowercase"]:
        return "words"
    return "whole"


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class SentencePieces:
    """Encodes texts by a sentencepiece model; ``cuts`` says whether a text may be encoded in ``chunks``.

    A model has cuts if it is a BPE model that leaves texts as they are but for one space before them,
    and none of its pieces has a space after another character or a line end anywhere: then no merge
    crosses from a character that is no white space to a space or a line end."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        normal, trained, kinds = model.normalizer_spec, model.trainer_spec, {1, 2, 3, 6}  # normal, unknown, control and byte pieces
        plain = not normal.precompiled_charsmap and not normal.normalization_rule_tsv and normal.add_dummy_prefix and normal.escape_whitespaces
        plain = plain and not normal.remove_extra_whitespaces and not trained.treat_whitespace_as_suffix and trained.model_type == 2
        parts = (p.type in kinds and SPACE not in p.piece.lstrip(SPACE) and "\n" not in p.piece for p in model.pieces)
        self.cuts = bool(plain) and all(parts)
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.lengths = Cache(lambda chunk: len(self.encode_chunks([chunk])[0]), PIECES)

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each of the chunks of a text with a space before it."""
        found = self.library.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        # What the model puts before a line end is a piece of its own; nothing comes of an empty text.
        return [ids[1:] if c[0] != " " else ids or [self.library.piece_to_id(SPACE)] for c, ids in zip(chunks, found)]

    def may_cut(self, text: str) -> bool:
        return self.cuts and SPACE not in text and text != ""

    def count(self, text: str) -> int:
        return self.count_chunks(" " + text) if self.may_cut(text) else len(self.library.encode(text, num_threads=1))

    def count_chunks(self, spaced: str) -> int:
        """Tokens of a text that may be cut, given with the space before it (or of a part of it)."""
        return sum(map(self.lengths.__getitem__, chunks(spaced)))


def chunks(text: str) -> list[str]:
    """text cut before each space or line end that follows a character that is no white space."""
    if text[:1] == " " and _single_spaced(text[1:]):
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]
    return CHUNKS.split(text)


def safe_parts(text: str, size: int) -> Iterator[str]:
    """text in parts of about ``size`` characters or more, each but the first with white space at its start
    and each but the last with none at its end."""
    at = 0
    while len(text) - at > size and (end := BOUNDARY.search(text, at + size - 1)):
        yield text[at : end.end()]
        at = end.end()
    yield text[at:] if at else text


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = False) -> PieceEncoder:
    """One encoder for each worker process and vocabulary."""
    return PieceEncoder(path, special)


@lru_cache(maxsize=4)
def sentence_pieces(path: str) -> SentencePieces:
    """One for each worker process and model."""
    return SentencePieces(path)
