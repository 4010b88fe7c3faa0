"""Exact, memoised use of the tokenizers library: whole texts are encoded unit by unit where the cuts are proven safe.

A unit is a run without white space, with its preceding blank where the vocabulary keeps blanks. Byte-level BPE
with the usual pattern always begins a new pre-token at a single blank or line feed between other characters, and
every merge stays inside a pre-token, so the ids of the units in turn are the ids of the text. Texts with any
other white space (runs, tabs, leading or trailing blanks, Unicode blanks) or unprintable characters are encoded
whole by the library. Units that the memo lacks are encoded by the library too. Which rule holds is read from the
vocabulary's file; with any other normaliser, pre-tokenizer or model, every text goes whole to its library.
"""

from __future__ import annotations

import json
import os
import unicodedata
import weakref
from array import array
from functools import lru_cache

#: Entries of the memo of units, and of each generation of pre-tokens: about 100 MB each in a worker.
MEMO = 500_000
#: Punctuation that no contraction and no special token holds.
TAIL = ".,;:!?#%&$*()[]{}+-=/@^~"
_kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up in turn.
LETTERS = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _kept)}


#: What a file of each kind says of its normaliser and pre-tokenizer.
BYTES = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None)
WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "</w>",
)


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizers library's object for a .json, sentencepiece's for a .model."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=path)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(maxsize=4)
def rule(path: str) -> str | None:
    """"bytes" if pre-tokens carry the blank before them, "words" if blanks are dropped, None if units can't be told by white space."""
    if path.endswith(".model"):
        return None
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model = said["model"]
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    tokens = all(x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in said.get("added_tokens", []))
    found = (said.get("normalizer"), said.get("pre_tokenizer"), model.get("end_of_word_suffix") or None)
    return {True: "bytes" if found == BYTES else "words" if found == WORDS else None, False: None}[plain and tokens]


class Units(dict):
    """unit -> value, made when it is first asked for.

    The encoder that makes it is held weakly: in a cycle, its memos would stay until Python looks for cycles, long after
    the next encoder has filled its own.
    """

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = weakref.proxy(encoder)

    def __missing__(self, unit: str):
        value = self[unit] = self.encoder._unit(unit)
        return value


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes, or their numbers.

    Units are cheap to make again from their pre-tokens, so their memo is emptied when full; the pre-tokens, which
    cost the merges, are kept for another generation.
    """

    def __init__(self, path: str, counts: bool = False):
        self.tokenizer, self.rule, self.counts = load(path), rule(path), counts
        self.keeps_blanks = self.rule == "bytes"
        self.model, self.units, self.heads, self.old = getattr(self.tokenizer, "model", None), Units(self), {}, {}
        self.feed = self._whole(["\n"])[0] if self.keeps_blanks else None

    def _value(self, ids):
        return len(ids) if self.counts else array("I", ids).tobytes()

    def _whole(self, texts: list[str]) -> list:
        if not hasattr(self.tokenizer, "encode_batch"):
            return [self._value(x) for x in self.tokenizer.encode(texts, num_threads=1)]
        return [self._value(x.ids) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pretoken(self, text: str) -> bytes | int:
        """One pre-token through the library's model alone; its splitting and alignments cost more than the merges."""
        if not text.isascii() or text[0] == " ":
            text = text.encode().decode("latin-1").translate(LETTERS)
        return self._value([x.id for x in self.model.tokenize(text)])

    def _made(self, pretoken: str) -> bytes | int:
        """A pre-token that the memo's newer generation lacks."""
        if len(self.heads) >= MEMO:
            self.old, self.heads = self.heads, {}
        found = self.old.get(pretoken)
        if found is None:
            found = self._pretoken(pretoken)
        self.heads[pretoken] = found
        return found

    def _unit(self, unit: str) -> bytes | int:
        """Letters and a tail of plain punctuation are one pre-token each, and so is such a tail alone; any other unit goes to the whole pipeline.

        A unit after a line feed begins with it and holds its id too; any other has a blank before it, if blanks are kept.
        """
        before = None
        if self.keeps_blanks:
            if unit[0] == "\n":
                before, unit = self.feed, unit[1:]
            else:
                unit = " " + unit
        head = unit.rstrip(TAIL)
        value = self.heads.get(head)
        if value is None:
            if head.lstrip(" ").isalpha():
                value = self._made(head)
            elif head in ("", " "):
                head, value = unit, self._made(unit)
            else:
                head, value = unit, self._whole([unit])[0]
        if len(head) < len(unit):
            tail = unit[len(head) :]
            more = self.heads.get(tail)
            value = value + (self._made(tail) if more is None else more)
        return value if before is None else before + value

    @staticmethod
    def _folds(text: str) -> bool:
        """Whether lower() is all that the vocabulary's normaliser does beside white space: it composes and lowers letter by letter."""
        return text.isascii() or ("\u03a3" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", text.lower()))

    def __call__(self, texts: list[str]) -> list:
        """One value for each text: bytes of its ids, or with counts=True how many there are."""
        out, join = [], sum if self.counts else b"".join
        if self.rule is None:
            return [self._whole([text])[0] for text in texts]
        for text in texts:
            flat = text.replace("\n", "")
            if not text or text[0] in " \n" or text[-1] in " \n" or not flat.isprintable() or any(x in text for x in ("  ", "\n\n", " \n", "\n ")):
                out.append(self._whole([text])[0])
                continue
            if self.keeps_blanks:
                units = ("\n" + text.replace("\n", " \n")).split(" ")
            elif "<|" in text or not self._folds(text):
                out.append(self._whole([text])[0])
                continue
            else:
                units = text.lower().replace("\n", " ").split(" ")
            if self.keeps_blanks:  # the first unit has no line feed before it
                value = join(map(self.units.__getitem__, units))
                out.append(value - self.feed if self.counts else value[len(self.feed) :])
            else:
                out.append(join(map(self.units.__getitem__, units)))
            if len(self.units) > MEMO:
                self.units.clear()
        return out


@lru_cache(maxsize=1)
def encoder(path: str, counts: bool = False) -> Encoder:
    """The last that was asked for in a worker, so that its memo serves all of the worker's tasks of a step, and no two are held."""
    return Encoder(path, counts)


def forget() -> None:
    """Give up the worker's encoder. A worker outlives its steps, so those that don't encode call this before they fill its memory."""
    encoder.cache_clear()
