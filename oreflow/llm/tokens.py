"""Exact, fast use of the public tokenizers: every distinct word piece is encoded once per batch, common ones once per worker.

A position between a non-space character and one blank or line feed that a
non-space character follows is a boundary that neither pre-tokenizer crosses
(the patterns attach at most that one blank to the word behind it), so the
ids of a text are the ids of its pieces, one after another.  Arrow cuts a
batch into pieces and numbers the distinct ones; numpy puts their ids together.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from oreflow.llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SPLIT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Texts with other white space than single blanks and line feeds between words, or with a NUL.
_UNUSUAL = "[\\x00\\x09\\x0B-\\x0D\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]|[ \\n][ \\n]|^[ \\n]|[ \\n]$|^$"
#: Bytes of the pieces kept by one worker, counting ENTRY for each besides its key and ids; later ones live for one batch only.
CACHE_BYTES, ENTRY = 32 << 20, 200
#: Places that remember which pieces were met in a batch before.
ONCE = 1 << 22
#: Texts of this many characters at most are encoded at a time, but for longer single ones.
BATCH_CHARS = 2 << 20
#: Words that make one string for the model, and such strings in a call of the library.
JOINED, WORDS = 64, 128
_MARKS = "!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"
#: A word behind a blank, of Latin letters, with marks behind it or not.
_WORD = "^[A-Za-z\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{12F}\\x{131}-\\x{24F}]+[" + re.escape(_MARKS) + "]*$"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """Keys of a text's pieces: NUL + text for the first, line feed + text after a line feed, the bare text after a blank."""
    first, *rest = _SPLIT.split(text)
    return ["\0" + first, *[x[1:] if x[0] == " " else x for x in rest]]


def _strings(column: pa.Array) -> list[str]:
    """As ``to_pylist``, without a scalar for each."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _segment(key: str) -> str:
    return key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key


class PieceEncoder:
    """Ids (little-endian uint32 bytes) as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [x.content for x in added.values()]
        self.mark_id, mark = max(added.items(), key=lambda x: x[0])
        self.mark = mark.content
        self.known: dict[str, bytes] = {}
        self.room = CACHE_BYTES
        self.once = np.zeros(ONCE, bool)  # a piece is kept when it is met in a second batch
        self.tokenize = self.tokenizer.model.tokenize
        self.single = self._single_word_form()
        self.signs = dict(enumerate(_byte_signs()))
        self.begins = self.words = None
        if self.single == ("\u0120", False):  # the sign of the blank tells in the ids where a word begins
            self.words = Tokenizer(self.tokenizer.model)  # the model alone, without a pre-tokenizer
            self.begins = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
            self.begins[[i for x, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if x[0] == "\u0120"]] = True
        self.tails: dict[str, bytes] = {"": b"", "\n": self.direct("\n")}

    def _single_word_form(self) -> tuple[str, bool] | None:
        """How the model sees an ASCII word behind a blank: the sign put before it, and whether it is lower-cased."""
        spec = json.loads(self.tokenizer.to_str())
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "\u0120", False  # the byte-level sign of the blank
        if norm and "Lowercase" in [x["type"] for x in norm.get("normalizers", [norm])] and spec["model"].get("end_of_word_suffix"):
            return "", True
        return None

    def _word(self, key: str) -> bytes | None:
        """Ids of a word of Latin letters, with a line feed before it and marks behind it or not, straight from the model."""
        if self.single is None:
            return None
        sign, lower = self.single
        before = b""
        if key[0] in "\0\n":  # no blank before it
            before, sign, key = self.tails[key[0].strip("\0")], "", key[1:]
        word = key.rstrip(_MARKS)
        if not word.isalpha() or not word.isascii() and (max(word) > "\u024f" or "\u0130" in word):
            return None
        after = self._tail(key[len(word) :])
        if lower:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.signs)
        return before + array("I", [t.id for t in self.tokenize(sign + word)]).tobytes() + after

    def _signed(self, words: str) -> str:
        """Words of letters, with blanks, in byte signs."""
        if words.isascii():
            return words.replace(" ", "\u0120")
        return words.encode().decode("latin-1").translate(self.signs)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words behind a blank, several as one string of byte signs.

        A merge over the end of a word would make an id with the blank's sign
        inside; then fewer ids than words begin with it, and the words are
        encoded one by one.
        """
        out: list[bytes] = []
        for at in range(0, len(words), WORDS * JOINED):
            some = words[at : at + WORDS * JOINED]
            texts = [self._signed(f" {' '.join(some[k : k + JOINED])}") for k in range(0, len(some), JOINED)]
            ids = np.array([i for e in self.words.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], dtype="<u4")
            places = np.flatnonzero(self.begins[ids])
            if len(places) != len(some):
                out += [self.direct(f" {w}") for w in some]
                continue
            raw, edges = ids.tobytes(), [*(4 * places).tolist(), 4 * len(ids)]
            out += [raw[a:z] for a, z in zip(edges, edges[1:], strict=False)]
        return out

    def _learn_words(self, keys: list[str], out: list[bytes | None]) -> list[int]:
        """Puts the ids of the keys that are words, with marks behind them or not, to their places in ``out``, each word encoded once; returns the places of the others."""
        column = pa.array(keys, pa.large_string())
        simple = pc.match_substring_regex(column, _WORD)
        own = column.filter(simple)
        cut = pc.utf8_rtrim(own, _MARKS)
        marked = pc.not_equal(pc.binary_length(cut), pc.binary_length(own)).to_numpy(zero_copy_only=False)
        bare = cut.dictionary_encode()
        words, simple = _strings(bare.dictionary), simple.to_numpy(zero_copy_only=False)
        ids = list(map(self.known.get, words))
        new = [k for k, v in enumerate(ids) if v is None]
        for k, v in zip(new, self._words([words[k] for k in new]), strict=True):
            ids[k] = v
        places, which = np.flatnonzero(simple), bare.indices.to_numpy()
        for place, k in zip(places[~marked].tolist(), which[~marked].tolist(), strict=True):
            out[place] = ids[k]
        for place, k in zip(places[marked].tolist(), which[marked].tolist(), strict=True):
            out[place] = ids[k] + self._tail(keys[place][len(words[k]) :])
        return np.flatnonzero(~simple).tolist()

    def _tail(self, tail: str) -> bytes:
        after = self.tails.get(tail)
        if after is None:
            after = self.direct(tail)
            if len(self.tails) < 10_000:
                self.tails[tail] = after
        return after

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, keys: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(keys)
        plain = []
        for place in self._learn_words(keys, out) if self.words is not None else range(len(keys)):
            k = keys[place]
            if (ids := self._word(k)) is not None:
                out[place] = ids
            elif "<" in k and any(s in k for s in self.special):
                out[place] = self.direct(_segment(k))
            else:
                plain.append(place)
        for at in range(0, len(plain), 32):
            some = plain[at : at + 32]
            text = self.mark.join(_segment(keys[k]) for k in some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark_id).tolist()
            if len(ends) != len(some) - 1:  # a piece that itself makes the mark: never for whole special tokens
                for k in some:
                    out[k] = self.direct(_segment(keys[k]))
                continue
            raw, begin = ids.tobytes(), 0
            for k, end in zip(some, [*ends, len(ids)], strict=True):
                out[k] = raw[4 * begin : 4 * end]
                begin = end + 1
        return out

    def _ids(self, keys: list[str]) -> list[bytes]:
        got = list(map(self.known.get, keys))
        missing = [k for k, v in enumerate(got) if v is None]
        if not missing:
            return got
        for k, v in zip(missing, self._learn([keys[k] for k in missing]), strict=True):
            got[k] = v
        if self.room > 0:
            places = np.fromiter(map(hash, map(keys.__getitem__, missing)), np.int64, len(missing)) % ONCE
            for at in np.flatnonzero(self.once[places]).tolist():
                key, v = keys[missing[at]], got[missing[at]]
                self.known[key] = v
                self.room -= len(key) + len(v) + ENTRY
                if self.room <= 0:
                    break
            self.once[places] = True
        return got

    def encode(self, texts: list[str], batch_chars: int | None = None) -> list[bytes]:
        """``batch_chars``, in place of BATCH_CHARS: more of them cost memory and spare words that come again."""
        most = batch_chars or BATCH_CHARS
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= most):
                held += len(texts[end])
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        unusual = pc.match_substring_regex(column, _UNUSUAL).to_numpy(zero_copy_only=False)
        usual = column.filter(pa.array(~unusual)) if unusual.any() else column
        start, nothing = (pa.scalar(x, pa.large_string()) for x in ("\0", ""))
        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(start, usual, nothing), "\n", " \n"), " ")
        words = cut.flatten().dictionary_encode()
        counts = np.diff(cut.offsets.to_numpy())
        keys, which = _strings(words.dictionary), words.indices.to_numpy()
        if unusual.any():  # their pieces behind those of the others
            own = [["\0" + x] if "\0" in x else pieces(x) if x else [] for x in (texts[k] for k in np.flatnonzero(unusual).tolist())]
            more = [k for x in own for k in x]
            places = {k: at for at, k in enumerate(dict.fromkeys(more), len(keys))}
            which = np.concatenate([which, np.fromiter(map(places.__getitem__, more), np.int64, len(more))])
            keys, counts = [*keys, *places], np.concatenate([counts, np.fromiter(map(len, own), counts.dtype, len(own))])
        ids = self._ids(keys)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        begins = np.cumsum(sizes) - sizes
        # Each piece's ids, one after another.
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        joined = flat[np.repeat(begins[which] - (ends - lengths), lengths) + np.arange(total)].tobytes()
        edges = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]]) * 4
        by_place = [joined[a:z] for a, z in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
        if not unusual.any():
            return by_place
        order = np.concatenate([np.flatnonzero(~unusual), np.flatnonzero(unusual)])
        return [by_place[k] for k in np.argsort(order).tolist()]


def _byte_signs() -> list[int]:
    """The code point that stands for each byte in byte-level vocabularies: itself if it is shown, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [b if b in shown else next(hidden) for b in range(256)]


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One per worker and file; Spark reuses its Python workers."""
    return PieceEncoder(path)


@lru_cache(maxsize=2)
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    back = {chr(sign): b for b, sign in enumerate(_byte_signs())}
    added = t.get_added_tokens_decoder()
    out = [b""] * t.get_vocab_size(with_added_tokens=True)
    for word, i in t.get_vocab(with_added_tokens=True).items():
        out[i] = added[i].content.encode() if i in added else bytes(back[c] for c in word)
    return out


def decode(ids: np.ndarray, table: list[bytes]) -> str:
    """As the byte-level decoder does, special tokens kept."""
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


common.keeps(encoder.cache_clear)
common.keeps(byte_table.cache_clear)
