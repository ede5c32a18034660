"""BPE encoding and decoding of whole texts by prefix-sharing trie traversal.

The distinct words of a block of texts form a trie (kept as a sorted list with common-prefix lengths, which lists its
nodes in depth-first order). A node's state is the last token of the encoding of its prefix: encodings nest, so the
encoding of a prefix is that of the prefix without its last token, then that token. Prefixes that words share are
encoded once; a word's ids are read back along the path.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from struct import pack

from pyspark.sql import DataFrame

from sedimark.llm.common import KEPT, chunks, map_arrow

#: Fixed values of the tokenizer file's format: its white space and its contractions.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _char_class(kind: str) -> str:
    """Ranges of all code points whose general category begins with `kind`."""
    out, start, prev = [], None, None
    for cp in range(sys.maxunicode + 1):
        if unicodedata.category(chr(cp))[0] == kind:
            if start is None:
                start = cp
            prev = cp
        elif start is not None:
            out.append((start, prev))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if a != b else f"\\U{a:08x}" for a, b in out)


class Splitter:
    """Text -> words, as the file's added tokens, normalizer and pre-tokenizer do. `specials` stay words of their own."""

    def __init__(self, specials: dict[str, int]) -> None:
        letter, number = _char_class("L"), _char_class("N")
        tail = "|".join(CONTRACTIONS)
        self.word = re.compile(f"[{letter}]+|[{number}]|'(?:{tail})|[^{SPACE}{letter}{number}]+").findall
        #: the same for ASCII only, where small classes are quicker
        self.plain = re.compile(f"[a-z]+|[0-9]|'(?:{tail})|[^\t\n\x0b\x0c\r a-z0-9]+").findall
        small = [chr(c) for c in range(256)]
        letter, number = ("".join(c for c in small if unicodedata.category(c)[0] == k and not c.isupper()) for k in "LN")
        self.latin = re.compile(f"[{letter}]+|[{number}]|'(?:{tail})|[^\t\n\x0b\x0c\r \x85\xa0{letter}{number}]+").findall
        self.beyond = re.compile("[^\0-\xff]").search
        self.cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")").split if specials else None
        self.specials = specials

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain(text.lower())
        if not self.beyond(text):  # Latin-1 is in normal form C
            return self.latin(text.lower())
        return self.word(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.specials):
            return self._words(text)
        out = []
        for part in self.cut(text):
            if part in self.specials:
                out.append("\0" + part)  # no word begins so: a word with this character is one of symbols only
            else:
                out += self._words(part)
        return out


class Bpe:
    """Encoder and decoder of a word-end BPE file of the tokenizers library.

    `most` bounds the words that are kept (with 64 bytes each on average, of text and ids) and three times that the token pairs. Beyond
    it only the words met in a second block stay, as most words of a large corpus never come again; that costs time only.
    """

    def __init__(self, path: str, most: int = 300_000, decodes: bool = True) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: s for s, i in self.vocab.items()}
        self.end = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.names |= {i: s for s, i in self.specials.items()}
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        #: endings of tokens inside a word and at its end (without the suffix): the token's id, or -1 for a mere ending
        self.inner, self.final = {}, {}
        for name, i in self.vocab.items():
            closes = bool(self.end) and name.endswith(self.end) and name != self.end
            body, known = (name[: -len(self.end)], self.final) if closes else (name, self.inner)
            for k in range(1, len(body)):
                known.setdefault(body[k:], -1)
            known[body] = i
        if not self.end:
            self.final = self.inner
        self.split = Splitter(self.specials)
        self.bytes_as = self._byte_symbols()
        self.most, self.decodes = most, decodes
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.held = 0
        self.fits: dict[int, bool] = {}

    @staticmethod
    def _byte_symbols() -> list[str]:
        """Byte-level files write a printable Latin-1 byte as itself and the others from U+0100 on, in order."""
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = iter(range(0x100, 0x200))
        return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _compatible(self, before: int, token: int) -> bool:
        """Whether `token` stays apart after `before` (-1: at a word's start), that is, the two are their own encoding.

        Plain merging by definition, lowest rank first and leftmost of equals, given up when it crosses the border.
        """
        rank, never = self.rank.get, len(self.rank)
        left = self._symbols(self.names[before]) if before >= 0 else []
        parts, border = left + self._symbols(self.names[token]), len(left)
        ranks = [rank(p, never) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            if i == border - 1:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            border -= i < border
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), never)
        return len(parts) == (1 if before < 0 else 2)

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known yet, by one depth-first pass over their trie.

        tokens[k], lengths[k]: last token of path[:k]. A node's candidates are the tokens that end there, longest first;
        exactly one of them fits after the last token before it.
        """
        ids_of = self.ids
        new = [w for w in words if w not in ids_of]
        self.again |= words.difference(new)
        if len(self.ids) + len(new) > self.most or self.held > 64 * self.most:
            self._forget(words)
        if len(self.fits) > 3 * self.most:
            self.fits = {}
        by, fits, inner, final = self.bytes_as, self.fits, self.inner, self.final
        path, tokens, lengths = "", [-1], [0]
        for symbols, word in sorted([(w if w.isascii() and w.isprintable() else "".join([by[b] for b in w.encode()]), w) for w in new]):
            if word[0] == "\0" and word[1:] in self.specials:
                self._keep(word, [self.specials[word[1:]]])
                continue
            last = len(symbols) - 1
            shared, most = 0, min(len(path), last)
            while shared < most and path[shared] == symbols[shared]:
                shared += 1
            del tokens[shared + 1 :], lengths[shared + 1 :]
            for depth in range(shared + 1, last + 2):
                known = inner if depth <= last else final
                found, n, low = [], 1, depth
                # tokens that end here, by walking back while the characters still end some token
                while low:
                    low -= 1
                    t = known.get(symbols[low:depth])
                    if t is None:
                        break
                    if t >= 0:
                        found.append((t, low))
                for token, low in reversed(found):
                    key = (tokens[low] + 1) << 20 | token
                    fit = fits.get(key)
                    if fit is None:
                        fit = fits[key] = self._compatible(tokens[low], token)
                    if fit:
                        break
                else:
                    raise ValueError(f"{word!r} has no encoding in this vocabulary")
                if depth <= last:
                    tokens.append(token)
                    lengths.append(depth - low)
            path = symbols[:last]
            ids = [token]
            while low:
                ids.append(tokens[low])
                low -= lengths[low]
            ids.reverse()
            self._keep(word, ids)

    def _forget(self, words: set[str]) -> None:
        """The words of this block stay, and those met again since they were first met, unless these fill the tables themselves; the rest
        is learned anew when it comes again."""
        size = lambda w: len(w) + len(self.ids[w]) + len(self.texts.get(w, b""))
        if 4 * len(self.again) > 3 * self.most or 4 * sum(map(size, self.again)) > 3 * 64 * self.most:
            self.again = self.again & words
        self.ids = {w: x for w, x in self.ids.items() if w in words or w in self.again}
        self.texts = {w: x for w, x in self.texts.items() if w in self.ids}
        self.held = sum(map(size, self.ids))

    def _keep(self, word: str, ids: list[int]) -> None:
        names = self.names
        self.ids[word] = pack(f"<{len(ids)}I", *ids)
        self.held += len(word) + 4 * len(ids)
        if self.decodes:
            self.texts[word] = " ".join([names[i] for i in ids]).encode()
            self.held += len(self.texts[word])

    def encode_words(self, text: str) -> list[str]:
        return self.split(text)

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self.learn(set(words))
        return [int.from_bytes(self.ids[w][i : i + 4], "little") for w in words for i in range(0, len(self.ids[w]), 4)]

    def packed(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Per text: ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8 (decoder-less files join
        tokens with blanks)."""
        out = []
        split = self.split
        lists = [split(t) for t in texts]
        for part in self._parts(lists):
            self.learn({w for words in part for w in words})
            ids, names = self.ids, self.texts
            for words in part:
                out.append((b"".join([ids[w] for w in words]), b" ".join([names[w] for w in words]) if self.decodes else b""))
        return out

    def _parts(self, lists: list[list[str]]) -> list[list[list[str]]]:
        """Slices with no more than `most` words, so that a slice's words are known together."""
        ends, total = [0], 0
        for i, words in enumerate(lists):
            if total and total + len(words) > self.most * 8:
                ends.append(i)
                total = 0
            total += len(words)
        return [lists[a:b] for a, b in zip(ends, [*ends[1:], len(lists)])]


_LOADED: dict[tuple, Bpe] = {}
KEPT["bpe"] = _LOADED.clear


def loaded(path: str, most: int = 600_000, decodes: bool = True) -> Bpe:
    """One encoder per Python worker, file and use."""
    key = (path, most, decodes)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(path, most, decodes)
    return _LOADED[key]




def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids binary (little-endian unsigned 32-bit), decoded string for every document; no shuffle.

    A null text is empty: no ids, an empty decoded text. Repeated rows are encoded each; null doc_ids stay null; further
    columns are ignored; an empty table gives no rows. Memory: blocks of about 2 MB of text (one document at least) and a
    bounded table of known words per worker.
    """

    def make():
        import pyarrow as pa

        bpe = loaded(path)

        def run(batches):
            for b in chunks(batches, "text"):
                texts = [t or "" for t in b.column("text").to_pylist()]
                pairs = bpe.packed(texts)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1].decode() for p in pairs], pa.string())], ["doc_id", "ids", "decoded"])

        return run

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, ids binary, decoded string", "bpe")
