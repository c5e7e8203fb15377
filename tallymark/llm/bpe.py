"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a pre-token has one encoding, and so one last token. A match automaton over
all vocabulary strings gives the tokens that end at each place; the one that is compatible
with the last token of what stands before it is stored, and back-pointers from the end give
the ids. Two neighbouring tokens are compatible if no merge across their border would have
come before the merges that built them.

Texts are cut at white space, and what a task has worked out for a piece is kept in a bounded
table, so that frequent words cost a look-up. Encoding needs no shuffle.

Defined results: a null text is an empty one, with 0 tokens and the digests of empty text;
special tokens written in a text become their ids, as the library does; repeated rows give
repeated results; null ids are kept; an empty table has no rows; other columns are left out, whatever
their names. A vocabulary whose special tokens hold white space is refused.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallymark.llm.common import Batcher

WORD_END = "</w>"
#: White space of the vocabulary's patterns (fixed values).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(f"[{_SPACE}]+")
#: Controls that str.split takes for white space and the vocabulary's patterns don't.
_NOT_SPACE = regex.compile(r"[\x1c-\x1f]")
#: The vocabulary's pre-token pattern (fixed value), with its white space spelled out.
_PRE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: Beyond Latin letters, the library's own normalizer and pattern are asked.
_PLAIN = regex.compile(r"[\x00-\u024f]*")
#: ASCII that is neither letter, digit, control nor space.
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
MOST_KEPT = 400_000
#: Bytes of pieces and words with their ids that a task of the library's encoder keeps.
MOST_BYTES = 112 << 20


def pieces(text: str | None) -> list[str]:
    """A text cut at white space; no token reaches across."""
    if not text:
        return []
    return [x for x in _SPLIT.split(text) if x] if _NOT_SPACE.search(text) else text.split()


def _byte_chars() -> list[str]:
    """The printable stand-in of every byte: itself where it prints, else from 256 upwards."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A vocabulary file: how a text is cut into words, and what its tokens are."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        model, self.path = self.spec["model"], path
        if model.get("end_of_word_suffix") != WORD_END or model.get("dropout"):
            raise ValueError("a vocabulary with word ends and without dropout is needed")
        self.special = {x["content"]: x["id"] for x in self.spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        if any(_SPLIT.search(x) for x in self.special):
            raise ValueError("a special token holds white space")
        self._sign = "<|" if all("<|" in x for x in self.special) else ""
        self._library = None

    def _pre_tokens(self, piece: str) -> list[str]:
        if _PLAIN.fullmatch(piece):
            if piece.isascii() and piece.isalpha():
                return [piece.lower()]
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece)
            return _PRE.findall(piece.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        from tokenizers import NormalizedString, PreTokenizedString

        normal = NormalizedString(piece)
        self._library.normalizer.normalize(normal)
        whole = PreTokenizedString(normal.normalized)
        split = self._library.pre_tokenizer[0] if hasattr(self._library.pre_tokenizer, "__getitem__") else None
        if split is None:
            return _PRE.findall(normal.normalized)
        split.pre_tokenize(whole)
        return [x for x, _, _ in whole.get_splits() if x]

    def encode_word(self, word: str) -> list[int]:
        raise NotImplementedError

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of text without white space."""
        out: list[int] = []
        for part in self._special.split(piece) if self._special and self._sign in piece else (piece,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for word in self._pre_tokens(part):
                    out += self.encode_word(word)
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for x in pieces(text) for i in self.encode_piece(x)]


class PrefixBPE(Vocabulary):
    """A vocabulary file read for encoding by prefixes."""

    def __init__(self, path: str):
        super().__init__(path)
        spec = self.__dict__.pop("spec")
        model = spec["model"]
        self.tokens = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        # inside, a symbol is one character: a byte's own, or 256 on for a byte that ends a word
        stand_in = {c: b for b, c in enumerate(_byte_chars())}

        def inner(token: str) -> str:
            body, end = (token[: -len(WORD_END)], 256) if token.endswith(WORD_END) else (token, 0)
            codes = [stand_in[c] for c in body]
            codes[-1] += end
            return "".join(map(chr, codes))

        vocab = {inner(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.of_symbol = {t: i for t, i in vocab.items() if len(t) == 1}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left part, right part, rank
        for k, (a, b) in enumerate(merges):
            left, right = model["vocab"][a], model["vocab"][b]
            whole = vocab[inner(a) + inner(b)] if not a.endswith(WORD_END) else None
            if whole is None:
                raise ValueError(f"merge {k} has a word end inside")
            self.rank.setdefault((left, right), k)
            self.parts.setdefault(whole, (left, right, k))
        for whole, (left, right, k) in self.parts.items():
            if any(self.parts[x][2] >= k for x in (left, right) if x in self.parts):
                raise ValueError(f"token {whole} comes before its parts")
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            if len(text) == 1 or (i in self.parts and self._is_own(i)):
                self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.lengths = {i: len(t) for t, i in vocab.items()}
        self.kept: dict[str, tuple[str, str, int]] = {}
        self.kept_words: dict[str, list[int]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens along one edge of a token's merge tree, each with the rank that ends it."""
        out, ends = [], float("inf")
        while True:
            out.append((token, ends))
            if token not in self.parts:
                return out
            ends = self.parts[token][2]
            token = self.parts[token][side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both strings together is just these two tokens.

        A merge across the border happens if its two sides exist at its rank: each side must
        not have been merged away before. Merges of one rank go from left to right, so on
        the left the inner merge comes first and on the right the one across the border.
        """
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            known = True
            rights = self._spine(right, 0)
            for x, x_ends in self._spine(left, 1):
                for y, y_ends in rights:
                    m = self.rank.get((x, y))
                    if m is not None and m < x_ends and m <= y_ends:
                        known = False
                        break
                if not known:
                    break
            if len(self.fits) >= 1_000_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _is_own(self, token: int) -> bool:
        """Whether a token's string encodes as the token itself."""
        left, right, k = self.parts[token]
        # the two parts must stand side by side until their merge, with none across earlier
        for x, x_ends in self._spine(left, 1):
            for y, y_ends in self._spine(right, 0):
                m = self.rank.get((x, y))
                if m is not None and m < k and m < x_ends and m <= y_ends:
                    return False
        return True

    def encode_word(self, word: str) -> list[int]:
        ids = self.kept_words.get(word)
        if ids is None:
            if len(self.kept_words) >= MOST_KEPT:
                self.kept_words.clear()
            ids = self.kept_words[word] = self.by_prefixes(word)
        return ids

    def by_prefixes(self, word: str) -> list[int]:
        """Ids of one pre-token: its last token for every prefix, then back from the end."""
        raw = word.encode()
        n = len(raw)
        if not n:
            return []
        text = raw[:-1].decode("latin-1") + chr(raw[-1] + 256)
        last: dict[int, int] = {}  # for every place, the last token of the prefix that ends there
        fits, lengths = self.fits, self.lengths
        for end, (length, token) in self.automaton.iter(text):
            if end in last:
                continue
            start = end - length
            if start < 0:
                last[end] = token
                continue
            before = last.get(start)
            if before is not None:
                known = fits.get(before << 20 | token)
                if known is None:
                    known = self.compatible(before, token)
                if known:
                    last[end] = token
        ids, at = [], n - 1
        while at >= 0:
            if at not in last:
                raise ValueError(f"no encoding of {word!r}")
            ids.append(last[at])
            at -= lengths[last[at]]
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder: its strings, joined by a space."""
        return " ".join(self.tokens[i] for i in ids)

    def encoded(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids as decimal text and the decoded text, both joined by a space."""
        kept, parts = self.kept, pieces(text)
        rows = list(map(kept.get, parts))
        for i in [i for i, row in enumerate(rows) if row is None]:
            if len(kept) >= MOST_KEPT:
                kept.clear()
            ids = self.encode_piece(parts[i])
            rows[i] = kept[parts[i]] = (" ".join(map(str, ids)), self.decode(ids), len(ids))
        rows = [r for r in rows if r[2]]
        return sum([r[2] for r in rows]), " ".join([r[0] for r in rows]), " ".join([r[1] for r in rows])


class LibraryBPE(Vocabulary):
    """The same pieces and pre-tokens, with each word's ids from the tokenizers library.

    It keeps the ids of pieces and of words met before, up to ``MOST_BYTES``, and no automaton: a piece that is
    new is often a known word in other letters or beside other signs. A word is a piece of its own, so both are
    kept together, unless a special token could be taken for a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        del self.spec
        self._library = Tokenizer.from_file(path)
        self._words = self._library.model
        self._stand_ins = str.maketrans(dict(enumerate(_byte_chars())))
        self._kept: dict[str, bytes] = {}
        self._kept_words = {} if any(self._pre_tokens(x) == [x] for x in self.special) else self._kept
        self._held = 0

    def encode_word(self, word: str) -> list[int]:
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self._stand_ins)
        return [t.id for t in self._words.tokenize(word)]

    def _keep(self, table: dict[str, bytes], key: str, raw: bytes) -> None:
        self._held += 200 + 2 * len(key) + len(raw)
        if self._held > MOST_BYTES:
            self._kept.clear()
            self._kept_words.clear()
            self._held = 200 + 2 * len(key) + len(raw)
        table[key] = raw

    def _packed_word(self, word: str) -> bytes:
        raw = self._kept_words.get(word)
        if raw is None:
            raw = array("I", self.encode_word(word)).tobytes()
            self._keep(self._kept_words, word, raw)
        return raw

    def _packed_piece(self, piece: str) -> bytes:
        if piece.isascii():
            core = piece.rstrip(_SIGNS)
            if core.isalpha() and not (self._special and self._sign in piece):
                tail = piece[len(core) :]  # a run of signs is one word
                return self._packed_word(core.lower()) + (self._packed_word(tail) if tail else b"")
        if self._special and self._sign in piece and self._special.search(piece):
            return array("I", self.encode_piece(piece)).tobytes()
        return b"".join(map(self._packed_word, self._pre_tokens(piece)))

    def packed(self, text: str | None) -> list[bytes]:
        """The ids of each piece of a text, as little-endian unsigned 32-bit numbers."""
        parts, kept = pieces(text), self._kept
        out = list(map(kept.get, parts))
        for i in [i for i, raw in enumerate(out) if raw is None]:
            raw = kept.get(parts[i])
            if raw is None:
                raw = self._packed_piece(parts[i])
                if parts[i] not in kept:
                    self._keep(kept, parts[i], raw)
            out[i] = raw
        return out


_PREFIX: dict[str, PrefixBPE] = {}


def model(path: str, library: bool = False) -> Vocabulary:
    """The prefix model of a vocabulary file, read once in each Python process, or a new model by the library."""
    if library:
        return LibraryBPE(path)
    if path not in _PREFIX:
        _PREFIX[path] = PrefixBPE(path)
    return _PREFIX[path]


def encode_documents(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    ``vocab`` is the vocabulary file's path, the same on every executor.
    """
    kind = dict(df.dtypes)[id_col]
    fields = [("id", pa.string()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        ddl += ", ids array<int>, decoded string"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, out = model(vocab), Batcher(schema)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, ids, decoded = bpe.encoded(text.as_py())
                row = (key, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                more = (list(map(int, ids.split())), decoded) if with_ids else ()
                yield from out.add(row + more, 256 + (4 * n + len(decoded)) * with_ids)
        yield out.flush()

    wide = df.selectExpr(f"cast(`{id_col}` as string) as id", f"cast(`{text_col}` as string) as text").mapInArrow(run, ddl)
    return wide.selectExpr(f"cast(id as {kind}) as `{id_col}`", *wide.columns[1:])
