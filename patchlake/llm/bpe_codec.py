"""BPE encoding by longest matches with backtracking, decoding by an offset table.

A sequence of tokens is what the merges give exactly if every two neighbours
are compatible: merging their concatenation does not cross the border between
them. So the encoder takes the longest token at each place (all matches come
from one Aho-Corasick pass), checks it against the token before, tries shorter
ones if they do not fit, and steps back from places where nothing fits; such a
place is never entered again, which keeps the work linear.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patchlake.llm.common import slices

# Words and pairs that a worker holds (twice as many words with those met before); about 150 MB.
WORD_TABLE = 150_000
WORD_TABLE_CHARS = 8 << 20
PAIR_TABLE = 200_000
_END = "Ā"
_NEVER = 1 << 60


def _byte_signs() -> dict[int, str]:
    """Byte -> printable sign: printable Latin-1 stands for itself, the others follow from code point 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {b: chr(b) for b in own}
    for b in range(256):
        signs.setdefault(b, chr(256 + len(signs) - len(own)))
    return signs


@lru_cache(maxsize=2)
def codec_of(path: str) -> "Codec":
    """One codec per worker process: its tables outlive the task."""
    return Codec(path)


class Codec(dict):
    """Encoder and decoder of one tokenizer file (BPE with word ends, as ``tokenizers`` stores it).

    As a dict it holds the words met lately: word -> (number of ids, ids as
    text, decoded text, ids).
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        super().__init__()

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        if spec["decoder"] is not None or not suffix:
            raise ValueError("only word-end BPE files without a decoder are read")
        vocab: dict[str, int] = model["vocab"]
        back = {s: chr(b) for b, s in _byte_signs().items()}

        def symbols(token: str) -> str:
            ends = token.endswith(suffix)
            return "".join(back[c] for c in token.removesuffix(suffix)) + _END * ends

        # Matches are (length, token); shorter[token] is the longest token that is a proper prefix of it.
        self.automaton = ahocorasick.Automaton()
        forms = {symbols(token): i for token, i in vocab.items()}
        for form, i in forms.items():
            self.automaton.add_word(form, (len(form), i))
        self.automaton.make_automaton()
        self.shorter: list[tuple[int, int] | None] = [None] * (max(vocab.values()) + 1)
        for form, i in forms.items():
            length = next((k for k in range(len(form) - 1, 0, -1) if form[:k] in forms), 0)
            self.shorter[i] = (length, forms[form[:length]]) if length else None
        # Ranks of merges by pair of ids, and the two parts of every merged token.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, rank)
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = pair, rank
        self.spines: tuple[dict, dict] = ({}, {})
        self.fits: dict[tuple[int, int], bool] = {}
        # Decoding: all token strings in one pool, token i from offset i to offset i + 1.
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.pool = "".join(strings.get(i, "") for i in range(max(strings) + 1))
        self.offsets = [0]
        for i in range(max(strings) + 1):
            self.offsets.append(self.offsets[-1] + len(strings.get(i, "")))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.pretoken = regex.compile(
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        )
        self.decimal = [str(i) for i in range(max(strings) + 1)]
        self.older: dict[str, tuple] = {}
        self.held = 0

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank of the merge that ends it) along the right (1) or left (0) edge, smallest part first."""
        known = self.spines[side].get(token)
        if known is None:
            chain, part, until = [], token, _NEVER
            while True:
                chain.append((part, until))
                if part not in self.parts:
                    break
                until = self.born[part]
                part = self.parts[part][side]
            known = self.spines[side][token] = chain[::-1]
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of both leaves the border between them alone.

        The parts that touch the border change with time: the one that is merged
        away first gives way to the next. A merge across happens if it comes
        before both parts are gone; of equal ranks the left one happens first.
        """
        known = self.fits.get((a, b))
        if known is not None:
            return known
        right, left = self.spine(a, 1), self.spine(b, 0)
        i = j = 0
        fits = True
        while True:
            (x, x_until), (y, y_until) = right[i], left[j]
            rank = self.rank.get((x, y), _NEVER)
            if rank < x_until and rank <= y_until and rank != _NEVER:
                fits = False
                break
            if x_until == y_until == _NEVER:
                break
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        if len(self.fits) >= PAIR_TABLE:
            self.fits.clear()
        self.fits[a, b] = fits
        return fits

    def encode_symbols(self, symbols: str) -> list[int]:
        """Ids of one word, given as byte symbols and the end mark."""
        n, fits, shorter = len(symbols), self.fits, self.shorter
        longest: list[tuple[int, int] | None] = [None] * (n + 1)
        for end, match in self.automaton.iter(symbols):
            longest[end - match[0] + 1] = match
        dead = bytearray(n + 1)
        out: list[tuple[int, int]] = []
        place, match, last = 0, longest[0], -1
        while place < n:
            while match is not None:
                if not dead[place + match[0]]:
                    fit = True if last < 0 else fits.get((last, match[1]))
                    if fit or fit is None and self.compatible(last, match[1]):
                        break
                match = shorter[match[1]]
            if match is not None:
                out.append(match)
                place, last = place + match[0], match[1]
                match = longest[place]
                continue
            dead[place] = 1
            if not out:
                raise ValueError("no exact encoding")
            length, token = out.pop()
            place, last = place - length, out[-1][1] if out else -1
            match = shorter[token]
        return [token for _, token in out]

    def __missing__(self, word: str) -> tuple[int, str, str, tuple[int, ...]]:
        if len(self) >= WORD_TABLE or self.held >= WORD_TABLE_CHARS:
            self.older = dict(self)
            self.clear()
            self.held = 0
        entry = self.older.get(word)
        if entry is None:
            ids = self.encode_symbols(word.encode("utf-8", "surrogatepass").decode("latin-1") + _END)
            entry = (len(ids), " ".join([self.decimal[i] for i in ids]), self.decode(ids), tuple(ids))
        self[word] = entry
        self.held += len(word)
        return entry

    def decode(self, ids) -> str:
        """Token strings joined by one space, read from the pool by offset."""
        pool, offsets = self.pool, self.offsets
        return " ".join([pool[offsets[i] : offsets[i + 1]] for i in ids])

    def normalise(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # Lower case goes character by character, so the final sigma has no form of its own.
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def encode(self, text: str | None) -> list[tuple[int, str, str, tuple[int, ...]]]:
        """The entries of the words of a text; special strings are tokens of their own."""
        if not text:
            return []
        found: list = []
        for piece in self.split_special.split(text) if "<|" in text else (text,):
            if piece in self.special:
                i = self.special[piece]
                found.append((1, str(i), piece, (i,)))
            else:
                found += map(self.__getitem__, self.pretoken.findall(self.normalise(piece)))
        return found


_FIELDS = {
    "n_tokens": ("bigint", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def encode_documents(
    docs: DataFrame, path: str, outputs: list[str], doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id and the wanted ``outputs`` of every row, repeated ones too.

    Outputs: n_tokens, ids, decoded (the text that decoding the ids gives) and
    the digests ids_sha256 (decimal ids joined by one space) and decoded_sha256.
    Null and empty texts have no ids and decode to the empty text. ``path`` names
    the tokenizer file on every executor. One narrow pass, no shuffle.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        makers = {
            "n_tokens": lambda words: sum([w[0] for w in words]),
            "ids": lambda words: [i for w in words for i in w[3]],
            "decoded": lambda words: " ".join([w[2] for w in words]),
            "ids_sha256": lambda words: sha(" ".join([w[1] for w in words])),
            "decoded_sha256": lambda words: sha(" ".join([w[2] for w in words])),
        }
        schema = pa.schema([("doc_id", pa.int64()), *((o, _FIELDS[o][1]) for o in outputs)])
        for batch in slices(batches):
            columns: list[list] = [[] for _ in outputs]
            for value in batch.column(1).to_pylist():
                words = codec.encode(value)
                for column, name in zip(columns, outputs):
                    column.append(makers[name](words))
            arrays = [pa.array(c, _FIELDS[o][1]) for c, o in zip(columns, outputs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=schema)

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(encode, ", ".join(["doc_id bigint", *(f"{o} {_FIELDS[o][0]}" for o in outputs)]))
