"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Whatever comes later, only the last few tokens of a word's prefix can still change. A token is final
once it belongs to the encodings of all of the word's last prefixes, as far back as the longest token
reaches: the encoding of the finished word must pass through one of them. That reach is the
lookahead, computed from the merge list, so a word of any length is encoded in memory that does not
grow with it. All words go that way; those met before are remembered. Texts are taken in segments,
ids and decoded text leave as they come. Decoding from bytes likewise keeps at most the bytes of one
unfinished character.

The encoding of each prefix is found from those before it: its last token is the one whose
predecessor, the last token of the prefix before it, stays apart from it under the merges.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.llm.common import KEPT, lean, slices, table

#: Strings whose tokens are kept at hand (of each of two generations), and the longest such string.
MEMORY, MEMORY_CHARS = 500_000, 64
#: Symbols of a word taken at once, and characters of a text, or more up to white space.
PIECE, SEGMENT = 1024, 1 << 16
_SPACE = regex.compile(r"[ \t\n\v\f\r]")
TOKENIZER = "word_bpe_49k.json"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, all others in order for the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    stands = {b: chr(b) for b in own}
    return [stands[b] if b in stands else chr(next(others)) for b in range(256)]


class Merges:
    """A merge list: pairs of symbols by rank, and what is known of each token from it."""

    def __init__(self, merges: Iterable[tuple[str, str]], vocab: dict[str, int], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.alphabet = byte_alphabet()
        self.text_of = {i: t for t, i in vocab.items()}
        #: symbols in the longest token; how far back a prefix's last token can begin
        self.lookahead = max((len(self.body(t)) for t in vocab), default=1)
        #: ids of the tokens that the merges make, by their symbols: those within a word, and those that end it
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for token, i in vocab.items():
            body = self.body(token)
            if body and self.merge(self.symbols(token)) == [token]:
                (self.inner if len(body) == len(token) else self.final)[body] = i
        if not suffix:
            self.final = self.inner
        #: lengths of these tokens, long ones first, by their last two symbols
        self.inner_sizes, self.final_sizes = self._sizes(self.inner), self._sizes(self.final)
        self._apart: dict[int, bool] = {}

    @staticmethod
    def _sizes(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
        sizes: dict[str, set[int]] = {}
        for body in tokens:
            if len(body) > 1:
                sizes.setdefault(body[-2:], set()).add(len(body))
        return {end: tuple(sorted(own, reverse=True)) for end, own in sizes.items()}

    def body(self, token: str) -> str:
        """A token's symbols as characters, without the word's end."""
        return token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token

    def symbols(self, token: str) -> list[str]:
        """A token's symbols: single characters, the last with the word's end if it has one."""
        body = self.body(token)
        return [*body[:-1], body[-1] + self.suffix] if len(body) < len(token) and body else list(token)

    def merge(self, symbols: list[str]) -> list[str]:
        """The merges applied to a few symbols: always the lowest rank, the leftmost of its pairs."""
        symbols, rank_of, never = symbols[:], self.rank.get, len(self.rank)
        ranks = [rank_of(pair, never) for pair in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]  # only the two pairs beside the new symbol are others now
            if i:
                ranks[i - 1] = rank_of((symbols[i - 1], symbols[i]), never)
            if i < len(ranks):
                ranks[i] = rank_of((symbols[i], symbols[i + 1]), never)
        return symbols

    def apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens as they are when they meet."""
        key = left << 32 | right
        known = self._apart.get(key)
        if known is None:
            a, b = self.text_of[left], self.text_of[right]
            known = self.merge(self.symbols(a) + self.symbols(b)) == [a, b]
            if len(self._apart) >= MEMORY:
                self._apart.clear()
            self._apart[key] = known
        return known


class WordEncoder:
    """Ids of one word's tokens from its symbols as they come; feed() returns those that have become
    final. A prefix's last token is the one whose predecessor, the last token of the prefix before it,
    stays apart from it."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.text = ""  # symbols that are not in tokens returned, and the last token returned before them
        #: for each prefix that ends at symbol i + 1 here: its last token and that token's length
        self.last: list[int] = []
        self.size: list[int] = []

    def feed(self, symbols: str) -> list[int]:
        """More symbols, of which none is the word's last."""
        out = []
        for i in range(0, len(symbols), PIECE):
            self._extend(symbols[i : i + PIECE], self.merges.inner, self.merges.inner_sizes)
            if len(self.text) > 2 * self.merges.lookahead:
                out += self._settle()
        return out

    def finish(self, symbol: str) -> list[int]:
        """The word's last symbol; all that is left is final."""
        self._extend(symbol, self.merges.final, self.merges.final_sizes)
        out = self._path(len(self.text))
        self.text, self.last, self.size = "", [], []
        return out

    def _extend(self, symbols: str, tokens: dict[str, int], sizes: dict[str, tuple[int, ...]]) -> None:
        text, last, lengths, apart = self.text + symbols, self.last, self.size, self.merges.apart
        known = self.merges._apart.get
        for n in range(len(self.text) + 1, len(text) + 1):
            for size in sizes.get(text[n - 2 : n], ()) if n > 1 else ():
                if size <= n and (token := tokens.get(text[n - size : n])) is not None:
                    if size == n:
                        break
                    left = last[n - size - 1]
                    fits = known(left << 32 | token)
                    if fits or (fits is None and apart(left, token)):
                        break
            else:
                size, token = 1, tokens.get(text[n - 1])
                if token is None:
                    raise ValueError(f"no token for {text[n - 1]!r}")
            last.append(token)
            lengths.append(size)
        self.text = text

    def _path(self, end: int) -> list[int]:
        out = []
        while end:
            out.append(self.last[end - 1])
            end -= self.size[end - 1]
        return out[::-1]

    def _settle(self) -> list[int]:
        """The tokens that all prefixes within the lookahead have in common; all but the last of them
        leave the buffer, as the next token's neighbour must stay known."""
        n, reach = len(self.text), self.merges.lookahead
        paths = [self._path(end) for end in range(n - reach + 1, n + 1)]
        common = 0
        while all(len(p) > common and p[common] == paths[0][common] for p in paths):
            common += 1
        final = paths[0][: max(0, common - 1)]
        size = sum(len(self.merges.text_of[t]) for t in final)  # none of them ends the word
        self.text, self.last, self.size = self.text[size:], self.last[size:], self.size[size:]
        return final


class Memory:
    """Ids of strings met lately, in two generations: a full one becomes the older one, whose strings
    come back when they are met again. So frequent strings stay at hand and memory is bounded."""

    def __init__(self, make):
        self.make, self.recent, self.older = make, {}, {}

    def fetch(self, key: str) -> bytes:
        ids = self.recent.get(key)
        if ids is None:
            ids = self.older.get(key)
            if ids is None:
                ids = self.make(key)
            if len(key) <= MEMORY_CHARS:
                if len(self.recent) >= MEMORY:
                    self.older = self.recent.copy()
                    self.recent.clear()  # stays the same object, for loops that hold on to it
                self.recent[key] = ids
        return ids


@dataclass
class Tokenizer:
    """Encoder and decoder for a tokenizer file with NFC, white space, lower case, a splitting
    pattern, byte-level symbols and a word-end suffix."""

    merges: Merges
    pattern: regex.Pattern
    special: dict[str, int]

    def __post_init__(self):
        self.texts = self.merges.text_of | {i: t for t, i in self.special.items()}
        self.by_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.encoder = WordEncoder(self.merges)
        # of each byte its symbol, where that is another character
        self._symbols = {b: c for b, c in enumerate(self.merges.alphabet) if ord(c) != b}
        self._chunks = Memory(self._chunk)

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        """Read a tokenizer file; one built of other parts than these is refused."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        plain = (split["type"], split["behavior"], split["invert"], level["type"], level["use_regex"]) == ("Split", "Removed", True, "ByteLevel", False)
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or not plain or spec["post_processor"] or spec["decoder"]:
            raise ValueError(f"{path} is not a tokenizer of this kind")
        merges = Merges([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["vocab"], model["end_of_word_suffix"] or "")
        return cls(merges, regex.compile(split["pattern"]["Regex"]), {x["content"]: x["id"] for x in spec["added_tokens"]})

    def word(self, word: str) -> list[int]:
        """Ids of one word, by the transducer."""
        symbols = word.encode().decode("latin-1").translate(self._symbols)
        return self.encoder.feed(symbols[:-1]) + self.encoder.finish(symbols[-1])

    def stream(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text, part by part; what is held besides the text is a segment and what is known of
        words met lately."""
        for piece, special in self._pieces(text):
            out: list[bytes] = []
            for segment in segments(piece):
                segment = normal(segment)
                for space in "\t\n\v\f\r":
                    segment = segment.replace(space, " ")
                # no word crosses white space; of that, only what is so beyond doubt is split at here
                recent = self._chunks.recent.get
                for chunk in segment.split(" "):
                    out.append(recent(chunk) or self._chunks.fetch(chunk))
                yield np.frombuffer(b"".join(out), "<u4")
                out = []
            if special is not None:
                yield np.array([special], "<u4")

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([*self.stream(text), np.zeros(0, "<u4")])

    def _chunk(self, chunk: str) -> bytes:
        words = self.pattern.findall(chunk)
        if words == [chunk]:
            ids = self.word(chunk)
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join([self._chunks.fetch(w) for w in words])

    def _pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Parts of the text, each with the special token that follows it."""
        at = 0
        if self.special and any(t in text for t in self.special):
            for m in self.by_special.finditer(text):
                yield text[at : m.start()], self.special[m[0]]
                at = m.end()
        yield text[at:], None

    def decoder(self) -> TokenJoiner:
        return TokenJoiner(self.texts)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' own texts between spaces: what a file without a decoder stands for."""
        return self.decoder().feed(ids)

    def decode_text(self, ids: np.ndarray) -> str:
        """Readable text: words between spaces, bytes back to characters."""
        machine = TextDecoder(self.merges.alphabet, self.merges.suffix)
        return ("".join(machine.feed(self.texts[i]) for i in np.asarray(ids).tolist()) + machine.finish()).strip(" ")


def normal(text: str) -> str:
    """NFC and lower case, character by character: without the final form of sigma."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def segments(text: str, least: int = SEGMENT) -> Iterator[str]:
    """Parts of a text of `least` characters or more, cut before white space."""
    at = 0
    while len(text) - at > least and (m := _SPACE.search(text, at + least)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class TokenJoiner:
    """Decoding for a file without a decoder: the tokens' own texts between spaces. Its state is whether a
    token has come."""

    def __init__(self, texts: dict[int, str]):
        self.texts, self.begun = texts, False

    def feed(self, ids: np.ndarray) -> str:
        out = " ".join([self.texts[i] for i in np.asarray(ids).tolist()])
        out, self.begun = (" " + out if self.begun and len(ids) else out), self.begun or len(ids) > 0
        return out


class TextDecoder:
    """A state machine from byte-level tokens to text. Its state is the bytes of an unfinished
    character, three at most; what cannot become a character turns into U+FFFD."""

    def __init__(self, alphabet: list[str], suffix: str = ""):
        import codecs

        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.suffix = suffix
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, token: str) -> str:
        """The text that is certain after this token."""
        end = bool(self.suffix) and token.endswith(self.suffix)
        body = token[: -len(self.suffix)] if end else token
        if any(c not in self.byte_of for c in body):  # a special token
            return self.machine.decode(b"", True) + token
        return self.machine.decode(bytes(self.byte_of[c] for c in body), end) + " " * end

    def finish(self) -> str:
        return self.machine.decode(b"", True)


#: What tokenize() can return besides n_tokens, and its type.
OUTPUTS = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> Tokenizer:
    """A worker's tokenizer: the file is read, and words met are remembered, for all its tasks."""
    return Tokenizer.load(path)


def _let_go() -> bool:
    held = _loaded.cache_info().currsize > 0
    _loaded.cache_clear()
    return held


KEPT["bpe"] = _let_go


def tokenize(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), outputs: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """A row for each row of docs: id, the columns in keep, n_tokens and the outputs: ids, the text
    decoded from them, or either's SHA-256 (of the ids as little-endian unsigned 32-bit integers).

    A null text counts as empty and has no tokens. Repeated rows come out alike, a very long text is
    streamed, and an empty table gives an empty table. The tokenizer file is read where it is used, from
    the given path, which every machine has. Nothing is shuffled."""

    def one(tokenizer: Tokenizer, text: str) -> tuple:
        n, shas, kept, decoder = 0, {x: hashlib.sha256() for x in ("ids_sha256", "decoded_sha256") if x in outputs}, {"ids": [], "decoded": []}, tokenizer.decoder()
        for ids in tokenizer.stream(text):
            n += len(ids)
            if "ids_sha256" in shas:
                shas["ids_sha256"].update(ids)
            if "ids" in outputs:
                kept["ids"].append(ids)
            if {"decoded", "decoded_sha256"} & set(outputs):
                decoded = decoder.feed(ids)
                if "decoded_sha256" in shas:
                    shas["decoded_sha256"].update(decoded.encode())
                if "decoded" in outputs:
                    kept["decoded"].append(decoded)
        made = {"decoded": "".join(kept["decoded"])} | {x: sha.hexdigest() for x, sha in shas.items()}
        if "ids" in outputs:
            made["ids"] = np.concatenate([*kept["ids"], np.zeros(0, "<u4")]).astype(np.int32)
        return n, *[made[x] for x in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean("bpe")
        tokenizer = _loaded(path)
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                found = [one(tokenizer, text.as_py() or "") for text in part.column("_text")]
                made = [pa.array(column, kind) for column, kind in zip(zip(*found, strict=True), (pa.int64(), *[OUTPUTS[x] for x in outputs]), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *made], names=[*names, "n_tokens", *outputs])

    names = [id_col, *keep]
    picked = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    kinds += ["n_tokens long", *[f"{x} {'array<int>' if x == 'ids' else 'string'}" for x in outputs]]
    return picked.mapInArrow(run, ", ".join(kinds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), outputs=("ids_sha256", "decoded_sha256"))
