"""BPE encoding and decoding by a prefix-sharing trie.

The last token of the encoding of a prefix fixes that whole encoding: drop the token, and the rest is the encoding of a
shorter prefix. So each trie node keeps one last token; a depth-first walk finds it from those of the node's ancestors,
once for all words that share the prefix. Sorted words are the walk's order, and the common prefix with the word
before is the part of the stack that stays.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import json
import re
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import string_array

#: The pre-tokenizer's pattern of byte-level BPE files of this kind (a fixed value of the public tokenizers).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Memory bounds of a worker: entries of the caches, which are emptied when full; results do not depend on them.
MOST_WORDS, MOST_PAIRS, MOST_STATES = 400_000, 500_000, 500_000


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes sets of words to lists of token ids; one per worker. Words and tokens are strings of symbols below 512."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[int, int]]):
        self.ids = vocab
        token = {i: t for t, i in vocab.items()}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            made = vocab[token[a] + token[b]]
            self.pairs.setdefault((a, b), r)
            if made not in self.parts:
                self.rank[made], self.parts[made] = r, (a, b)
        usable = {t: i for t, i in vocab.items() if len(t) == 1 or i in self.parts}
        self.heads = {t[:n] for t in usable for n in range(len(t) + 1)}
        self.usable = usable
        self.agreed: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        """States: of a prefix, its longest suffix that begins some token, and the last tokens of the prefixes that end in that suffix.

        That is all that later tokens depend on, so a step is worked out once for each state and symbol.
        """
        self.states: dict[tuple, int] = {("", (-1,)): 0}
        self.names: list[tuple[str, tuple[int, ...]]] = [("", (-1,))]
        self.moves: dict[int, tuple[int, int, int]] = {}

    def _move(self, state: int, symbol: str) -> tuple[int, int, int]:
        """The next state, the last token there, and its length."""
        suffix, lasts = self.names[state]
        s = suffix + symbol
        for k in range(len(s)):
            token = self.usable.get(s[k:])
            if token is None:
                continue
            left = lasts[k]
            if left >= 0:
                p = left << 20 | token
                if p not in self.agreed:
                    if len(self.agreed) > MOST_PAIRS:
                        self.agreed.clear()
                    self.agreed[p] = self._agree(left, token)
                if not self.agreed[p]:
                    continue
            break
        else:
            raise ValueError(f"the vocabulary has no token for symbol {symbol!r}")
        size, cut = len(s) - k, 0
        while s[cut:] not in self.heads:
            cut += 1
        name = (s[cut:], (*lasts[cut:], token))
        to = self.states.get(name)
        if to is None:
            to = self.states[name] = len(self.names)
            self.names.append(name)
        made = self.moves[state << 9 | ord(symbol)] = (to, token, size)
        return made

    def _agree(self, x: int, y: int) -> bool:
        """Whether x and y can stand side by side: no merge across the border comes before those that made them.

        Undoes the later of the two last merges again and again. A merge across the border at an earlier rank than the
        one undone would have come first; at the same rank, the one further left comes first.
        """
        limit = 1 << 60
        while True:
            if self.pairs.get((x, y), limit) < limit:
                return False
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                limit, x = rx, self.parts[x][1]
            else:
                limit, y = ry + 1, self.parts[y][0]

    def encode(self, words) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        if len(self.names) > MOST_STATES:
            self._forget()
        moves = self.moves
        before = ""
        stack = [(0, -1, 0)]  # of each prefix its state, its last token and that token's length
        for word in sorted(words):
            n = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                n += 1
            del stack[n + 1 :]
            step = stack[n]
            for symbol in word[n:]:
                step = moves.get(step[0] << 9 | ord(symbol)) or self._move(step[0], symbol)
                stack.append(step)
            ids, at = [], len(word)
            while at:
                _, token, size = stack[at]
                ids.append(token)
                at -= size
            ids.reverse()
            out[word] = ids
            before = word
        return out


class ByteBpe:
    """A byte-level tokenizer file: encodes as the library does without post-processing, and decodes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        to_bytes = lambda t: "".join(chr(letters[c]) for c in t)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {to_bytes(t): i for t, i in model["vocab"].items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.trie = TrieEncoder(vocab, [(vocab[to_bytes(a)], vocab[to_bytes(b)]) for a, b in pairs])
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = special
        self.at_special = regex.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in [*((t.encode("latin-1"), i) for t, i in vocab.items()), *((s.encode(), i) for s, i in special.items())]:
            self.tokens[i] = t
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before the last time that the cache was full
        self.odd = re.compile(r"\s\s").search
        self.unlike = re.compile("[\x1c-\x1f᠎]").search  # white space to some libraries only
        self.far = re.compile("[^\x00-ɏ]").search

    def _pieces(self, chunk: str) -> list[str]:
        """Pre-tokens. Beyond Latin letters the library splits, as versions of Unicode differ."""
        if self.far(chunk):
            return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        return self.split(chunk)

    def chunks(self, text: str) -> list[str]:
        """Parts whose encodings in a row are the text's: cut before single spaces between other characters."""
        if self.odd(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]

    def learn(self, chunks) -> None:
        """Encodes those chunks that are not known yet, by one walk over the trie of their pre-tokens."""
        new = [c for c in set(chunks) if c not in self.known]
        if len(self.known) + len(new) > MOST_WORDS:
            self.older, self.known, new = self.known, {}, list(set(chunks))
        self.known.update((c, self.older[c]) for c in new if c in self.older)
        new = [c for c in new if c not in self.known]
        pieces = [[p.encode().decode("latin-1") for p in self._pieces(c)] for c in new]
        codes = self.trie.encode({p for x in pieces for p in x})
        packed = {p: array("I", ids).tobytes() for p, ids in codes.items()}
        self.known.update(zip(new, (b"".join([packed[p] for p in x]) for x in pieces), strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(texts)
        parts: list[list] = []
        step: set[str] = set()
        begun = 0

        def flush(upto: int) -> None:
            nonlocal parts, step, begun
            self.learn(step)
            for i, segments in zip(range(begun, upto), parts, strict=True):
                if segments is not None:
                    out[i] = b"".join([x if type(x) is bytes else b"".join(map(self.known.__getitem__, x)) for x in segments])
            parts, step, begun = [], set(), upto

        for i, text in enumerate(texts):
            if self.unlike(text):
                out[i] = array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
                parts.append(None)
                continue
            segments = []
            for s in self.at_special.split(text) if self.at_special else [text]:
                if s in self.special:
                    segments.append(array("I", [self.special[s]]).tobytes())
                elif s:
                    segments.append(self.chunks(s))
                    step.update(segments[-1])
            parts.append(segments)
            if len(step) > MOST_WORDS // 3:
                flush(i + 1)
        flush(len(texts))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, array("I", ids))).decode("utf-8", "replace")


_coders: dict[str, ByteBpe] = {}


def byte_coder(path: str) -> ByteBpe:
    """The process's own coder: what it has learnt serves all tasks of a worker."""
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]


@contextlib.contextmanager
def no_collection():
    """Without cycle collection, which would walk the large caches again and again and finds nothing in them."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids (array<long>) and decoded, of every whole text.

    Null texts count as empty and give no tokens. Special tokens' strings in a text are special tokens, as in the
    library's default. Rows are encoded alone: repeated rows repeat; other columns are ignored. path is read on each
    machine, where the vocabulary is installed. A worker holds its caches (bounded above) and one batch.
    """

    def work(batches):
        coder = byte_coder(path)
        for b in batches:
            texts = string_array(b.column("text")).to_pylist()
            for at in range(0, len(texts), 2000):
                part = texts[at : at + 2000]
                with no_collection():
                    ids = coder.encode_batch(part)
                    back = [coder.decode(x) for x in ids]
                cols = [
                    b.column("doc_id").slice(at, len(part)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                ]
                if with_ids:
                    cols += [pa.array([array("I", x).tolist() for x in ids], pa.list_(pa.int64())), pa.array(back)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids)
