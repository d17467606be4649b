"""Byte-pair encoding and decoding of whole texts with a public vocabulary.

A text is normalised, cut into words and each word into pieces; a piece starts as one token a
byte.  Every piece has a segment tree over the merge ranks of its adjacent tokens.  The root
holds the lowest rank, the way down that prefers the left child leads to its leftmost place,
and a merge changes three leaves, so it costs a logarithmic number of steps; the piece is done
when the root holds no rank.  Short pieces of equal tree size form a forest in one array and
merge side by side; a long piece has a tree of its own.

Words repeat, so each worker keeps the ids of those it has met, up to KEPT_WORDS.

Defined cases: a null text is empty and has no ids; ids outside the vocabulary decode to
nothing; rows, ties and further columns are kept as they are; an empty table stays empty.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .shared import table, whole_text

VOCABULARY = "word_bpe_49k.json"
KEPT_WORDS = 1 << 18
# Characters cut into words at once.
PIECE = 1 << 21
# Rows passed on at once.
ROWS_AT_ONCE = 1000
# Pieces whose tree has more leaves than this get one of their own.
FOREST_LEAVES = 256
FOREST_CELLS = 1 << 20
NO_RANK = np.int32(2**31 - 1)
KEY_BITS = 20

# Fixed by the vocabulary file.
WORD_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"
# Python's split() takes these for white space, the vocabulary's pattern doesn't.
SEPARATORS = regex.compile("[\x1c-\x1f]")
UNSPACED = regex.compile(r"\S+")
SPACE = regex.compile(r"\s")


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of all given ranges, one range after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(moved)}
    return [letters[b] for b in range(256)]


def lowered(text: str) -> str:
    """NFC and lower case, one character at a time as the vocabulary wants it."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def cut(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about the given size that end at white space."""
    start = 0
    while len(text) - start > size:
        found = SPACE.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class Vocabulary:
    """Tokens, merges and the words met so far."""

    def __init__(self, file: str) -> None:
        known = json.loads(file)
        self.library = Tokenizer.from_str(file)
        model = known["model"]
        ids: dict[str, int] = dict(model["vocab"])
        added = {t["content"]: t["id"] for t in known["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *added.values()]) + 1)
        for token, number in (ids | added).items():
            self.tokens[number] = token
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.final = np.array([ids[c + WORD_END] for c in letters], np.int32)
        pairs = np.array([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]], np.int64)
        keys = pairs[:, 0] << KEY_BITS | pairs[:, 1]
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.rank_of: dict[int, int] | None = None
        self.merged = pairs[:, 2].astype(np.int32)
        self.added = added
        self.specials = regex.compile("|".join(regex.escape(t) for t in added)) if added else None
        self.nothing = len(self.tokens)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of token pairs, NO_RANK where they don't merge."""
        wanted = left.astype(np.int64) << KEY_BITS | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], NO_RANK)

    def _forest(self, tokens: np.ndarray) -> None:
        """Merge pieces side by side, in place.

        A row holds a piece, filled up with NOTHING to one more than a power of two and one
        further place that stands behind every piece.  Links lead from a token to its neighbours.
        """
        many, wide = tokens.shape
        leaves = wide - 2
        levels = leaves.bit_length() - 1
        after = np.tile(np.arange(1, wide + 1, dtype=np.int32), (many, 1))
        after[:, -1] = wide - 1
        before = np.tile(np.arange(-1, wide - 1, dtype=np.int32), (many, 1))
        tree = np.full((many, 2 * leaves), NO_RANK, np.int32)
        tree[:, leaves:] = self.ranks(tokens[:, :leaves], tokens[:, 1 : leaves + 1])
        for node in range(leaves - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        # All rows in one line, each with the place where its part begins.
        tokens, after, before, tree = tokens.reshape(-1), after.reshape(-1), before.reshape(-1), tree.reshape(-1)
        rows = np.flatnonzero(tree[1 :: 2 * leaves] != NO_RANK)
        while len(rows):
            cells, nodes = rows * wide, rows * (2 * leaves)
            best = tree[nodes + 1]
            node = np.ones(len(rows), np.int64)
            for _ in range(levels):
                node *= 2
                node += tree[nodes + node] != best
            left = cells + (node - leaves)
            right = cells + after[left]
            beyond = cells + after[right]
            token = self.merged[best]
            tokens[left] = token
            tokens[right] = self.nothing
            after[left] = after[right]
            before[beyond] = node - leaves
            ahead = before[left]
            has = np.flatnonzero(ahead >= 0)
            gone = right - cells
            inside = np.flatnonzero(gone < leaves)
            at_left = nodes + node
            at_right = (nodes + leaves + gone)[inside]
            at_ahead = (nodes + leaves + ahead)[has]
            tree[at_left] = self.ranks(token, tokens[beyond])
            tree[at_right] = NO_RANK
            tree[at_ahead] = self.ranks(tokens[(cells + ahead)[has]], token[has])
            start = np.concatenate([nodes, nodes[inside], nodes[has]])
            changed = np.concatenate([at_left, at_right, at_ahead]) - start
            for _ in range(levels):
                changed >>= 1
                child = start + 2 * changed
                tree[start + changed] = np.minimum(tree[child], tree[child + 1])
            rows = rows[tree[nodes + 1] != NO_RANK]

    def _alone(self, piece: np.ndarray) -> np.ndarray:
        """Merge one long piece."""
        if self.rank_of is None:
            self.rank_of = dict(zip(self.keys.tolist(), self.order.tolist(), strict=True))
        rank_of = self.rank_of
        none, size = int(NO_RANK), len(piece)
        leaves = 1 << (size - 1).bit_length()
        tokens = piece.tolist()
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        tree = [none] * (2 * leaves)
        tree[leaves : leaves + size - 1] = self.ranks(piece[:-1], piece[1:]).tolist()
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, rank: int) -> None:
            node = leaves + leaf
            tree[node] = rank
            while node > 1:
                node >>= 1
                lowest = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == lowest:
                    break
                tree[node] = lowest

        while (best := tree[1]) != none:
            node = 1
            while node < leaves:
                node = 2 * node if tree[2 * node] == best else 2 * node + 1
            left = node - leaves
            right = after[left]
            beyond = after[right]
            tokens[left], tokens[right] = int(self.merged[best]), -1
            after[left] = beyond
            put(right, none)
            if beyond < size:
                before[beyond] = left
                put(left, rank_of.get(tokens[left] << KEY_BITS | tokens[beyond], none))
            else:
                put(left, none)
            if (ahead := before[left]) >= 0:
                put(ahead, rank_of.get(tokens[ahead] << KEY_BITS | tokens[left], none))
        return np.array([t for t in tokens if t >= 0], np.int32)

    def split(self, word: str) -> list[bytes]:
        """Pieces of a raw word.

        Characters that this Python's Unicode tables don't have are left to the vocabulary's
        library, so that both see the same letters.
        """
        normal = lowered(word)
        if normal.isalpha():
            return [normal.encode()]
        if not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word):
            normal = self.library.normalizer.normalize_str(word)
            found = self.library.pre_tokenizer.pre_tokenize_str(normal)
            return [bytes(map(self.byte_of.__getitem__, letters)) for letters, _ in found]
        return [piece.encode() for piece in WORD_PIECE.findall(normal)]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all pieces in one array, and where each piece's start and how many they are."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        first = self.inner[data]
        first[ends - 1] = self.final[data[ends - 1]]
        starts, many = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        found: list[np.ndarray] = []
        total = 0
        # The power of two that holds a piece's pairs.
        leaves_of = 1 << np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(np.int64)
        for leaves in np.unique(leaves_of).tolist():
            members = np.flatnonzero(leaves_of == leaves)
            if leaves > FOREST_LEAVES:
                groups = [(members[k : k + 1], None) for k in range(len(members))]
            else:
                step = max(1, FOREST_CELLS // leaves)
                groups = [(members[k : k + step], leaves) for k in range(0, len(members), step)]
            for group, wide in groups:
                if wide is None:
                    at = group[0]
                    ids = self._alone(first[ends[at] - sizes[at] : ends[at]])
                    counts = np.array([len(ids)])
                else:
                    places = np.arange(wide + 2)
                    within = places < sizes[group, None]
                    tokens = np.full(within.shape, self.nothing, np.int32)
                    tokens[within] = first[((ends - sizes)[group, None] + places)[within]]
                    self._forest(tokens)
                    left = tokens != self.nothing
                    counts, ids = left.sum(axis=1), tokens[left]
                many[group] = counts
                starts[group] = total + np.cumsum(counts) - counts
                total += len(ids)
                found.append(ids)
        return np.concatenate(found) if found else first, starts, many

    def learn(self, words: Iterable[str]) -> None:
        """Find the ids of words that aren't kept yet."""
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if not new:
            return
        numbers: dict[bytes, int] = {}
        of_word: list[int] = []
        in_word: list[int] = []
        added: list[tuple[int, int]] = []
        for at, word in enumerate(new):
            # A marked word, which begins with a space, is an added token.
            pieces = () if word[0] == " " else self.split(word)
            if word[0] == " ":
                added.append((at, self.added[word[1:]]))
            for piece in pieces:
                of_word.append(numbers.setdefault(piece, len(numbers)))
            in_word.append(len(pieces))
        flat, starts, many = self.merge(list(numbers))
        pieces_of, counts = np.array(of_word, np.int64), np.array(in_word, np.int64)
        ids = spread(flat, starts[pieces_of], many[pieces_of])
        upto = np.concatenate([[0], np.cumsum(many[pieces_of])])
        ends = np.cumsum(counts)
        sizes = upto[ends] - upto[ends - counts]
        starts = len(self.flat) + upto[ends - counts]
        first, base = len(self.place), len(self.flat) + len(ids)
        for number, (at, _) in enumerate(added):
            starts[at], sizes[at] = base + number, 1
        self.place.update(zip(new, range(first, first + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, starts])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids, np.array([t for _, t in added], np.int32)])

    def words(self, text: str) -> list[str]:
        """Words of a piece of text, added tokens among them marked by a space."""
        if self.specials is not None and "<" in text:
            found, start = [], 0
            for special in self.specials.finditer(text):
                found += self._plain(text[start : special.start()])
                found.append(" " + special.group())
                start = special.end()
            return found + self._plain(text[start:])
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        return UNSPACED.findall(text) if SEPARATORS.search(text) else text.split()

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each word has."""
        if len(self.place) > KEPT_WORDS:
            self.forget()
        self.learn(words)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return spread(self.flat, self.starts[at], self.sizes[at]), self.sizes[at]

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's end."""
        ids: list[np.ndarray] = []
        ends: list[int] = []
        held: list[str] = []
        sizes: list[int] = []
        total = 0

        def flush() -> None:
            nonlocal total
            if sizes:
                found, many = self.ids_of(held)
                upto = np.concatenate([[0], np.cumsum(many)])
                ends.extend((total + upto[np.cumsum(sizes)]).tolist())
                ids.append(found)
                total += len(found)
                held.clear()
                sizes.clear()

        waiting = 0
        for text in texts:
            if len(text) > PIECE:
                flush()
                waiting = 0
                for piece in cut(text):
                    ids.append(self.ids_of(self.words(piece))[0])
                    total += len(ids[-1])
                ends.append(total)
                continue
            own = self.words(text)
            held += own
            sizes.append(len(own))
            waiting += len(text)
            if waiting > PIECE:
                flush()
                waiting = 0
        flush()
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(ends, np.int64)

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as a vocabulary file without a decoder wants it."""
        tokens, last = self.tokens, len(self.tokens)
        return " ".join([tokens[i] for i in ids if 0 <= i < last])


def vocabulary_file(path: str | None = None) -> str:
    """Content of a vocabulary file, read on the driver; its size is the file's."""
    return Path(path or public_tokenizers.path(VOCABULARY)).read_text(encoding="utf-8")


def _more(frame: DataFrame, field: T.StructField, fill: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The frame with one more, computed last column."""
    schema = T.StructType([*frame.schema.fields, field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                column = fill(batch, state)
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, field.name])

    return frame.mapInArrow(run, schema)


def encode(documents: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with the token ids of their text in one more column, which replaces one of its name."""
    file = vocabulary_file(path)
    documents = documents.drop(ids) if ids != text else documents
    at = documents.columns.index(text)

    def fill(batch: pa.RecordBatch, state: list) -> pa.Array:
        if not state:
            state.append(Vocabulary(file))
        texts = batch.column(at)
        found, ends = state[0].encode(t.as_py() or "" for t in texts)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))

    return _more(documents, T.StructField(ids, T.ArrayType(T.IntegerType())), fill)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with the text that their ids stand for in one more column, which replaces one of its name."""
    file = vocabulary_file(path)
    encoded = encoded.drop(decoded) if decoded != ids else encoded
    at = encoded.columns.index(ids)

    def fill(batch: pa.RecordBatch, state: list) -> pa.Array:
        if not state:
            state.append(Vocabulary(file))
        return pa.array([state[0].decode(i.as_py() or []) for i in batch.column(at)], pa.string())

    return _more(encoded, T.StructField(decoded, T.StringType()), fill)


def digests(encoded: DataFrame) -> list:
    """Columns that sum up ids and decoded text."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def op3_segment_tree_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every whole document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", whole_text("text").alias("text"))
    both = decode(encode(documents).drop("text"))
    return both.select("doc_id", *digests(both))
