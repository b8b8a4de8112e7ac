"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's public pattern, as array operations
over many texts at once. The distinct words a partition hasn't met yet are cut further wherever no
token of the vocabulary that stands in the word reaches across, since no contraction
can do so either. The pieces go as token-position rows into an in-process DuckDB,
where one recursive query joins adjacent tokens with the merge table, contracts
in every piece its leftmost pair of minimum rank (with the other occurrences of
that same pair, left to right, as the algorithm would do next
anyway) and repeats until no piece has a pair left; an ordered aggregation turns
the rows into ids. Each text is then the concatenation of its words' ids.

So that long pieces take few steps, a pair is also contracted when it isn't
the minimum but nothing of lower rank can get at it: whatever token the left
neighbour may grow into has no merge with the pair's first token of a rank as low, nor
has the pair's second with what the right neighbour may grow into. The two tables of
bounds are derived from the merge table. Such a pair stands until its rank is reached, so
contracting it earlier gives the same tokens.

The query keeps only the last state of every token position, so its memory grows with the
pieces and not with the steps. No shuffle: the encoding is a map over the input's
partitions. Words are kept between batches and tasks of a Python worker, up to
KEPT_WORDS, then forgotten and encoded anew when met again.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Folder of the public vocabularies, read by the driver.
TOKENIZERS = "/opt/tokenizers"
KEPT_WORDS = 400_000
#: Bytes of pieces that one query contracts together; a longer piece is a query of its own.
QUERY_BYTES = 200_000

FIXPOINT = """
WITH RECURSIVE step(w, pos, tok) USING KEY (w, pos) AS (
    SELECT w, pos, tok FROM fresh
    UNION ALL
    SELECT w, pos, CASE WHEN hit THEN merged WHEN NOT coalesce(lag(hit) OVER (PARTITION BY w ORDER BY pos), false) THEN tok END AS tok
    FROM (
        SELECT *, coalesce(safe OR at_best AND (tok <> nxt OR row_number() OVER (PARTITION BY w, run ORDER BY pos) % 2 = 1), false) AS hit
        FROM (
            SELECT *, CASE WHEN at_best AND tok = nxt THEN i - row_number() OVER (PARTITION BY w, at_best AND tok = nxt ORDER BY pos) END AS run
            FROM (
                SELECT p.w, p.pos, p.tok, p.nxt, p.i, m.merged, min(m.rank) OVER (PARTITION BY p.w) AS best, coalesce(m.rank = best, false) AS at_best,
                       p.tok <> p.nxt AND m.rank < coalesce(a.least, 2147483647) AND m.rank < coalesce(b.least, 2147483647) AS safe
                FROM (SELECT w, pos, tok, lag(tok) OVER place AS prv, lead(tok) OVER place AS nxt, lead(tok, 2) OVER place AS far, row_number() OVER place AS i
                      FROM step WHERE tok IS NOT NULL WINDOW place AS (PARTITION BY w ORDER BY pos)) p
                LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
                LEFT JOIN before_pair a ON a.grown = p.prv AND a.tok = p.tok
                LEFT JOIN behind_pair b ON b.tok = p.nxt AND b.grown = p.far
            ) WHERE best IS NOT NULL
        )
    )
)
SELECT w, list(tok ORDER BY pos) AS ids FROM step WHERE tok IS NOT NULL GROUP BY w ORDER BY w
"""


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def cut_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words into which PATTERN cuts texts: all characters' codes, each word's first position, each text's number of words.

    The same cut as findall gives, from the changes of character class, for all
    texts at once. A zero stands behind each text in the codes and belongs to no
    word; the position behind the last word's end is the last of the firsts.
    """
    codes = np.frombuffer("\0".join([t or "" for t in texts] + [""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    size = np.array([len(t or "") for t in texts], dtype=np.int64)
    ends = np.cumsum(size + 1) - 1
    kind = character_classes()[codes]
    kind[ends] = 4
    change = np.empty(len(codes), dtype=bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    mark = change.copy()
    mark[ends] = True
    begin = np.flatnonzero(change[1:] & (kind[1:] % 4 != 0) & (kind[:-1] == 0)) + 1
    mark[begin - 1] = True
    mark[begin[codes[begin - 1] == 32]] = False
    quote = np.flatnonzero((codes[:-1] == 39) & mark[:-1])
    if len(quote):
        padded = np.concatenate([codes, np.zeros(3, dtype=np.uint32)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [115, 116, 109, 100])
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        mark[quote[short | long] + 1] = False
        mark[quote[short] + 2] = True
        mark[quote[long] + 3] = True
    firsts = np.flatnonzero(mark)
    upto = np.searchsorted(firsts, ends, side="left")  # a text's words and the ends before it
    counts = np.diff(upto, prepend=-1) - 1
    return codes, firsts, counts


_CLASSES: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 other."""
    if not _CLASSES:
        import regex

        table = np.full(0x110000, 3, dtype=np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((0, r"\s"), (1, r"\p{L}"), (2, r"\p{N}")):
            table[[ord(c) for c in regex.findall(pattern, every)]] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def _automaton(tokens: list[bytes]):  # noqa: ANN202
    """Finds all tokens that stand in a word, written as Latin-1."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for t in tokens:
        found.add_word(t.decode("latin-1"), len(t))
    found.make_automaton()
    return found


def _bounds(left: list[int], right: list[int], merged: list[int], spelled: dict[int, bytes]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """The lowest rank with which what a token may grow into, leftwards or rightwards, merges with a neighbour.

    First by (token, its right neighbour), then by (token, its left neighbour).
    """
    known = {t: i for i, t in spelled.items()}
    before: dict[tuple[int, int], int] = {}
    behind: dict[tuple[int, int], int] = {}
    for k, (a, b) in enumerate(zip(left, right)):
        x, y = spelled[a], spelled[b]
        for own, pairs in ((before, ((known.get(x[i:]), b) for i in range(len(x)))), (behind, ((known.get(y[: len(y) - i]), a) for i in range(len(y))))):
            for pair in pairs:
                if pair[0] is not None:
                    own.setdefault(pair, k)  # ranks rise, so the first is the lowest
    return before, behind


class Encoder:
    """Words to ids, for one vocabulary and one Python worker."""

    def __init__(self, content: bytes) -> None:
        import duckdb

        model = json.loads(content)["model"]
        vocab, letters = model["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        left, right = ([vocab[m[i]] for m in pairs] for i in (0, 1))
        merged = [vocab[m[0] + m[1]] for m in pairs]
        spelled = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.cuts = _automaton([t for t in spelled.values() if len(t) > 1])
        # bounds say what is safe where every token is made by one merge, which comes before all that use it
        made = {c: k for k, c in enumerate(merged)}
        sound = len(made) == len(merged) and all(made.get(t, -1) < k for k, pair in enumerate(zip(left, right)) for t in pair)
        self.query = FIXPOINT if sound else FIXPOINT.replace(" AS safe", " AND false AS safe")
        draw = np.random.default_rng(8)
        self.letter = draw.integers(1, 2**63, 0x110000, dtype=np.uint64) | np.uint64(1)
        self.power = draw.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        table = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(range(len(left)), pa.int32()), "merged": pa.array(merged, pa.int32())})
        self.db.register("merge_rows", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        for name, bounds in zip(("before_pair", "behind_pair"), _bounds(left, right, merged, spelled)):
            grown, tok, least = (pa.array(x, pa.int32()) for x in (zip(*((*k, v) for k, v in bounds.items())) if bounds else ((), (), ())))
            self.db.register("bound_rows", pa.table({"grown": grown, "tok": tok, "least": least}))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM bound_rows")
        self._forget()

    def _forget(self) -> None:
        self.index = pd.Index(np.empty(0, dtype=np.uint64))
        self.chars, self.char_at = np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.ids, self.id_at = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode words that aren't known yet and keep them."""
        raw = [w.encode() for w in words]
        pieces, own = [], []
        for i, w in enumerate(raw):
            for piece in self._pieces(w):
                pieces.append(piece)
                own.append(i)
        found: list[np.ndarray] = []
        first = held = 0
        for i, piece in enumerate([*pieces, None]):
            if i > first and (piece is None or held + len(piece) > QUERY_BYTES):
                found += self._recursive(pieces[first:i])
                first, held = i, 0
            held += len(piece or b"")
        count = np.bincount(own, [len(x) for x in found], len(words)).astype(np.int64) if own else np.zeros(len(words), dtype=np.int64)
        self.index = self.index.append(pd.Index(hashes))
        self.chars = np.concatenate([self.chars, np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)])
        self.char_at = np.concatenate([self.char_at, self.char_at[-1] + np.cumsum([len(w) for w in words])])
        self.ids = np.concatenate([self.ids, *found])
        self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(count)])

    def _pieces(self, word: bytes) -> list[bytes]:
        """The word cut where no token that stands in it reaches across."""
        if len(word) < 3:
            return [word]
        open_ = np.zeros(len(word) + 1, dtype=np.int32)
        for end, size in self.cuts.iter(word.decode("latin-1")):
            open_[end - size + 1] += 1
            open_[end] -= 1
        cut = np.flatnonzero(np.cumsum(open_)[: len(word) - 1] == 0) + 1
        if not len(cut):
            return [word]
        at = [0, *cut.tolist(), len(word)]
        return [word[x:y] for x, y in zip(at, at[1:])]

    def _recursive(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece, by the recursive query; pieces that are equal are contracted once."""
        place: dict[bytes, int] = {}
        at = [place.setdefault(x, len(place)) for x in pieces]
        size = np.array([len(x) for x in place], dtype=np.int64)
        first = np.repeat(np.cumsum(size) - size, size)
        tok = self.byte_id[np.frombuffer(b"".join(place), dtype=np.uint8)]
        rows = pa.table({"w": np.repeat(np.arange(len(place), dtype=np.int32), size), "pos": (np.arange(size.sum()) - first).astype(np.int32), "tok": tok})
        self.db.register("fresh", rows)
        result = self.db.sql(self.query).to_arrow_table()
        self.db.unregister("fresh")
        ids = result.column("ids").combine_chunks()
        flat, offsets = ids.values.to_numpy().astype(np.int32), ids.offsets.to_numpy()
        return [flat[offsets[i] : offsets[i + 1]] for i in at]

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word of the texts among the known ones; each text's number of words."""
        codes, firsts, counts = cut_words(texts)
        size = np.diff(np.append(firsts, len(codes)))
        inside = np.arange(len(codes)) - np.repeat(firsts, size)
        while len(self.power) <= inside.max(initial=0):
            self.power = np.concatenate([self.power, self.power * (self.power[-1:] | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)])
        hashes = np.add.reduceat(self.letter[codes] * self.power[inside], firsts)
        ends = np.cumsum(counts + 1) - 1  # places of the zeros among the firsts
        word = np.ones(len(firsts), dtype=bool)
        word[ends] = False
        hashes, begin, size = hashes[word], firsts[word], size[word]
        place = self.index.get_indexer(hashes)
        if (place < 0).any():
            if len(self.index) > KEPT_WORDS:
                self._forget()
                place[:] = -1
            unknown = np.flatnonzero(place < 0)
            fresh, at = np.unique(hashes[unknown], return_index=True)
            at = unknown[at]
            self._learn(fresh, [codes[a : a + n].tobytes().decode("utf-32-le") for a, n in zip(begin[at], size[at])])
            place = self.index.get_indexer(hashes)
        kept = np.repeat(word, np.diff(np.append(firsts, len(codes))))
        shift = np.repeat(self.char_at[place] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        known = np.diff(self.char_at)[place]
        if not (np.array_equal(known, size) and np.array_equal(self.chars[shift], codes[kept])):
            raise ValueError("two words share a hash")
        return place, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after another, and the number of ids of each; none for an empty or null text."""
        place, counts = self._places(texts)
        size = np.diff(self.id_at)[place]
        take = np.repeat(self.id_at[place] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.ids[take], _per_text(size, counts)

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        place, counts = self._places(texts)
        return _per_text(np.diff(self.id_at)[place], counts)


def _per_text(size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(size)])
    return np.diff(upto[np.concatenate([[0], np.cumsum(counts)])])


def _blocks(column: pa.Array, chars: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive texts with the first one's place, cut after chars characters, so that what is in hand stays small; a text is never cut."""
    first, block, held = 0, [], 0
    for t in column.to_pylist():
        block.append(t)
        held += len(t or "")
        if held > chars:
            yield first, block
            first, block, held = first + len(block), [], 0
    if block:
        yield first, block


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, content: bytes | None = None) -> Encoder:
    """This worker's encoder of a vocabulary, from the file's content or the file itself."""
    if path not in _ENCODERS:
        if content is None:
            with open(path, "rb") as f:
                content = f.read()
        _ENCODERS[path] = Encoder(content)
    return _ENCODERS[path]


def _shipped(df: DataFrame, path: str):  # noqa: ANN202
    """The vocabulary file as a broadcast (some 2 MB), so that only the driver must have it."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """key and ids (array<int>) of each row of df, without special tokens.

    An empty or null text has the ids [] ; a null key, repeated keys and rows
    stay as they are, one row out for each row in. Strings of special tokens in a
    text are ordinary text. Other columns aren't read.
    """
    path = os.path.join(folder, vocabulary)
    shared = _shipped(df, path)
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(src.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, shared.value)
        for batch in batches:
            for first, texts in _blocks(batch.column(1)):
                ids, counts = enc.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), lists], names=["k", "ids"])

    return src.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """key and tokens (int), the number of ids encode_corpus gives; 0 for an empty or null text."""
    path = os.path.join(folder, vocabulary)
    shared = _shipped(df, path)
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(src.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, shared.value)
        for batch in batches:
            for first, texts in _blocks(batch.column(1)):
                sizes = pa.array(enc.lengths(texts).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), sizes], names=["k", "tokens"])

    return src.mapInArrow(run, f"k {kind}, tokens int").select(F.col("k").alias(key), "tokens")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """key and text of each row of df, from its ids; the text of null or no ids is empty, of bytes that are no UTF-8 the replacement character."""
    shared = _shipped(df, os.path.join(folder, vocabulary))
    src = df.select(F.col(key).alias("k"), F.col(ids).alias("i"))
    kind = dict(src.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = {c: b for b, c in byte_letters().items()}
        spelled = {i: bytes(back[c] for c in t) for t, i in json.loads(shared.value)["model"]["vocab"].items() if all(c in back for c in t)}
        for batch in batches:
            texts = [b"".join(map(spelled.__getitem__, x or ())).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "t"])

    return src.mapInArrow(run, f"k {kind}, t string").select(F.col("k").alias(key), F.col("t").alias("text"))
