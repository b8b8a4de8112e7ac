"""Texts that were decoded with the wrong character encoding.

One pass counts the adjacent character pairs of the whole corpus (as classes of
characters, so that the table is bounded). A pair's part in the mutual
information of neighbours, p(ab) * log(p(ab) / p(a) p(b)), says how much it is
of this corpus; pairs of little weight score above zero, all others below, and
the maximum-scoring segments of a text are its improbable runs. Only inside
such runs inverse mappings are tried: written in the encoding that was wrongly
used and read in the one that was right, repeatedly for texts damaged more than
once. A mapping is taken if the pairs of the restored run, with its neighbours,
are clearly more probable than those it replaces. Replacement characters, C1
controls and halves of broken sequences count as damage that can't be undone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Character classes; the pair table has at most CLASSES**2 entries of 4 bytes.
CLASSES = 2048
#: A pair under this part of the mutual information (nats) scores above zero.
WEIGHT = 5e-4
#: What a pair inside a shown UTF-8 sequence scores at least, as damage may be frequent enough to have weight.
SHOWN = 1.0
#: A sequence's character is known if the corpus has it at least so often for each time it is shown as the sequence.
KNOWN = 0.1
# fixed value: where the Latin letters of common use end
LATIN = 0x250
#: Log-likelihood a restored run must gain: with a multi-byte sequence that fits, and without.
GAIN_SEQUENCE, GAIN_SINGLE = 0.5, 4.0
# fixed values: encodings by which Western texts are commonly misread
MISREAD = ("cp1252", "mac_roman", "cp437", "cp850")
# fixed values: the first byte of an accented letter's sequence as cp1252 shows it, and the letters whose second byte shows as nothing
LEAD, LOST = "Ã", "íàÁÍÏÐÝ"
# fixed values: characters that a misreading leaves for letters, but that often are what they seem
UNSEEN = "\xa0\xad"
#: Ranges of characters that each are a class of their own; all others share classes by block.
OWN = ((0x00, 0x250), (0x2C6, 0x2DE), (0x370, 0x530), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2150), (0x2200, 0x2300), (0x2500, 0x25D0), (0xFB00, 0xFB07))

#: Keys that are broadcast at most to choose rows; beyond, the join shuffles.
BROADCAST_KEYS = 1_000_000

_STATE: dict[str, object] = {}


def class_table() -> np.ndarray:
    """The class of each code point; digits are one class."""
    if "classes" not in _STATE:
        table = np.zeros(0x110000, dtype=np.int64)
        own = [i for a, b in OWN for i in range(a, b)] + [0xFFFD]
        shared = CLASSES - len(own)
        table[:] = len(own) + (np.arange(0x110000) >> 7) % shared
        table[own] = np.arange(len(own))
        table[48:58] = table[48]
        _STATE["classes"] = table
    return _STATE["classes"]


def own(c: str) -> bool:
    """Whether the character is a class of its own, so that the class's counts are the character's."""
    return any(a <= ord(c) < b for a, b in OWN)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters, with a line break after each text, and where each text ends."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    return codes, np.cumsum([len(t) + 1 for t in texts])


def pair_counts(df: DataFrame, text: str) -> DataFrame:
    """a, b (classes) and n: how often they are neighbours in the text column, over all rows; at most CLASSES**2 rows."""
    src = df.select(F.col(text).alias("t")).where("t is not null and t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        classes = class_table()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                c = classes[_codes(batch.column(0).slice(start, 2000).to_pylist())[0]]
                total += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((seen // CLASSES).astype(np.int32)), pa.array((seen % CLASSES).astype(np.int32)), pa.array(total[seen])], names=["a", "b", "n"])

    return src.mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


class Model:
    """What the corpus's pairs say; built from (a, b, n)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        joint = np.zeros((CLASSES, CLASSES))
        joint[a, b] = n
        total = max(joint.sum(), 1.0)
        left, right = joint.sum(1), joint.sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            mutual = joint / total * np.maximum(np.log(joint * total / (left[:, None] * right[None, :])), 0.1)
            score = np.log(WEIGHT / np.where(joint > 0, mutual, 1e-12))
        self.score = np.clip(np.nan_to_num(score, nan=6.0), -3.0, 6.0).astype(np.float32)
        self.logp = np.log((joint + 0.02) / (left[:, None] + 0.02 * CLASSES)).astype(np.float32)
        self.joint, self.seen, self.uses = joint, right, left
        self.unseen = np.log(0.02 / (left + 0.02 * CLASSES)).astype(np.float32)
        self.memo: dict[str, tuple[str, bool]] = {}

    def likelihood(self, text: str) -> float:
        c = class_table()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
        return float(self.logp[c[:-1], c[1:]].sum())

    def familiarity(self, run: str, to: dict[str, int]) -> float:
        """The likelihood that the run's UTF-8 sequences owe to being frequent, where the corpus has what they stand for beside one of the same neighbours too.

        A sequence that doesn't begin with a letter (a corner of a frame, a root sign) must touch one and stand for a Latin one, and both neighbours count.
        """
        c = class_table()[np.frombuffer(run.encode("utf-32-le", "replace"), dtype=np.uint32)]
        out = 0.0
        for i, size, shown in decoded(run, to):
            a, b = c[i : i + size - 1], c[i + 1 : i + size]
            r, most = class_table()[ord(shown)], KNOWN * self.joint[a, b].min()
            before = i == 0 or self.joint[c[i - 1], r] >= most * self.joint[c[i - 1], c[i]] / max(self.uses[c[i]], 1)
            after = i + size == len(run) or self.joint[r, c[i + size]] >= most * self.joint[c[i + size - 1], c[i + size]] / max(self.uses[c[i + size - 1]], 1)
            touches = before and after and ord(shown) < LATIN and (run[max(i - 1, 0)].isalpha() or run[i + size : i + size + 1].isalpha())
            if own(shown) and self.seen[r] >= most and (before or after if run[i].isalpha() else touches):
                out += float((self.logp[a, b] - self.unseen[a]).sum())
        return out

    def restore(self, run: str, unseen: bool = True) -> tuple[str, bool]:
        """The run, restored as far as possible, and whether it was damaged; with unseen, blanks and invisible characters may stand for letters."""
        key = run + "\1" * unseen
        if key not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[key] = self._restore(run, unseen)
        return self.memo[key]

    def _restore(self, run: str, unseen: bool) -> tuple[str, bool]:
        now, damaged = run, False
        for _ in range(8):
            base = self.likelihood(now)
            best, most = None, 0.0
            for candidate, least, to in candidates(now, unseen):
                gain = self.likelihood(candidate) - base + (self.familiarity(now, to) if to else 0.0)
                if gain > max(least, most):
                    best, most = candidate, gain
            if best is None:
                break
            now, damaged = best, True
        return now, damaged or broken(now)


def misread_tables() -> dict[str, tuple[dict[str, int], dict[int, str]]]:
    """Of each encoding, character to byte and byte to character, above 0x7F; undefined bytes of cp1252 are controls, as browsers have them."""
    if "tables" not in _STATE:
        tables = {}
        for name in MISREAD:
            back = {}
            for i in range(0x80, 0x100):
                try:
                    back[i] = bytes([i]).decode(name)
                except UnicodeDecodeError:
                    back[i] = chr(i)
            to = {c: i for i, c in back.items()}
            if name == "cp1252":
                to |= {chr(i): i for i in range(0x80, 0x100) if chr(i) not in to}
            tables[name] = (to, back)
        _STATE["tables"] = tables
    return _STATE["tables"]


def decoded(run: str, to: dict[str, int]) -> Iterator[tuple[int, int, str]]:
    """Place, length and character of every UTF-8 sequence that the bytes of the run's characters form."""
    i = 0
    while i < len(run):
        b = to.get(run[i], 0)
        size = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        part = [to.get(c, 0) for c in run[i : i + size]]
        if size and len(part) == size and all(0x80 <= x < 0xC0 for x in part[1:]):
            try:
                yield i, size, bytes(part).decode("utf-8")
                i += size
                continue
            except UnicodeDecodeError:
                pass
        i += 1


def sequences(run: str, to: dict[str, int]) -> str | None:
    """The run with every UTF-8 sequence that its characters' bytes form decoded; None if there is none."""
    out, done = [], 0
    for i, size, shown in decoded(run, to):
        out += [run[done:i], shown]
        done = i + size
    return "".join([*out, run[done:]]) if out else None


def in_sequences(codes: np.ndarray) -> np.ndarray:
    """Of each pair of neighbours, whether both stand in UTF-8 sequences that a misreading shows as characters."""
    if "bytes" not in _STATE:
        size, more = np.zeros((len(MISREAD), 0x110000), dtype=np.uint8), np.zeros((len(MISREAD), 0x110000), dtype=bool)
        for k, (to, _) in enumerate(misread_tables().values()):
            for c, b in to.items():
                size[k, ord(c)] = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
                more[k, ord(c)] = 0x80 <= b < 0xC0
        _STATE["bytes"] = size, more
    inside = np.zeros(len(codes), dtype=bool)
    odd = np.flatnonzero(codes > 0x7F)
    for size, more in zip(*_STATE["bytes"]):
        for n in (2, 3, 4):
            at = odd[size[codes[odd]] == n]
            at = at[at + n <= len(codes)]
            for k in range(1, n):
                at = at[more[codes[at + k]]]
            for k in range(n):
                inside[at + k] = True
    return inside[:-1] & inside[1:]


def candidates(run: str, unseen: bool = True) -> Iterator[tuple[str, float, dict[str, int] | None]]:
    """Restored forms of a run, each with the likelihood it has to gain, and the bytes of its characters if sequences were decoded."""
    tables = misread_tables()
    for to, _ in tables.values():
        if (found := sequences(run, to)) is not None:
            yield found, GAIN_SEQUENCE, to
            yield from ((x, least, to) for x, least in lost(found))
    yield from ((x, least, None) for x, least in lost(run))
    for wrong, right in (("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman")):
        to, back = tables[wrong][0], tables[right][1]
        other = {c: x for c in set(run) if c in to and (x := back[to[c]]) != c and x.isprintable() and (unseen or c not in UNSEEN)}
        if len(other) > 1:
            yield "".join(other.get(c, c) for c in run), GAIN_SINGLE, None
        for c, x in sorted(other.items()):  # a run may hold sound characters too
            yield run.replace(c, x), GAIN_SINGLE, None


def lost(run: str) -> Iterator[tuple[str, float]]:
    """The run with each letter whose sequence lost its second, invisible part put in for the first."""
    if LEAD in run:
        for letter in LOST:
            yield run.replace(LEAD, letter), GAIN_SINGLE


def broken(text: str) -> bool:
    """Whether characters stand in the text that only a wrong decoding leaves."""
    return any(c == "�" or "\x80" <= c <= "\x9f" and c != "\x85" for c in text)


def segments(score: np.ndarray, flagged: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments (first, last position), where only the flagged positions may score above zero.

    Exact and in one pass: each flagged position is put to the segments before it. The nearest one whose
    sum up to its begin is lower takes it in with all between them if that raises its own sum.
    """
    gains = np.minimum(score, 0.0)
    gains[flagged] = score[flagged]
    upto = np.cumsum(gains)
    found: list[tuple[float, float, int, int]] = []
    for at in flagged.tolist():
        high, first = float(upto[at]), at
        low = high - float(gains[at])
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][0] >= low:
                k -= 1
            if k < 0 or found[k][1] >= high:
                found.append((low, high, first, at))
                break
            low, first = found[k][0], found[k][2]
            del found[k:]
    return [(first, last) for _, _, first, last in found]


def with_shown(runs: list[tuple[int, int]], shown: list[int]) -> list[tuple[int, int]]:
    """The runs and those of the shown pairs' positions that none holds, as a segment leaves out what doesn't raise its sum."""
    more: list[tuple[int, int]] = []
    k = 0
    for at in shown:
        while k < len(runs) and runs[k][1] < at:
            k += 1
        if k == len(runs) or at < runs[k][0]:
            if more and more[-1][1] == at - 1:
                more[-1] = more[-1][0], at
            else:
                more.append((at, at))
    return sorted(runs + more) if more else runs


def repair(texts: list[str | None], model: Model) -> list[tuple[str | None, bool]]:
    """Of each text its restored form and whether it was damaged."""
    given = [t or "" for t in texts]
    codes, ends = _codes(given)
    c = class_table()[codes]
    score = model.score[c[:-1], c[1:]]
    lost_for_good = codes == 0xFFFD
    shown = in_sequences(codes) | lost_for_good[:-1] | lost_for_good[1:]
    score = np.where(shown, np.maximum(score, SHOWN), score)
    odd = codes > 0x7F
    flagged = np.flatnonzero((score > 0) & (odd[:-1] | odd[1:]))
    out: list[tuple[str | None, bool]] = []
    upto = np.searchsorted(flagged, ends)
    begin = 0
    for k, (text, end) in enumerate(zip(texts, ends)):
        own = flagged[(upto[k - 1] if k else 0) : upto[k]] - begin
        if len(own):
            own = own[own < len(text)] if text else own[:0]  # the last pair is that with the end of the text
        if not text or not len(own):
            out.append((text, False))
        else:
            runs = with_shown(segments(score[begin : end - 1], own), own[shown[begin : end - 1][own]].tolist())
            now, damaged = _restored(text, runs, model, False)
            if damaged and any(c in text for c in UNSEEN):  # where letters were misread, those that left no trace may be too
                now, _ = _restored(text, runs, model, True)
            out.append((now, damaged))
        begin = end
    return out


def _restored(text: str, runs: list[tuple[int, int]], model: Model, unseen: bool) -> tuple[str, bool]:
    spans: list[list[int]] = []
    for first, last in runs:
        done, b = spans[-1][1] if spans else 0, min(last + 3, len(text))
        if first < done:  # the run before reaches into this one; a sequence isn't to be cut
            spans[-1][1] = b
        else:
            spans.append([max(first - 1, done), b])
    pieces, done, damaged = [], 0, False
    for a, b in spans:
        now, bad = model.restore(text[a:b], unseen)
        damaged |= bad
        pieces += [text[done:a], now]
        done = b
    return "".join([*pieces, text[done:]]), damaged


def repaired(df: DataFrame, key: str = "id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """key, text (restored as far as it can be) and damaged of each distinct key.

    A null or empty text is not damaged. Rows that repeat a key count once (one of
    them, whichever, if they differ); rows with null key are left out. The pair table, at most
    CLASSES**2 numbers, goes to every executor. With only, a table of keys, the pairs of all rows are counted
    and the rows with these keys are restored.
    """
    rows = pair_counts(df, text).toPandas()
    a, b, n = (rows[c].to_numpy() for c in ("a", "b", "n"))
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null")
    if only is not None:
        few = only.select(F.col(key).alias("k")).distinct()
        src = src.join(F.broadcast(few) if few.count() <= BROADCAST_KEYS else few, "k", "left_semi")
    kind = dict(src.dtypes)["k"]
    shared = df.sparkSession.sparkContext.broadcast((a.astype(np.int32), b.astype(np.int32), n.astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                found = repair(part.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([d for _, d in found])], names=["k", "t", "damaged"])

    return src.mapInArrow(run, f"k {kind}, t string, damaged boolean").select(F.col("k").alias(key), F.col("t").alias(text), "damaged")


def damaged_keys(df: DataFrame, key: str = "id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """The distinct keys whose text is damaged; with only, among these keys."""
    return repaired(df, key, text, only).where("damaged").select(key).distinct()
