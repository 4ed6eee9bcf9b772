"""Garbled text from a wrong character encoding: candidate encode-decode chains scored by character n-gram models.

The chains that can apply to a record are found by the marks every wrong decoding of UTF-8 leaves: a character standing for
a lead byte followed by one standing for a continuation byte (plain, or after NFKC or lower-casing had changed it), a C1
control or U+FFFD. A record without such marks is left unchanged by every chain and trains the model, unless it is held out
to validate the margin; the others are scored. Records are tested for marks batch by batch with a linear-time engine, and
only those that have some are looked at one by one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings with which UTF-8 is misread.
CODECS = ["cp1252", "latin-1", "cp1258", "cp1250", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "cp1254", "koi8-r"]
#: Buckets of the hashed n-gram model: its size never grows with the data.
BUCKETS = 1 << 18
ORDERS = (1, 2, 3)
#: Blocks of 2**7 code points are what unseen characters are judged by.
_BLOCK_BITS = 7
_MIX = np.array([1, 1_000_003, 998_244_353], dtype=np.uint64)
#: One clean record in so many is kept from training and validates the margin.
HELD_OUT = 50
#: Parts of the records, by hash of their texts, where all of them are to train and to validate: each is judged by a model of the others.
FOLDS = 3
#: Steps of a nat in the histograms of gains, and their reach in nats: gains beyond it count in the outermost step.
_STEPS, _REACH = 2, 500


@lru_cache(None)
def _bytes_of(codec: str) -> dict[str, int]:
    """Characters that stand for a byte from 0x80 on; bytes the codec leaves undefined stand for the C1 control of that number."""
    out = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(None)
def _compat() -> dict[str, str]:
    """NFKC forms, and lower-case forms, back to the single characters that stand for continuation bytes in Windows-1252."""
    back: dict[str, str] = {}
    for ch, b in _bytes_of("cp1252").items():
        if 0x80 <= b < 0xC0:
            for form in (unicodedata.normalize("NFKC", ch), ch.lower()):
                if form != ch and form not in back:
                    back[form] = ch
    return back


def _class(chars: list[str]) -> str:
    return "(?:" + "|".join(sorted(map(re.escape, chars), key=len, reverse=True)) + ")" if chars else "(?!)"


def _cont() -> str:
    """Windows-1252 characters of continuation bytes, without the ellipsis: after changed letters it is punctuation."""
    return "[" + "".join(re.escape(c) for c, b in _bytes_of("cp1252").items() if 0x80 <= b < 0xC0 and c != "…") + "]"


@lru_cache(None)
def _marks_source() -> str:
    """Any lead-continuation pair that some codec can have made from UTF-8, in a syntax that linear-time engines know too."""
    alts = ["[\x80-\x84\x86-\x9f\ufffd]"]
    for codec in CODECS:
        table = _bytes_of(codec)
        by = lambda lo, hi, t=table: "[" + "".join(re.escape(c) for c, b in t.items() if lo <= b < hi) + "]"
        alts.append(by(0xC2, 0xE0) + by(0x80, 0xC0))
        alts.append(by(0xE0, 0xF0) + by(0x80, 0xC0) + by(0x80, 0xC0))
        alts.append(by(0xF0, 0xF5) + by(0x80, 0xC0) * 3)
    cont = _cont()
    soft = _class([f for f in _compat() if f != " "])
    alts.append(f"[ÃÄÅÆÂ](?:[123oaµ]|{_class([f for f in _compat() if len(f) > 1])})")
    alts.append("[a-z]Ã ")
    alts.append(f"[ãäåæâ]{cont}")
    alts.append(f"[áâ](?:{cont}{soft}|{soft}{cont})")
    return "|".join(alts)


@lru_cache(None)
def _marks() -> re.Pattern[str]:
    return re.compile(_marks_source())


def marked(texts: pa.Array) -> np.ndarray:
    """Which texts some chain can change; null for none. One pass of a linear-time engine over the whole batch."""
    return pa.compute.match_substring_regex(texts, _marks_source()).fill_null(False).to_numpy(zero_copy_only=False)


def has_marks(text: str) -> bool:
    """Whether some chain can change the text."""
    return _marks().search(text) is not None


#: Words: parts between white space; a space before a combining mark is what NFKC makes of a spacing accent and stays inside.
_WORD = re.compile("(?:[^ \t\r\n]| (?=[\u0300-\u036f]))+")
#: Words up to this length are remembered, so many at most.
_SHORT, _REMEMBERED = 64, 1 << 16


@lru_cache(None)
def _sequences(codec: str) -> re.Pattern[str]:
    """UTF-8 sequences of two to four bytes as this codec shows them."""
    table = _bytes_of(codec)
    by = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in table.items() if lo <= b < hi) + "]"
    cont = by(0x80, 0xC0)
    return re.compile(f"{by(0xC2, 0xE0)}{cont}|{by(0xE0, 0xF0)}{cont}{{2}}|{by(0xF0, 0xF5)}{cont}{{3}}")


def _undo_any(text: str, codec: str) -> str:
    """The text with every UTF-8 sequence that ``codec`` misread put right; all other characters stay as they are."""
    table = _bytes_of(codec)

    def one(m: re.Match[str]) -> str:
        try:
            return bytes(table[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _sequences(codec).sub(one, text)


def _undo_long(word: str) -> tuple[str, ...]:
    return tuple(_undo_any(word, codec) for codec in CODECS)


_undo_short = lru_cache(_REMEMBERED)(_undo_long)


def _undo(word: str) -> tuple[str, ...]:
    """What each of CODECS makes of the word."""
    return _undo_short(word) if len(word) <= _SHORT else _undo_long(word)


@lru_cache(None)
def _unfold_patterns() -> tuple[re.Pattern[str], ...]:
    cont, forms = _cont(), _class(list(_compat()))
    return (re.compile(f"([ãäåæâ])({cont}|{forms})"), re.compile(f"([ÃÄÅÆÂ])({forms})"), re.compile(f"([áâ])({cont}|{forms})({cont}|{forms})"))


def _unfold(text: str) -> str:
    """Characters that NFKC or lower-casing changed after the wrong decoding, put back where a lead byte asks for them."""
    back, patterns = _compat(), _unfold_patterns()
    text = patterns[0].sub(lambda m: m.group(1).upper() + m.group(2), text)
    text = patterns[1].sub(lambda m: m.group(1) + back[m.group(2)], text)
    return patterns[2].sub(lambda m: m.group(1) + back.get(m.group(2), m.group(2)) + back.get(m.group(3), m.group(3)), text)


@dataclass
class _Chain:
    """A chain of misreadings: its name, the text it starts from, and the words it changes with what it makes of them."""

    name: str
    base: str
    words: tuple[str, ...]
    made: tuple[str, ...]

    def text(self) -> str:
        new = dict(zip(self.words, self.made))
        return _WORD.sub(lambda m: new.get(m.group(), m.group()), self.base)


def _chains(text: str) -> list[_Chain]:
    """Every chain of up to three misreadings, each undone in all words, that changes the text; a chain changes no ASCII and joins no words."""
    out = []
    soft = _unfold(text)
    for name, base in [("", text)] + ([("unfold", soft)] if soft != text else []):
        words = tuple(sorted(w for w in set(_WORD.findall(base)) if not w.isascii() and any(u != w for u in _undo(w))))
        seen, todo = {words}, [(name, words)]
        for _ in range(3):
            new = []
            for chain, ws in todo:
                for codec, us in zip(CODECS, zip(*map(_undo, ws))):
                    if us not in seen:
                        seen.add(us)
                        new.append((f"{chain}+{codec}".lstrip("+"), us))
            out += [_Chain(chain, base, words, us) for chain, us in new]
            todo = new
    return out


def candidates(text: str) -> list[tuple[str, str]]:
    """(chain, text) of every chain of up to three misreadings that changes the text; bytes no chain explains keep their characters."""
    return [(c.name, c.text()) for c in _chains(text)]


@lru_cache(_REMEMBERED)
def _marks_in_short(word: str) -> int:
    return len(_marks().findall(word))


def _marks_in(word: str) -> int:
    return _marks_in_short(word) if len(word) <= _SHORT else len(_marks().findall(word))


def cleanest(text: str) -> str:
    """The text after the chain that leaves the fewest marks, of several the one that leaves it shortest; itself where none leaves fewer. Only the chosen chain's text is put together."""
    if not has_marks(text):
        return text
    best, chosen = (len(_marks().findall(text)), len(text)), None
    of: dict[str, tuple[Counter, int]] = {}
    for c in _chains(text):
        if c.base not in of:
            of[c.base] = Counter(_WORD.findall(c.base)), len(_marks().findall(c.base))
        n, left = of[c.base]
        size = len(c.base)
        for w, u in zip(c.words, c.made):
            if u != w:
                left += n[w] * (_marks_in(u) - _marks_in(w))
                size += n[w] * (len(u) - len(w))
        if (left, size) < best:
            best, chosen = (left, size), c
    return chosen.text() if chosen else text


def _grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed 1-, 2- and 3-grams ending at every character, case folded, its block of code points, and the text each position belongs to."""
    joined = "\x02\x02" + "\x02\x02".join(texts)
    a = np.frombuffer(joined.lower().encode("utf-32-le") if len(joined.lower()) == len(joined) else joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    # Digits are alike.
    a[(a >= 48) & (a <= 57)] = 48
    own = np.repeat(np.arange(len(texts)), lens + 2)
    keep = np.ones(len(a), bool)
    starts = np.concatenate(([0], np.cumsum(lens + 2)[:-1])) if len(texts) else np.array([], dtype=np.int64)
    keep[starts] = keep[starts + 1] = False
    hashes, h = [], np.zeros(len(a), dtype=np.uint64)
    for k in ORDERS:
        shifted = np.concatenate((np.zeros(k - 1, np.uint64), a[: len(a) - k + 1]))
        h = h * np.uint64(1_000_003) + (shifted + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
        hashes.append(((h >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)[keep])
    hashes.append((a >> np.uint64(_BLOCK_BITS)).astype(np.int64)[keep])
    return hashes, own[keep]


class CharModel:
    """Interpolated character trigrams over hashed counts (Witten-Bell weights by context count); below them characters by their block of code points."""

    def __init__(self, counts: np.ndarray) -> None:
        self.c = counts.astype(np.float32)  # whole counts up to 2**24 are exact; beyond, a part in 2**24 is no matter
        self.total = max(1.0, float(counts[0].sum()))
        self.kinds = max(1, int((counts[0] > 0).sum()))

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text in nats; an empty text has 0."""
        if not texts:
            return np.zeros(0)
        hashes, own = _grams(texts)
        c1, c2, c3, c0 = (self.c[k][hashes[k]] for k in range(4))
        prev = lambda x: np.concatenate(([0.0], x[:-1]))
        first = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
        ctx1, ctx2 = prev(c1), prev(c2)
        ctx1[first], ctx2[first] = 0, 0
        # No gram is commoner than its parts: what hashing adds to rare ones is cut back.
        c2 = np.minimum(c2, np.minimum(c1, ctx1))
        c3 = np.minimum(c3, np.minimum(c2, ctx2))
        p0 = (c0 + 0.01) / (self.total + 0.01 * (0x110000 >> _BLOCK_BITS)) / (1 << _BLOCK_BITS)
        p1 = (c1 + self.kinds * p0) / (self.total + self.kinds)
        p2 = (c2 + 12 * p1) / (ctx1 + 12)
        p3 = (c3 + 6 * p2) / (ctx2 + 6)
        return np.bincount(own, weights=np.log(p3), minlength=len(texts))


def _counts(texts: list[str]) -> np.ndarray:
    out = np.zeros((4, BUCKETS))
    if texts:
        hashes, _ = _grams(texts)
        for k in range(4):
            out[k] = np.bincount(hashes[k], minlength=BUCKETS)
    return out


_HELD = f"pmod(xxhash64(text), {HELD_OUT}) = 0"


def train(texts: DataFrame) -> CharModel:
    """The model of the column ``text``: counts of all records without marks, but for the held-out ones, summed by bucket; what the driver gets is bounded by (ORDERS + 1) x BUCKETS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, BUCKETS))
        for batch in batches:
            total += _counts(batch.column(0).filter(pa.array(~marked(batch.column(0)))).to_pylist())
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k * BUCKETS + b), pa.array(total[k, b].astype(np.int64))], ["cell", "n"])

    used = texts.select("text").where(f"text <> '' AND NOT ({_HELD})")
    rows = used.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(4 * BUCKETS)
    counts[rows.cell.to_numpy()] = rows.n.to_numpy()
    return CharModel(counts.reshape(4, BUCKETS))


def garble(text: str, codec: str) -> str:
    """The text as UTF-8 that is read by ``codec``; bytes the codec leaves undefined become C1 controls."""

    def one(b: int) -> str:
        try:
            return bytes([b]).decode(codec)
        except UnicodeDecodeError:
            return chr(b)

    return "".join(chr(b) if b < 0x80 else one(b) for b in text.encode("utf-8"))


def best(model: CharModel, text: str) -> tuple[float, str, str]:
    """(gain in nats, chain, text) of the likeliest candidate; (-inf, '', text) without one. Words are scored one by one, so only those that differ count."""
    found = _chains(text)
    if not found:
        return float("-inf"), "", text
    own = Counter(_WORD.findall(text))
    of = {text: own} | {base: Counter(_WORD.findall(base)) for base in {c.base for c in found} - {text}}
    plain = {b: (n - own, own - n) for b, n in of.items()}
    names = sorted({w for c in found for w in (*c.words, *c.made)} | {w for p in plain.values() for n in p for w in n})
    score = dict(zip(names, model.score([f" {w} " for w in names]).tolist()))
    start = {b: sum(score[w] * n for w, n in more.items()) - sum(score[w] * n for w, n in less.items()) for b, (more, less) in plain.items()}
    gain = [start[c.base] + sum((score[u] - score[w]) * of[c.base][w] for w, u in zip(c.words, c.made) if u != w) for c in found]
    i = int(np.argmax(gain))
    return gain[i], found[i].name, found[i].text()


def _chance_marks(text: str, word: str) -> list[str]:
    """Clean writings of the text in which marks can come about by chance: in capitals, in lower case, and a word in quotes or after a dash."""
    around = [text.replace(word, f"{a}{word}{b}", 1) for a, b in ("“”", "‘’", "«»", ("–", ""), ("—", ""), ("", "…"))]
    return [text.upper(), text.lower(), *around]


def gains(texts: DataFrame, model: CharModel) -> np.ndarray:
    """Histograms (2 x steps) of the gains on held-out clean records: of clean writings of them, and garbled.

    Of a record with a non-ASCII word, that word alone is misread by the codec that the record's hash picks - the least that
    can be garbled. Its clean writings are those of ``_chance_marks``; without marks or candidates they count as lowest gain.
    Two histograms of 2 x _REACH x _STEPS cells are all the driver gets.
    """
    bm = texts.sparkSession.sparkContext.broadcast(model)
    size = 2 * _REACH * _STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros((2, size), dtype=np.int64)
        for batch in batches:
            made: list[str] = []
            kind: list[int] = []
            clean = pa.array(~marked(batch.column(0)))
            for t, h in zip(batch.column(0).filter(clean).to_pylist(), batch.column(1).filter(clean).to_pylist()):
                words = [w for w in t.split() if not w.isascii()]
                if words:
                    w = words[h % len(words)]
                    fine = _chance_marks(t, w)
                    made += [t.replace(w, garble(w, CODECS[h % len(CODECS)]), 1), *fine]
                    kind += [1] + [0] * len(fine)
            # A codec that shows some word as it is garbles nothing; a clean writing without marks can't be mistaken.
            some = marked(pa.array(made, pa.string()))
            hist[0, 0] += int(np.sum(~some & (np.array(kind, dtype=int) == 0)))
            known: dict[str, float] = {}
            for i in np.flatnonzero(some):
                t = made[i]
                if t not in known:
                    known[t] = best(bm.value, t)[0]
                hist[kind[i], int(np.clip(np.floor((known[t] + _REACH) * _STEPS), 0, size - 1))] += 1
        k, b = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(hist[k, b])], ["k", "b", "n"])

    held = texts.select("text", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)).cast("int").alias("h")).where(f"text IS NOT NULL AND {_HELD}")
    rows = held.mapInArrow(run, "k long, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((2, size), dtype=np.int64)
    for r in rows:
        out[r["k"], r["b"]] = r["n"]
    return out


def margin_of(hist: np.ndarray) -> float:
    """The margin of no less than 0 nats at which the share of clean writings above it and that of garbled records not above it are least together.

    Of margins that are equally good the middle one; 0 where nothing was held out.
    """
    size = hist.shape[1]
    edges = (np.arange(size) / _STEPS - _REACH).astype(float)
    part = hist / np.maximum(1, hist.sum(1, keepdims=True))
    wrong = part[0][::-1].cumsum()[::-1] + np.concatenate(([0.0], part[1].cumsum()[:-1]))
    open_ = np.flatnonzero(edges >= 0)
    if not hist.sum():
        return 0.0
    least = open_[np.isclose(wrong[open_], wrong[open_].min(), atol=1e-12)]
    first = least[: int(np.argmax(np.append(np.diff(least), 2) > 1)) + 1]
    return float(edges[first].mean())


def validate(texts: DataFrame, model: CharModel) -> float:
    """The margin, from the held-out part of the clean records that the model has not seen."""
    return margin_of(gains(texts, model))


def _fold() -> Column:
    return F.pmod(F.xxhash64("text", F.lit(2)), F.lit(FOLDS)).cast("int").alias("f")


def train_whole(texts: DataFrame) -> tuple[CharModel, list[CharModel]]:
    """The model of all records without marks in the column ``text``, and for each fold the model of all but its records; what the driver gets is bounded by (ORDERS + 1) x BUCKETS cells of FOLDS counts."""
    cols = [f"n{k}" for k in range(FOLDS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, 4, BUCKETS))
        for batch in batches:
            clean, fold = ~marked(batch.column(0)), batch.column(1).to_numpy()
            for k in range(FOLDS):
                total[k] += _counts(batch.column(0).filter(pa.array(clean & (fold == k))).to_pylist())
        flat = total.reshape(FOLDS, -1)
        at = np.flatnonzero(flat.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x.astype(np.int64)) for x in flat[:, at])], ["cell", *cols])

    used = texts.select("text", _fold()).where("text <> ''")
    rows = used.mapInArrow(count, ", ".join(f"{c} long" for c in ["cell", *cols])).groupBy("cell").agg(*(F.sum(c).alias(c) for c in cols)).toArrow()
    counts = np.zeros((FOLDS, 4 * BUCKETS))
    for k, c in enumerate(cols):
        counts[k, rows.column("cell").to_numpy()] = rows.column(c).to_numpy()
    counts = counts.reshape(FOLDS, 4, BUCKETS)
    return CharModel(counts.sum(0)), [CharModel(counts.sum(0) - x) for x in counts]


def _what_changes(text: str) -> str:
    """A text with the same gain: the words alone that some chain changes; the whole text where characters that NFKC or lower-casing changed are put back, which may join words."""
    return text if _unfold(text) != text else "\n".join(w for w in _WORD.findall(text) if not w.isascii() and any(u != w for u in _undo(w)))


def validate_whole(texts: DataFrame, models: list[CharModel]) -> float:
    """The margin, from all clean records as ``gains`` makes them, each judged by the model of all folds but its own; what changes in them is judged once a task for each fold."""
    bm = texts.sparkSession.sparkContext.broadcast(models)
    size = 2 * _REACH * _STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros((2, size), dtype=np.int64)
        known: dict[tuple[int, str], float] = {}
        for batch in batches:
            made: list[str] = []
            kind: list[int] = []
            fold: list[int] = []
            clean = pa.array(~marked(batch.column(0)))
            for t, h, f in zip(*(batch.column(i).filter(clean).to_pylist() for i in range(3))):
                words = [w for w in t.split() if not w.isascii()]
                if words:
                    w = words[h % len(words)]
                    fine = _chance_marks(t, w)
                    made += [t.replace(w, garble(w, CODECS[h % len(CODECS)]), 1), *fine]
                    kind += [1] + [0] * len(fine)
                    fold += [f] * (1 + len(fine))
            some = marked(pa.array(made, pa.string()))
            hist[0, 0] += int(np.sum(~some & (np.array(kind, dtype=int) == 0)))
            for i in np.flatnonzero(some):
                key = fold[i], _what_changes(made[i])
                if key not in known:
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    known[key] = best(bm.value[key[0]], key[1])[0]
                hist[kind[i], int(np.clip(np.floor((max(known[key], -_REACH) + _REACH) * _STEPS), 0, size - 1))] += 1
        k, b = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(hist[k, b])], ["k", "b", "n"])

    every = texts.select("text", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)).cast("int").alias("h"), _fold()).where("text <> ''")
    out = np.zeros((2, size), dtype=np.int64)
    for r in every.mapInArrow(run, "k long, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).collect():
        out[r["k"], r["b"]] = r["n"]
    return margin_of(out)


_BROKEN = re.compile("[\x80-\x84\x86-\x9f\ufffd]")


def judge(model: CharModel, margin: float, text: str | None) -> tuple[bool, str | None, str | None, float]:
    """(garbled, restored, chain, gain). U+FFFD and C1 controls can't come from a right decoding: such a text is garbled whatever its gain."""
    if not text or not has_marks(text):
        return False, None, None, 0.0
    gain, chain, t = best(model, text)
    if gain > margin:
        whole = not _BROKEN.search(t) and (not has_marks(t) or best(model, t)[0] <= margin)  # marks by chance don't count
        return True, t if whole else None, chain, gain
    return _BROKEN.search(text) is not None, None, None, max(gain, 0.0)


def garbled_flags(df: DataFrame, text: str, model: CharModel, margin: float) -> DataFrame:
    """``df`` with garbled (boolean), restored, chain and gain; columns of these names are replaced. Null and empty texts aren't garbled."""
    bm = df.sparkSession.sparkContext.broadcast(model)
    schema = "garbled boolean, restored string, chain string, gain double"

    @F.pandas_udf(schema)
    def flags(s: pd.Series) -> pd.DataFrame:
        some = np.flatnonzero(marked(pa.array(s, pa.string(), from_pandas=True)))
        known = {t: judge(bm.value, margin, t) for t in set(s.iloc[some])}
        out: list[tuple] = [(False, None, None, 0.0)] * len(s)
        for i in some:
            out[i] = known[s.iloc[i]]
        return pd.DataFrame(out, columns=["garbled", "restored", "chain", "gain"])

    return df.withColumn("_g", flags(F.col(text))).drop("garbled", "restored", "chain", "gain").select("*", "_g.*").drop("_g")


def with_marks(df: DataFrame, text: str) -> DataFrame:
    """The rows of ``df`` whose ``text`` some chain can change."""
    at = df.columns.index(text)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(batch.column(at))))

    return df.mapInArrow(some, df.schema)


def find_garbled(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(src_table, row id, text, restored, chain, gain) of the garbled rows of the tables given as name -> (rows, id, text column).

    The model is trained on the clean rows of all tables together and the margin validated on held-out ones. ``restored``
    is null where no chain gives a text that is no longer garbled. An id counts once per table, with the first in order of its texts
    that have marks; null ids, null and blank texts have no rows; other columns play no part. Without any clean text the
    margin is 0 and all likelihoods are those of an empty model.
    """
    parts = []
    for name, (df, rid, text) in tables.items():
        parts.append(df.select(F.lit(name).alias("src_table"), F.col(rid).cast("long").alias("row_id"), F.col(text).alias("text")).where("row_id IS NOT NULL AND trim(text) <> ''"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    model = train(rows)
    margin = validate(rows, model)
    # Only rows with marks are shuffled, to be judged once each.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number is kept, where small partitions would be merged: rows are few, but dear
    some = with_marks(rows, "text").repartition(tasks, "src_table", "row_id").groupBy("src_table", "row_id").agg(F.min("text").alias("text"))
    return garbled_flags(some, "text", model, margin).where("garbled").select("src_table", "row_id", "text", "restored", "chain", "gain")
