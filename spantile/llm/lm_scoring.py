"""LM scoring: causal self-attention over subword ids, trained in numpy, with counts of the whole corpus.

The texts are read as words (A-Z lower-cased) and one end; a word is spelled by the ids of a public byte-level BPE.

* Model.  An id attends to the ids of its own window of WINDOW and of the one before, of its text, by vectors and by
  distance (causal, masked, many windows in one product); windows overlap by half, and each id is scored once, as a
  query.  The state predicts the class of the next id; within its class an id has its frequency.  Classes hold ids that
  begin words or ids that go on with them, so the model also says how likely a word ends: the product over a word's ids
  is a distribution over words.
* Blocks.  A block's words are hashed and spelled once; what is stored of it, and read again by each pass, is the ids of
  its distinct words and its texts as numbers of these.
* Ids.  How often an id stands in the training documents, and near which others, is counted in all of them: that gives
  the classes, the ids' shares of these, and which ids have vectors of their own.
* Training.  Every block learns from all of its training documents, and the blocks' weights are averaged by the ids that
  they have learnt from.  Where the weights begin, and only that, comes from a bounded sample on the driver (TRAIN_DOCS,
  TRAIN_BYTES): what the first steps would otherwise be spent on in each block.
* Counts.  Blocks of documents send each distinct word's hash and count, and those of each distinct run of three words,
  by ranges of hashes; each range adds them up and answers every block for its own.  These cover all training documents.
* Scoring.  A word's probability mixes its spelling's with its corpus frequency; to that, as MASS words' worth, come the
  counts of what followed the same two words in the corpus: (count + mass * mixture) / (count of the two words + mass).
  Weight and mass are the best for all training documents, each without its own counts, and spelled by the weights as they
  were before its stretch was learnt from; units are gathered in bins of their four figures for that (``binned``).

Defined cases: a null or empty text is the end alone; with no training documents every word has the same base score;
rows that repeat count, are learnt from and are scored as often; a doc_id that many rows have gives the sample one of
them; an empty table gives an empty result.  Other columns are ignored.  A run of three words is recognised by 54 bits of hashes, 40 of
them of the first two; a word by 64.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, documents, partitions, summed, written
from .jaccard_join import _mixed, _powers
from .packing import encoding
from .suffix_dedup import blocks, unpacked

#: Ids of the vocabulary file; END stands for the end of a text.
IDS, END = 50_257, 50_256
CLASSES, OWN_ROWS, DIMENSION = 64, 2_000, 16
#: Bytes of text that are hashed at once.
HASHED_BYTES = 1 << 19
#: Ids in a window of queries; its keys are these and the window before.  And windows that are worked on at once, in a step
#: of learning and in scoring (where that changes nothing).
WINDOW, AT_ONCE, SCORED_AT_ONCE = 32, 64, 256
#: Documents and bytes that the driver's sample has at most, ids of it that the weights begin with, and epochs.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_TOKENS, EPOCHS = 500, 20_000_000, 500_000, 3
#: One in so many training documents is learnt from by the blocks (1: all of them), at this rate.
SHARE, SHARE_RATE = 1, 0.002
#: Parts in which the blocks' weights are added up, and the number of the part that holds bins instead.
SUM_PARTS, BINS = 64, -1
#: Numbers of the vector that says what stands near an id, and how far that reaches.
NEAR, REACH = 24, 8
#: Bits of the two words and of the third, in the hash of a run of three.
CONTEXT_BITS, NEXT_BITS = 40, 14
#: What the spelling's weight and the mass of the mixture are chosen from.
WEIGHTS, MASSES = np.arange(1, 50) / 50, np.array([0.25, 0.5, 1, 2, 4, 8, 16, 64, 256, 1024, 1e9])
#: Blocks whose hashes, some 700,000 each, would be added up in one task if all were of one range.
RANGE_BLOCKS = 8
UNICODE_SPACE = regex.compile(r"\s")
_END_HASH, _BEGIN, _BEFORE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def is_training(doc_id: int | None) -> bool:
    """The contract learns from rows whose crc32(doc_id as text) mod 7 is not 2."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


# ---------------------------------------------------------------- words and ids


@dataclass
class Words:
    """The distinct words of some texts, and each text's words as numbers of them."""

    hashes: np.ndarray
    spelled: list[bytes]
    number: np.ndarray
    of: np.ndarray
    texts: int

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.of, minlength=self.texts)

    def those(self, texts: np.ndarray) -> Words:
        """The words of some of the texts."""
        keep = texts[self.of]
        return replace(self, number=self.number[keep], of=(np.cumsum(texts) - 1)[self.of[keep]], texts=int(texts.sum()))

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        """All texts' words, each text with an end (number: as many as there are distinct words), and the text that each is of."""
        out = np.full(len(self.number) + self.texts, len(self.hashes), dtype=np.int32)
        out[np.arange(len(self.number)) + self.of] = self.number
        return out, np.repeat(np.arange(self.texts), self.counts + 1)

    def unit_hashes(self) -> np.ndarray:
        return np.append(self.hashes, _END_HASH)


def words_of(texts: list[bytes]) -> Words:
    raw = b" ".join([*texts, b""]).lower()
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hashes, starts_, ends = [], [], []
    # texts in lots of bytes that are hashed at once: what that needs is many times their size
    cuts = sorted({0, len(texts), *np.searchsorted(begins, np.arange(HASHED_BYTES, len(raw), HASHED_BYTES)).tolist()})
    for low, high in zip(cuts, cuts[1:], strict=False):
        h, start, end = _hashed(np.frombuffer(raw, dtype=np.uint8, count=int(begins[high] - begins[low]), offset=int(begins[low])))
        hashes.append(h)
        starts_.append(start + begins[low])
        ends.append(end + begins[low])
    none = np.zeros(0, np.int64)
    h, start, end = np.concatenate([none.astype(np.uint64), *hashes]), np.concatenate([none, *starts_]), np.concatenate([none, *ends])
    number, distinct = pd.factorize(h)
    first = np.zeros(len(distinct), dtype=np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return Words(distinct, [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], number.astype(np.int32), np.searchsorted(begins[:-1], start, side="right") - 1, len(texts))


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, begin and end of each word."""
    space = np.concatenate(([True], (data == 32) | (data >= 9) & (data <= 13)))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    power, back = _powers(1 << max(HASHED_BYTES.bit_length(), len(data).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)), start, end


def grams(words: Words) -> np.ndarray:
    """For each unit of the texts the hash of it and the two before: CONTEXT_BITS of these, then NEXT_BITS of its own."""
    unit, text = words.units()
    h = words.unit_hashes()[unit]
    one, two = np.full(len(h), _BEGIN), np.full(len(h), _BEFORE)
    same = text[1:] == text[:-1]
    one[1:][same] = h[:-1][same]
    two[1:][same] = one[:-1][same]
    context = _mixed(_mixed(two) + one) >> np.uint64(64 - CONTEXT_BITS)
    return (context << np.uint64(NEXT_BITS)) | (_mixed(h) >> np.uint64(64 - NEXT_BITS))


@lru_cache(maxsize=1)
def _initial(ranks: str) -> np.ndarray:
    """Whether an id begins a word."""
    coder = encoding(ranks)
    out = np.zeros(IDS, dtype=bool)
    for i in range(IDS - 1):
        out[i] = coder.decode_single_token_bytes(i)[:1] == b" "
    out[END] = True
    return out


def spellings(words: list[bytes], ranks: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row, and how many each has."""
    coder = encoding(ranks)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    joined = (b" " + b" ".join(words)).decode("utf-8", "replace")
    own: dict[int, list[int]] = {}
    if len(UNICODE_SPACE.findall(joined)) != len(words):
        # some words hold white space beyond ASCII, or end in a letter cut short: these are spelled one by one
        texts = [w.decode("utf-8", "replace") for w in words]
        own = {i: coder.encode_ordinary(" " + t) for i, t in enumerate(texts) if UNICODE_SPACE.search(t)}
        joined = "".join(" a" if i in own else " " + t for i, t in enumerate(texts))
    ids = coder.encode_to_numpy(joined, disallowed_special=()).astype(np.int32)
    begins = np.flatnonzero(_initial(ranks)[ids])
    sizes = np.diff(np.append(begins, len(ids)))
    if own:
        parts = np.split(ids, begins[1:])
        for i, x in own.items():
            parts[i] = np.array(x, dtype=np.int32)
        ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
    return ids, sizes


def stream(words: Words, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' ids, each text between ends: ids, the text each is from, and the word's place in the row of words (-1 for ends)."""
    counts, n_texts = words.counts, words.texts
    # a text is the opening end, its words, the closing end
    units = np.zeros(len(words.number) + 2 * n_texts, dtype=np.int32)
    text = np.repeat(np.arange(n_texts, dtype=np.int32), counts + 2)
    at = np.arange(len(words.number)) + 2 * words.of + 1
    is_word = np.zeros(len(units), dtype=bool)
    is_word[at] = True
    units[at] = words.number
    size = np.where(is_word, sizes[units] if len(sizes) else 0, 1)
    begin = np.concatenate(([0], np.cumsum(sizes)))[units] if len(sizes) else np.zeros(len(units), np.int64)
    ends = np.cumsum(size)
    unit = np.repeat(np.arange(len(units), dtype=np.int32), size)
    inside = np.arange(len(unit)) - (ends - size)[unit]
    flat = np.full(len(unit), END, dtype=np.int32)
    word = is_word[unit]
    flat[word] = ids[(begin[unit] + inside)[word]]
    return flat, text[unit], np.where(inside == 0, unit, -1)


# ---------------------------------------------------------------- model


@dataclass
class Model:
    """Weights (``par``), and each id's row of vectors, class and ln of its share of the class; which classes begin words."""

    par: dict[str, np.ndarray]
    row: np.ndarray
    of_class: np.ndarray
    inside: np.ndarray
    opens: np.ndarray

    def scores(self, ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each id after the first: ln of its probability, and of that of any id that begins a word."""
        n = max(0, len(ids) - 1)
        p, opening = np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.float32)
        both = np.stack((np.ones_like(self.opens), self.opens), 1)
        table = beside(self.par)
        rows, start = self.row[ids[:n]], starts(text[:n])
        for at in range(0, n, WINDOW * SCORED_AT_ONCE):
            high = min(n, at + WINDOW * SCORED_AT_ONCE)
            logits = bounded_logits(self.par, attended(rows, start, at, high, table, self.par["lag"])[0])
            following = ids[at + 1 : high + 1]
            p[at:high] = logits[np.arange(high - at), self.of_class[following]] + self.inside[following]
            sums = np.log(np.exp(logits, out=logits) @ both)
            p[at:high] -= sums[:, 0]
            opening[at:high] = sums[:, 1] - sums[:, 0]
        return p, opening


def starts(text: np.ndarray) -> np.ndarray:
    """For each place where its text begins."""
    out = np.zeros(len(text), dtype=np.int64)
    if len(text):
        out[1:] = np.where(text[1:] != text[:-1], np.arange(1, len(text)), 0)
    return np.maximum.accumulate(out)


@lru_cache(maxsize=1)
def _distance() -> np.ndarray:
    """Of each query of a window from each key of it and the window before."""
    return np.arange(WINDOW)[:, None] + WINDOW - np.arange(2 * WINDOW)[None, :]


def ones_beside(value: np.ndarray) -> np.ndarray:
    """Vectors with a one at their end, so that one product sums them and their weights."""
    return np.concatenate((value, np.ones((len(value), 1), dtype=value.dtype)), 1)


def beside(par: dict[str, np.ndarray]) -> np.ndarray:
    """Each row's query, key, value, a one, and its own share of the state."""
    size = par["x"].shape[1]
    table = par["x"] @ np.concatenate((par["q"], par["k"], par["v"], np.zeros((size, 1), par["x"].dtype), par["s"]), 1)
    table[:, 3 * size] = 1
    return table


def bounded_logits(par: dict[str, np.ndarray], state: np.ndarray) -> np.ndarray:
    """Of each class; no exponential of them overflows, so no row needs its maximum.  state: with a one at its end."""
    logits = state @ np.concatenate((par["out"], par["bias"][None, :]))
    if logits.max(initial=0) > 70 or logits.min(initial=0) < -70:
        np.clip(logits, -70, 70, out=logits)
    return logits


def _product(x: np.ndarray, y: np.ndarray, lot: int = 512) -> np.ndarray:
    """x.T @ y in lots of rows: long and narrow products are slow."""
    return sum(x[at : at + lot].T @ y[at : at + lot] for at in range(0, len(x), lot))


def _by_window(x: np.ndarray, windows: int) -> np.ndarray:
    """The columns of each window and the one before, as a view."""
    step, size = x.strides
    return np.ndarray((windows, x.shape[0], 2 * WINDOW), x.dtype, x, 0, (WINDOW * size, step, size))


def attend(rows: np.ndarray, start: np.ndarray, low: int, high: int, query, key, value, skip, lag):
    """As ``attended``, of separate tables (value: with ones beside it), and states without a one."""
    state, *others = attended(rows, start, low, high, np.concatenate((query, key, value, skip), 1), lag)
    return state[:, :-1], *others


def attended(rows: np.ndarray, start: np.ndarray, low: int, high: int, table: np.ndarray, lag: np.ndarray):
    """States of the places low to high: what each is itself, and what it attends to in its window and the one before.

    low is the first place of a window; places beyond high are empty; table: see ``beside``.  Returns the states, each with a
    one at its end, and what the gradients need: what is attended to, the weights (their sums not one) and their sums, the queries by window, the
    keys and the values by window as columns, and the row of each place from the window before on.
    """
    n, windows, size = high - low, -(-(high - low) // WINDOW), table.shape[1] // 4
    own = np.zeros((windows + 1) * WINDOW, dtype=np.int64)
    before = min(WINDOW, low)
    own[WINDOW - before : WINDOW + n] = rows[low - before : high]
    there = table.take(own, axis=0)
    q = there[WINDOW:, :size].reshape(windows, WINDOW, size)
    columns = np.ascontiguousarray(there[:, size : 3 * size + 1].T)
    k, v = _by_window(columns[:size], windows), _by_window(columns[size:], windows)
    distance = _distance()
    w = np.matmul(q, k)
    w += np.where(distance >= 0, lag[np.maximum(distance, 0)], -1e9).astype(w.dtype)
    if w.max(initial=0) > 60:
        np.minimum(w, 60, out=w)
    np.exp(w, out=w)
    # keys of another text, in the windows that have any
    begins = np.full(windows * WINDOW, -1, dtype=np.int64)
    begins[:n] = start[low:high] - low + WINDOW
    begins = begins.reshape(windows, WINDOW) - np.arange(windows)[:, None] * WINDOW
    some = np.flatnonzero((begins > 0).any(1))
    if len(some):
        w[some] *= np.arange(2 * WINDOW)[None, None, :] >= begins[some][:, :, None]
    seen = np.matmul(w, v.transpose(0, 2, 1)).reshape(windows * WINDOW, -1)[:n]
    total = seen[:, size:]
    found = seen[:, :size] / total
    state = np.ones((n, size + 1), dtype=w.dtype)
    np.add(found, there[WINDOW : WINDOW + n, 3 * size + 1 :], out=state[:, :size])
    return state, found, w, total, q, k, v, own


def gradients(par: dict[str, np.ndarray], rows: np.ndarray, start: np.ndarray, low: int, high: int, following: np.ndarray, keep: np.ndarray, opens: np.ndarray | None = None, told: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Of the mean loss of the places low to high that are kept; following: the class that comes after each.

    told: gets the ln of each class's probability, and of that of any class of ``opens``.
    """
    x, n, size = par["x"], high - low, par["x"].shape[1]
    state, found, w, total, q, k, v, own = attended(rows, start, low, high, beside(par), par["lag"])
    p, each = bounded_logits(par, state), (np.arange(n), following)
    said = p[each]
    np.exp(p, out=p)
    sums = p @ np.stack((np.ones_like(par["bias"]), np.zeros_like(par["bias"]) if opens is None else opens.astype(p.dtype)), 1)
    if told is not None:
        told[0, low:high] = said - np.log(sums[:, 0])
        told[1, low:high] = np.log(sums[:, 1] / sums[:, 0] + 1e-30)
    share = (keep / max(1, keep.sum())).astype(p.dtype)
    p *= (share / sums[:, 0])[:, None]
    p[each] -= share
    logit = _product(state, p)
    windows, past = len(q), np.zeros((WINDOW, size), dtype=p.dtype)
    # the last window may be partly empty
    ds = np.zeros((windows * WINDOW, size), dtype=p.dtype)
    np.matmul(p, np.ascontiguousarray(par["out"].T), out=ds[:n])
    # of a weight: the value's product with ds, less that of what is attended to, which the one beside the value takes away
    scaled = np.zeros((windows * WINDOW, size + 1), dtype=p.dtype)
    np.divide(ds[:n], total, out=scaled[:n, :size])
    scaled[:n, size] = np.einsum("ij,ij->i", ds[:n], found) / -total[:, 0]
    scaled = scaled.reshape(windows, WINDOW, size + 1)
    dscore = np.matmul(scaled, v)
    dscore *= w

    def of_keys(by: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Of each place, which is a key in its own window and in the next."""
        by = by.transpose(0, 2, 1)
        out = np.concatenate((past, np.matmul(by[:, WINDOW:], to).reshape(-1, size)))
        out[:-WINDOW] += np.matmul(by[:, :WINDOW], to).reshape(-1, size)
        return out

    every = np.concatenate((np.concatenate((past, np.matmul(dscore, k.transpose(0, 2, 1)).reshape(-1, size))), of_keys(dscore, q), of_keys(w, scaled[:, :, :size]), np.concatenate((past, ds))), 1)
    grad = {"out": logit[:-1], "bias": logit[-1]} | dict(zip("qkvs", np.split(_product(x.take(own, axis=0), every), 4, axis=1), strict=True))
    dx = (every @ np.ascontiguousarray(np.concatenate([par[name] for name in "qkvs"], 1).T)).T.astype(np.float64)
    grad["x"] = np.stack([np.bincount(own, weights=d, minlength=len(x)) for d in dx]).T
    distance = _distance()
    grad["lag"] = np.bincount(np.maximum(distance, 0).ravel(), weights=(dscore.sum(0) * (distance >= 0)).ravel(), minlength=2 * WINDOW)
    return grad


def learn(par: dict[str, np.ndarray], rows: np.ndarray, text: np.ndarray, classed: np.ndarray, epochs: int, rate: float, seed: int = 5, opens: np.ndarray | None = None, told: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The weights after Adam over stretches of windows.  classed: the class of each id; told: see ``gradients``."""
    rng, start = np.random.default_rng(seed), starts(text)
    # all weights are one vector, of which each has a view
    every = np.concatenate([a.ravel() for a in par.values()])
    cuts = np.cumsum([a.size for a in par.values()])[:-1]
    par = {name: x.reshape(a.shape) for (name, a), x in zip(par.items(), np.split(every, cuts), strict=True)}
    mean, var = np.zeros_like(every), np.zeros_like(every)
    step, size = 0, WINDOW * AT_ONCE
    begins = np.arange(0, max(1, len(rows) - 1), size)
    for epoch in range(epochs):
        for low in rng.permutation(begins):
            high = min(len(rows) - 1, low + size)
            keep = text[low:high] == text[low + 1 : high + 1]
            if high <= low or not keep.any():
                continue
            grad = gradients(par, rows, start, low, high, classed[low + 1 : high + 1], keep, opens, told)
            g = np.concatenate([grad[name].ravel() for name in par], dtype=np.float32, casting="same_kind")
            step += 1
            now = rate * (1 - 0.9 * epoch / max(1, epochs))
            mean *= 0.9
            mean += 0.1 * g
            var *= 0.99
            g *= g
            g *= 0.01
            var += g
            root = np.sqrt(var)
            root *= (1 - 0.99**step) ** -0.5
            root += 1e-6
            np.divide(mean, root, out=root)
            root *= now / (1 - 0.9**step)
            every -= root
    return par


def classes(counts: np.ndarray, initial: np.ndarray, around: np.ndarray | None = None, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each id's input row and class; and which classes begin words.

    Ids are classed by what stands near them (k-means), so that a class is of one language where there are several;
    those that the training documents do not have are the kind's last class, as all are without ``around``.
    """
    weight = counts + 0.5
    rank = np.empty(IDS, dtype=np.int32)
    rank[np.lexsort((np.arange(IDS), -weight))] = np.arange(IDS)
    seen = np.zeros(IDS) if around is None else counts
    if around is not None:
        # rare ids are little sure of where they belong
        vectors = (around / (np.linalg.norm(around, axis=1, keepdims=True) + 1e-9) * (seen / (seen + 2))[:, None]).astype(np.float32)
    of_class, opens, base = np.zeros(IDS, dtype=np.int32), np.zeros(CLASSES, dtype=np.float32), 1
    opens[0] = 1
    rng = np.random.default_rng(seed)
    for kind, n in ((initial & (np.arange(IDS) != END), CLASSES // 2 - 1), (~initial, CLASSES // 2)):
        of_class[kind] = base + n - 1
        own = np.flatnonzero(kind & (seen > 0))
        if len(own):
            x, w = vectors[own], seen[own]
            centre = x[rng.choice(len(own), size=n - 1, p=w / w.sum())]
            for _ in range(12):
                near = (x @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
                total = np.bincount(near, weights=w, minlength=n - 1)
                sums = np.stack([np.bincount(near, weights=w * x[:, j], minlength=n - 1) for j in range(x.shape[1])], 1)
                centre = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-9)[:, None], centre).astype(np.float32)
            of_class[own] = base + near
        opens[base : base + n] = kind[initial].any()
        base += n
    return np.where(rank < OWN_ROWS, rank, OWN_ROWS + of_class).astype(np.int32), of_class, opens


def shares(counts: np.ndarray, of_class: np.ndarray) -> np.ndarray:
    """ln of each id's share of its class."""
    weight = counts + 0.5
    return np.log(weight / np.bincount(of_class, weights=weight, minlength=CLASSES)[of_class]).astype(np.float32)


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """A vector for each id, of which sums tell ids apart."""
    return np.random.default_rng(1).normal(size=(IDS, NEAR)).astype(np.float32)


def neighbours(ids: np.ndarray, text: np.ndarray, lot: int = 1 << 16) -> np.ndarray:
    """For each id of the vocabulary the sum of the codes of what stands within REACH of it, in its text."""
    code, out = _codes().T.copy(), np.zeros((NEAR, IDS))
    # REACH places of no code (id IDS) between texts, before the first and after the last: then what is near is a slice
    gap = np.zeros(len(ids), dtype=np.int64)
    gap[1:] = text[1:] != text[:-1]
    apart = np.full(len(ids) + REACH * (2 + int(gap.sum())), IDS, dtype=np.int64)
    apart[np.arange(len(ids)) + REACH * (1 + np.cumsum(gap))] = ids
    for at in range(REACH, len(apart) - REACH, lot):
        there = apart[at - REACH : min(at + lot, len(apart) - REACH) + REACH]
        own = there[REACH:-REACH]
        sums = np.zeros(len(there) + 1)
        for j in range(NEAR):
            x = np.append(code[j], np.float32(0))[there]
            np.cumsum(x, dtype=np.float64, out=sums[1:])
            near = sums[2 * REACH + 1 :] - sums[: -2 * REACH - 1]
            near -= x[REACH:-REACH]
            out[j] += np.bincount(own, weights=near, minlength=IDS + 1)[:IDS]
    return np.ascontiguousarray(out.T)


def first_model(sample: Words, counts: np.ndarray, near: np.ndarray, ranks: str, seed: int = 5) -> Model:
    """The model of the corpus's ids, with weights that have learnt from the sample."""
    flat, text, _ = stream(sample, *spellings(sample.spelled, ranks))
    flat, text = flat[:TRAIN_TOKENS], text[:TRAIN_TOKENS]
    row, of_class, opens = classes(counts, _initial(ranks), near)
    rng, d = np.random.default_rng(seed), DIMENSION
    mass = np.bincount(of_class, weights=counts + 0.5, minlength=CLASSES)
    par = {
        "x": rng.normal(0, 0.3, (OWN_ROWS + CLASSES, d)), "q": rng.normal(0, d**-0.5, (d, d)), "k": rng.normal(0, d**-0.5, (d, d)), "v": rng.normal(0, d**-0.5, (d, d)),
        "s": np.eye(d), "lag": -0.1 * np.arange(2 * WINDOW), "out": rng.normal(0, 0.1, (d, CLASSES)), "bias": np.log((mass + 1e-9) / mass.sum()),
    }
    par = {name: a.astype(np.float32) for name, a in par.items()}
    if len(flat) > 1:
        par = learn(par, row[flat], text, of_class[flat], EPOCHS, 0.01)
    return Model(par, row, of_class, shares(counts, of_class), opens)


# ---------------------------------------------------------------- what all training documents say


def _in_parts(held: np.ndarray) -> pd.DataFrame:
    squeeze = zstandard.ZstdCompressor(level=1)
    return pd.DataFrame({"part": range(SUM_PARTS), "held": [squeeze.compress(x.tobytes()) for x in np.array_split(held.astype(np.float64), SUM_PARTS)]})


def _total(parts: DataFrame) -> np.ndarray | None:
    rows = summed(parts, "float64").collect()  # SUM_PARTS rows
    return np.concatenate([np.frombuffer(unpacked(r["held"]), dtype=np.float64) for r in sorted(rows, key=lambda r: r["part"])]) if rows else None


def _ids(training: Callable[[int | None], bool]):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, near = np.zeros(IDS), np.zeros((IDS, NEAR))
        for batch in batches:
            for r in batch.itertuples(index=False):
                words, spelling, ids = _coded(r)
                flat, text, _ = stream(words.those(np.array([training(i) for i in ids], dtype=bool)), *spelling)
                seen += np.bincount(flat, minlength=IDS)
                near += neighbours(flat, text)
        if seen.any():
            yield _in_parts(np.concatenate([seen, near.ravel().astype(np.float32)]))

    return count


def counted_ids(coded: DataFrame, training: Callable[[int | None], bool]) -> tuple[np.ndarray, np.ndarray]:
    """How often the training documents have each id, and the sum of what stands near it."""
    total = _total(coded.mapInPandas(_ids(training), "part int, held binary"))
    return (np.zeros(IDS), np.zeros((IDS, NEAR))) if total is None else (total[:IDS], total[IDS:].reshape(IDS, NEAR))


def _learning(handed, ranks: str, training: Callable[[int | None], bool]):
    def train(coded: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        model, none = handed.value, pd.DataFrame({"part": [], "held": []})
        if not len(coded):
            return none
        words, spelling, ids = _coded(next(coded.itertuples(index=False)), ranks)
        learns = np.array([training(i) for i in ids], dtype=bool)
        if SHARE > 1:
            learns &= np.array([xxhash.xxh32_intdigest(words.hashes[x].tobytes()) % SHARE == 0 for x in np.split(words.number, np.cumsum(words.counts)[:-1])], dtype=bool)
        own_words = words.those(learns)
        flat, text, unit = stream(own_words, *spelling)
        if len(flat) < 2:
            return none
        said = np.zeros((2, len(flat) - 1), dtype=np.float32)
        par = learn(model.par, model.row[flat], text, model.of_class[flat], 1, SHARE_RATE, opens=model.opens, told=said)
        own = _by_unit(said[0] + model.inside[flat[1:]], said[1], unit, own_words.counts)
        bins = binned(own, *without_own(words, answers, learns))
        held = np.concatenate([[len(flat)], *((len(flat) * par[name]).ravel() for name in sorted(par))])
        return pd.concat([_in_parts(held), pd.DataFrame({"part": [BINS], "held": [zstandard.ZstdCompressor(level=1).compress(bins.tobytes())]})])

    return train


def trained(learnt: DataFrame, model: Model) -> Model:
    """The model after all blocks have learnt from their training documents: the mean of their weights by the ids of each."""
    total = _total(learnt.where(F.col("part") != BINS))
    if total is None:
        return model
    names, mean = sorted(model.par), total[1:] / total[0]
    cuts = np.cumsum([model.par[name].size for name in names])[:-1]
    return replace(model, par={name: x.astype(np.float32).reshape(model.par[name].shape) for name, x in zip(names, np.split(mean, cuts), strict=True)})


# ---------------------------------------------------------------- corpus counts


def _read(row) -> tuple[list[bytes], list[int | None]]:
    data, out, at = unpacked(row.data), [], 0
    for n in row.sizes:
        out.append(data[at : at + n])
        at += n
    return out, _doc_ids(row)


def _doc_ids(row) -> list[int | None]:
    return [None if i is None or i != i else int(i) for i in row.ids]


@lru_cache(maxsize=1)
def _letters(ranks: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids in a row, where each id's begin, and how many it has."""
    coder = encoding(ranks)
    held = [coder.decode_single_token_bytes(i) for i in range(IDS - 1)] + [b""]
    sizes = np.array([len(x) for x in held])
    return np.frombuffer(b"".join(held), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def spelled_hashes(ids: np.ndarray, ranks: str) -> np.ndarray:
    """The hashes of the words that ids spell, each with a space before it."""
    letters, begins, sizes = _letters(ranks)
    size = sizes[ids]
    ends = np.cumsum(size)
    data = letters[np.arange(int(size.sum())) + np.repeat(begins[ids] - (ends - size), size)]
    space = np.flatnonzero(data == 32)
    # lots of words that are hashed at once
    cuts = np.unique(np.append(space[np.searchsorted(space, np.arange(0, len(data), HASHED_BYTES)).clip(max=len(space) - 1)], len(data))) if len(data) else []
    return np.concatenate([np.zeros(0, np.uint64), *(_hashed(np.append(data[a:b], np.uint8(32)))[0] for a, b in zip(cuts, cuts[1:], strict=False))])


def _planes(x: np.ndarray) -> bytes:
    """Numbers of four bytes, all their first bytes first."""
    return np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _coding(ranks: str):
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for r in batch.itertuples(index=False):
                words = words_of(_read(r)[0])
                ids, sizes = spellings(words.spelled, ranks)
                held = {"spelled": squeeze(ids.astype(np.uint16).tobytes()), "number": squeeze(_planes(words.number)), "counts": squeeze(_planes(words.counts)), "spelling": squeeze(_planes(sizes))}
                # ids spell all words but those that are no UTF-8
                again = spelled_hashes(ids, ranks)
                held["hashes"] = None if np.array_equal(again, words.hashes) else words.hashes.tobytes()
                yield pd.DataFrame({"block": [r.block], "ids": [_doc_ids(r)]} | {name: [x] for name, x in held.items()})

    return code


_CODED = "block long, ids array<long>, spelled binary, number binary, counts binary, spelling binary, hashes binary"


def _coded(row, ranks: str | None = None) -> tuple[Words, tuple[np.ndarray, np.ndarray], list[int | None]]:
    """A block's words (with ranks: and their hashes), what ``spellings`` says of them, and its texts' doc_ids."""
    number, counts, sizes = (np.ascontiguousarray(np.frombuffer(unpacked(x), dtype=np.uint8).reshape(4, -1).T).view(np.int32).ravel() for x in (row.number, row.counts, row.spelling))
    ids = np.frombuffer(unpacked(row.spelled), dtype=np.uint16).astype(np.int32)
    hashes = np.frombuffer(row.hashes, dtype=np.uint64) if row.hashes is not None else spelled_hashes(ids, ranks) if ranks else np.zeros(0, np.uint64)
    return Words(hashes, [], number, np.repeat(np.arange(len(counts)), counts), len(counts)), (ids, sizes.astype(np.int64)), _doc_ids(row)


def thin(keys: np.ndarray) -> bytes:
    """Sorted keys, by what each adds to the one before, byte by byte."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes())


def thick(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unpacked(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def by_range(keys: np.ndarray, width: int, bits: int) -> list[int]:
    """Where each of 2 ** bits ranges of sorted keys of ``width`` bits ends and the next begins."""
    return np.searchsorted(keys >> np.uint64(width - bits) if bits else np.zeros(len(keys)), np.arange((1 << bits) + 1)).tolist()


@dataclass
class Asked:
    """What a block asks the corpus for: its distinct words and runs of three, sorted; and each unit's place among them."""

    words: np.ndarray
    word_of: np.ndarray
    grams: np.ndarray
    gram_of: np.ndarray

    @classmethod
    def of(cls, words: Words) -> Asked:
        unit, _ = words.units()
        hashes = words.unit_hashes()
        order = np.argsort(hashes)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        number, found = pd.factorize(grams(words))
        sort = np.argsort(found)
        gram_place = np.empty(len(sort), dtype=np.int64)
        gram_place[sort] = np.arange(len(sort))
        return cls(hashes[order], place[unit], found[sort], gram_place[number])

    def rows(self, block: int, learns: np.ndarray, bits: int) -> pd.DataFrame:
        """A row for each range; learns: which units are of training documents."""
        squeeze = zstandard.ZstdCompressor(level=1).compress
        n, m = (np.bincount(of[learns], minlength=len(keys)).astype(np.uint32) for of, keys in ((self.word_of, self.words), (self.gram_of, self.grams)))
        w, g = by_range(self.words, 64, bits), by_range(self.grams, CONTEXT_BITS + NEXT_BITS, bits)
        rows = [(p, block, thin(self.words[a:b]), squeeze(n[a:b].tobytes()), thin(self.grams[c:d]), squeeze(m[c:d].tobytes())) for p, (a, b, c, d) in enumerate(zip(w, w[1:], g, g[1:], strict=False)) if b > a or d > c]
        return pd.DataFrame(rows, columns=["part", "block", "words", "counts", "grams", "gram_counts"])


_ASKED = "part int, block long, words binary, counts binary, grams binary, gram_counts binary"
_ANSWERS = "part int, block long, counts binary, gram_counts binary, contexts binary, tokens long, words long"


def _counting(bits: int, training: Callable[[int | None], bool], ranks: str = ""):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                # blocks of texts, or (with ranks) of their words
                words, ids = _coded(r, ranks)[::2] if ranks else (words_of(_read(r)[0]), _doc_ids(r))
                yield Asked.of(words).rows(r.block, np.array([training(i) for i in ids], dtype=bool)[words.units()[1]], bits)

    return count


def _adding(part: pd.DataFrame) -> pd.DataFrame:
    """The corpus counts of a range of hashes, for each block its own words and runs; and the range's tokens and words."""
    squeeze = zstandard.ZstdCompressor(level=1).compress

    def added(keys: str, counts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        held = [thick(x) for x in part[keys]]
        number, own = pd.factorize(np.concatenate(held))
        total = np.bincount(number, weights=np.concatenate([np.frombuffer(unpacked(x), dtype=np.uint32) for x in part[counts]]), minlength=len(own))
        return own, total, number, np.cumsum([0, *map(len, held)]).tolist()

    own, total, number, ends = added("words", "counts")
    words = total[number].astype(np.uint64)
    grams, seen, gram_of, gram_ends = added("grams", "gram_counts")
    context_of, found = pd.factorize(grams >> np.uint64(NEXT_BITS))
    context = np.bincount(context_of, weights=seen, minlength=len(found))[context_of][gram_of].astype(np.uint32)
    seen = seen[gram_of].astype(np.uint32)
    first = np.array([1] + [0] * (len(part) - 1))
    answers = {"counts": [squeeze(words[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)]}
    answers |= {name: [squeeze(x[a:b].tobytes()) for a, b in zip(gram_ends, gram_ends[1:], strict=False)] for name, x in (("gram_counts", seen), ("contexts", context))}
    return pd.DataFrame({"part": part["part"], "block": part["block"], **answers, "tokens": first * int(total.sum()), "words": first * int((total > 0).sum())})


def told(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the corpus has of a block's words, runs and their first two words, in the order of ``Asked``."""
    rows = rows.sort_values("part")
    return tuple(np.concatenate([np.zeros(0)] + [np.frombuffer(unpacked(x), dtype=kind).astype(np.float64) for x in rows[name]]) for name, kind in (("counts", np.uint64), ("gram_counts", np.uint32), ("contexts", np.uint32)))


# ---------------------------------------------------------------- scores


def spelled(model: Model, words: Words, spelling: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """ln of the model's probability of each unit of the texts.

    A word's probability is that of its ids, the first among those that may begin a word, and that no id goes on with it.
    """
    flat, text, unit = stream(words, *spelling)
    return _by_unit(*model.scores(flat, text), unit, words.counts)


def _by_unit(p: np.ndarray, opening: np.ndarray, unit: np.ndarray, count: np.ndarray) -> np.ndarray:
    """ln of the probability of each unit from what ``Model.scores`` says of each id; count: words of each text."""
    head = np.flatnonzero(unit >= 0)
    product = np.add.reduceat(np.concatenate(([0.0], p.astype(np.float64))), head) if len(head) else np.zeros(0)
    begin = np.concatenate(([0.0], opening))[head] if len(head) else np.zeros(0)
    closing = np.cumsum(count + 2) - 1
    is_word = np.ones(len(head), dtype=bool)
    is_word[closing], is_word[closing - count - 1] = False, False
    after = np.zeros(len(head))
    after[:-1] = begin[1:]
    out = product - begin + np.where(is_word, after, 0.0)
    return np.delete(out, closing - count - 1)


def mixed(own: np.ndarray, seen: np.ndarray, tokens: float, gram: np.ndarray, context: np.ndarray, weight: float, mass: float) -> np.ndarray:
    """The probability of each unit from its spelling's (ln), its count and that of its run and of the two words before."""
    base = weight * np.exp(own) + (1 - weight) * seen / max(1, tokens)
    return (gram + mass * base) / (context + mass) + 1e-300


def own_counts(place: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each unit's text has what the unit has at ``place``."""
    number, found = pd.factorize(place.astype(np.int64) * (int(text.max(initial=0)) + 1) + text)
    return np.bincount(number, minlength=len(found))[number].astype(np.float64)


def without_own(words: Words, answers: pd.DataFrame, learns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the units of a block's texts that are learnt from, the counts of words, runs and contexts that other texts make."""
    asked, (counts, gram, context) = Asked.of(words), told(answers)
    _, text = words.units()
    keep = learns[text]
    text, word, run = text[keep], asked.word_of[keep], asked.gram_of[keep]
    seen = np.maximum(0, counts[word] - own_counts(word, text))
    runs = np.maximum(0, gram[run] - own_counts(run, text))
    first = pd.factorize(asked.grams[run] >> np.uint64(NEXT_BITS))[0]
    return seen, runs, np.maximum(runs, context[run] - own_counts(first, text))


def binned(own: np.ndarray, seen: np.ndarray, runs: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Units in bins, by whole numbers of ln and by powers of two: key, units, and the sums of the four figures."""
    key = np.clip(-own, 0, 127).astype(np.int64)
    for x in (seen, runs, contexts):
        key = (key << 7) | np.where(x > 0, 1 + np.log2(np.maximum(x, 1)), 0).astype(np.int64)
    keys, number = np.unique(key, return_inverse=True)
    return np.stack([keys.astype(np.float64), *(np.bincount(number, weights=x, minlength=len(keys)) for x in (np.ones(len(own)), own, seen, runs, contexts))])


def _bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for held in batch["held"]:
            yield pd.DataFrame(np.frombuffer(unpacked(held), dtype=np.float64).reshape(6, -1).T, columns=["key", "n", "own", "seen", "runs", "contexts"])


def fitted(learnt: DataFrame, tokens: int) -> tuple[float, float]:
    """The spelling's weight and the mass that are best for all units learnt from, each at the means of its bin."""
    names = ["n", "own", "seen", "runs", "contexts"]
    bins = learnt.where(F.col("part") == BINS).select("held").mapInPandas(_bins, "key double, " + ", ".join(f"{x} double" for x in names))
    rows = bins.groupBy("key").agg(*[F.sum(x).alias(x) for x in names]).orderBy("key").collect()  # by logarithms: some thousands
    if not rows:
        return 0.5, 1.0
    n, *sums = np.array([[r[x] for x in names] for r in rows]).T
    own, seen, runs, contexts = (x / n for x in sums)
    best = max((float((n * np.log(mixed(own, seen, tokens, runs, contexts, w, m))).sum()), w, m) for w in WEIGHTS for m in MASSES)
    return float(best[1]), float(best[2])


def _scoring(handed, weight: float, mass: float, totals: tuple[int, int], ranks: str, training: Callable[[int | None], bool]):
    tokens, distinct = totals

    def score(coded: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(coded):
            return pd.DataFrame(columns=columns)
        words, spelling, ids = _coded(next(coded.itertuples(index=False)), ranks)
        asked, (counts, gram, context) = Asked.of(words), told(answers)
        seen = counts[asked.word_of]
        p = mixed(spelled(handed.value, words, spelling), seen, tokens, gram[asked.gram_of], context[asked.gram_of], weight, mass)
        _, text = words.units()
        out = pd.DataFrame({"doc_id": pd.array([pd.NA if i is None else i for i in ids], dtype="Int64"), "held_out": [not training(i) for i in ids], "n_tokens": words.counts + 1, "train_tokens": tokens})
        for name, x in (("n_known", (seen > 0).astype(float)), ("base_score", np.log10((seen + 1) / (tokens + distinct + 1))), ("score", np.log10(p))):
            out[name] = np.bincount(text, weights=x, minlength=words.texts)
        return out.astype({"n_known": "int64"})[columns]

    return score


def _each(training: Callable[[int | None], bool]):
    def learns(ids: pd.Series) -> pd.Series:
        return pd.Series([training(int(i)) for i in ids], dtype="bool")

    return learns


def sampled(docs: DataFrame, training: Callable[[int | None], bool]) -> list[bytes]:
    """Whole texts of at most TRAIN_DOCS training documents, in order of a hash, so many as TRAIN_BYTES allow; one for an id."""
    learns = F.pandas_udf(_each(training), "boolean")
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & learns("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    held = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("held", held).where(F.col("held") <= TRAIN_BYTES).collect()
    return [(r["text"] or "").encode("utf-8", "surrogatepass") for r in sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))]


def lm_scores(docs: DataFrame, training: Callable[[int | None], bool] = is_training, ranks: str | None = None) -> DataFrame:
    """Base score and score of each text, learnt from the rows whose doc_id is for training."""
    spark = docs.sparkSession
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    # each word is hashed and spelled once; what follows reads no text
    coded = written(blocks(docs).mapInPandas(_coding(ranks), _CODED))
    # as many ranges as shuffle partitions, and more where a range would be of more than RANGE_BLOCKS blocks' hashes
    bits = max((partitions(spark) - 1).bit_length(), (-(-coded.count() // RANGE_BLOCKS) - 1).bit_length(), 0)
    model = first_model(words_of(sampled(docs, training)), *counted_ids(coded, training), ranks)
    asked = coded.mapInPandas(_counting(bits, training, ranks), _ASKED)
    answers = written(asked.groupBy("part").applyInPandas(_adding, _ANSWERS))
    sums = answers.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("tokens", "words")]).first()
    given = answers.select("block", "part", "counts", "gram_counts", "contexts")
    beside_answers = lambda: coded.groupBy("block").cogroup(given.groupBy("block"))
    learnt = written(beside_answers().applyInPandas(_learning(spark.sparkContext.broadcast(model), ranks, training), "part int, held binary"))
    model = trained(learnt, model)
    weight, mass = fitted(learnt, sums[0])
    handed = spark.sparkContext.broadcast(model)
    return beside_answers().applyInPandas(_scoring(handed, weight, mass, (sums[0], sums[1]), ranks, training), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark, 1_000)
    return lm_scores(documents(spark, sf_dir))
