"""Compiled dictionaries: the five binary files that analysers of the lattice family read, written and opened.

``compile_dictionary`` makes them of a folder of definitions (lexicon CSVs, matrix.def, char.def, unk.def, dicrc);
``open_dictionary`` and ``open_packed`` give what the lattice tokenizer needs.  All of it happens on the driver: a
dictionary is some tens of megabytes, and its size is checked before it is handed to the workers.

A lexicon file is a header, a double array over the surfaces' bytes, the words' tokens and their feature records.
"""

from __future__ import annotations

import csv
import glob
import os
import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

from .dictionary import DICTIONARY_VERSION, FILES, DictionaryError, unpack

# The header's key, the kinds of lexicons, and the records' layouts.
HEADER_KEY, SYSTEM, USER, UNKNOWN = 0xEF718F77, 0, 1, 2
HEADER, CHARSET_BYTES, NAME_BYTES, CODE_POINTS = "<10I", 32, 32, 0xFFFF
TOKEN = np.dtype([("left", "<u2"), ("right", "<u2"), ("posid", "<u2"), ("cost", "<i2"), ("feature", "<u4"), ("compound", "<u4")])
UNIT = np.dtype([("base", "<i4"), ("check", "<u4")])
#: Words that a dictionary may have when it is opened, over all of its lexicons.
MOST_WORDS = 4_000_000


@dataclass(frozen=True)
class Word:
    surface: str
    left: int
    right: int
    cost: int
    feature: str
    posid: int = 0


@dataclass(frozen=True)
class Category:
    """How unknown words of a class of characters are made: also where the dictionary has words, of whole runs, up to a length."""

    name: str
    invoke: bool
    group: bool
    length: int


# ---------------------------------------------------------------- double array


def double_array(keys: list[bytes], values: list[int]) -> np.ndarray:
    """Units of base and check for sorted, different keys."""
    size = 1 << 12
    base, check = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    taken, first, used = {0}, 1, np.zeros(size, dtype=bool)
    used[0] = True

    def children(low: int, high: int, depth: int) -> list[tuple[int, int, int]]:
        """(code, first key, last key + 1) of what follows ``depth`` bytes; code 0 is the key's end."""
        out: list[tuple[int, int, int]] = []
        for i in range(low, high):
            code = keys[i][depth] + 1 if depth < len(keys[i]) else 0
            if not out or out[-1][0] != code:
                out.append((code, i, i + 1))
            else:
                out[-1] = (code, out[-1][1], i + 1)
        return out

    def place(codes: list[int]) -> int:
        """The first begin at which all codes are free."""
        nonlocal size, base, check, used, first
        at = max(first, codes[0] + 1)
        while True:
            if at + 256 + 1 >= size:
                base, check, used = (np.concatenate((x, np.zeros(size, dtype=x.dtype))) for x in (base, check, used))
                size *= 2
            begin = at - codes[0]
            if not used[at] and begin > 0 and begin not in taken:
                if begin + codes[-1] + 1 >= size:
                    base, check, used = (np.concatenate((x, np.zeros(size, dtype=x.dtype))) for x in (base, check, used))
                    size *= 2
                if not any(used[begin + c] for c in codes):
                    break
            at += 1
        while first < size - 1 and used[first]:
            first += 1
        taken.add(begin)
        for c in codes:
            used[begin + c], check[begin + c] = True, begin
        return begin

    # (slot that gets the begin, keys, depth)
    left = [(0, 0, len(keys), 0)]
    while left:
        slot, low, high, depth = left.pop()
        found = children(low, high, depth)
        begin = place([c for c, _, _ in found])
        base[slot] = begin
        for code, a, b in found:
            if code == 0:
                base[begin] = -values[a] - 1
            else:
                left.append((begin + code, a, b, depth + 1))
    end = int(np.flatnonzero(used)[-1]) + 1 + 256
    out = np.zeros(min(end, size), dtype=UNIT)
    out["base"], out["check"] = base[: len(out)], check[: len(out)]
    return out


def keys_of(units: np.ndarray) -> list[tuple[bytes, int]]:
    """All keys of a double array with their values, by breadth."""
    base, check = units["base"].astype(np.int64), units["check"].astype(np.int64)
    out: list[tuple[bytes, int]] = []
    front = [(int(base[0]), b"")] if len(base) else []
    while front:
        begins = np.array([b for b, _ in front], dtype=np.int64)
        ends = (begins < len(base)) & (check[np.minimum(begins, len(base) - 1)] == begins) & (base[np.minimum(begins, len(base) - 1)] < 0)
        for i in np.flatnonzero(ends).tolist():
            out.append((front[i][1], -int(base[begins[i]]) - 1))
        places = begins[:, None] + np.arange(256) + 1
        inside = places < len(base)
        places = np.minimum(places, len(base) - 1)
        node, byte = np.nonzero(inside & (check[places] == begins[:, None]))
        front = [(int(base[places[i, b]]), front[i][1] + bytes([b])) for i, b in zip(node.tolist(), byte.tolist(), strict=True)]
    return out


# ---------------------------------------------------------------- lexicons


def lexicon_bytes(words: Iterable[Word], kind: int, left_size: int, right_size: int, charset: str = "utf-8") -> bytes:
    coded = sorted(((w.surface.encode(charset), w) for w in words), key=lambda x: x[0])
    groups: list[tuple[bytes, list[Word]]] = []
    for key, w in coded:
        if not groups or groups[-1][0] != key:
            groups.append((key, []))
        groups[-1][1].append(w)
    tokens, features, at = np.zeros(len(coded), dtype=TOKEN), [], 0
    keys, values, n = [], [], 0
    for key, own in groups:
        if not key:
            raise DictionaryError("a word without a surface")
        if len(own) > 255:
            raise DictionaryError(f"{key.decode(charset)!r} has more than 255 words")
        keys.append(key)
        values.append(n << 8 | len(own))
        for w in own:
            record = w.feature.encode(charset) + b"\0"
            tokens[n] = (w.left, w.right, w.posid, w.cost, at, 0)
            features.append(record)
            at, n = at + len(record), n + 1
    units = double_array(keys, values) if keys else np.zeros(1, dtype=UNIT)
    body = units.tobytes() + tokens.tobytes() + b"".join(features)
    size = struct.calcsize(HEADER) + CHARSET_BYTES + len(body)
    head = struct.pack(HEADER, size ^ HEADER_KEY, DICTIONARY_VERSION, kind, len(coded), left_size, right_size, units.nbytes, tokens.nbytes, at, 0)
    return head + charset.upper().encode().ljust(CHARSET_BYTES, b"\0") + body


def lexicon_of(data: bytes, name: str = "lexicon") -> tuple[dict, list[Word]]:
    """What the header says, and the words."""
    start = struct.calcsize(HEADER)
    if len(data) < start + CHARSET_BYTES:
        raise DictionaryError(f"{name} ends too early")
    key, version, kind, size, left_size, right_size, units_n, tokens_n, features_n, _ = struct.unpack_from(HEADER, data)
    if key ^ HEADER_KEY != len(data):
        raise DictionaryError(f"{name} is no compiled lexicon, or is cut short")
    if version != DICTIONARY_VERSION:
        raise DictionaryError(f"{name} has version {version}; {DICTIONARY_VERSION} is known")
    if size > MOST_WORDS:
        raise DictionaryError(f"{name} has more than {MOST_WORDS} words")
    charset = data[start : start + CHARSET_BYTES].split(b"\0")[0].decode().lower() or "utf-8"
    at = start + CHARSET_BYTES
    units = np.frombuffer(data, dtype=UNIT, count=units_n // UNIT.itemsize, offset=at)
    tokens = np.frombuffer(data, dtype=TOKEN, count=tokens_n // TOKEN.itemsize, offset=at + units_n)
    features = data[at + units_n + tokens_n : at + units_n + tokens_n + features_n]
    words = []
    for key_, value in keys_of(units):
        surface = key_.decode(charset, "replace")
        for t in tokens[value >> 8 : (value >> 8) + (value & 255)]:
            record = features[t["feature"] : features.index(b"\0", t["feature"])].decode(charset, "replace")
            words.append(Word(surface, int(t["left"]), int(t["right"]), int(t["cost"]), record, int(t["posid"])))
    return {"charset": charset, "size": size, "type": kind, "lsize": left_size, "rsize": right_size, "version": version}, words


# ---------------------------------------------------------------- definitions


def _lines(path: str, charset: str) -> list[str]:
    try:
        with open(path, "rb") as f:
            return f.read().decode(charset).splitlines()
    except (OSError, UnicodeDecodeError) as e:
        raise DictionaryError(f"{os.path.basename(path)}: {e}") from e


def words_of_csv(lines: Iterable[str], name: str) -> list[Word]:
    """Rows of surface, left id, right id, cost and the feature's fields, which stay as they are written."""
    out = []
    for number, line in enumerate(lines, 1):
        if not line.strip():
            continue
        try:
            if line.startswith('"'):
                surface = next(csv.reader([line]))[0]
                rest = line[len('"' + surface.replace('"', '""') + '"') + 1 :]
            else:
                surface, rest = line.split(",", 1)
            left, right, cost, feature = rest.split(",", 3)
            out.append(Word(surface, int(left), int(right), int(cost), feature))
        except ValueError as e:
            raise DictionaryError(f"{name}, line {number}: {e}") from e
        if min(out[-1].left, out[-1].right) < 0:
            raise DictionaryError(f"{name}, line {number}: a word needs its ids")
    return out


def matrix_of(lines: list[str]) -> np.ndarray:
    """Costs by (left id of the second word, right id of the first)."""
    try:
        rows = [tuple(map(int, x.split())) for x in lines if x.strip()]
        (firsts, seconds), rows = rows[0], rows[1:]
        out = np.zeros((seconds, firsts), dtype="<i2")
        for right, left, cost in rows:
            out[left, right] = cost
    except (ValueError, IndexError) as e:
        raise DictionaryError(f"matrix.def: {e}") from e
    return out


def characters_of(lines: list[str]) -> tuple[list[Category], np.ndarray]:
    """The categories, and for each code point its record: bits of its categories, its first one, length, group and invoke."""
    categories: list[Category] = []
    ranges = []
    for line in lines:
        parts = line.split("#")[0].split()
        if not parts:
            continue
        try:
            if parts[0].startswith("0x"):
                low, _, high = parts[0].partition("..")
                ranges.append((int(low, 16), int(high or low, 16), parts[1:]))
            else:
                categories.append(Category(parts[0], parts[1] == "1", parts[2] == "1", int(parts[3])))
        except (ValueError, IndexError) as e:
            raise DictionaryError(f"char.def: {line!r}: {e}") from e
    at = {c.name: i for i, c in enumerate(categories)}
    if not {"DEFAULT", "SPACE"} <= at.keys() or any(n not in at for _, _, names in ranges for n in names):
        raise DictionaryError("char.def: DEFAULT, SPACE or a category of a range is not defined")
    record = lambda names: sum({1 << at[n] for n in names}) | at[names[0]] << 18 | (c := categories[at[names[0]]]).length << 26 | c.group << 30 | c.invoke << 31
    table = np.full(CODE_POINTS, record(["DEFAULT"]), dtype="<u4")
    for low, high, names in ranges:
        table[low : high + 1] = record(names)
    return categories, table


def compiled_files(words: list[Word], unknown: list[Word], matrix: np.ndarray, categories: list[Category], table: np.ndarray, settings: Iterable[str] = (), charset: str = "utf-8") -> dict[str, bytes]:
    """The five files of a dictionary."""
    if missing := {w.surface for w in unknown} - {c.name for c in categories}:
        raise DictionaryError(f"unk.def: {sorted(missing)} are no categories")
    seconds, firsts = matrix.shape
    for w in (*words, *unknown):
        if w.left >= seconds or w.right >= firsts:
            raise DictionaryError(f"{w.surface!r}: the matrix has no such id")
    names = b"".join(c.name.encode().ljust(NAME_BYTES, b"\0") for c in categories)
    return {
        "char.bin": struct.pack("<I", len(categories)) + names + table.tobytes(),
        "dicrc": "".join(f"{x}\n" for x in settings if not x.startswith(("config-charset", "dictionary-charset"))).encode(charset),
        "matrix.bin": struct.pack("<HH", firsts, seconds) + matrix.tobytes(),
        "sys.dic": lexicon_bytes(words, SYSTEM, firsts, seconds, charset),
        "unk.dic": lexicon_bytes(unknown, UNKNOWN, firsts, seconds, charset),
    }


def compile_dictionary(source: str, out: str, charset: str = "utf-8", to: str = "utf-8") -> None:
    """Compiles a folder of definitions, written in ``charset``, into the five files."""
    paths = sorted(glob.glob(os.path.join(glob.escape(source), "*.csv")))
    if not paths:
        raise DictionaryError(f"{source} has no lexicon")
    lines = lambda name: _lines(os.path.join(source, name), charset)
    words = [w for p in paths for w in words_of_csv(_lines(p, charset), os.path.basename(p))]
    settings = lines("dicrc") if os.path.exists(os.path.join(source, "dicrc")) else []
    files = compiled_files(words, words_of_csv(lines("unk.def"), "unk.def"), matrix_of(lines("matrix.def")), *characters_of(lines("char.def")), settings, to)
    os.makedirs(out, exist_ok=True)
    for name in FILES:
        with open(os.path.join(out, name), "wb") as f:
            f.write(files[name])


# ---------------------------------------------------------------- opening


@dataclass(frozen=True)
class Compiled:
    """An open dictionary: words, unknown words by category, connection costs, characters, and what is known of its lexicons."""

    words: list[Word]
    unknown: dict[str, list[Word]]
    matrix: np.ndarray
    categories: list[Category]
    characters: np.ndarray
    settings: dict[str, str]
    infos: list[dict]


def _compiled(files: dict[str, bytes], users: dict[str, bytes]) -> Compiled:
    if missing := [n for n in FILES if n not in files]:
        raise DictionaryError(f"the dictionary lacks {', '.join(missing)}")
    n, data = struct.unpack_from("<I", files["char.bin"])[0], files["char.bin"]
    if len(data) != 4 + n * NAME_BYTES + 4 * CODE_POINTS:
        raise DictionaryError("char.bin has another size than its categories ask for")
    table = np.frombuffer(data, dtype="<u4", offset=4 + n * NAME_BYTES)
    names = [data[4 + i * NAME_BYTES : 4 + (i + 1) * NAME_BYTES].split(b"\0")[0].decode() for i in range(n)]
    categories = []
    for i, name in enumerate(names):
        # a category's options are in the records of its characters
        own = table[(table >> 18 & 0xFF) == i]
        record = int(own[0]) if len(own) else 0
        categories.append(Category(name, bool(record >> 31), bool(record >> 30 & 1), record >> 26 & 15))
    firsts, seconds = struct.unpack_from("<HH", files["matrix.bin"])
    if len(files["matrix.bin"]) != 4 + 2 * firsts * seconds:
        raise DictionaryError("matrix.bin has another size than its ids ask for")
    matrix = np.frombuffer(files["matrix.bin"], dtype="<i2", offset=4).reshape(seconds, firsts)
    words, infos = [], []
    for name, lexicon in (("sys.dic", files["sys.dic"]), *users.items()):
        info, own = lexicon_of(lexicon, name)
        words += own
        infos.append({"filename": name} | info)
    unknown: dict[str, list[Word]] = {}
    for w in lexicon_of(files["unk.dic"], "unk.dic")[1]:
        unknown.setdefault(w.surface, []).append(w)
    settings = dict(tuple(p.strip() for p in x.split("=", 1)) for x in files["dicrc"].decode("utf-8", "replace").splitlines() if "=" in x and not x.startswith((";", "#")))
    return Compiled(words, unknown, matrix, categories, table, settings, infos)


def _read(path: str) -> bytes:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError as e:
        raise DictionaryError(f"{path}: {e}") from e


def open_dictionary(folder: str, users: tuple[str, ...] = ()) -> Compiled:
    """A folder's dictionary, with lexicons of one's own."""
    return _compiled({n: _read(os.path.join(folder, n)) for n in FILES}, {p: _read(p) for p in users})


def open_packed(data: bytes) -> Compiled:
    """The dictionary in a container, which is not written anywhere."""
    return _compiled(dict(unpack(data)), {})


def compile_user(source: str, out: str, dictionary: Compiled, charset: str = "utf-8") -> None:
    """A lexicon of one's own, with the ids of a dictionary."""
    seconds, firsts = dictionary.matrix.shape
    with open(out, "wb") as f:
        f.write(lexicon_bytes(words_of_csv(_lines(source, charset), os.path.basename(source)), USER, firsts, seconds))
