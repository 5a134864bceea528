"""Byte-pair encoding by a lexicon of frequent words, and decoding.

The most frequent words of the corpus are encoded once and compiled into a minimal acyclic transducer: a shared-suffix
automaton over their bytes whose arcs carry additive outputs, so that the sum along a word's path is its number in
sorted order, which points at its ids.  The file is sent to every executor once (`SparkContext.addFile`), where the
workers memory-map it and look up all new words of a batch at the same time.  Words that it lacks are merged exactly,
pair by pair in the order of the merge ranks, again for a whole batch at a time.

The vocabulary file describes a word-end BPE: NFC, white space runs to one blank, lower case, a split into pieces, one
symbol for each byte with `</w>` at the last, and special tokens that are found in the raw text.  Decoding joins the
tokens of the ids by blanks, which is what the tokenizers library does without a decoder in the file.

Edge cases: a null or empty text, and one of white space only, has no ids; special tokens in a text become their ids;
texts of any length are encoded whole; an empty table gives an empty lexicon and no rows.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from hashlib import sha256
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from vigil.llm.shared import KEPT, most_frequent, release, shared_file, stored, text_slices

#: Characters (and 8 for each entry) of what a worker remembers before a generation is let go.
REMEMBERED = 4_000_000
#: Bytes of texts that are cut at a time: the more, the fewer stretches are looked up twice.
AT_ONCE = 4 << 20
#: Pieces that a task counts before it hands the counts on.
COUNTED = 300_000
#: Words of more bytes are merged one by one.
LONG = 64
#: White space of the vocabulary's rules: U+001C to U+001F are symbols there, unlike to Python.
ODD_BLANK = re.compile(r"[^\S\x1c-\x1f]+")
#: The same split of texts up to U+0557 without underscores, for Python's faster `re`; only for the known pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FAST_SPLIT = re.compile(r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|'(?:s|t|re|ve|m|ll|d)|[\d\xb2\xb3\xb9\xbc-\xbe]|[^\w\s]+")
SLOW = re.compile(r"[\x1c-\x1f_]")
#: Beyond these code points the tokenizers library tells letters and cases by its own Unicode version.
OLD = re.compile(r"[^\x00-\x1b\x20-\u0557]")
#: What is not normalised together with others: those, symbols of the library's rules, line breaks and the capital sigma.
ODD = re.compile(r"[^\x00-\x09\x0b-\x1b\x20-\x5e\x60-\u03a2\u03a4-\u0557]")
END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others take the characters from U+0100 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the rules before them, read from a file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or whole.get("decoder") is not None:
            raise ValueError("not a word-end BPE without a decoder")
        self.ids: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.special = special
        self.tokens = [""] * (1 + max([*self.ids.values(), *special.values()]))
        for token, number in chain(self.ids.items(), special.items()):
            self.tokens[number] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        split = whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.piece = regex.compile(split)
        self.fast = FAST_SPLIT if split == SPLIT else self.piece
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.kind = np.uint16 if len(self.tokens) <= 1 << 16 else np.uint32
        symbols = byte_symbols()
        self.byte = {s: b for b, s in enumerate(symbols)}
        # without the model, which takes most of the library's memory
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.inner = np.array([self.ids[s] for s in symbols], np.int64)
        self.last = np.array([self.ids[s + END] for s in symbols], np.int64)
        pairs = []
        for rank, (a, b) in enumerate(model["merges"]):
            pairs.append(((self.ids[a] << 32) | self.ids[b], rank, self.ids[a + b]))
        pairs.sort()
        self.pair, self.rank, self.merged = (np.array(x, np.int64) for x in zip(*pairs))

    def pieces(self, text: str) -> list[str]:
        """The normalised pieces of a text without special tokens."""
        if text.isascii() and not SLOW.search(text):
            return self.fast.findall(text.lower())
        if OLD.search(text):
            return list(chain.from_iterable(map(self._odd_pieces, ODD_BLANK.split(text))))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # letter by letter: the capital sigma has a form of its own at the end of a word otherwise
            text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        else:
            text = text.lower()
        return (self.piece if SLOW.search(text) else self.fast).findall(text)

    def all_pieces(self, stretches: list[str]) -> list[list[str]]:
        """The pieces of stretches without special tokens or white space; plain ones are normalised together."""
        out: list[list[str]] = [[]] * len(stretches)
        plain, marked = stretches, range(len(stretches))
        if ODD.search("\n".join(stretches)):
            odd = list(map(bool, map(ODD.search, stretches)))
            for i in compress(marked, odd):
                out[i] = self.pieces(stretches[i])
            marked = [i for i, x in enumerate(odd) if not x]
            plain = [stretches[i] for i in marked]
        # a line break composes with nothing, and no rule of lower case looks across it
        whole = unicodedata.normalize("NFC", "\n".join(plain)).lower()
        find = self.fast.findall
        for i, own, text in zip(marked, plain, whole.split("\n")):
            # a piece that is its stretch is the same object, which both memories hold
            out[i] = [own if own == text else text] if text.isalpha() else find(text)
        return out

    def _odd_pieces(self, chunk: str) -> list[str]:
        """The same for text without white space, with the library's own tables of letters and cases if needed."""
        if not OLD.search(chunk):
            return self.pieces(chunk)
        chunk = self.normalizer.normalize_str(chunk)
        return [
            bytes(map(self.byte.__getitem__, p)).decode() for p, _ in self.pre_tokenizer.pre_tokenize_str(chunk)]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words by exact merging: in each round, every word merges the leftmost pair of least rank."""
        out = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(-(-len(word) // 3), []).append(i)
        for size, group in by_length.items():
            if 3 * size > LONG:
                for i in group:
                    out[i] = self._merge_long(words[i]).astype(self.kind).tobytes()
                continue
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                rows, count = self._merge_block([words[i] for i in part])
                width = rows.shape[1] * rows.itemsize
                whole = rows.tobytes()
                for k, (i, n) in enumerate(zip(part, (count * rows.itemsize).tolist())):
                    out[i] = whole[k * width : k * width + n]
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One long word: each round merges all places of the pair of least rank, from the left.

        That is the same as one place at a time: a pair that a merge makes has a higher rank than the merge.
        """
        codes = np.frombuffer(word, np.uint8)
        row = np.append(self.inner[codes[:-1]], self.last[codes[-1]])
        while len(row) > 1:
            key = (row[:-1] << 32) | row[1:]
            found = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            rank = np.where(self.pair[found] == key, self.rank[found], len(self.pair))
            least = rank.min()
            if least == len(self.pair):
                break
            at = np.flatnonzero(rank == least)
            run = np.concatenate(([True], np.diff(at) > 1))  # of overlapping places, every other one merges
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            row = row.copy()
            row[at] = self.merged[found[at[0]]]
            row = np.delete(row, at + 1)
        return row

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs (the number of merges where there is none) and the ids that they merge to."""
        key = (left << 32) | right
        key[(left < 0) | (right < 0)] = -1
        found = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[found] == key, self.rank[found], len(self.pair)), self.merged[found]

    def _merge_block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([len(w) for w in words])
        width = max(2, int(length.max()))
        grid = np.full((len(words), width + 1), -1, np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        rows = np.repeat(np.arange(len(words)), length)
        columns = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        grid[rows, columns] = self.inner[flat]
        some = np.flatnonzero(length)
        grid[some, length[some] - 1] = self.last[flat[np.cumsum(length)[some] - 1]]
        live = np.flatnonzero(length > 1)
        own = grid[live]
        rank, joined = self.look_up(own[:, :-1], own[:, 1:])
        place = np.arange(width)[None, :]
        while len(live):
            line = np.arange(len(live))
            best = rank.argmin(1)
            go = rank[line, best] < len(self.pair)
            if not go.all():
                grid[live[~go]] = own[~go]
                live, own, rank, joined, best = live[go], own[go], rank[go], joined[go], best[go]
                line = np.arange(len(live))
            if not len(live):
                break
            made = joined[line, best]
            behind = place > best[:, None]
            own[:, :-1] = np.where(behind, own[:, 1:], own[:, :-1])
            own[:, -1] = -1
            own[line, best] = made
            behind = behind[:, :-1]
            rank[:, :-1] = np.where(behind, rank[:, 1:], rank[:, :-1])
            joined[:, :-1] = np.where(behind, joined[:, 1:], joined[:, :-1])
            rank[:, -1] = len(self.pair)
            for at in (np.maximum(best - 1, 0), np.minimum(best, width - 1)):
                rank[line, at], joined[line, at] = self.look_up(own[line, at], own[line, at + 1])
        return grid.astype(self.kind), (grid >= 0).sum(1)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(words: list[bytes], ids: list[bytes]) -> bytes:
    """The transducer of distinct words as one block of bytes: arrays, each after its length.

    Words are added in sorted order; a state that no later word can change is looked up by its arcs among the
    finished ones and shared, which makes the automaton minimal.  `skip` of an arc counts the words that sort
    before those behind it, seen from the arc's state.
    """
    order = sorted(range(len(words)), key=lambda i: words[i])
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]  # states of the last word, not yet shared

    def settle(depth: int, last: bytes) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            signature = (final[state], tuple(arcs[state].items()))
            arcs[path[-1]][last[len(path) - 1]] = register.setdefault(signature, state)

    last = b""
    for i in order:
        word = words[i]
        shared = len(os.path.commonprefix([word, last]))
        settle(shared, last)
        for byte in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    settle(0, last)
    counts: dict[int, int] = {}
    stack = [0]
    while stack:  # children first
        state = stack[-1]
        missing = [t for t in arcs[state].values() if t not in counts]
        if missing:
            stack += missing
        else:
            counts[state] = final[state] + sum(counts[t] for t in arcs[state].values())
            stack.pop()
    number = {state: n for n, state in enumerate(sorted(counts))}
    key, target, skip = [], [], []
    for state in sorted(counts):
        before = int(final[state])
        for byte in sorted(arcs[state]):
            key.append((number[state] << 8) | byte)
            target.append(number[arcs[state][byte]])
            skip.append(before)
            before += counts[arcs[state][byte]]
    parts = [
        np.array(key, np.int64), np.array(target, np.int64), np.array(skip, np.int64),
        np.array([final[s] for s in sorted(counts)], np.int64),
        np.cumsum([0, *(len(ids[i]) for i in order)])]
    head = b"".join(np.array([len(x)], np.int64).tobytes() + np.asarray(x, np.int64).tobytes() for x in parts)
    packed = b"".join(ids[i] for i in order)
    return head + packed + bytes(-len(packed) % 8)


class Lexicon:
    """The memory-mapped transducer."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.int64, mode="r")
        parts, at = [], 0
        for _ in range(5):
            size = int(whole[at])
            parts.append(whole[at + 1 : at + 1 + size])
            at += 1 + size
        self.key, self.target, self.skip, self.final, self.start = parts
        self.packed = whole[at:].view(np.uint8)

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The packed ids of each word, or None."""
        if not len(self.key) or not words:
            return [None] * len(words)
        length = np.array([len(w) for w in words])
        first = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(words), np.uint8)
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(length > 0)
        done = np.zeros(len(words), bool)
        step = 0
        while len(live):
            wanted = (state[live] << 8) | flat[first[live] + step]
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            fits = self.key[at] == wanted
            live, at = live[fits], at[fits]
            state[live] = self.target[at]
            number[live] += self.skip[at]
            step += 1
            ended = length[live] == step
            done[live[ended]] = self.final[state[live[ended]]] > 0
            live = live[~ended]
        out: list[bytes | None] = [None] * len(words)
        found = np.flatnonzero(done)
        first, last = self.start[number[found]].tolist(), self.start[number[found] + 1].tolist()
        for i, a, b in zip(found.tolist(), first, last):
            out[i] = self.packed[a:b].tobytes()
        return out


def distinct_stretches(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct stretches of texts without ASCII white space, their numbers in order, and where texts begin and end."""
    cut = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    ends = np.cumsum(np.concatenate(([0], pc.list_value_length(cut).to_numpy(zero_copy_only=False))))
    numbered = pc.dictionary_encode(cut.flatten())
    names = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
    return names, numbered.indices.to_numpy(zero_copy_only=False), ends


class Encoder:
    """Ids of whole texts; remembers those of pieces and of stretches without ASCII white space, and forgets what two
    fillings have not used.

    No rule before the merges sees across white space, so the ids of a text are those of its stretches, one after another.
    Arrow cuts the texts and numbers the distinct stretches of a batch; Python sees each of these once.
    """

    def __init__(self, words: Vocabulary, lexicon: Lexicon | None, remembered: int = REMEMBERED):
        if any(re.search(r"[ \t-\r]", name) for name in words.special):
            raise ValueError("a special token with white space")
        self.words, self.lexicon = words, lexicon
        self.kind = words.kind
        self.pieces, self.stretches = Memory(remembered), Memory(remembered)
        self.marks = {name: np.array([number], self.kind).tobytes() for name, number in words.special.items()}

    def of_pieces(self, new: list[str]) -> list[bytes]:
        """The ids of new pieces: from the lexicon, else by merging."""
        raw = [p.encode() for p in new]
        found = self.lexicon.find(raw) if self.lexicon else [None] * len(raw)
        unseen = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(unseen, self.words.merge([raw[i] for i in unseen])):
            found[i] = ids
        return found

    def of_stretches(self, new: list[str]) -> list[bytes]:
        """The ids of new stretches, which may have special tokens in them."""
        cut = self.words.all_pieces(new)
        names = list(set(chain.from_iterable(cut)))
        if self.words.split.search("\n".join(new)):
            for i, stretch in enumerate(new):
                if self.words.split.search(stretch):
                    parts = self.words.split.split(stretch)
                    # a special token is told from the piece of the same letters by a blank, which no piece has
                    cut[i] = list(chain.from_iterable([x + " "] if x in self.marks else self.words.pieces(x) for x in parts))
                    names += cut[i]
            names = list(set(names) - {x + " " for x in self.marks})
        known = dict(zip(names, self.pieces.look_up(names, self.of_pieces)))
        known.update((x + " ", ids) for x, ids in self.marks.items())
        return [known[x[0]] if len(x) == 1 else b"".join(map(known.__getitem__, x)) for x in cut]

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        names, at, ends = distinct_stretches(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        ids = self.stretches.look_up(names, self.of_stretches)
        flat = np.frombuffer(b"".join(ids), self.kind)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize
        n = size[at]
        last = np.concatenate(([0], np.cumsum(n)))
        shift = (np.cumsum(size) - size)[at] - last[:-1]
        narrow = np.int32 if max(last[-1], len(flat)) < 1 << 31 else np.int64
        whole = flat[np.repeat(shift.astype(narrow), n) + np.arange(last[-1], dtype=narrow)]
        return [whole[a:b] for a, b in zip(last[ends[:-1]].tolist(), last[ends[1:]].tolist())]


class Memory:
    """Packed ids by string, in two generations of a bounded number of characters."""

    def __init__(self, bound: int = REMEMBERED):
        self.bound = bound
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def look_up(self, names: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of distinct strings; those that are not remembered are made."""
        if self.size > self.bound:
            self.known, self.older, self.size = {}, self.known, 0
        found = list(map(self.known.get, names))
        lost = [i for i, x in enumerate(found) if x is None]
        wanted = [names[i] for i in lost]
        older = list(map(self.older.get, wanted))
        fresh = [i for i, x in enumerate(older) if x is None]
        for i, ids in zip(fresh, make([wanted[i] for i in fresh]) if fresh else ()):
            older[i] = ids
        for i, ids in zip(lost, older):
            found[i] = ids
        self.known.update(zip(wanted, older))
        self.size += sum(map(len, wanted)) + 8 * len(wanted)
        return found


def frequent_words(docs: DataFrame, path: str, size: int) -> list[bytes]:
    """The most frequent pieces of all texts, at most `size`, in byte order."""

    def count(batches):
        words = vocabulary(path)
        counts: Counter[str] = Counter()

        def emit():
            made = pa.RecordBatch.from_arrays(
                [pa.array([x.encode() for x in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])
            counts.clear()
            return made

        for batch in batches:
            for part in text_slices(batch, "text", AT_ONCE):
                names, at, _ = distinct_stretches(part.column("text"))
                for pieces, n in zip(words.all_pieces(names), np.bincount(at, minlength=len(names)).tolist()):
                    for piece in pieces:
                        counts[piece] += n
                if len(counts) > COUNTED:
                    yield emit()
        yield emit()

    totals = stored(
        docs.select("text").mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    return sorted(bytes(r.piece) for r in most_frequent(totals, size).select("piece").collect() if r.piece)


def ship_lexicon(spark: SparkSession, words: list[bytes], path: str) -> str:
    """Compile the words and send the file to all executors; gives the name under which it is found there."""
    data = compile_lexicon(words, vocabulary(path).merge(words))
    path = shared_file(spark, "lexicon", ".bin", data)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


@lru_cache(2)
def encoder(path: str, lexicon: str | None, remembered: int = REMEMBERED) -> Encoder:
    """One for each worker, which keeps what it remembers from task to task.

    What it remembers is a function of the piece alone, and so is the same in all tasks.
    """
    KEPT.append(forget)
    words = vocabulary(path)
    release()
    return Encoder(words, Lexicon(SparkFiles.get(lexicon)) if lexicon else None, remembered)


def forget() -> None:
    """Let go of encoders and vocabularies."""
    encoder.cache_clear()
    vocabulary.cache_clear()


def encode(docs: DataFrame, path: str, lexicon: str | None, column: str = "ids", text: str = "text") -> DataFrame:
    """docs with the ids of their texts as little-endian integers of 16 bits, or 32 for a large vocabulary."""
    names = docs.columns
    if column.lower() in {c.lower() for c in names}:
        raise ValueError(f"the input has a column {column!r} already")
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.BinaryType())])

    def add(batches):
        own = encoder(path, lexicon)
        for batch in batches:
            for part in text_slices(batch, text, AT_ONCE):
                ids = [x.tobytes() for x in own.encode(part.column(text))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], [*names, column])

    return docs.mapInArrow(add, schema)


def decode(ids: list[int], words: Vocabulary) -> str:
    """What the library's decode gives with skip_special_tokens=False."""
    tokens = words.tokens
    return " ".join([tokens[i] for i in ids])


def digests(ids: list[np.ndarray], words: Vocabulary) -> list[pa.Array]:
    """Number of ids, sha256 of the decimal ids and sha256 of the decoded text, for each array of ids."""
    decimal, sizes, first, second = words.decimal, [], [], []
    for own in ids:
        numbers = own.tolist()
        sizes.append(len(numbers))
        first.append(sha256(" ".join([decimal[i] for i in numbers]).encode()).hexdigest())
        second.append(sha256(decode(numbers, words).encode()).hexdigest())
    return [pa.array(sizes, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]


def token_digests(rows: DataFrame, path: str, lexicon: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows with `doc_id` and `ids`, or else of the ids of their `text`.

    Texts are encoded and told in one task: a task of two steps would keep a vocabulary in two workers.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    schema = T.StructType([rows.schema["doc_id"]]).add(names[0], "long").add(names[1], "string").add(names[2], "string")

    def of_ids(batches):
        words = vocabulary(path)
        for batch in batches:
            ids = [np.frombuffer(packed, words.kind) for packed in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *digests(ids, words)], ["doc_id", *names])

    def of_texts(batches):
        own = encoder(path, lexicon)
        for batch in batches:
            for part in text_slices(batch, "text", AT_ONCE):
                made = digests(own.encode(part.column("text")), own.words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", *names])

    if "ids" in rows.columns:
        return rows.select("doc_id", "ids").mapInArrow(of_ids, schema)
    return rows.select("doc_id", "text").mapInArrow(of_texts, schema)
