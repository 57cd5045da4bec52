"""Byte-level BPE with a lexicon of frequent words compiled to a minimal acyclic transducer.

Words (the pieces of the tokenizer's own splitting) are counted over all documents.  The most frequent
ones are compiled to an automaton that shares prefixes and suffixes; the numbers on the path of a
word add up to its place in a table of ids.  The automaton is one file of flat arrays in the shared
folder; each executor gets it once, and its Python workers map the same pages of memory.  All words
of a batch walk the automaton together, a byte a step.  A word that it doesn't hold is merged by the
ranks of the vocabulary, so ids never depend on what the lexicon holds.

Results equal those of the tokenizer file's own library with its settings as they are: a special token written in
a text becomes its id.  Classes of characters are asked of that library, so both
agree on every character.  A null text is an empty one; repeated rows and null ids are encoded row by row;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haloflux.llm.scratch import arrow_settings, shared_folder, written
from haloflux.llm.text import pieces, raw

#: Words of a lexicon at most; others are merged when they are met.
WORDS = 1 << 17
#: Bytes of a word of the lexicon at most.
LONGEST = 48
#: Unseen words whose ids a worker remembers, and the bytes up to which one is remembered.
REMEMBERED = 200_000
#: Splitting of byte-level vocabularies (a fixed value of the public format), to count words by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Gaps in which a state's transitions are tried before they go behind all others.
TRIES = 32
OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 255


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or spec.get("normalizer") or spec.get("post_processor") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        added = spec.get("added_tokens", ())
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path} has special tokens that take in their surroundings")
        letters = byte_letters()
        vocab = model["vocab"]
        self.first = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in added}
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, number in vocab.items():
            self.tokens[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, number in self.special.items():
            self.tokens[number] = token.encode()

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of least rank merges first, of equal ones the leftmost.

        A heap of pairs over a linked list, so that a long word takes n log n steps.
        """
        ids = [self.first[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], k, found[1], ids[k], ids[k + 1]) for k in range(n - 1) if (found := merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, made, a, b = heapq.heappop(heap)
            after = right[k]
            if ids[k] != a or after >= n or ids[after] != b:
                continue
            ids[k], ids[after] = made, -1
            after = right[k] = right[after]
            if after < n:
                left[after] = k
                if found := merges.get((made, ids[after])):
                    heapq.heappush(heap, (found[0], k, found[1], made, ids[after]))
            before = left[k]
            if before >= 0 and (found := merges.get((ids[before], made))):
                heapq.heappush(heap, (found[0], before, found[1], ids[before], made))
        return [i for i in ids if i >= 0]


def byte_letters() -> dict[str, int]:
    """The letter that byte-level files write for each byte: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """Minimal acyclic automaton of sorted words, as arrays.

    ``cell = base[state] + byte`` belongs to the state if ``owner[cell] == state``; then ``target[cell]`` is
    the next state and ``number[cell]`` counts the words passed over.  ``final`` marks ends of words.
    """

    NAMES = ("base", "owner", "target", "number", "final")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compiled(cls, words: list[bytes]) -> Automaton:
        """From distinct words in order of bytes; states with equal continuations become one as soon as they are complete."""
        known: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        sizes: list[int] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in known:
                known[key] = len(states)
                states.append(key)
                sizes.append(node[0] + sum(sizes[child] for _, child in node[1]))
            return known[key]

        path: list[list] = [[False, []]]
        before = b""

        def complete(depth: int) -> None:
            while len(path) > depth + 1:
                child = freeze(path.pop())
                path[-1][1].append((before[len(path) - 1], child))

        for word in words:
            same = next((k for k, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), len(word)))
            complete(same)
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            before = word
        complete(0)
        root = freeze(path[0])
        # the start is state 0
        order = {root: 0} | {s: k + 1 for k, s in enumerate(s for s in range(len(states)) if s != root)}
        final = np.zeros(len(states), dtype=bool)
        for s, k in order.items():
            final[k] = states[s][0]
        return cls(_cells([states[s] for s in order], order, sizes) | {"final": final})

    def walk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each word (a range of ``data``) in the order of words, -1 for one that isn't held."""
        found = np.full(len(starts), -1, dtype=np.int64)
        size = ends - starts
        alive = np.flatnonzero(size <= LONGEST)
        state, number, at = np.zeros(len(alive), np.int32), np.zeros(len(alive), np.int32), starts[alive]
        stop = ends[alive]
        while len(alive):
            over = at == stop
            if over.any():
                held = over & self.final[state]
                found[alive[held]] = number[held]
                going = ~over
                alive, state, number, at, stop = alive[going], state[going], number[going], at[going], stop[going]
            cell = self.base[state] + data[at]
            good = self.owner[cell] == state
            if not good.all():
                alive, cell, number, at, stop = alive[good], cell[good], number[good], at[good], stop[good]
            state, number, at = self.target[cell], number + self.number[cell], at + 1
        return found


def _cells(states: list[tuple], order: dict[int, int], sizes: list[int]) -> dict[str, np.ndarray]:
    """Places the transitions of all states in one row of cells, first fit, largest states first."""
    total = sum(len(moves) for _, moves in states)
    taken = bytearray(2 * total + 1024)
    base = np.zeros(len(states), np.int32)
    placed: list[tuple[int, int, int, int]] = []
    free = start = end = 256
    for k in sorted(range(len(states)), key=lambda k: -len(states[k][1])):
        final, moves = states[k]
        if not moves:
            continue
        lead = moves[0][0]
        if len(moves) == 1:
            at = free = taken.index(0, free)
        else:
            # some tries among the gaps, then behind all cells; later states of one move fill what is left
            at = taken.index(0, start)
            for _ in range(TRIES):
                if not any(taken[at - lead + b] for b, _ in moves):
                    break
                at = taken.index(0, at + 1)
            else:
                at, start = end, taken.index(0, start + 1)
        first = at - lead
        base[k] = first
        number = int(final)
        for b, child in moves:
            taken[first + b] = 1
            placed.append((first + b, k, order[child], number))
            number += sizes[child]
        end = max(end, first + moves[-1][0] + 1)
        if end + 512 > len(taken):
            taken.extend(bytes(len(taken)))
    last = max((p[0] for p in placed), default=0) + 512
    cells = {name: np.full(last, -1, np.int32) for name in ("owner", "target", "number")}
    if placed:
        at, owner, target, numbers = np.array(placed, dtype=np.int64).T
        cells["owner"][at], cells["target"][at], cells["number"][at] = owner, target, numbers
    return cells | {"base": base}


def compiled(vocabulary: Vocabulary, words: list[bytes]) -> bytes:
    """The file of a lexicon: a line that describes the arrays, then the arrays."""
    words = sorted(set(words))
    ids = [np.array(vocabulary.merged(w), np.int32) for w in words]
    automaton = Automaton.compiled(words)
    arrays = {n: getattr(automaton, n) for n in Automaton.NAMES}
    arrays["starts"] = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int64)
    arrays["ids"] = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    parts, described, at = [], {}, 0
    for name, array in arrays.items():
        described[name] = (array.dtype.str, len(array), at)
        part = array.tobytes()
        part += bytes(-len(part) % 16)
        parts.append(part)
        at += len(part)
    head = json.dumps(described).encode()
    head += b" " * (-(len(head) + 1) % 16) + b"\n"
    return head + b"".join(parts)


@lru_cache(maxsize=2)
def mapped(path: str) -> tuple[Automaton, np.ndarray, np.ndarray]:
    """Automaton, starts and ids of a file, read through a memory map."""
    with open(path, "rb") as file:
        described = json.loads(file.readline())
        head = file.tell()
        memory = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    arrays = {name: np.frombuffer(memory, dtype, n, head + at) for name, (dtype, n, at) in described.items()}
    return Automaton({n: arrays[n] for n in Automaton.NAMES}), arrays["starts"], arrays["ids"]


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = WORDS) -> list[bytes]:
    """The most frequent words of all documents, at most ``most`` and such that of equally frequent ones all or none is in.

    Words are counted over the whole table; what reaches the driver is a histogram of some hundred counts and the words.
    """
    found = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0))).alias("word"))
    counts = found.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST))
    counts = written(counts.withColumn("rank", F.floor(F.log2("n") * 64).cast("int")))
    least, words = None, 0
    for rank, n in sorted(((r["rank"], r["n"]) for r in counts.groupBy("rank").agg(F.count("*").alias("n")).collect()), reverse=True):
        words += n
        if words > most:
            break
        least = rank
    if least is None:
        return []
    return [r.word.encode() for r in counts.where(F.col("rank") >= least).select("word").collect()]


def published(spark: SparkSession, content: bytes) -> str:
    """Writes a file to the shared folder, has every executor fetch it once, and returns the name tasks find it by."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/haloflux-llm/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        for at in range(0, len(content), 1 << 20):
            out.write(content[at : at + (1 << 20)])
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def build(docs: DataFrame, tokenizer_path: str, text_col: str = "text", most: int = WORDS) -> str:
    """Compiles the frequent words of all documents; returns the name of the lexicon."""
    words = frequent_words(docs, text_col, most)
    return published(docs.sparkSession, compiled(Vocabulary(tokenizer_path), words))


class Splitter:
    """Starts of words in many texts at once, by the rules of :data:`PATTERN`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)

    def _learn(self, points: np.ndarray) -> None:
        """Asks the library how it splits each character between a letter or digit and a mark."""
        for point in points.tolist():
            c = chr(point)
            if c == " ":
                self.classes[point] = SPACE
                continue
            joined = lambda text: {p for _, p in self.library.pre_tokenize_str(text)}
            if (0, 2) in joined("a" + c + "!"):
                kind = LETTER
            elif (0, 2) in joined("1" + c + "!"):
                kind = NUMBER
            else:
                kind = OTHER if (1, 3) in joined("a" + c + "!") else SPACE
            self.classes[point] = kind

    def starts(self, points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Positions at which words begin; ``cuts`` are positions that no word spans (0 and the end among them)."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        kinds = self.classes[points]
        if (kinds == UNKNOWN).any():
            self._learn(np.unique(points[kinds == UNKNOWN]))
            kinds = self.classes[points]
        cut = np.zeros(n + 1, bool)
        cut[cuts] = True
        begins = cut[:-1].copy()
        begins[1:] |= kinds[1:] != kinds[:-1]
        space = kinds == SPACE
        # the last space of a run before a word stands alone, or starts the word if it is a plain one
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~cut[1:-1]
        begins |= last
        plain = np.zeros(n, bool)
        plain[1:] = last[:-1] & (points[:-1] == 32)
        begins &= ~plain
        # an apostrophe that starts a word may start a contraction
        marks = np.flatnonzero(begins & (points == 39))
        if len(marks):
            left = np.append(points, np.zeros(2, points.dtype))
            closed = np.append(cut, [True, True])
            for ending in CONTRACTIONS:
                size = len(ending)
                fits = np.ones(len(marks), bool)
                for k, c in enumerate(ending, 1):
                    fits &= ~closed[np.minimum(marks + k, n)] & (left[np.minimum(marks + k, n)] == ord(c))
                hit = marks[fits]
                begins[hit + 1] = False
                after = hit + size + 1
                begins[after[after < n]] = True
                marks = marks[~fits]
        return np.flatnonzero(begins)


class Codec:
    """Encodes and decodes batches of texts."""

    def __init__(self, tokenizer_path: str, lexicon_path: str):
        self.vocabulary = Vocabulary(tokenizer_path)
        self.splitter = Splitter(tokenizer_path)
        self.automaton, self.word_starts, self.word_ids = mapped(lexicon_path)
        self.remembered: dict[bytes, list[int]] = {}
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in special)) if special else None

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids before each."""
        data, offsets = raw(column)
        content = data.tobytes()
        marked = []
        if self.special is not None and self.special.search(content):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                marked += [(a + m.start(), a + m.end(), self.vocabulary.special[m[0].decode()]) for m in self.special.finditer(content[a:b])]
        points = np.frombuffer(content.decode().encode("utf-32-le"), np.uint32)
        size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        place = np.concatenate(([0], np.cumsum(size)))
        borders = np.array([x for a, b, _ in marked for x in (a, b)], np.int64)
        starts = place[self.splitter.starts(points, np.searchsorted(place, np.concatenate((offsets, borders))))]
        for a, b, _ in marked:
            low, high = np.searchsorted(starts, (a + 1, b))
            starts = np.delete(starts, slice(low, high))
        ends = np.append(starts[1:], len(data))
        word = self.automaton.walk(data, starts, ends)
        extra: list[int] = []
        begin = np.where(word >= 0, self.word_starts[word], 0)
        length = np.where(word >= 0, self.word_starts[word + 1] - begin, 0)
        own = len(self.word_ids)
        special = {a: i for a, _, i in marked}
        for k in np.flatnonzero((word < 0) | np.isin(starts, [*special])).tolist():
            a = int(starts[k])
            ids = [special[a]] if a in special else self._merged(content[a : ends[k]])
            begin[k], length[k] = own + len(extra), len(ids)
            extra += ids
        table = np.concatenate((self.word_ids, np.array(extra, np.int32))) if extra else self.word_ids
        after = np.concatenate(([0], np.cumsum(length)))
        at = np.repeat(begin - after[:-1], length) + np.arange(after[-1])
        return table[at], after[np.searchsorted(starts, offsets)]

    def _merged(self, word: bytes) -> list[int]:
        found = self.remembered.get(word)
        if found is None:
            found = self.vocabulary.merged(word)
            if len(word) <= LONGEST:
                if len(self.remembered) >= REMEMBERED:
                    self.remembered.clear()
                self.remembered[word] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no text become replacement marks, unknown ids nothing."""
        return decoded_text(self.vocabulary, ids)


def decoded_text(vocabulary: Vocabulary, ids: list[int]) -> str:
    tokens = vocabulary.tokens
    return b"".join([tokens[i] for i in ids if 0 <= i < len(tokens)]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(tokenizer_path: str, lexicon_path: str) -> Codec:
    return Codec(tokenizer_path, lexicon_path)


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(docs: DataFrame, tokenizer_path: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id and ids of every row and, with ``decode``, the text that the ids stand for."""
    arrow_settings(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer_path, SparkFiles.get(lexicon))
        for batch in batches:
            for part in pieces(batch):
                ids, before = coder.encode(part.column("text"))
                arrays = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32()))]
                if decode:
                    plain = ids.tolist()
                    arrays.append(pa.array([coder.decode(plain[a:b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)], pa.large_string()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"][: len(arrays)])

    schema = "doc_id long, ids array<int>" + (", decoded string" if decode else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)


def decoded(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each row of ids (null: empty)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(tokenizer_path)
        for batch in batches:
            texts = pa.array([decoded_text(vocabulary, ids or []) for ids in batch.column("ids").to_pylist()], pa.large_string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(decode, "doc_id long, text string")
