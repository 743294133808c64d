"""BPE encoding and decoding through a minimal acyclic transducer.

Frequent words of the corpus are compiled, with their token ids as outputs, into a minimal
acyclic automaton (equal suffixes share states).  A word's number is the sum of the counts of
words that its path passes by, and the number addresses its ids, so the automaton is a finite
transducer in four flat arrays.  Workers map those arrays into memory.  A word outside the
lexicon is merged exactly by rank, so the lexicon changes speed only, never a result.

Texts are cut where the byte-level pattern always cuts: before a space or at a line feed that
stands between two non-space characters.  Other white space goes through the full pattern.
The special token's own string becomes its id, as the tokenizers library does by default.

Defined results: null texts encode as empty; empty texts have no ids and decode to the empty text;
very long texts are encoded whole; rows with equal or null ids are encoded like any other; an empty
table yields no rows; further columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import tempfile
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.llm._common import free_name, most_frequent, slices, table, written

#: Fixed value: the byte-level pre-tokenization pattern of the vocabulary.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", regex.V1)
#: White space next to white space: there the cuts depend on the neighbours.
_UNSAFE = regex.compile(r"\s\s")
LEXICON_WORDS = 20_000
_CACHE_WORDS = 400_000
#: Marks that a letter run ends at; a run of them is one pre-token.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_alphabet() -> dict[int, str]:
    """Printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in keep}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(keep))
    return out


class Vocabulary:
    """Token bytes, merge ranks and special tokens of one byte-level BPE file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        back = {c: b for b, c in byte_alphabet().items()}
        as_bytes = lambda s: bytes(back[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = [self.ids[bytes([b])] for b in range(256)]
        self.rank, self.merged = {}, []  # (left id << 20 | right id) -> rank; rank -> id
        for rank, pair in enumerate(spec["model"]["merges"]):
            x, y = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank[self.ids[x] << 20 | self.ids[y]] = rank
            self.merged.append(self.ids[x + y])
        self.pairs = PairTable(self.rank)
        self.bytes = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.names = [str(i) for i in range(len(self.bytes))]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Merge one pre-token by rank: the lowest rank first, leftmost among equals."""
        first, rank, merged = self.first, self.rank.get, self.merged
        ids = [first[b] for b in word]
        if len(ids) > 200:
            return self._merge_long(ids)
        none = len(merged)
        ranks = [rank(x << 20 | y, none) for x, y in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [merged[low]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], none)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], none)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap over a linked list, for very long pre-tokens."""
        import heapq

        n, rank = len(ids), self.rank.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = right[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j], right[i] = self.merged[r], -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (r := rank(ids[k] << 20 | ids[right[k]])) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[right[k]]))
        return tuple(i for i in ids if i >= 0)


class PairTable:
    """Vectorised look-up of merge ranks: a few open tables, each for the keys that the last left over."""

    def __init__(self, rank: dict[int, int]):
        self.none = len(rank)
        keys = np.fromiter(rank, np.uint64, len(rank))
        values = np.fromiter(rank.values(), np.int32, len(rank))
        self.levels = []
        while len(keys):
            bits = max(4, int(len(keys)).bit_length() + 2)
            factor = np.uint64((0x9E3779B97F4A7C15 + 2 * len(self.levels) * 0x632BE59BD9B4E019) & (2**64 - 1) | 1)
            slot = (keys * factor) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            k, v = np.full(1 << bits, 2**63, np.uint64), np.zeros(1 << bits, np.int32)
            k[slot[first]], v[slot[first]] = keys[first], values[first]
            self.levels.append((factor, np.uint64(64 - bits), k, v))
            keys, values = np.delete(keys, first), np.delete(values, first)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        out = np.full(key.shape, self.none, np.int32)
        for factor, shift, k, v in self.levels:
            slot = (key * factor) >> shift
            hit = k[slot] == key
            out[hit] = v[slot[hit]]
        return out


def merge_many(vocabulary: Vocabulary, words: list[bytes]) -> list[tuple[int, ...]]:
    """``Vocabulary.merge`` of many words of similar length at once."""
    pairs, none = vocabulary.pairs, len(vocabulary.merged)
    merged = np.asarray(vocabulary.merged, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max())
    flat = np.asarray(vocabulary.first, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
    ids = np.full((len(words), width + 1), -1, np.int64)
    inside = np.arange(width + 1) < sizes[:, None]
    ids[inside] = flat
    ranks = np.full((len(words), width), none, np.int32)
    both = inside[:, 1:]
    ranks[both] = pairs(ids[:, :-1][both], ids[:, 1:][both])
    done = np.empty((len(words), width), np.int64)
    rows, column = np.arange(len(words)), np.arange(width)
    while len(rows):
        at = ranks.argmin(1)
        low = ranks[np.arange(len(rows)), at]
        live = low < none
        if not live.all():
            done[rows[~live]] = ids[~live, :width]
            rows, ids, ranks, at, low = rows[live], ids[live], ranks[live], at[live], low[live]
            if not len(rows):
                break
        k = np.arange(len(rows))
        after = column > at[:, None]
        ids[:, :-1][after] = ids[:, 1:][after]
        ids[:, -1] = -1
        ids[k, at] = merged[low]
        ranks[:, :-1][after[:, :-1]] = ranks[:, 1:][after[:, :-1]]
        ranks[:, -1] = none
        right = ids[k, at + 1]
        ranks[k, at] = np.where(right >= 0, pairs(ids[k, at], np.maximum(right, 0)), none)
        some = at > 0
        ranks[k[some], at[some] - 1] = pairs(ids[k[some], at[some] - 1], ids[k[some], at[some]])
    left = (done >= 0).sum(1)
    return [tuple(r[:n]) for r, n in zip(done.tolist(), left.tolist(), strict=True)]


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """Minimal acyclic automaton over the sorted words; layout: header, arrays, ids.

    Words are added in order; a suffix that no later word can change is replaced by an equal
    state already registered.
    """
    register: dict[tuple, int] = {}
    final, arcs = [False], [{}]  # state -> is a word's end; label -> state

    def settle(path: list[tuple[int, int, int]], depth: int) -> None:
        for parent, label, state in reversed(path[depth:]):
            key = (final[state], tuple(sorted(arcs[state].items())))
            arcs[parent][label] = register.setdefault(key, state)
        del path[depth:]

    path: list[tuple[int, int, int]] = []
    last = b""
    for word in sorted(entries):
        same = len(os.path.commonprefix((last, word)))
        settle(path, same)
        at = path[-1][2] if path else 0
        for label in word[same:]:
            final.append(False)
            arcs.append({})
            arcs[at][label] = len(arcs) - 1
            path.append((at, label, len(arcs) - 1))
            at = len(arcs) - 1
        final[at] = True
        last = word
    settle(path, 0)
    number, order, stack = {}, [], [0]
    while stack:
        s = stack.pop()
        if s not in number:
            number[s] = len(order)
            order.append(s)
            stack.extend(arcs[s].values())
    counts: dict[int, int] = {}

    def count(s: int) -> int:
        todo = [s]
        while todo:
            x = todo[-1]
            missing = [t for t in arcs[x].values() if t not in counts]
            if missing:
                todo.extend(missing)
            else:
                counts[todo.pop()] = final[x] + sum(counts[t] for t in arcs[x].values())
        return counts[s]

    count(0)
    starts, labels, targets, skips, ends = [0], [], [], [], []
    for s in order:
        passed = int(final[s])
        for label, t in sorted(arcs[s].items()):
            labels.append(label)
            targets.append(number[t])
            skips.append(passed)
            passed += counts[t]
        starts.append(len(labels))
        ends.append(int(final[s]))
    outs = [entries[w] for w in sorted(entries)]
    at = np.cumsum([0, *map(len, outs)], dtype=np.int32)
    arrays = [np.asarray(x, np.int32) for x in (starts, ends, labels, targets, skips, at, [i for o in outs for i in o])]
    head = np.asarray([len(arrays), *map(len, arrays)], np.int32)
    return b"".join(x.tobytes() for x in (head, *arrays))


class Lexicon:
    """The compiled automaton, mapped into memory from an unlinked file."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self._map = mmap.mmap(f.fileno(), len(data), access=mmap.ACCESS_READ)
        whole = memoryview(self._map).cast("i")
        n, at, parts = whole[0], 1 + whole[0], []
        for k in range(n):
            parts.append(whole[at : at + whole[1 + k]])
            at += whole[1 + k]
        self.starts, self.ends, self.labels, self.targets, self.skips, self.at, self.outs = parts

        arrays = [np.asarray(x) for x in parts]
        starts, _, labels, targets, skips, *_ = arrays
        self._arcs = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts)) << 8 | labels
        self._targets, self._skips, self._ends = targets, skips, arrays[1]

    def find_many(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """``get`` of many words: all walk the automaton in step."""
        out: list[tuple[int, ...] | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(words), np.uint8)
        rows, state, number = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(rows) and len(self._arcs):
            ended = sizes[rows] == step
            for r, n in zip(rows[ended & (self._ends[state] > 0)].tolist(), number[ended & (self._ends[state] > 0)].tolist(), strict=True):
                out[r] = tuple(self.outs[self.at[n] : self.at[n + 1]])
            rows, state, number = rows[~ended], state[~ended], number[~ended]
            key = state << 8 | data[begin[rows] + step]
            k = np.minimum(np.searchsorted(self._arcs, key), len(self._arcs) - 1)
            hit = self._arcs[k] == key
            rows, k = rows[hit], k[hit]
            state, number = self._targets[k].astype(np.int64), number[hit] + self._skips[k]
            step += 1
        return out

    def get(self, word: bytes) -> tuple[int, ...] | None:
        state, number = 0, 0
        for label in word:
            for k in range(self.starts[state], self.starts[state + 1]):
                if self.labels[k] == label:
                    number += self.skips[k]
                    state = self.targets[k]
                    break
            else:
                return None
        return tuple(self.outs[self.at[number] : self.at[number + 1]]) if self.ends[state] else None


class Tokenizer:
    """Encodes whole texts to ids and decodes ids to text."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self._spaced: dict[str, tuple] = {}
        self._bare: dict[str, tuple] = {}
        self._word: dict[str, tuple] = {}

    def word(self, word: str) -> tuple[int, ...]:
        ids = self._word.get(word)
        if ids is None:
            raw = word.encode()
            ids = (self.lexicon.get(raw) if self.lexicon else None) or self.vocabulary.merge(raw)
            if len(self._word) >= _CACHE_WORDS:
                self._word.clear()
            if len(word) <= 64:
                self._word[word] = ids
        return ids

    def prepare(self, texts: list[str | None]) -> None:
        """Look up or merge, all at once, the words of these texts that are not cached yet."""
        spaced: set[str] = set()
        bare: set[str] = set()
        for t in texts:
            for line in t.split("\n") if t else ():
                first, *rest = line.split(" ")
                bare.add(first)
                spaced.update(rest)
        for lead, pieces, cache in ((" ", spaced, self._spaced), ("", bare, self._bare)):
            if len(cache) + len(pieces.difference(cache)) > _CACHE_WORDS:
                cache.clear()
            new = pieces.difference(cache)
            heads = {p.rstrip(_MARKS) for p in new}.difference(cache)
            self._fill([p for p in heads if p.isalpha() and len(p) <= 30], cache, lead)
            for p in new:
                head = p.rstrip(_MARKS)
                if len(head) < len(p) <= 60 and head in cache and head.isalpha():
                    cache[p] = cache[head] + self.word(p[len(head) :])

    def _fill(self, pieces: list[str], cache: dict, lead: str) -> None:
        if not pieces:
            return
        raw = [(lead + p).encode() for p in pieces]
        found = self.lexicon.find_many(raw) if self.lexicon else [None] * len(raw)
        for p, ids in zip(pieces, found, strict=True):
            if ids is not None:
                cache[p] = ids
        left = sorted((k for k, ids in enumerate(found) if ids is None), key=lambda k: len(raw[k]))
        for at in range(0, len(left), 8192):
            part = left[at : at + 8192]
            for k, ids in zip(part, merge_many(self.vocabulary, [raw[k] for k in part]), strict=True):
                cache[pieces[k]] = ids

    def _piece(self, piece: str, cache: dict, lead: str) -> tuple[int, ...]:
        ids = tuple(chain.from_iterable(map(self.word, PATTERN.findall(lead + piece))))
        if len(cache) >= _CACHE_WORDS:
            cache.clear()
        if len(piece) <= 64:
            cache[piece] = ids
        return ids

    def _ordinary(self, text: str) -> list[int]:
        if _UNSAFE.search(text) or text[:1].isspace():
            return list(chain.from_iterable(map(self.word, PATTERN.findall(text))))
        feed = self.word("\n")
        out: list[tuple] = []
        spaced, bare = self._spaced, self._bare
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(feed)
            first, *rest = line.split(" ")
            if first:
                out.append(bare.get(first) or self._piece(first, bare, ""))
            if rest:
                try:
                    out += [spaced[p] for p in rest]
                except KeyError:
                    out += [spaced[p] if p in spaced else self._piece(p, spaced, " ") for p in rest]
        return list(chain.from_iterable(out))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        v = self.vocabulary
        if v.split_special is None or not any(s in text for s in v.special):
            return self._ordinary(text)
        out: list[int] = []
        for part in v.split_special.split(text):
            if part in v.special:
                out.append(v.special[part])
            elif part:
                out += self._ordinary(part)
        return out

    def decode(self, ids: list[int]) -> str:
        token = self.vocabulary.bytes
        return b"".join([token[i] for i in ids]).decode("utf-8", "replace")


def word_counts(docs: DataFrame, text: str = "text", flush: int = 600_000) -> DataFrame:
    """Counts of space-separated words over all texts; each task adds up before the shuffle."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(t.as_py().replace("\n", " ").split(" "))
                if len(seen) > flush:
                    yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        if seen:
            yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})

    some = docs.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "word string, n long")
    return some.where("length(word) between 1 and 64").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, size: int = LEXICON_WORDS, text: str = "text") -> bytes:
    """Compile the most frequent words; ``size`` rows at most reach the driver."""
    top = most_frequent(written(word_counts(docs, text).where("n > 1")), "n", size)
    seen = {w for r in top for w in PATTERN.findall(" " + r.word)}
    return compile_lexicon({w.encode(): vocabulary.merge(w.encode()) for w in seen})


_workers: dict[str, Tokenizer] = {}


def encode_documents(docs: DataFrame, path: str, text: str = "text", digests: bool = False, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """All columns of ``docs`` plus ``ids`` and ``decoded`` (see ``free_name``) or, with ``digests``, their counts and hashes.

    With ``digests`` the columns are ``doc_id``, ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256`` and texts leave the worker as hashes only.
    """
    spark = docs.sparkSession
    spec = open(path, encoding="utf-8").read()
    vocabulary = Vocabulary(spec)
    # bound: the vocabulary file and lexicon_words entries of 64 characters
    shared = spark.sparkContext.broadcast((spec, build_lexicon(docs, vocabulary, lexicon_words, text)))
    name = hashlib.sha256(shared.value[1]).hexdigest()
    added = [free_name(docs, n) for n in ("ids", "decoded")]

    def tokenizer() -> Tokenizer:
        if name not in _workers:
            _workers.clear()
            _workers[name] = Tokenizer(Vocabulary(shared.value[0]), Lexicon(shared.value[1]))
        return _workers[name]

    def digest(batches):
        t = tokenizer()
        names = t.vocabulary.names
        for batch in batches:
            for lo, hi, *_ in slices(batch, 1):
                n, ids_hash, text_hash = [], [], []
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                t.prepare(texts)
                for x in texts:
                    ids = t.encode(x)
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def plain(batches):
        t = tokenizer()
        for batch in batches:
            k = batch.schema.get_field_index(text)
            for lo, hi, *_ in slices(batch, k):
                part = batch.slice(lo, hi - lo)
                texts = part.column(k).to_pylist()
                t.prepare(texts)
                ids = [t.encode(x) for x in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([t.decode(x) for x in ids], pa.string())], [*part.schema.names, *added])

    if digests:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", text).mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.mapInArrow(plain, T.StructType([*docs.schema, T.StructField(added[0], T.ArrayType(T.IntegerType())), T.StructField(added[1], T.StringType())]))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every whole text of ``documents``."""
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)
