"""Packing documents into token sequences, in order, by dynamic programming.

A task tokenizes its documents into one stream and chooses where windows of at
most ``length`` tokens end. Ends fall on ends of documents or sentences (and,
inside very long sentences, every so many tokens). Cost is padding plus a
penalty for what a cut breaks; the best predecessor of every position is at the
head of a monotone queue, so a stream is cut in time linear in its positions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import kernels as K

LENGTH = 4096
#: Penalties, in tokens of padding: a window more, a document cut between sentences, a sentence cut.
PER_WINDOW, CUT_SENTENCES, CUT_WORDS = 8, 24, 256
#: Inside a sentence longer than this, windows may also end at multiples of it.
STRIDE = 512
#: Windows of a power of two of tokens, from here on, need no padding.
LEAST_POWER = 256
#: Tokens that are cut at once; the last window of each portion stays open for the next.
PORTION = 1 << 18
#: Bytes of text whose words are looked up at once.
LOOKUP_BYTES = 1 << 21
#: Words whose ids a task remembers.
CACHE_WORDS = 600_000
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
MARK = np.zeros(256, bool)
MARK[list(b".,")] = True
ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])


class WordTokens:
    """Token ids of words, that a tokenizer which never merges across white space gives; words seen before are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        self.mark = (special[0][1], special[0][0]) if special else None
        self.special = [name.encode() for _, name in special]
        self.lowers = self.ids_of("ABCXYZ") == self.ids_of("abcxyz")
        self.splits = self.ids_of("word.") == self.ids_of("word") + self.ids_of(".") and self.ids_of("word,") == self.ids_of("word") + self.ids_of(",")
        self.clear()

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def _room(self, name: str, n: int) -> None:
        old = getattr(self, name)
        if len(old) < n:
            setattr(self, name, np.concatenate([old, np.zeros(max(n, 2 * len(old)) - len(old), old.dtype)]))

    def _encoded(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        if not plain or self.mark is None:
            ids = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
            size = np.array([len(x) for x in ids], np.int64)
            return np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum())), size
        # Many words in one call, with a special token between them.
        name, mark = self.mark
        texts = [name.join(words[i : i + 256]) + name for i in range(0, len(words), 256)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(ids == mark)
        return ids[ids != mark], np.diff(ends, prepend=-1) - 1

    def __call__(self, block: K.Block, found: K.Words, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and how many each word has. ``plain``: no word holds a special token, so case doesn't matter."""
        if len(self.at) > CACHE_WORDS:
            self.clear()
        lower = plain and self.lowers
        names, sample, inverse = np.unique(K.hash_words(block, found, lower), return_index=True, return_inverse=True)
        slot = np.fromiter((self.at.get(h, -1) for h in names.tolist()), np.int64, len(names))
        new = np.flatnonzero(slot < 0)
        if len(new):
            raw = block.data.tobytes()
            words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(found.start[sample[new]].tolist(), found.end[sample[new]].tolist(), strict=True)]
            flat, size = self._encoded(words, plain)
            n = len(self.at)
            slot[new] = np.arange(n, n + len(new))
            self.at.update(zip(names[new].tolist(), slot[new].tolist(), strict=True))
            for name in ("first", "size"):
                self._room(name, n + len(new))
            self._room("ids", self.used + len(flat))
            self.first[slot[new]], self.size[slot[new]] = self.used + np.cumsum(size) - size, size
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
        word = slot[inverse]
        size = self.size[word]
        return self.ids[np.repeat(self.first[word], size) + K.runs(size)], size


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One for each file in a worker, kept for its next tasks."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def split_marks(block: K.Block, found: K.Words) -> K.Words:
    """The same words, with a full stop or comma after an ASCII letter or digit as a word of its own."""
    if not len(found.start):
        return found
    ends = found.end
    splits = MARK[block.data[ends - 1]] & ALNUM[block.data[np.maximum(ends - 2, 0)]] & (ends - found.start > 1)
    size = 1 + splits
    at = np.cumsum(size) - size
    start, end = np.empty(at[-1] + size[-1], np.int64), np.empty(at[-1] + size[-1], np.int64)
    start[at], end[at] = found.start, ends - splits
    start[at[splits] + 1], end[at[splits] + 1] = ends[splits] - 1, ends[splits]
    return K.Words(start, end, np.concatenate([at, [len(start)]])[found.of_doc])


def tokenized(block: K.Block, tokens: WordTokens, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of all documents (each with end_id last), where each document ends, and where sentences end inside documents."""
    found = K.words(block)
    raw = block.data.tobytes()
    lowered = raw.lower()
    plain = not any(name.lower() in lowered for name in tokens.special)
    if plain and tokens.splits:
        found = split_marks(block, found)
    ids, size = tokens(block, found, plain)
    n_docs = len(block.at) - 1
    doc = found.doc
    after = np.cumsum(size)
    total = np.concatenate([[0], after])
    ends = total[found.of_doc[1:]] + np.arange(1, n_docs + 1)
    out = np.full(len(ids) + n_docs, end_id, np.uint32)
    is_id = np.ones(len(out), bool)
    is_id[ends - 1] = False
    out[is_id] = ids
    lines = np.concatenate([[0], np.cumsum(block.data == 10, dtype=np.int64)])
    stops = np.zeros(len(size), bool)
    if len(size):
        stops |= STOP[block.data[found.end - 1]]
        stops[:-1] |= lines[found.start[1:]] > lines[found.end[:-1]]
        stops[found.of_doc[1:][np.diff(found.of_doc) > 0] - 1] = False
    return out, ends, after[stops] + doc[stops]


def choose_ends(positions: list[int], penalties: list[int], length: int = LENGTH) -> list[int]:
    """Window ends, out of ``positions`` (ascending, the last one always), of least total cost; the stream begins at 0.

    Neighbouring positions are at most ``length`` apart.
    """
    at, cost = [0, *positions], [0]
    before = [0] * len(at)
    index = {0: 0}
    powers = [1 << k for k in range(LEAST_POWER.bit_length() - 1, length.bit_length()) if 1 << k <= length]
    queue: deque[int] = deque([0])
    base = [0]
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        best = base[i] + length - here
        for p in powers:
            k = index.get(here - p)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += PER_WINDOW + penalties[j - 1]
        before[j] = i
        cost.append(best)
        index[here] = j
        value = best + here
        base.append(value)
        while queue and base[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = before[j]
    return out[::-1]


def tail_ends(first: int, last: int, length: int = LENGTH) -> list[int]:
    """Ends of the last window of a stream: cut into powers of two, which need no padding, where that costs less than padding it."""
    out, at = [], first
    while at < last:
        at += 1 << ((last - at).bit_length() - 1)
        out.append(at)
    return out if (len(out) - 1) * (PER_WINDOW + CUT_WORDS) < length - (last - first) or len(out) == 1 else [last]


def _positions(ends: np.ndarray, sentences: np.ndarray, skipped: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([ends, sentences])
    penalty = np.concatenate([np.zeros(len(ends), np.int64), np.full(len(sentences), CUT_SENTENCES)])
    order = np.lexsort((penalty, at))
    at, penalty = at[order], penalty[order]
    keep = (at > 0) & np.concatenate([[True], at[1:] > at[:-1]])
    at, penalty = at[keep], penalty[keep]
    gaps = np.diff(np.concatenate([[0], at]))
    more = (gaps - 1) // STRIDE
    if more.any():
        extra = np.repeat(at - gaps, more) + (K.runs(more) + 1) * STRIDE
        at, penalty = np.concatenate([at, extra]), np.concatenate([penalty, np.full(len(extra), CUT_WORDS)])
        order = np.argsort(at, kind="stable")
        at, penalty = at[order], penalty[order]
    return at, penalty


class Stream:
    """Tokens of whole documents that wait to be cut; the first ``skipped`` ids of the first document are already out."""

    def __init__(self):
        self.parts, self.ends, self.sentences, self.doc_ids, self.totals, self.skipped, self.n = [], [], [], [], [], 0, 0

    def add(self, ids: np.ndarray, ends: np.ndarray, sentences: np.ndarray, doc_ids: pa.Array) -> None:
        self.parts.append(ids)
        self.totals.append(np.diff(np.concatenate([[0], ends])))
        self.ends.append(ends + self.n)
        self.sentences.append(sentences + self.n)
        self.doc_ids.append(doc_ids)
        self.n += len(ids)

    def cut(self, first_sequence: int, last: bool, length: int) -> tuple[pa.RecordBatch, int]:
        """Pieces of all windows but, unless ``last``, the one at the end, which stays; and how many windows."""
        ids, ends, sentences = np.concatenate(self.parts), np.concatenate(self.ends), np.concatenate(self.sentences)
        totals, doc_ids = np.concatenate(self.totals), pa.concat_arrays(self.doc_ids)
        at, penalty = _positions(ends, sentences, self.skipped)
        windows = choose_ends(at.tolist(), penalty.tolist(), length)
        if last:
            from_ = windows[-2] if len(windows) > 1 else 0
            windows = windows[:-1] + tail_ends(from_, windows[-1], length)
        else:
            windows = windows[:-1]
        windows = np.array(windows, np.int64)
        done = int(windows[-1]) if len(windows) else 0
        stop = np.union1d(ends[ends <= done], windows)
        start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
        doc = np.searchsorted(ends, start, "right")
        window = np.searchsorted(windows, start, "right")
        begins = ends - totals
        begins[0] = -self.skipped
        raw = ids.tobytes()
        out = pa.RecordBatch.from_arrays(
            [
                doc_ids.take(pa.array(doc)),
                pa.array(start - begins[doc]),
                pa.array(stop - start),
                pa.array([raw[4 * s : 4 * e] for s, e in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary()),
                pa.array(totals[doc]),
                pa.array(first_sequence + window),
                pa.array(start - np.concatenate([[0], windows])[window]),
            ],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        left = np.flatnonzero(ends > done)
        if len(left):
            self.skipped = int(done - begins[left[0]])
            self.parts, self.ends, self.sentences = [ids[done:]], [ends[left] - done], [sentences[sentences > done] - done]
            self.totals, self.doc_ids, self.n = [totals[left]], [doc_ids.take(pa.array(left))], len(ids) - done
        else:
            self.__init__()
        return out, len(windows)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Cut ``docs`` (doc_id, text) into pieces and put them into sequences of at most ``length`` tokens, in the order of the rows.

    Returns for each piece doc_id, start and length (in the ids of its
    document), ids (binary, unsigned 32-bit little-endian), doc_tokens,
    sequence_id and offset (gapless from 0 in each sequence). ``tokenizer`` is
    a file every executor can read; it must split at white space. Null and
    empty texts are ``end_id`` alone; every row, repeated ones too, is packed
    for itself, also with a null doc_id; an empty table gives no rows; other
    columns are ignored. Texts are read whole, however long. Between window
    ends of equal cost the longer window is chosen. A task cuts PORTION tokens
    at once, each portion at least cost from where the one before it ended; the
    last window of a portion stays open, so a portion costs at most one window
    more than a cut of the whole stream. Only ends of a task's stream need no
    neighbour, so nothing is shuffled.
    """
    path = tokenizer or default_tokenizer()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        tokens, stream = word_tokens(path), Stream()
        for batch in batches:
            for block in K.blocks(batch.column("text"), LOOKUP_BYTES):
                stream.add(*tokenized(block, tokens, end_id), batch.column("doc_id").slice(block.first, block.last - block.first))
                if stream.n >= PORTION:
                    out, n = stream.cut(sequence, False, length)
                    sequence += n
                    yield out
        if stream.n:
            yield stream.cut(sequence, True, length)[0]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
