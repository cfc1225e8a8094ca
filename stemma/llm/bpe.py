"""Problem 8: token ids of the whole corpus by a public byte-level BPE vocabulary.

The vocabulary is compiled into a transducer that is determinised while it runs. A state stands for the
longest suffix of the input that begins some token, together with the last token of the encoding of every
prefix inside that window; that is all the past that can matter, so the number of states is finite and the
lookahead is bounded by the longest token. Reading a byte finds the one token that ends there and
agrees with what precedes it. Tokens are emitted as soon as every way on shares them.

Decoding runs a UTF-8 state machine byte by byte, so that ids can be fed in any portions."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import partitions, ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how texts are divided before merging (the published pattern of this vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_STATES, MAX_WORDS, LONG_WORD = 400_000, 400_000, 1024


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class _State:
    __slots__ = ("suffix", "lasts", "next", "token", "size")

    def __init__(self, suffix: bytes, lasts: tuple, token: int, size: int):
        self.suffix, self.lasts, self.token, self.size, self.next = suffix, lasts, token, size, {}


class Transducer:
    """Encoder of one vocabulary. Not shared between processes; its tables fill as texts need them."""

    START = -1

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.prefixes = {b[:i] for b in ranks for i in range(len(b) + 1)}
        self.split = regex.compile(pattern).findall
        self._pairs: dict = {}
        self._whole: dict = {}
        self._words: dict = {}
        self._reset()

    def _reset(self) -> None:
        self._states: dict = {}
        self.start = _State(b"", (self.START,), self.START, 0)
        self._states[(b"", (self.START,))] = self.start

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by rank; only used to decide on single tokens and pairs of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _alone(self, token: int) -> bool:
        ok = self._whole.get(token)
        if ok is None:
            ok = self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return ok

    def _agree(self, left: int, right: int) -> bool:
        """Whether right may follow left: merging their bytes gives just these two."""
        key = (left, right)
        ok = self._pairs.get(key)
        if ok is None:
            if left == self.START:
                ok = self._alone(right)
            else:
                ok = self._alone(right) and self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self._pairs) > 4 * MAX_STATES:
                self._pairs.clear()
            self._pairs[key] = ok
        return ok

    def _step(self, state: _State, byte: int) -> _State:
        """The transition by one byte, made when it is first needed."""
        suffix = state.suffix + bytes((byte,))
        lasts, ranks = state.lasts, self.ranks
        token = size = None
        for k in range(len(suffix)):  # longest candidate first; lasts[k] ends where it would begin
            t = ranks.get(suffix[k:])
            if t is not None and self._agree(lasts[k], t):
                token, size = t, len(suffix) - k
                break
        window = lasts + (token,)
        drop = 0
        while suffix[drop:] not in self.prefixes:
            drop += 1
        key = (suffix[drop:], window[drop:])
        to = self._states.get(key)
        if to is None:
            to = self._states[key] = _State(key[0], key[1], token, size)
        state.next[byte] = to
        return to

    def stream(self, chunks):
        """Token ids of one word given in portions of bytes, each emitted once all ways on agree on it."""
        state, tokens, sizes, base = self.start, [], [], 0  # of the positions not yet committed
        for chunk in chunks:
            for i, byte in enumerate(chunk):
                state = state.next.get(byte) or self._step(state, byte)
                tokens.append(state.token)
                sizes.append(state.size)
                if i & 255 == 255 or i == len(chunk) - 1:
                    done = self._settled(sizes, len(state.suffix))
                    if done:
                        yield from self._back(tokens, sizes, done)
                        del tokens[:done], sizes[:done]
        yield from self._back(tokens, sizes, len(tokens))

    @staticmethod
    def _settled(sizes: list[int], window: int) -> int:
        """The last position that the chains of every position in the window pass through."""
        live = set(range(max(0, len(sizes) - window), len(sizes) + 1))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(top - sizes[top - 1] if top else 0)
        return live.pop()

    @staticmethod
    def _back(tokens: list[int], sizes: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(tokens[end - 1])
            end -= sizes[end - 1]
        out.reverse()
        return out

    def word(self, word: str) -> list[int]:
        known = self._words.get(word)
        if known is not None:
            return known
        data = word.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        if len(self._states) > MAX_STATES:
            self._reset()
        if len(data) > LONG_WORD:
            return list(self.stream(data[i : i + 4096] for i in range(0, len(data), 4096)))
        if whole is not None and self._alone(whole):
            ids = [whole]
        else:
            ids = list(self.stream((data,)))
        if len(self._words) > MAX_WORDS:
            self._words.clear()
        self._words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; [] for null or empty text. Strings of special tokens are ordinary text."""
        if not text:
            return []
        out: list[int] = []
        known, add = self._words.get, out.extend
        for w in self.split(text):
            add(known(w) or self.word(w))
        return out

    def decode(self, portions) -> str:
        """Text of ids given in portions; broken UTF-8 becomes U+FFFD."""
        machine, out = Utf8Machine(), []
        for ids in portions:
            for i in ids:
                out.append(machine.feed(self.bytes_of[i]))
        out.append(machine.end())
        return "".join(out)


class Utf8Machine:
    """Incremental UTF-8: the state is the code point so far, the continuation bytes still due, and the range
    the next one must lie in (which excludes overlong forms, surrogates and what is beyond U+10FFFF)."""

    def __init__(self):
        self.code, self.due, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.code, self.due = self.code << 6 | b & 0x3F, self.due - 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.code, self.due = b & 0x1F, 1
            elif 0xE0 <= b <= 0xEF:
                self.code, self.due = b & 0x0F, 2
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.code, self.due = b & 0x07, 3
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        broken, self.due = self.due, 0
        return "�" if broken else ""


@lru_cache(maxsize=4)
def _compiled(data: bytes, pattern: str) -> Transducer:
    return Transducer(read_ranks(data), pattern)


def _worker(shared, pattern):
    return _compiled(bytes(shared.value), pattern)


def _vocabulary(spark, path: str):
    """The file's bytes for the workers: a public vocabulary, under 2 MB whatever the corpus."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 8 << 20:
        raise ValueError("vocabulary file above 8 MiB")
    return spark.sparkContext.broadcast(data)


def _spread(df: DataFrame) -> DataFrame:
    """Few input splits must not leave cores idle: rows are dealt out evenly before the Python work."""
    return df.repartition(partitions(df.sparkSession))


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids array<int>) of every row, whole texts. Null and empty texts give an empty list; repeated
    rows are encoded each; an empty table gives an empty result. Only the two named columns are read."""
    spark = docs.sparkSession
    ship(spark)
    shared = _vocabulary(spark, vocabulary)
    kind = docs.schema[doc_id].dataType

    def run(batches):
        t = _worker(shared, pattern)
        for b in batches:
            offsets, values = [0], []
            for s in b.column(1).to_pylist():
                values.extend(t.encode(s))
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[doc_id, "ids"])

    rows = docs.select(F.col(doc_id), F.col(text).alias("_text"))
    return _spread(rows).mapInArrow(run, f"`{doc_id}` {kind.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, doc_id: str, text: str, keep: list[str], vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The kept columns with n_tokens of every row's text (0 for null or empty)."""
    spark = docs.sparkSession
    ship(spark)
    shared = _vocabulary(spark, vocabulary)
    cols = [doc_id, *keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols) + ", n_tokens long"

    def run(batches):
        t = _worker(shared, pattern)
        for b in batches:
            n = pa.array([len(t.encode(s)) for s in b.column(len(cols)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], n], names=[*cols, "n_tokens"])

    return _spread(docs.select(*cols, F.col(text).alias("_text"))).mapInArrow(run, schema)


def decode_corpus(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from lists of ids; null lists give null, empty lists ''."""
    spark = encoded.sparkSession
    ship(spark)
    shared = _vocabulary(spark, vocabulary)
    kind = encoded.schema[doc_id].dataType

    def run(batches):
        t = _worker(shared, PATTERN)
        for b in batches:
            texts = [None if x is None else t.decode([x]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[doc_id, "text"])

    return encoded.select(F.col(doc_id), F.col(ids)).mapInArrow(run, f"`{doc_id}` {kind.simpleString()}, text string")
