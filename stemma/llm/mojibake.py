"""Problem 10: text that was decoded with the wrong character encoding.

Every stretch between blanks that isn't plain ASCII is a node of a search graph whose edges undo one mishap:
encode by the code page that was wrongly used and decode by the right one, or unescape. A best-first search with
hashed visited states follows the cheapest texts first; the cost is how implausible a text's characters and
their neighbours are (stray controls, symbols inside words, mixed scripts and cases, and for Cyrillic words the
letter pairs, counted over the whole corpus). A stretch is garbled if some path leads to a text that is
clearly more plausible. Characters already lost (U+FFFD) are a case of their own."""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import partitions, ship

# Code pages that texts are wrongly read in, and encodings they were really in.
READ_AS = ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "gbk", "cp932", "mac_cyrillic", "iso8859_5", "cp1250", "iso8859_15"]
WAS_IN = ["utf-8", "cp1252", "cp1251", "koi8_r", "cp866", "mac_roman", "cp932", "euc_jp", "gbk", "iso8859_5", "mac_cyrillic", "cp437", "cp850"]
MARGIN, WORSE, SHORT = 0.5, 1.5, 64
# Mishaps seen often; a step of another kind has to gain more.
USUAL_STEPS = {"cp1252>cp1251", "cp1251>cp1252", "cp1251>koi8_r", "koi8_r>cp1251", "cp1251>cp866", "cp1252>koi8_r", "cp1252>mac_roman", "mac_roman>cp1252", "cp1252>cp437", "cp1252>cp850", "cp437>cp1252", "cp850>cp1252", "cp1252>cp932", "cp932>euc_jp", "cp1252>euc_jp", "cp1252>gbk", "latin-1>cp932", "latin-1>cp1251", "gbk>cp932", "gbk>euc_jp"}
_CYRILLIC = re.compile("[а-яёА-ЯЁ]+")
_TOKEN = re.compile(r"[^ \t\r\n]+")
_SPECIAL = re.compile(r"[^\x00-\x7f]|&#|&(?:[AaENOIU][a-z]+|euro);|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|=[C-F][0-9A-F]=|%[C-Fc-f][0-9A-Fa-f]%")
_RUN = re.compile(r"[^\x00-\x7f]+")
_USUAL = set("äöüßéèêëàâîïôûùçñáíóúãõœæøåìòýãõ")
_USUAL_UPPER = set("ÄÖÜÉÈÊËÀÂÎÏÔÛÙÇÑÁÍÓÚÃÕŒÆØÅÌÒ")
_QUIET = set("¡¿«»§©®°±µ·€£¢¥½¼¾²³…–—‘’“”„•™×÷→←↑↓↔⇒≤≥≠≈∞✅✓✔✗★☆№​‍﻿️")


@lru_cache(maxsize=1 << 16)
def _char(c: str) -> tuple[str, float]:
    """(class, cost). Classes: a ASCII letter, d digit, p other ASCII, l L Latin, c C Cyrillic, g Greek, k kana, h other
    CJK, o other letter, q quotes and dashes, s symbol, b box or block, x stray."""
    o = ord(c)
    if o < 128:
        return ("a" if c.isalpha() else "d" if c.isdigit() else "x" if o < 32 and c not in "\t\r\n\f" or o == 127 else "p"), (1.5 if o < 32 and c not in "\t\r\n\f\x0b\x1b" else 0.0)
    if o < 0xA0 or c == "�" or 0xE000 <= o <= 0xF8FF or o >= 0xF0000:
        return "x", 2.5
    if o == 0xA0:
        return "n", 0.5
    if o == 0xAD:
        return "n", 1.0
    cat = unicodedata.category(c)
    if cat in ("Cn", "Cs", "Co"):
        return "x", 2.5
    if c in _USUAL:
        return "l", 0.15
    if c in _USUAL_UPPER:
        return "L", 0.4
    if c in "‘’“”„–—…•":
        return "q", 0.2
    if c in _QUIET:
        return "s", 0.35
    if 0x2500 <= o < 0x25A0:
        return "b", 0.3
    if 0xAA == o or 0xBA == o:
        return "s", 0.8
    if 0x180 <= o < 0x2B0:
        return "l", 1.8
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        if cat[0] == "L":
            return ("L" if cat == "Lu" else "l"), 0.9
        return "s", 1.2
    if 0x2C0 <= o < 0x370 or c in "‚ƒ†‡‰‹›":
        return "s", 1.3
    if 0x370 <= o < 0x400:
        return "g", 0.4
    if 0x400 <= o < 0x530:
        if c in "ёЁ" or 0x410 <= o < 0x450:
            return ("C" if cat == "Lu" else "c"), 0.08
        return ("C" if cat == "Lu" else "c"), 1.0
    if 0x3040 <= o < 0x3100 or o in (0x3001, 0x3002, 0x300C, 0x300D, 0x30FC, 0x3005) or 0xFF01 <= o < 0xFF5F:
        return "k", 0.1
    if 0xFF61 <= o < 0xFFA0:
        return "j", 1.0
    if 0x3400 <= o < 0xA000 or 0x20000 <= o < 0x30000:
        return "h", 0.3
    if 0xF900 <= o < 0xFB00 or 0x2E80 <= o < 0x3000:
        return "h", 1.2
    if cat[0] == "L" or cat[0] == "M":
        return "o", 0.25
    if cat in ("So", "Sm", "Sc"):
        return "s", 0.4
    return "s", 0.8


def _pairs() -> dict[str, float]:
    """Cost of two classes standing side by side (either order unless given)."""
    out = {}

    def both(a: str, b: str, v: float):
        for x in a:
            for y in b:
                out[x + y] = out[y + x] = v

    both("al", "cCg", 1.6)
    both("L", "cCg", 1.6)
    both("cC", "g", 1.6)
    both("lL", "khjo", 1.5)
    both("a", "h", 0.55)
    both("a", "k", 0.05)
    both("aj", "j", 0.3)
    both("cCg", "khj", 1.5)
    both("acClLg", "b", 0.9)
    both("d", "b", 0.2)
    both("sq", "b", 0.8)
    both("khj", "bs", 0.7)
    both("kh", "j", 0.8)
    both("lLg", "s", 0.7)
    both("cC", "s", 0.6)
    both("a", "s", 0.35)
    both("s", "s", 0.3)
    both("s", "q", 0.5)
    both("L", "q", 0.4)
    both("lgcC", "q", 0.15)
    both("x", "acClLghkbsqdjonp", 0.3)
    both("n", "acClLghkbsq", 0.4)
    both("h", "q", 0.5)
    both("o", "acClLghks", 1.0)
    out["lL"] = 0.9
    out["cC"] = 0.9
    return out


_PAIR = _pairs()


class Plausibility:
    def __init__(self, bigrams: dict[str, int] | None = None):
        total = Counter()
        self.logs: dict[str, float] = {}
        for k, n in (bigrams or {}).items():
            total[k[0]] += n
        self.total, self.counts = total, bigrams or {}
        self.known: dict[str, float] = {}

    def letters(self, word: str) -> float:
        """Cost of a Cyrillic word's letter pairs, from how often they follow each other in the corpus."""
        low = word.lower()
        bits = 0.0
        seq = "^" + low + "$"
        for a, b in zip(seq, seq[1:]):
            bits -= math.log2((self.counts.get(a + b, 0) + 0.3) / (self.total.get(a, 0) + 10.0))
        mean = bits / (len(seq) - 1)
        caps = sum(1 for a, b in zip(word, word[1:]) if a.islower() and b.isupper())
        odd = max(0.0, mean - 4.2) * min(len(low), 12) * 0.35 if self.total and len(low) >= 4 else 0.0
        shout = 0.25 if len(word) >= 4 and word.isupper() else 0.0
        return odd + shout + 0.3 * caps

    def cost(self, s: str, limit: float = math.inf) -> float:
        """Every character and pair adds to the cost, so from `limit` on the rest of the text need not be looked at. Texts
        above SHORT characters are looked up in tables, all characters at once; the sum is the same."""
        c = self.known.get(s)
        if c is not None:
            return c
        if len(s) > SHORT:
            total = _long_cost(s)
            return self._whole(s, total) if total < limit else total
        total, last, before, earlier = 0.0, "p", "", "p"
        for ch in s:
            k, v = _char(ch)
            total += v
            if last in "sn" and k in "alL" and earlier in "alL":
                total += 0.7  # a symbol within a word
            if k != last or k in "sx":
                # A symbol after itself (rows of marks) is no oddity.
                if not (k == "s" and ch == before):
                    total += _PAIR.get(last + k, 0.0)
            if k == "L" and last == "a" and before.islower():
                total += 0.9
            if total >= limit:
                return total
            earlier, last, before = last, k, ch
        return self._whole(s, total)

    def _whole(self, s: str, total: float) -> float:
        for m in _CYRILLIC.finditer(s):
            total += self.letters(m.group())
        if len(self.known) > 400_000:
            self.known.clear()
        self.known[s] = total
        return total


_CLASSES = "adpxnlLqsbgcCkjho"
_TABLES: list = []


def _tables():
    """(class, cost, is lower) of every character of the basic plane and (pair cost) of every two classes."""
    if not _TABLES:
        known = [_char(chr(o)) if not 0xD800 <= o < 0xE000 else ("x", 2.5) for o in range(0x10000)]
        pair = np.zeros((len(_CLASSES), len(_CLASSES)))
        for two, v in _PAIR.items():
            pair[_CLASSES.index(two[0]), _CLASSES.index(two[1])] = v
        _TABLES.extend([np.array([_CLASSES.index(k) for k, _ in known], np.int8), np.array([v for _, v in known]), np.array([chr(o).islower() for o in range(0x10000)]), pair])
    return _TABLES


def _long_cost(s: str) -> float:
    """The character and pair costs of Plausibility.cost by table."""
    classes, costs, lower, pair = _tables()
    cp = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(cp, 0xFFFF)
    k, v, small = classes[low], costs[low], lower[low]
    for o in np.unique(cp[cp > 0xFFFF]):
        kind, cost = _char(chr(o))
        k, v = np.where(cp == o, _CLASSES.index(kind), k).astype(np.int8), np.where(cp == o, cost, v)
    of = lambda names: np.isin(k, [_CLASSES.index(c) for c in names])
    word, p = of("alL"), _CLASSES.index("p")
    last, before = np.r_[p, k[:-1]], np.r_[0, cp[:-1]]
    inside = np.zeros(len(k), bool)
    inside[2:] = of("sn")[1:-1] & word[2:] & word[:-2]
    beside = ((k != last) | of("sx")) & ~((k == _CLASSES.index("s")) & (cp == before))
    raised = np.zeros(len(k), bool)
    raised[1:] = (k[1:] == _CLASSES.index("L")) & (k[:-1] == _CLASSES.index("a")) & small[:-1]
    return float(v.sum() + 0.7 * inside.sum() + pair[last, k][beside].sum() + 0.9 * raised.sum())


def _encode(s: str, page: str) -> bytes | None:
    try:
        return s.encode(page)
    except UnicodeEncodeError:
        if page != "cp1252":
            return None
    out = bytearray()
    for ch in s:  # the five bytes that the code page leaves open pass through as controls
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) > 0xFF:
                return None
            out.append(ord(ch))
    return bytes(out)


def _decode(data: bytes, page: str) -> str | None:
    try:
        return data.decode(page)
    except UnicodeDecodeError:
        return None


def _unescape(s: str) -> str:
    s = html.unescape(s.replace("&nbsp;", " ")) if "&" in s else s
    if "\\" in s:
        s = re.sub(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1) or m.group(2), 16)), s)
    if re.search(r"=[C-F][0-9A-F]=[89AB][0-9A-F]", s):
        s = re.sub(r"=([89A-F][0-9A-F])", lambda m: chr(int(m.group(1), 16)), s)
    if re.search(r"%[C-Fc-f][0-9A-Fa-f]%[89ABab][0-9A-Fa-f]", s):
        s = re.sub(r"%([89A-Fa-f][0-9A-Fa-f])", lambda m: chr(int(m.group(1), 16)), s)
    return s


def step_cost(name: str, path: tuple) -> float:
    """A valid UTF-8 reading hardly comes about by chance, a reading in a one-byte page always does."""
    if name == "unescape":
        return 0.0
    if name.endswith(">utf-8"):
        return 0.1
    base = 0.35 if name in USUAL_STEPS else 0.9
    return base + (0.6 if path and path != ("unescape",) else 0.0)


def moves(s: str, path: tuple = (), budget: float = math.inf):
    """(name, text, step cost) of all texts one undone mishap away whose step costs less than the budget."""
    t = _unescape(s)
    if t != s:
        yield "unescape", t, 0.0
    done = set()
    for page in READ_AS:
        names = [(f"{page}>{enc}", enc, step_cost(f"{page}>{enc}", path)) for enc in WAS_IN if enc != page]
        names = [x for x in names if x[2] < budget]
        data = _encode(s, page) if names else None
        if data is None or data in done:  # equal bytes give equal readings
            continue
        done.add(data)
        for name, enc, step in names:
            t = _decode(data, enc)
            if t is not None and t != s:
                yield name, t, step


def search(s: str, model: Plausibility):
    """(best text, its cost, path, cost of the start). The start's escapes are undone at no gain: ordinary
    entities of web pages are no mishap.

    A path costs its steps and the implausibility of the text it leads to. A text is left aside only where no path on from
    it can still pay (its steps alone cost what the best path does in all, or less than MARGIN would be gained) or where a
    step makes it less plausible by WORSE or more; it is visited again if a cheaper way leads to it. So the search ends
    by itself, whatever the length of the text and of the path."""
    plain = _unescape(s)
    first = ("unescape",) if plain != s else ()
    start = model.cost(plain)
    heap, spent_at, best, n = [(start, 0, plain, first, 0.0)], {plain: 0.0}, (start, plain, first), 0
    bound = start - MARGIN + 1e-6
    while heap:
        cost, _, text, path, spent = heapq.heappop(heap)
        if spent > spent_at[text]:
            continue
        for name, t, step in moves(text, path, bound - spent):
            now = spent + step
            if now >= spent_at.get(t, math.inf) or now >= bound:
                continue
            spent_at[t] = now
            n += 1
            c = model.cost(t, max(bound, cost + WORSE) - now) + now
            if c < bound - 1e-9:
                best, bound = (c, t, (*path, name)), c
            if c < cost + WORSE:
                heapq.heappush(heap, (c, n, t, (*path, name), now))
    return best[1], best[0], best[2], start


def enough(s: str, path: tuple, gain: float) -> bool:
    """Whether a path's gain proves a mishap: a fixed margin, and without a UTF-8 step more the longer the text is."""
    if not path or path == ("unescape",) or gain < MARGIN:
        return False
    return any(p.endswith(">utf-8") for p in path) or gain >= 0.12 * sum(1 for c in s if c > "\x7f")


class Restorer:
    def __init__(self, bigrams: dict[str, int] | None = None):
        self.model, self.memo = Plausibility(bigrams), {}

    def stretch(self, s: str):
        """(restored, gain, path) of one stretch between blanks."""
        known = self.memo.get(s)
        if known is not None:
            return known
        if self.model.cost(_unescape(s)) < MARGIN:  # no path can gain more than the whole cost
            self.memo[s] = (s, 0.0, ())
            return self.memo[s]
        text, gain, path = self.whole_or_runs(s)
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[s] = (text, gain, path)
        return self.memo[s]

    def whole_or_runs(self, s: str):
        """(restored, gain, path) of a stretch read as a whole or, where that is no case, run by run of its non-ASCII
        characters: a part may be garbled next to characters that the wrong code page never had."""
        t, c, path, start = search(s, self.model)
        if enough(s, path, start - c):
            return t, start - c, path
        out, done, most, how = [], 0, 0.0, ()
        for m in _RUN.finditer(s):
            run = m.group()
            if len(run) == len(s) or self.model.cost(run) < MARGIN:
                continue
            t, c, path, start = search(run, self.model)
            if enough(run, path, start - c):
                out.append(s[done : m.start()] + t)
                done, most, how = m.end(), most + start - c, path
        return ("".join(out) + s[done:], most, how) if how else (s, 0.0, ())

    def document(self, text: str | None, known: dict | None = None):
        """(restored text, total gain, paths, lost characters) of a whole text; known holds the judged stretches."""
        if not text or text.isascii() and not _SPECIAL.search(text):
            return text, 0.0, "", 0
        out, at, gain, paths = [], 0, 0.0, Counter()
        for m in _TOKEN.finditer(text):
            s = m.group()
            if known is not None and s not in known or s.isascii() and not _SPECIAL.search(s):
                continue
            t, g, p = self.stretch(s) if known is None else known[s]
            if g:
                out.append(text[at : m.start()] + t)
                at, gain = m.end(), gain + g
                paths["+".join(p)] += 1
        out.append(text[at:])
        return "".join(out), gain, ",".join(k for k, _ in paths.most_common(3)), text.count("\ufffd")


def letter_pairs(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often Cyrillic letters follow each other, over all documents: at most 35 * 35 pairs, whatever the corpus."""

    def run(frames):
        for pdf in frames:
            n: Counter = Counter()
            for t in pdf["t"]:
                for w, k in Counter(_CYRILLIC.findall(t)).items():
                    seq = "^" + w.lower() + "$"
                    for a, b in zip(seq, seq[1:]):
                        n[a + b] += k
            yield pd.DataFrame(list(n.items()), columns=["pair", "n"])

    some = docs.select(F.col(text).alias("t")).where(F.col(text).rlike("[а-яё]"))
    counts = some.repartition(partitions(docs.sparkSession)).mapInPandas(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r.pair: r.n for r in counts.collect()}


def _odd(text) -> Column:
    return text.rlike(_SPECIAL.pattern)


def garbled_stretches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, s, restored, gain, path) of every stretch between blanks of every text that a search finds garbled, once
    a row. Each distinct stretch of the corpus is searched once, whatever the number of texts that hold it."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(letter_pairs(docs, text))

    def run(frames):
        r = Restorer(shared.value)
        for pdf in frames:
            rows = [(s, *r.stretch(s)) for s in pdf["s"]]
            yield pd.DataFrame([(s, t, g, list(p)) for s, t, g, p in rows if g > 0], columns=["s", "restored", "gain", "path"])

    stretches = F.array_distinct(F.filter(F.split(F.col(text), "[ \t\r\n]+"), _odd))
    held = docs.where(_odd(F.col(text))).select(F.col(doc_id), F.explode(stretches).alias("s"))
    cases = held.select("s").distinct().repartition(partitions(spark), "s").mapInPandas(run, "s string, restored string, gain double, path array<string>")
    return held.join(cases, "s")


def garbled_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The distinct ids of the texts that find_garbled finds, without restoring them; the texts are not moved."""
    lost = docs.where(F.instr(F.col(text), "\ufffd") > 0).select(F.col(doc_id))
    return garbled_stretches(docs, doc_id, text).select(F.col(doc_id)).unionByName(lost).distinct()


def find_garbled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored, gain, paths, lost) of every row whose text went through a wrong encoding, wholly or in
    places. lost counts characters that cannot be restored. Null, empty and plain ASCII texts are no case; rows
    are judged one by one, so repeated rows come back each; an empty table gives an empty result."""
    kind = docs.schema[doc_id].dataType.simpleString()
    # What one id collects are stretches of its own texts.
    hits = garbled_stretches(docs, doc_id, text).groupBy(F.col(doc_id).alias("_id")).agg(F.collect_set(F.struct("s", "restored", "gain", "path")).alias("hits"))
    src = docs.where(_odd(F.col(text))).select(F.col(doc_id), F.col(text).alias("t"))
    both = src.join(hits, F.col(doc_id).eqNullSafe(F.col("_id")), "left").where("hits is not null or instr(t, '\ufffd') > 0").select(F.col(doc_id), "t", "hits")

    def run(frames):
        r = Restorer()
        for pdf in frames:
            rows = [(i, *r.document(t, {h["s"]: (h["restored"], h["gain"], h["path"]) for h in (() if hits is None else hits)})) for i, t, hits in zip(pdf[doc_id], pdf["t"], pdf["hits"])]
            yield pd.DataFrame([x for x in rows if x[2] > 0 or x[4]], columns=[doc_id, "restored", "gain", "paths", "lost"])

    return both.mapInPandas(run, f"`{doc_id}` {kind}, restored string, gain double, paths string, lost int")
