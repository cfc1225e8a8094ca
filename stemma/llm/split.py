"""Problem 6: cutting oversized items at natural boundaries.

The bytes of every item are laid out in fixed ranges with a halo on either side. Workers see one range at
a time: near each range's start they fix a cut that their neighbour finds as well, because both see the
same halo, and cut what lies between into pieces. A table of pieces per range is prefix-summed to number
the pieces of the whole item. A giant item is therefore spread over many tasks and is never walked by
one; files are read by byte offset (split_files), never whole.

Boundaries, best first: paragraph end, line end, sentence end, word end, code point."""

from __future__ import annotations

import os

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, partitions, ship

LIMIT, OVERLAP, RANGE = 1500, 200, 1 << 16
PIECES = "item string, range_no long, piece_in_range int, n_in_range int, start long, end long, text string"

_PARAGRAPH = regex.compile(rb"(?:\r?\n[ \t]*){2,}|\r\r")
_LINE = regex.compile(rb"\r\n|\n|\r")
# Sentence ends: ASCII marks need a blank after them, the ideographic and Arabic ones do not.
_SENTENCE = regex.compile(
    rb"[.!?][\"')\]]*\s+|\xe2\x80\xa6\s+"  # . ! ? and the ellipsis
    rb"|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xef\xbd\xa1|\xd8\x9f\s*|\xe0\xa5\xa4\s*"  # CJK, Arabic, Devanagari
)
_WORD = regex.compile(rb"[ \t\x0b\x0c]+|\xc2\xa0|\xe3\x80\x80|\xe2\x80[\x80-\x8b]")


def _last(pattern, data: bytes, low: int, high: int) -> int:
    """End of the last match that ends in (low, high]; -1 if there is none."""
    best = -1
    for m in pattern.finditer(data, low, high):
        if low < m.end() <= high:
            best = m.end()
    return best


def cut_before(data: bytes, low: int, high: int) -> int:
    """The best boundary in (low, high] of data; of equal kinds the last one."""
    for pattern in (_PARAGRAPH, _LINE, _SENTENCE, _WORD):
        at = _last(pattern, data, low, high)
        if at > low:
            return at
    at = high
    while at > low and at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at if at > low else high


def overlap_start(data: bytes, low: int, cut: int, overlap: int) -> int:
    """Where the next piece starts: the first boundary within overlap bytes before the cut, else the first
    code point there."""
    if overlap <= 0:
        return cut
    begin = max(low, cut - overlap)
    for pattern in (_LINE, _SENTENCE, _WORD):
        m = pattern.search(data, begin, cut)
        if m and m.end() < cut:
            return m.end()
    while begin < cut and data[begin] & 0xC0 == 0x80:
        begin += 1
    return begin


def pieces_of(data: bytes, start: int, end: int, limit: int, overlap: int):
    """(from, to) of the pieces of data[start:end], each at most limit bytes, consecutive ones sharing up to
    overlap bytes. Cuts lie in the last three fifths of a piece where a boundary lets them."""
    at = start
    while end - at > limit:
        high = at + limit
        cut = cut_before(data, at + max(overlap, limit * 2 // 5), high)
        yield at, cut
        nxt = overlap_start(data, at + 1, cut, overlap)
        at = nxt if nxt > at else cut
    yield at, end


def _anchor(data: bytes, origin: int, edge: int, halo: int) -> int:
    """The cut fixed for a range edge: the best boundary in (edge - halo, edge], from the same bytes on either side."""
    a = edge - origin
    return origin + cut_before(data[: a + 4], max(0, a - halo), a)


def range_pieces(data: bytes, origin: int, total: int, number: int, limit: int, overlap: int, size: int):
    """Pieces of one range of an item of total bytes. data starts at byte origin and holds the range with
    halos of limit bytes. Offsets are absolute. All but an item's first piece reach back over the overlap."""
    low = 0 if number == 0 else _anchor(data, origin, number * size, limit)
    last = (number + 1) * size >= total
    high = total if last else _anchor(data, origin, (number + 1) * size, limit)
    begin = low if number == 0 else origin + overlap_start(data, max(0, low - origin - overlap), low - origin, overlap)
    for a, b in pieces_of(data, begin - origin, high - origin, limit, overlap):
        yield a + origin, b + origin


def _cut_ranges(limit: int, overlap: int, size: int):
    def run(frames):
        for pdf in frames:
            out = []
            for item, data, origin, total, number in zip(pdf["item"], pdf["data"], pdf["origin"], pdf["total"], pdf["range_no"]):
                data, origin = bytes(data), int(origin)
                found = list(range_pieces(data, origin, int(total), int(number), limit, overlap, size))
                for k, (a, b) in enumerate(found):
                    out.append((item, int(number), k, len(found), a, b, data[a - origin : b - origin].decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in PIECES.split(", ")])

    return run


def _ranges(total: Column, size: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((total - 1) / size)).cast("long"))


def _whole(pieces: DataFrame) -> DataFrame:
    """Numbered pieces of items that are one range: the range's own count is the item's."""
    return pieces.select("item", F.col("piece_in_range").alias("piece_no"), F.col("n_in_range").alias("n_pieces"), "start", "end", "text")


def _numbered(pieces: DataFrame) -> DataFrame:
    """piece_no and n_pieces of the item, by a prefix sum over the small table of pieces per range."""
    counts = pieces.groupBy("item", "range_no").agg(F.count("*").alias("n"))
    w = Window.partitionBy("item").orderBy("range_no")
    first = counts.select(
        "item", "range_no", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("item")).alias("n_pieces")
    )
    return pieces.join(first, ["item", "range_no"]).select(
        "item", (F.col("before") + F.col("piece_in_range")).cast("int").alias("piece_no"), F.col("n_pieces").cast("int").alias("n_pieces"), "start", "end", "text"
    )


def split_items(items: DataFrame, item: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """items -> (item, piece_no, n_pieces, start, end, text), offsets in bytes of UTF-8.

    The text of an item is its pieces joined, each after the first without the bytes before its
    predecessor's end. Items at or below the limit come back as one piece; null and empty texts give none.
    Repeated rows of an item are one: equal ids are cut once, from the greatest text. Only the two named
    columns are read, so other columns may have any name."""
    _check(limit, overlap, size)
    ship(items.sparkSession)
    src = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("t")).where("item is not null and t <> ''")
    src = src.groupBy("item").agg(F.max("t").alias("t"))
    data = src.select("item", F.encode("t", "UTF-8").alias("b")).withColumn("total", F.octet_length("b").cast("long"))
    # Slices are made in one pass over the item's bytes, so a giant value isn't copied for every range.
    slices = data.select(
        "item", "total",
        F.transform(_ranges(F.col("total"), size), lambda k: F.struct(
            k.alias("range_no"), F.greatest(F.lit(0), k * size - 2 * limit).alias("origin"),
            F.substring("b", (F.greatest(F.lit(0), k * size - 2 * limit) + 1).cast("int"), F.lit(size + 4 * limit)).alias("data"),
        )).alias("r"),
    )
    return _pieces(slices.select("item", "total", F.explode("r").alias("r")).select("item", "total", "r.*"), limit, overlap, size)


def _pieces(ranges: DataFrame, limit: int, overlap: int, size: int) -> DataFrame:
    """Items of one range are cut and numbered in one pass; only those of several need their ranges' counts."""
    spread = ranges.repartition(partitions(ranges.sparkSession), "item", "range_no").select("item", "data", "origin", "total", "range_no")
    pieces = lambda condition: spread.where(condition).mapInPandas(_cut_ranges(limit, overlap, size), PIECES)
    return _whole(pieces(F.col("total") <= size)).unionByName(_numbered(pieces(F.col("total") > size)))


def split_files(files: DataFrame, path: str, length: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """The same for files on storage that every worker mounts: only (path, length) is planned, and each task
    reads its byte range with halos. Files of length 0 or null give no pieces."""
    _check(limit, overlap, size)
    ship(files.sparkSession)
    src = files.select(F.col(path).alias("item"), F.col(length).cast("long").alias("total")).where("item is not null and total > 0").distinct()
    planned = src.select("item", "total", F.explode(_ranges(F.col("total"), size)).alias("range_no"))

    def read(frames):
        for pdf in frames:
            blobs, origins = [], []
            for p, k in zip(pdf["item"], pdf["range_no"]):
                with open(os.fspath(p).removeprefix("file://").removeprefix("file:"), "rb") as f:
                    origins.append(max(0, int(k) * size - 2 * limit))
                    f.seek(origins[-1])
                    blobs.append(f.read(size + 4 * limit))
            yield pdf.assign(origin=origins, data=blobs)

    loaded = planned.repartition(partitions(files.sparkSession), "item", "range_no").mapInPandas(read, "item string, total long, range_no long, origin long, data binary")
    # Every range is read once: its pieces are written before their counts are summed up.
    return _numbered(cut(loaded.select("item", "data", "origin", "total", "range_no").mapInPandas(_cut_ranges(limit, overlap, size), PIECES)))


def _check(limit: int, overlap: int, size: int) -> None:
    if not 0 <= overlap * 2 < limit or limit < 8 or size < 4 * limit:
        raise ValueError("need 0 <= 2 * overlap < limit, limit >= 8 and ranges of four limits at least")


def restore(pieces: DataFrame) -> DataFrame:
    """(item, text) put together again from the pieces; for checks, as it gathers each item."""
    w = Window.partitionBy("item").orderBy("piece_no")
    own = pieces.withColumn("skip", F.coalesce(F.lag("end").over(w) - F.col("start"), F.lit(0)))
    own = own.select("item", "piece_no", F.expr("decode(substring(encode(text, 'UTF-8'), cast(skip + 1 as int)), 'UTF-8')").alias("t"))
    return own.groupBy("item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "t"))), lambda x: x["t"]), "").alias("text"))
