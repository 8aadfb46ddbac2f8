"""Benchmark decontamination by template windows.

Texts become token sequences in which numbers, units after numbers and names are typed slots; all
else is lower-cased and without punctuation. Windows of tokens are hashed, with names as slots,
with capitalised words that open a sentence as names too (they may be one or not), and with names as
words (a text in capitals has no names to tell); windows that are mostly
numbers are hashed literally, so only exact copies of them match. Windows of documents meet
those of benchmark items by a hash join. Along a diagonal, that is hits of one document and item at
the same distance, slot values must correspond one to one: they do in the same question with other
numbers, not in a question of like wording about unrelated things. Where they don't, windows count
that keep to the correspondence which most windows support.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _U, SpanHasher, bounded_batches, columns_of, fresh, mix64, stage_table, text_chunks

WINDOW = 8
#: Shorter items are one window of their own length; below this they are too common to tell.
LEAST_TOKENS = 4
#: At least this share of a window must be words; others have no slots.
LEAST_WORDS = 0.5
COVERAGE = 0.5
#: Benchmarks of up to this many windows are first looked up in a bitmap of 2 ** BITMAP_BITS bits,
#: of which at most so many are sent to the driver; windows of larger ones are all shuffled.
BITMAP_WINDOWS, BITMAP_BITS = 1 << 22, 26
#: A window in more items than this is joined late, for pairs that another window has already found.
COMMON_ITEMS = 64
UNITS = "mm cm m km in ft mi mg g kg t lb oz ml l s sec seconds min minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent mph kmh kph w kw mw v a hz degrees miles meters metres kilometers kilometres grams kilograms liters litres".split()
#: Number words of the tables' languages, but for those that are articles or units.
NUMBER_WORDS = {
    "en": "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million dozen",
    "de": "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend",
    "fr": "zéro deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille",
    "es": "cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil",
}


def number_words() -> list[str]:
    """The words of all languages, and the German ones that are written together, such as dreiundzwanzig."""
    german = NUMBER_WORDS["de"].split()
    together = [f"{one}und{ten}" for one in ["ein", *german[1:9]] for ten in german[19:27]]
    return sorted({w for words in NUMBER_WORDS.values() for w in words.split()} | set(together))


_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_TOKEN = _DIGIT | _UPPER
_TOKEN[97:123] = True
_TOKEN[128:] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b".!?:;\n\"("]] = True
NUM, UNIT, NAME, OPENER, LITERAL = 1, 2, 3, 4, 0
#: Ways to hash a window: without slots, names as words, names as slots, names and openers as slots; and which kinds are slots in each.
EXACT, WORDS, NAMES, OPENERS = 0, 1, 2, 3
_SLOTS = np.array([[0, 0, 0, 0, 0], [0, 1, 1, 0, 0], [0, 1, 1, 1, 0], [0, 1, 1, 1, 1]], dtype=bool)
_SLOT_HASH = mix64(np.array([11, 12, 13, 14, 14], dtype=_U))


def lower_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the Latin-1 capitals lower-cased."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        capital = np.zeros(len(data), dtype=bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[capital] += 32
    return out


def _word_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    at = np.cumsum([0, *map(len, raw)])
    return np.sort(SpanHasher(np.frombuffer(b"".join(raw), dtype=np.uint8))(at[:-1], at[1:]))


_UNIT_HASHES, _NUMBER_HASHES = _word_hashes(UNITS), _word_hashes(number_words())
#: Which code points of up to three bytes are capitals.
_CAPITAL = np.array([chr(c).isupper() or chr(c).istitle() for c in range(1 << 16)])


def _among(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes


def _capitals(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which tokens begin with a capital letter of any script."""
    a, b, c = (data[np.minimum(starts + k, len(data) - 1)].astype(np.int64) for k in range(3))
    two, three = (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63
    return _CAPITAL[np.where(a < 128, a, np.where(a < 0xE0, two, np.where(a < 0xF0, three, 0xFFFF)))]


def _joined_numbers(starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends and hashes with number words in a row, such as twenty-three, as one token; and which are of number words."""
    word = _among(hashes, _NUMBER_HASHES)
    more = np.zeros(len(starts), dtype=bool)
    more[1:] = word[1:] & word[:-1] & (starts[1:] - ends[:-1] == 1)
    more[first[:-1][first[:-1] < len(starts)]] = False
    head = np.flatnonzero(~more)
    place = np.arange(len(starts)) - np.repeat(head, np.diff(np.append(head, len(starts))))
    parts = np.where(more, mix64(hashes + place.astype(_U)), hashes)
    return starts[head], ends[np.append(head[1:], len(starts)) - 1], np.add.reduceat(parts, head), word[head]


def template_tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts: hash of each token, its slot type, and each text's first token (n + 1 long).

    A '.' or ',' between digits belongs to the number; number words in a row are one number. A name is a
    word with a capital, of any script, that doesn't open a sentence, an opener one that does.
    """
    token = _TOKEN[data]
    inner = np.flatnonzero((data == 46) | (data == 44))
    inner = inner[(inner > 0) & (inner < len(data) - 1)]
    inner = inner[_DIGIT[data[inner - 1]] & _DIGIT[data[inner + 1]]]
    token[inner] = True
    before, after = np.zeros_like(token), np.zeros_like(token)
    before[1:], after[:-1] = token[:-1], token[1:]
    before[offs[:-1][offs[:-1] < len(data)]] = False
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(token & ~before), np.flatnonzero(token & ~after) + 1
    first = np.searchsorted(starts, offs)
    hashes = SpanHasher(lower_latin(data))(starts, ends)
    worded = np.zeros(len(starts), dtype=bool)
    if len(starts):
        starts, ends, hashes, worded = _joined_numbers(starts, ends, hashes, first)
        first = np.searchsorted(starts, offs)
    kind = np.zeros(len(starts), dtype=np.uint8)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data] | False)))
    marks = np.zeros(len(data), dtype=bool)
    marks[inner] = True
    digits = digits + np.concatenate(([0], np.cumsum(marks)))
    number = (digits[ends] - digits[starts] == ends - starts) | worded
    kind[number] = NUM
    opens = np.zeros(len(starts), dtype=bool)
    opens[first[:-1][first[:-1] < len(starts)]] = True
    if len(starts):
        unit = _among(hashes, _UNIT_HASHES)
        unit[1:] &= number[:-1] & ~opens[1:]
        unit[0] = False
        kind[unit] = UNIT
        capital = _capitals(data, starts)
        stops = np.concatenate(([0], np.cumsum(_STOP[data])))
        opens[1:] |= stops[starts[1:]] > stops[ends[:-1]]
        named = capital & (kind == LITERAL)
        kind[named] = np.where(opens[named], OPENER, NAME)
    return hashes, kind, first


def windows_of(hashes: np.ndarray, kind: np.ndarray, first: np.ndarray, width: int, variant: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of each window within a text that has words enough; for EXACT, of each that has too few.

    NAMES and OPENERS hash alike, as a name may open a sentence in one text only; OPENERS gives just
    the windows that have an opener.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    slot = _SLOTS[variant][kind]
    h = np.where(slot, _SLOT_HASH[kind], hashes)
    words = np.concatenate(([0], np.cumsum(~_SLOTS[max(variant, WORDS)][kind])))
    w = np.full(n, width * 4 + min(variant, NAMES), dtype=_U)
    for k in range(width):
        w = mix64(w * _U(0x2545F4914F6CDD1D) + h[k : n + k])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    enough = words[width:] - words[:-width] >= LEAST_WORDS * width
    ok = (text[:n] == text[width - 1 :]) & (enough if variant else ~enough)
    if variant == OPENERS:
        openers = np.concatenate(([0], np.cumsum(kind == OPENER)))
        ok &= openers[width:] > openers[:-width]
    at = np.flatnonzero(ok)
    return w[at], at


SCHEMA = "window long, pos int, slots array<long>, exact boolean, opener boolean, width int"


def template_windows(rows: DataFrame, widths: list[int], bitmap: bytes | None = None, own_width: bool = False) -> DataFrame:
    """id, window (hash), pos (first token), slot values, exact, opener (a slot is one) and width of the windows in rows(id, text); id may be of any type.

    bitmap: only windows whose bit is set. own_width: of each text only the windows of its own
    width, the largest of widths or all its tokens if it has fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, dtype=np.uint8) if bitmap else None
        for batch in batches:
            ids = batch.column(0)
            for ch in text_chunks(batch.column(1)):
                hashes, kind, first = template_tokens(ch.data, ch.offs)
                found = []
                own = np.minimum(np.diff(first), max(widths))
                for width in widths:
                    for variant in (EXACT, WORDS, NAMES, OPENERS):
                        w, at = windows_of(hashes, kind, first, width, variant)
                        if own_width and len(w):
                            hit = own[np.searchsorted(first, at, "right") - 1] == width
                            w, at = w[hit], at[hit]
                        if bits is not None and len(w):
                            place = (w >> _U(64 - BITMAP_BITS)).astype(np.int64)
                            hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1
                            w, at = w[hit > 0], at[hit > 0]
                        if len(at):
                            found.append((w, at, np.full(len(at), width), np.full(len(at), variant)))
                if not found:
                    continue
                w, at, width, variant = (np.concatenate(x) for x in zip(*found, strict=True))
                text = np.searchsorted(first, at, "right") - 1
                slots, offsets = [], [0]
                slot_places = np.flatnonzero(kind > 0)
                for a, n, v in zip(at, width, variant, strict=True):
                    inside = slot_places[np.searchsorted(slot_places, a) : np.searchsorted(slot_places, a + n)]
                    inside = inside[_SLOTS[v][kind[inside]]]
                    slots.append(hashes[inside].view(np.int64))
                    offsets.append(offsets[-1] + len(inside))
                values = np.concatenate(slots) if slots else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(ch.lo + text)), pa.array(w.view(np.int64)), pa.array((at - first[text]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype=np.int32)), pa.array(values)), pa.array(variant == EXACT), pa.array(variant == OPENERS), pa.array(width.astype(np.int32))], ["id", "window", "pos", "slots", "exact", "opener", "width"])

    kind = rows.schema["id"].dataType.simpleString()
    return bounded_batches(rows).select("id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"id {kind}, {SCHEMA}")


def _bitmap(windows: DataFrame) -> bytes | None:
    """A bitmap of the windows' leading bits, or None if there are too many windows for it."""
    if windows.count() > BITMAP_WINDOWS:
        return None
    places = windows.select(F.shiftrightunsigned("window", 64 - BITMAP_BITS).alias("p")).distinct().toPandas()["p"].to_numpy(dtype=np.int64)
    flags = np.zeros(1 << BITMAP_BITS, dtype=bool)
    flags[places] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _one_to_one(item: np.ndarray, doc: np.ndarray, support: np.ndarray) -> np.ndarray:
    """Which of a diagonal's distinct pairs of values are kept: the best supported first, none of equals that contradict each other."""
    keep = np.zeros(len(item), dtype=bool)
    left, right = set(), set()
    order = np.argsort(-support, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(support[order])) + 1):
        free = [k for k in group.tolist() if item[k] not in left and doc[k] not in right]
        n_left, n_right = Counter(item[free].tolist()), Counter(doc[free].tolist())
        for k in free:
            keep[k] = n_left[int(item[k])] == 1 and n_right[int(doc[k])] == 1
        left.update(n_left)
        right.update(n_right)
    return keep


def _ranks(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct tuple, and each row's tuple by number."""
    _, at, number = np.unique(np.column_stack(columns), axis=0, return_index=True, return_inverse=True)
    return at, number.reshape(-1)


def _agreeing(line: np.ndarray, ipos: np.ndarray, of: np.ndarray, item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows (line, ipos) hold only kept pairs; of: the window of each pair (item, doc)."""
    ok = np.ones(len(line), dtype=bool)
    if len(of):
        at, pair = _ranks(line[of], item, doc)
        keep = np.ones(len(at), dtype=bool)
        support = np.bincount(pair[_ranks(pair, ipos[of])[0]], minlength=len(at))
        owner = line[of[at]]
        clash = np.zeros(len(at), dtype=bool)
        for value in (item, doc):
            _, same = _ranks(owner, value[at])
            clash |= np.bincount(same)[same] > 1
        for k in np.unique(owner[clash]):
            mine = np.arange(*np.searchsorted(owner, [k, k + 1]))
            keep[mine] = _one_to_one(item[at[mine]], doc[at[mine]], support[mine])
        ok[of[~keep[pair]]] = False
    return ok


def consistent_places(lines: DataFrame) -> DataFrame:
    """doc, item_id and places (ipos, exact) of the windows that don't contradict their diagonal.

    lines: doc, item_id and windows (ipos, exact, opener, islots, slots), a row a diagonal. An
    opener may be no name, so windows without such slots need only agree among themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column(2)
            flat = windows.flatten()
            ipos, exact, opener, islots, slots = (flat.field(k) for k in range(5))
            line = np.repeat(np.arange(batch.num_rows), np.diff(windows.offsets.to_numpy()))
            of = np.repeat(np.arange(len(flat)), np.diff(slots.offsets.to_numpy()))
            item, doc, pos, opens = islots.flatten().to_numpy(zero_copy_only=False), slots.flatten().to_numpy(zero_copy_only=False), ipos.to_numpy(zero_copy_only=False), opener.to_numpy(zero_copy_only=False)
            plain = ~opens[of]
            ok = _agreeing(line, pos, of, item, doc) | (_agreeing(line, pos, of[plain], item[plain], doc[plain]) & ~opens)
            kept = np.flatnonzero(ok)
            ends = np.searchsorted(line[kept], np.arange(batch.num_rows + 1)).astype(np.int32)
            places = pa.StructArray.from_arrays([ipos.take(pa.array(kept)), exact.take(pa.array(kept))], ["ipos", "exact"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), places)], ["doc", "item_id", "places"])

    return lines.select("doc", "item_id", "windows").mapInArrow(run, f"doc {lines.schema['doc'].dataType.simpleString()}, item_id long, places array<struct<ipos: int, exact: boolean>>")


def _late_windows(table: DataFrame, coverage: float) -> DataFrame:
    """item_id, window: windows of more than COMMON_ITEMS items, of the items that no document can hold without some other window.

    Joined with documents at once, a window of many items and many documents would make a row for
    each of both. Where less than `coverage` of an item's places have such a window, whatever holds
    the item has a hit at another place.
    """
    common = table.groupBy("window").agg(F.countDistinct("id").alias("n")).filter(F.col("n") > COMMON_ITEMS).select("window", F.lit(True).alias("common"))
    places = table.join(common, "window", "left").groupBy("id", "pos", "exact").agg(F.coalesce(F.bool_or("common"), F.lit(False)).alias("common"))
    typed = F.when(~F.col("exact"), F.lit(1))
    share = [F.sum((F.col("common") & on).cast("long")) < coverage * F.sum(on.cast("long")) for on in (F.lit(True), ~F.col("exact"))]
    items = places.groupBy("id").agg((share[0] & (share[1] | (F.count(typed) == 0))).alias("elsewhere"), F.bool_or("common").alias("any")).filter("elsewhere and any")
    return table.join(common, "window", "left_semi").join(items, "id", "left_semi").select(F.col("id").alias("item_id"), "window").distinct()


def document_key() -> Column:
    """Tells documents apart: a hash of doc_id and text."""
    return F.xxhash64(F.lit("document"), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, doc_key, item_id, n_windows, n_matched, coverage for each document that holds an item.

    docs: doc_id, text. benchmark: item_id, text. More columns are ignored. At least `coverage` of
    an item's windows, or of those that have words enough (whichever share is larger is returned),
    must stand in the document, in windows that don't contradict their diagonal. Null or empty texts match
    nothing, nor do items under LEAST_TOKENS tokens. A document is its doc_id, which may be null, and its
    text: rows that repeat both count as one, other texts of one id are judged by themselves. Rows that
    repeat an item_id count as one item. Empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text")
    table = stage_table(template_windows(items, [*range(LEAST_TOKENS, window), window], own_width=True).distinct(), "benchmark-windows")
    short = [r["width"] for r in table.select("width").distinct().collect() if r["width"] < window]
    sizes = table.groupBy("id").agg(F.countDistinct("pos", "exact").cast("long").alias("n_all"), F.countDistinct(F.when(~F.col("exact"), F.col("pos"))).cast("long").alias("n_typed"))
    lookup = table.select(F.col("id").alias("item_id"), "window", F.col("pos").alias("ipos"), F.col("slots").alias("islots"), "exact", F.col("opener").alias("iopener"))
    late = stage_table(_late_windows(table, coverage), "benchmark-late")
    windows = template_windows(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), document_key().alias("key")).alias("id"), "text"), [window, *short], _bitmap(table)).drop("exact", "width").withColumnRenamed("id", "doc")
    if late.isEmpty():
        hits = windows.join(lookup, "window")
    else:
        windows = stage_table(windows.join(lookup.select("window").distinct(), "window", "left_semi"), "document-windows")
        hits = windows.join(lookup.join(late, ["item_id", "window"], "left_anti"), "window")
        known = hits.select("doc", "item_id").distinct().join(lookup.join(late, ["item_id", "window"], "left_semi"), "item_id")
        hits = hits.unionByName(windows.join(known, (windows["window"] == known["window"]) & windows["doc"].eqNullSafe(known["doc"])).select(windows["*"], *[known[c] for c in ("item_id", "ipos", "islots", "exact", "iopener")]))
    hits = hits.filter(F.size("slots") == F.size("islots"))
    lines = hits.groupBy("doc", "item_id", (F.col("pos") - F.col("ipos")).alias("diagonal")).agg(F.collect_set(F.struct("ipos", "exact", (F.col("opener") | F.col("iopener")).alias("opener"), "islots", "slots")).alias("windows"))
    places = F.array_distinct(F.flatten(F.collect_set("places")))
    matched = consistent_places(lines).groupBy("doc", "item_id").agg(F.size(places).cast("long").alias("m_all"), F.size(F.filter(places, lambda p: ~p["exact"])).cast("long").alias("m_typed"))
    shares = [F.struct(F.coalesce(F.try_divide(f"m_{k}", f"n_{k}"), F.lit(0.0)).alias("coverage"), F.col(f"n_{k}").alias("n_windows"), F.col(f"m_{k}").alias("n_matched")) for k in ("all", "typed")]
    joined = matched.join(sizes.withColumnRenamed("id", "item_id"), "item_id").withColumn("share", F.greatest(*shares))
    return joined.select("doc.doc_id", F.col("doc.key").alias("doc_key"), "item_id", "share.n_windows", "share.n_matched", "share.coverage").filter(F.col("coverage") >= coverage)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item, told by id and text; rows without a doc_id are judged like others."""
    key, gone = fresh(docs, "doc_key", "gone_key")
    found = contaminated_pairs(docs, benchmark).select(F.col("doc_key").alias(gone)).distinct()
    return docs.withColumn(key, document_key()).join(found, F.col(key) == F.col(gone), "left_anti").select(*columns_of(docs))
