"""Spelling variants by PartEnum signatures over letter multisets.

A word's letter multiset is a binary vector with a dimension for every (letter, how many of it came before). One replaced
letter makes a Hamming distance of two at most, one inserted or deleted letter a distance of one. The dimensions are dealt
to fixed parts; of p parts, a distance of k leaves at least p - k alike, so every choice of p - k parts is enumerated as a
signature: words of equal length in EQUAL parts with distance two, words whose lengths differ by one in SHIFTED parts
with distance one. A signature also names the length and, as one edit leaves the first or the last half alone, one half of
the word: an exact refinement that keeps the groups of words built from common syllables small. Words with a signature in
common meet in sorted partitions and are verified letter by letter in NumPy; only verified links become rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import code_points, flat_text, mix, piece_hashes, ragged, written

#: Parts of the dimensions for words of equal and of neighbouring length.
EQUAL, SHIFTED = 4, 2
#: Text in one step of the count, words of one signature in one group, pairs verified at once.
STEP, GROUP, PAIRS = 1 << 22, 2048, 200_000
#: Runs longer than this are hashed one by one.
LONG = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1).astype(np.uint32)
    return crc


_CRC = _crc_table()


def run_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes, going on from the crc32 of what stands before it."""
    state = ~prefix.astype(np.uint32)
    lengths = ends - starts
    at = np.flatnonzero(lengths <= LONG)
    at = at[np.argsort(-lengths[at], kind="stable")]
    left = np.searchsorted(-lengths[at], -np.arange(1, LONG + 1), "right")
    for i, count in enumerate(left):
        if not count:
            break
        part = at[:count]
        now = state[part]
        state[part] = _CRC[(now ^ data[starts[part] + i]) & 255] ^ (now >> np.uint32(8))
    done = ~state
    for j in np.flatnonzero(lengths > LONG):
        done[j] = zlib.crc32(data[starts[j]:ends[j]].tobytes(), int(prefix[j]))
    return done


def runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every run of letters (A-Z, a-z, U+00C0 to U+00FF) in rows of UTF-8 bytes."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3  # the second byte of a letter beyond ASCII
    text = np.concatenate([[False], inside, [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begins = np.flatnonzero(text[1:-1] & (~text[:-2] | edge[:-1]))
    ends = np.flatnonzero(text[1:-1] & (~text[2:] | edge[1:])) + 1
    return begins, ends, np.searchsorted(starts, begins, "right") - 1


def _pieces(data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, row starts and row values of about STEP bytes each; a longer row is cut between runs."""
    at, n = 0, len(starts) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + STEP, "right")) - 1)
        low, high = int(starts[at]), int(starts[end])
        while high - low > STEP:  # one long row
            cut = low + STEP
            while cut < high and (_LETTER[data[cut]] or data[cut - 1] == 0xC3):
                cut += 1
            yield data[low:cut], np.array([0, cut - low]), first[at:at + 1]
            low = cut
        if end == at + 1:
            yield data[low:high], np.array([0, high - low]), first[at:end]
        else:
            yield data[low:high], starts[at:end + 1] - low, first[at:end]
        at = end


def _counted(drop_every: int):
    """Words of the texts and how often a step of the task has met them."""
    def words(data: np.ndarray, starts: np.ndarray, prefix: np.ndarray) -> Iterator[pa.RecordBatch]:
        data = _LOWER[data]
        begins, ends, row = runs(data, starts)
        if not len(begins):
            return
        check = run_checksums(data, begins, ends, prefix[row])
        changed = check % np.uint32(drop_every) == 0
        other: Counter[str] = Counter()
        for b, e, h in zip(begins[changed].tolist(), ends[changed].tolist(), check[changed].tolist(), strict=True):
            word = data[b:e].tobytes().decode()
            place = h % len(word)
            other[word[:place] + word[place + 1:]] += 1
        begins, ends = begins[~changed], ends[~changed]
        _, place, count = np.unique(piece_hashes(data, begins, ends), return_index=True, return_counts=True)
        begins, ends = begins[place], ends[place]
        flat = data[ragged(begins, ends - begins)]
        offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
        plain = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes()))
        yield pa.RecordBatch.from_arrays([plain, pa.array(count.astype(np.int64))], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(list(other), pa.string()), pa.array(list(other.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in batch.column("doc_id").to_pylist()], np.uint32)
            data, starts = flat_text(batch.column("text"))
            for piece in _pieces(data, starts, prefix):
                yield from words(*piece)
    return run


def vocabulary(docs: DataFrame, drop_every: int = 97, length: int = 5, least: int = 3) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z in lower case, of `length` code points and `least` occurrences or more.

    Where drop_every divides the crc32 of '<doc_id>:<run>', the run loses a code point first. Null texts have no words, a
    null doc_id counts as empty.
    """
    met = docs.select("doc_id", "text").where("text is not null").mapInArrow(_counted(drop_every), "word string, n long")
    return met.groupBy("word").agg(F.sum("n").alias("n")).where((F.length("word") >= length) & (F.col("n") >= least))


def part_sums(letters: np.ndarray, parts: int) -> np.ndarray:
    """Of words of one length (a row each): a hash of the dimensions that each part holds, whatever their order."""
    ordered = np.sort(letters, axis=1).astype(np.uint64)
    place = np.arange(letters.shape[1])
    new = np.ones(ordered.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    before = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    with np.errstate(over="ignore"):
        dimension = mix(ordered * np.uint64(0x9E3779B97F4A7C15) + before.astype(np.uint64))
        part = (dimension >> np.uint64(40)) % np.uint64(parts)
        return np.stack([np.where(part == p, dimension, np.uint64(0)).sum(1, dtype=np.uint64) for p in range(parts)], axis=1)


def signatures(letters: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(keys, side) of words of one length: side 0 for equal length, 1 as the shorter and 2 as the longer of two lengths."""
    size = letters.shape[1]
    wide = letters.astype(np.uint64)
    with np.errstate(over="ignore"):
        def text(part: np.ndarray) -> np.ndarray:
            return (mix(part + np.uint64(0x51ED270B)) * (mix(np.arange(1, part.shape[1] + 1)) | np.uint64(1))).sum(1, dtype=np.uint64)
        equal, shifted = part_sums(letters, EQUAL), part_sums(letters, SHIFTED)
        for side, length, sums, distance in ((0, size, equal, 2), (1, size, shifted, 1), (2, size - 1, shifted, 1)):
            half = length // 2
            for end, piece in enumerate((wide[:, :half], wide[:, size - half:])):
                kept = text(piece)
                for number, chosen in enumerate(itertools.combinations(range(sums.shape[1]), sums.shape[1] - distance)):
                    tag = mix(np.array([(length << 16) + (min(side, 1) << 12) + (end << 8) + number], np.uint64))[0]
                    yield mix(sum((sums[:, c] * (mix(np.array([c + 1]))[0] | np.uint64(1)) for c in chosen), kept + tag)).view(np.int64), side


SIGNED = "key long, side int, word string, n long"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points, starts = code_points(*flat_text(batch.column("word")))
        lengths = np.diff(starts)
        for size in np.unique(lengths):
            places = np.flatnonzero(lengths == size)
            step = max(1, 1_000_000 // int(size))
            for i in range(0, len(places), step):
                at = places[i:i + step]
                rows = batch.select(["word", "n"]).take(pa.array(at))
                for keys, side in signatures(points[starts[at][:, None] + np.arange(size)]):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(at), side, np.int32)), rows.column("word"), rows.column("n")], names=["key", "side", "word", "n"])


def one_edit(points: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b differ by exactly one code point replaced, or inserted into a: lengths are equal or b's is one more."""
    near = np.zeros(len(a), bool)
    lengths = np.diff(starts)
    for size, more in {(int(s), int(m)) for s, m in np.unique(np.stack([lengths[a], lengths[b] - lengths[a]], 1), axis=0)}:
        which = np.flatnonzero((lengths[a] == size) & (lengths[b] - lengths[a] == more))
        place = np.arange(size)
        step = max(1, 4_000_000 // max(1, size))
        for i in range(0, len(which), step):
            w = which[i:i + step]
            one = points[starts[a[w]][:, None] + place]
            same = one == points[starts[b[w]][:, None] + place]
            if more == 0:
                near[w] = (~same).sum(1) == 1
            else:
                after = one == points[starts[b[w]][:, None] + place + 1]
                begin = np.logical_and.accumulate(same, axis=1).sum(1)
                end = np.logical_and.accumulate(after[:, ::-1], axis=1).sum(1)
                near[w] = begin + end >= size
    return near


def _pairs(sizes: np.ndarray, first: np.ndarray, others: np.ndarray, other_first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of a row of `sizes` with one of `others` in the same group, at most about PAIRS at a time."""
    for low, high in _ranges(sizes * others):
        per = np.repeat(np.arange(low, high), sizes[low:high])
        left = ragged(first[low:high], sizes[low:high])
        for i in range(0, len(left), max(1, PAIRS // max(1, int(others[low:high].max())))):
            part = slice(i, i + max(1, PAIRS // max(1, int(others[low:high].max()))))
            yield np.repeat(left[part], others[per[part]]), ragged(other_first[per[part]], others[per[part]])


def _ranges(weights: np.ndarray) -> Iterator[tuple[int, int]]:
    total, at = np.concatenate([[0], np.cumsum(weights)]), 0
    while at < len(weights):
        end = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        yield at, end
        at = end


LINKS = "word string, n long, near string, near_n long"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the words of each group (key, unit), which come sorted; `asks` rows meet the others, or each other where none ask."""
    rest: pa.Table | None = None

    def groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, unit = (rows.column(c).to_numpy() for c in ("key", "unit"))
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (unit[1:] == unit[:-1]), [False]])
        rows = rows.filter(pa.array(same[:-1] | same[1:])).combine_chunks()  # a word alone in its group meets none
        begin = np.flatnonzero(~same[:-1][same[:-1] | same[1:]])
        group = np.repeat(np.arange(len(begin)), np.diff(np.concatenate([begin, [len(rows)]])))
        if not len(rows):
            return
        side = rows.column("side").to_numpy()
        data, starts = flat_text(rows.column("word"))
        ids, found = piece_hashes(data, starts[:-1], starts[1:]), []
        points, starts = code_points(data, starts)
        first = np.bincount(group[side != 2], minlength=len(begin))
        last = np.bincount(group[side == 2], minlength=len(begin))
        equal = np.bincount(group[side == 0], minlength=len(begin))
        for own, own_at, other, other_at in ((equal, begin, equal, begin), (first - equal, begin + equal, last, begin + first)):
            both = np.flatnonzero((own > 0) & (other > 0))
            for a, b in _pairs(own[both], own_at[both], other[both], other_at[both]):
                keep = (a < b) & (ids[a] != ids[b])
                a, b = a[keep], b[keep]
                near = one_edit(points, starts, a, b)
                found.append(np.unique(np.stack([np.minimum(a[near], b[near]), np.maximum(a[near], b[near])], 1), axis=0))
        found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        if len(found):  # a link once, however many signatures share it here
            found = found[np.unique(ids[found], axis=0, return_index=True)[1]]
        for one, two in ((0, 1), (1, 0)):
            x, y = rows.select(["word", "n"]).take(pa.array(found[:, one])), rows.select(["word", "n"]).take(pa.array(found[:, two]))
            yield from pa.table([x.column(0), x.column(1), y.column(0), y.column(1)], names=["word", "n", "near", "near_n"]).to_batches()
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not len(rows):
            continue
        key, unit = (rows.column(c).to_numpy() for c in ("key", "unit"))
        differs = np.flatnonzero((key != key[-1]) | (unit != unit[-1]))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield from groups(rows.slice(0, cut).combine_chunks())
        rest = rows.slice(cut)
    if rest is not None and len(rest):
        yield from groups(rest.combine_chunks())


def links(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways and once each, for (word, n): pairs that one inserted, deleted or replaced code point apart."""
    signed = written(words.mapInArrow(_signed, SIGNED), "signatures")
    large = signed.groupBy("key").agg(F.ceil(F.count("*") / GROUP).alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    mine = F.pmod(F.xxhash64("word"), blocks)
    # A large group is cut into blocks and meets in units of two blocks each; any other group is one unit.
    unit = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.least(mine, o) * blocks + F.greatest(mine, o))
    met = signed.join(large, "key", "left").select("key", F.explode(unit).alias("unit"), "side", "word", "n")
    met = met.repartition("key", "unit").sortWithinPartitions("key", "unit", "side")
    return met.mapInArrow(_verified, LINKS).dropDuplicates(["word", "near"])


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `vocabulary`.

    Near words differ by exactly one inserted, deleted or replaced code point. form is the near word of largest n (ties:
    the smallest in code-point order) if its n is at least twice the word's; root follows forms to the last, the word
    itself if none. Repeated documents count as often as they stand; columns but doc_id and text are not read.
    """
    words = written(vocabulary(docs), "words")
    near = written(links(words), "links").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("first"))
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("first.near").alias("near"), (-F.col("first.order")).alias("near_n"))
    fits = F.col("near_n") >= 2 * F.col("n")
    named = written(named.select("word", F.when(fits, F.col("near")).alias("form"), "n", "n_near", F.when(fits, F.col("near_n")).alias("form_n")), "forms")
    ahead = named.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # n doubles with each step to a form, so a few rounds of jumping reach the last
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = written(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if ahead.where("moved").isEmpty():
            break
        ahead = ahead.drop("moved")
    return named.join(ahead.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
