"""Document likelihood over all segmentations into the pieces of an existing subword vocabulary.

White space ends a word and no piece crosses it, so a text's lattice is one lattice per word, opened by a word mark, and
an end token; the text's marginal probability is their product. Beside its vocabulary pieces a word's lattice has one
arc over the whole word, weighted by the word's discounted count in training; the discounts' mass goes to the pieces.
Each distinct word is scored once. The few frequent words (by pigeonhole at most 1/share of them) travel to the
documents, the documents' rare words travel to the scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import bytes_of, finished_hashes, longer_hashes, piece_hashes, ragged, symbols_of, written
from lotlens.llm.langid import SortedHashes

END = ""
#: A frequent word holds at least this share of all tokens.
SHARE = 1 / 200_000
MARK = b" "


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return text.encode().lower().split() if text else []


@dataclass
class Pieces:
    """Vocabulary pieces as bytes (a word mark is a blank), every single byte, and the end; log probabilities in order."""

    table: SortedHashes
    logs: np.ndarray
    end: float
    longest: int

    @classmethod
    def of(cls, scored: dict[bytes, float], end: float) -> Pieces:
        """From natural-log scores of pieces; a byte or mark without one gets the least score there is."""
        least = min(scored.values(), default=-1.0)
        scored = {bytes([b]): least for b in range(256)} | scored
        hashes = piece_hashes(*bytes_of(list(scored))).view(np.int64)
        table = SortedHashes(hashes)
        return cls(table, np.fromiter(scored.values(), float, len(scored))[table.order], end, max(map(len, scored)))

    def matches(self, words: np.ndarray) -> list[np.ndarray]:
        """For each length the places of the pieces that begin at each byte of each of the equally long words (or -1)."""
        n, size = words.shape
        found = []
        symbols, hashes = symbols_of(words), np.zeros((n, size + 1), np.uint64)
        for length in range(1, min(self.longest, size) + 1):
            hashes = longer_hashes(hashes[:, :-1], symbols[:, length - 1:], length)
            found.append(self.table.find(finished_hashes(hashes, length).ravel().view(np.int64)).reshape(n, -1))
        return found

    def forward(self, found: list[np.ndarray], reverse: bool = False) -> np.ndarray:
        """Log of the summed probability of all segmentations of each prefix (or suffix)."""
        n, size = found[0].shape
        total = np.full((n, size + 1), -np.inf)
        total[:, size if reverse else 0] = 0
        logs = np.append(self.logs, -np.inf)
        for j in range(1, size + 1):
            lengths = range(1, min(len(found), j) + 1)
            if reverse:
                at = size - j
                ways = np.stack([total[:, at + k] + logs[found[k - 1][:, at]] for k in lengths])
            else:
                at = j
                ways = np.stack([total[:, at - k] + logs[found[k - 1][:, at - k]] for k in lengths])
            top = ways.max(0)
            total[:, at] = top + np.log(np.exp(ways - top).sum(0))
        return total


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and bytes (with the word mark) of equally long words, in blocks of bounded size."""
    flat, starts, ends = bytes_of([MARK + w for w in words])
    sizes = ends - starts
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cuts):
        size = int(sizes[group[0]])
        step = max(1, 100_000 // size)
        for i in range(0, len(group), step):
            part = group[i:i + step]
            yield part, flat[ragged(starts[part], sizes[part])].reshape(len(part), size)


def log_scores(pieces: Pieces, words: list[bytes]) -> np.ndarray:
    """Natural log of each word's marginal probability; that of the end for an empty word."""
    out = np.full(len(words), pieces.end)
    some = np.array([i for i, w in enumerate(words) if w], np.int64)
    for part, block in _by_length([words[i] for i in some]) if len(some) else ():
        out[some[part]] = pieces.forward(pieces.matches(block))[:, -1]
    return out


def expected(pieces: Pieces, words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece (in table order) over the weighted words' segmentations."""
    uses = np.zeros(len(pieces.logs))
    for part, block in _by_length(words):
        found = pieces.matches(block)
        ahead, behind = pieces.forward(found), pieces.forward(found, reverse=True)
        whole = ahead[:, -1:]
        for k, place in enumerate(found, 1):
            there = place >= 0
            p = np.exp((ahead[:, :-k] + behind[:, k:] - whole)[there] + pieces.logs[place[there]])
            uses += np.bincount(place[there], p * np.broadcast_to(weights[part][:, None], place.shape)[there], len(uses))
    return uses


def vocabulary(path: str) -> dict[bytes, float]:
    """Pieces of a sentencepiece file with their scores as natural-log weights (a fixed rule).

    Scores that are probabilities' logs stay; a merge vocabulary's scores are minus the merge's rank and become Zipf
    weights. Control and unused pieces are left out, byte pieces stand for their byte.
    """
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unused(i) or model.is_unknown(i):
            continue
        text = model.id_to_piece(i)
        piece = bytes([int(text[3:5], 16)]) if model.is_byte(i) else text.replace("▁", MARK.decode()).encode()
        if piece and MARK not in piece[1:]:
            found[piece] = max(found.get(piece, -np.inf), model.get_score(i))
    scores = np.fromiter(found.values(), float, len(found))
    if len(scores) and scores.min() < -1000:
        ranks = np.argsort(np.argsort(-scores, kind="stable"))
        scores = -np.log(ranks + 10.0)
    return dict(zip(found, scores - (np.log(np.exp(scores).sum()) if len(scores) else 0), strict=True))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
    room = 400_000

    def rows():
        taught, others = counts[True], counts[False]
        known = [others.pop(w, 0) for w in taught]
        c = np.concatenate([np.fromiter(taught.values(), np.int64, len(taught)), np.zeros(len(others), np.int64)])
        used = c + np.concatenate([np.array(known, np.int64), np.fromiter(others.values(), np.int64, len(others))])
        return pa.RecordBatch.from_arrays([pa.array([*taught, *others], pa.binary()).cast(pa.string()), pa.array(c), pa.array(used)], names=["word", "c", "used"])
    for batch in batches:
        for text, teaches in zip(batch.column("text").to_pylist(), batch.column("teaches").to_pylist(), strict=True):
            own = counts[teaches]
            own.update(words_of(text))
            own[b""] += 1
            if len(counts[True]) + len(counts[False]) > room:
                yield rows()
                for own in counts.values():
                    own.clear()
    yield rows()


def _uses(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, uses = shared.value, 0.0
        for batch in batches:
            uses = uses + expected(pieces, [w.encode() for w in batch.column("word").to_pylist()], batch.column("c").to_numpy())
        if not np.isscalar(uses):
            some = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(uses[some])], names=["piece", "uses"])
    return run


def _score_words(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = log_scores(shared.value, [w.encode() for w in batch.column("word").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs / np.log(10))], names=[*batch.schema.names, "score"])
    return run


DOC_ROWS = "row bigint, doc_id bigint, held_out boolean, word string, k bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _document_rows(shared: Broadcast):
    """A row per document with its sums over frequent words, and a row per other distinct word of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        row = TaskContext.get().partitionId() << 33
        docs, words, times, rare = [], [], [], []
        for batch in batches:
            for text, doc, held in zip(batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
                tokens = Counter(words_of(text.as_py()))
                tokens[b""] = 1
                row += 1
                known, base, score, before = 0, 0.0, 0.0, len(words)
                for w, k in tokens.items():
                    got = frequent.get(w)
                    if got is None:
                        words.append(w)
                        times.append(k)
                    else:
                        known += got[0] * k
                        base += got[1] * k
                        score += got[2] * k
                docs.append((row, doc, held, tokens.total(), known, base, score))
                rare.append(len(words) - before)
                if len(words) + len(docs) > 1 << 17:
                    yield _rows(docs, words, times, rare)
                    docs, words, times, rare = [], [], [], []
        yield _rows(docs, words, times, rare)
    return run


def _rows(docs: list[tuple], words: list[bytes], times: list[int], rare: list[int]) -> pa.RecordBatch:
    """Rows of DOC_ROWS: the documents, then their rare words, of which each document has so many."""
    row, doc, held, *sums = zip(*docs, strict=True) if docs else [()] * 7
    row = np.array(row, np.int64)
    own = {"row": np.concatenate([row, np.repeat(row, rare)]), "doc_id": doc, "held_out": held, "n_tokens": sums[0], "n_known": sums[1], "base_score": sums[2], "score": sums[3]}
    of_words = {"word": pa.array(words, pa.binary()).cast(pa.string()), "k": pa.array(times, pa.int64())}
    kinds = {"held_out": pa.bool_(), "word": pa.string(), "base_score": pa.float64(), "score": pa.float64()}
    columns = []
    for name in (x.split()[0] for x in DOC_ROWS.split(", ")):
        kind = kinds.get(name, pa.int64())
        if name == "row":
            columns.append(pa.array(own[name], kind))
        else:
            parts = [pa.nulls(len(docs), kind), of_words[name]] if name in of_words else [pa.array(own[name], kind), pa.nulls(len(words), kind)]
            columns.append(pa.concat_arrays(parts))
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DOC_ROWS.split(", ")])


def fit(words: DataFrame, scores: dict[bytes, float], rounds: int = 2, prior: float = 100.0) -> Pieces:
    """Re-weights the vocabulary by expectation over `words` (word, c): every training word's every segmentation, once.

    The pieces stand for the discounted mass, to which each distinct word gives about as much. `prior` uses are spread by
    the given scores, so that pieces the training words never need keep a probability. Only one number per piece comes
    to the driver.
    """
    spark = words.sparkSession
    ends = 1
    taught = words.where((F.col("c") > 0) & (F.col("word") != END)).select("word", F.lit(1.0).alias("c"))
    pieces = Pieces.of(scores, np.log(0.01))
    base = np.exp(pieces.logs) / np.exp(pieces.logs).sum()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(pieces)
        uses = base * prior
        for r in taught.mapInArrow(_uses(shared), "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r.piece] += r.uses
        total = uses.sum() + ends + 1
        pieces = Pieces(pieces.table, np.log(uses / total), float(np.log((ends + 1) / total)), pieces.longest)
    return pieces


def score(docs: DataFrame, scores: dict[bytes, float], rounds: int = 2) -> DataFrame:
    """Scores every row of docs (doc_id, text, held_out): held-out texts are scored but teach nothing.

    Per row: n_tokens (words and the end), n_known (tokens met in training), train_tokens, base_score (add-one word
    model) and score (lattice marginal), both log10. Null or empty text is the end alone. Repeated rows get equal
    results, a null id stays null; without training rows the vocabulary's own scores decide and base_score is 0.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    words = written(rows.select("text", (~F.col("held_out")).alias("teaches")).mapInArrow(_word_counts, "word string, c bigint, used bigint")
                    .groupBy("word").agg(F.sum("c").alias("c"), F.sum("used").alias("used")), "words")
    sums = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum("used").alias("used"), F.count_if(F.col("c") == 1).alias("once"),
                     F.count_if(F.col("c") == 2).alias("twice")).first()
    n, v, used = sums.n or 0, sums.v, sums.used or 0
    discount = min(0.95, max(0.05, sums.once / max(1, sums.once + 2 * sums.twice)))
    whole = F.greatest(F.col("c") - discount, F.lit(0.0)) / float(max(n, 1))
    rest = F.lit(discount * v / n if n else 1.0)
    far = F.when(whole > 0, F.log10(whole)).otherwise(F.log10(rest) + F.col("score"))  # the power would be no double
    marginal = F.when(F.col("score") < -290, far).otherwise(F.log10(whole + rest * F.pow(F.lit(10.0), "score")))
    pieces = fit(words, scores, rounds)
    graded = words.mapInArrow(_score_words(spark.sparkContext.broadcast(pieces)), "word string, c bigint, used bigint, score double").select(
        "word", "used", (F.col("c") > 0).cast("long").alias("known"), F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("base"), marginal.alias("score"))
    graded = written(graded, "graded")
    frequent = {r.word.encode(): (r.known, r.base, r.score) for r in graded.where(F.col("used") >= used * SHARE).collect()}
    parts = written(rows.mapInArrow(_document_rows(spark.sparkContext.broadcast(frequent)), DOC_ROWS), "parts")
    rare = (parts.where("word is not null").select("row", "word", "k").join(graded.where(F.col("used") < used * SHARE).drop("used"), "word")
            .select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("long").alias("n_tokens"),
                    (F.col("k") * F.col("known")).alias("n_known"), (F.col("k") * F.col("base")).alias("base_score"), (F.col("k") * F.col("score")).alias("score")))
    return (parts.where("word is null").drop("word", "k").union(rare).groupBy("row")
            .agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
                 F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"))
