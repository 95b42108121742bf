"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of lower-cased UTF-8 bytes down to order 3. A byte is coded in the longest context
that the tree has, at count / (total + distinct); one not met there costs an escape, distinct / (total + distinct),
and is coded in the next shorter context, where the bytes that the longer one has met are excluded from counts and
totals, since they cannot follow an escape; below order 0 all bytes met nowhere are equally likely. The counts are
frozen after training, so the cost of four bytes in a row, three of them context, is a constant of the language and a
text's exact code length is a sum of looked-up costs. Four bytes that no language has met are costed when they occur.

Training takes about ``TRAIN_DOCS`` whole documents of each language, chosen by a hash of their id, and at least one;
fewer where all of them would pass about ``TRAIN_BYTES`` bytes. The model holds all that these documents hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_DOCS = 2_000
#: UTF-8 bytes of all training documents, about; each language has an equal share of them, or one document.
TRAIN_BYTES = 1 << 28
#: Share of the documents drawn for training that measure what a document usually takes, and are not learned from.
MEASURED = 0.1
#: Below this posterior a document counts as rejected.
LEAST_SCORE = 0.5
#: So is one that takes more than this many times the bits that its language usually takes, and ``SLACK`` bits more.
STRANGE, SLACK = 2.0, 200.0
UNDECIDED = "und"

_PAD = b"   "
_PIECE = 1 << 18
_HASH = np.uint32(2654435761)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of ``n``."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64)


def _get(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values at the asked keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(asked), values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0)


class Tree:
    """Counts of one language: for order 3 to 0 the grams (context and byte) and the contexts' totals.

    ``left_out`` of a context is what the bytes it has met count in the next shorter context.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray) -> None:
        self.orders = []
        keys, counts = _sums(gram, n)
        for order in (3, 2, 1, 0):
            shorter = _sums(keys & ((1 << 8 * order) - 1), counts) if order else (keys[:0], counts[:0])
            contexts, totals = _sums(keys >> 8, counts)
            _, distinct = _sums(keys >> 8, np.ones_like(counts))
            below = _get(*shorter, keys & ((1 << 8 * order) - 1)) if order else np.zeros_like(counts)
            _, left_out = _sums(keys >> 8, below)
            self.orders.append((keys, counts, contexts, totals, distinct, left_out))
            keys, counts = shorter

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the first three."""
        out = np.zeros(len(gram))
        open_ = np.ones(len(gram), bool)
        excluded, mass = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
        for order, (keys, counts, contexts, totals, distinct, left_out) in zip((3, 2, 1, 0), self.orders, strict=True):
            g = gram & ((1 << 8 * (order + 1)) - 1)
            n, total, d = _get(keys, counts, g), _get(contexts, totals, g >> 8), _get(contexts, distinct, g >> 8)
            new = d - excluded
            whole = total - mass + new
            with np.errstate(divide="ignore", invalid="ignore"):
                coded, escape = np.log2(whole / n), np.where(new > 0, np.log2(whole / new), 0.0)
            here = open_ & (n > 0)
            out[here] += coded[here]
            open_ &= n == 0
            out[open_] += escape[open_]
            excluded, mass = d, _get(contexts, left_out, g >> 8)
        out[open_] += np.log2(np.maximum(256 - excluded[open_], 1))
        return out


@dataclass(frozen=True)
class Model:
    """Trees by language, and the costs of all grams that any of them has met, found by open addressing."""

    languages: list[str]
    prior: np.ndarray
    trees: list[Tree]
    slot_gram: np.ndarray
    slot_row: np.ndarray
    costs: np.ndarray
    #: Bits that a byte usually takes in each language; empty if not measured.
    usual: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte of each gram (uint32), a column a language."""
        mask = np.uint32(len(self.slot_row) - 1)
        at = (gram * _HASH) >> np.uint32(32 - int(mask).bit_length())
        row = self.slot_row[at]
        look = np.flatnonzero((row >= 0) & (self.slot_gram[at] != gram))
        while len(look):
            at[look] = (at[look] + np.uint32(1)) & mask
            row[look] = self.slot_row[at[look]]
            look = look[(row[look] >= 0) & (self.slot_gram[at[look]] != gram[look])]
        out = self.costs[row]
        unmet = np.flatnonzero(row < 0)
        if len(unmet):
            new, which = np.unique(gram[unmet], return_inverse=True)
            out[unmet] = np.stack([t.bits(new.astype(np.int64)) for t in self.trees], 1)[which]
        return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, four bytes as a number, count) of each batch."""
    for b in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text.lower().encode())
        for lang, texts in by_lang.items():
            found = []
            for t in texts:
                v = np.frombuffer(_PAD + t, np.uint8).astype(np.int64)
                found.append((v[:-3] << 24) | (v[1:-2] << 16) | (v[2:-1] << 8) | v[3:])
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])


def build_model(grams: dict[str, tuple[np.ndarray, np.ndarray]], documents: dict[str, int]) -> Model:
    """grams: language -> (four bytes as a number, counts); documents: language -> number of its documents, for the prior."""
    languages = sorted(grams)
    trees = [Tree(*grams[lang]) for lang in languages]
    every = np.unique(np.concatenate([t.orders[0][0] for t in trees]))
    costs = np.stack([t.bits(every) for t in trees], 1).astype(np.float32)
    size = 1 << max(4, int(4 * len(every)).bit_length())
    slot_gram, slot_row = np.zeros(size, np.uint32), np.full(size, -1, np.int32)
    row = np.arange(len(every), dtype=np.int32)
    every = every.astype(np.uint32)
    at = (every * _HASH) >> np.uint32(32 - (size - 1).bit_length())
    while len(row):
        free = np.flatnonzero(slot_row[at] < 0)
        _, first = np.unique(at[free], return_index=True)
        put = free[first]
        slot_gram[at[put]], slot_row[at[put]] = every[row[put]], row[put]
        rest = np.ones(len(row), bool)
        rest[put] = False
        row, at = row[rest], (at[rest] + np.uint32(1)) & np.uint32(size - 1)
    share = np.array([documents.get(lang, 1) for lang in languages], float)
    return Model(languages, np.log2(share / share.sum()), trees, slot_gram, slot_row, costs)


def _measured(shared):
    """(language's place, bits, bytes) of documents of known language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for b in batches:
            rows = [(model.languages.index(lang), t.lower().encode()) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if lang in model.languages]
            at = np.array([i for i, _ in rows], np.int64)
            bits = code_lengths(model, [t for _, t in rows])[np.arange(len(rows)), at]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits, pa.float64()), pa.array([len(t) for _, t in rows], pa.int64())], ["at", "bits", "bytes"])

    return run


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, measure: bool = False, train_bytes: int = TRAIN_BYTES) -> Model | None:
    """A model of the languages in column ``lang`` from ``text``; None if no row has a language, an id and a text.

    Takes about ``train_docs`` documents of each language (see ``TRAIN_BYTES``), always the one whose hash comes first.
    With ``measure``, a tenth of the others tells what a document usually takes and is not learned from. What reaches
    the driver is a row for each language, and the context counts of the sample.
    """
    spark = docs.sparkSession
    usable = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("double")).alias("bytes"), F.min(draw).alias("first")).collect()
    if not sizes:
        return None
    each = train_bytes / len(sizes)
    # a literal with an entry for each language, as each byte's costs have: a table made of rows here would start Python workers
    # of another kind on the executors, and its broadcasts take a page of memory in each
    of_lang = lambda values: F.try_element_at(F.create_map(*[F.lit(x) for r, v in zip(sizes, values, strict=True) for x in (r["lang"], v)]), F.col("lang"))
    share = of_lang([min(1.0, train_docs / r["n"], each / max(r["bytes"], 1.0)) for r in sizes])
    first = of_lang([r["first"] for r in sizes])
    drawn = usable.where((draw < share) | (draw == first))
    for_measure = (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * MEASURED)) & (draw > first)
    learned = drawn.where(~for_measure) if measure else drawn
    counted = learned.select("lang", "text").mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    langs = table["lang"].combine_chunks().dictionary_encode()
    code, gram, n = langs.indices.to_numpy(zero_copy_only=False), table["gram"].to_numpy(), table["n"].to_numpy()
    grams = {lang: (gram[code == i], n[code == i]) for i, lang in enumerate(langs.dictionary.to_pylist())}
    if not grams:
        return None
    model = build_model(grams, {r["lang"]: r["n"] for r in sizes})
    if not measure:
        return model
    shared = spark.sparkContext.broadcast(model)
    seen = drawn.where(for_measure).select("lang", "text").mapInArrow(_measured(shared), "at long, bits double, bytes long")
    usual = np.zeros(len(model.languages))
    for r in seen.groupBy("at").agg((F.sum("bits") / F.greatest(F.sum("bytes"), F.lit(1))).alias("usual")).collect():  # a row for each language
        usual[r["at"]] = r["usual"]
    shared.destroy()  # executors would keep it beside the one that predicts
    return Model(model.languages, model.prior, model.trees, model.slot_gram, model.slot_row, model.costs, usual)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits that each text takes in each language. Long texts go in pieces, with their context."""
    out = np.zeros((len(texts), len(model.languages)))

    def flush(pieces: list[bytes], owners: list[int]) -> None:
        v = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
        costs = model.bits((v[:-3] << np.uint32(24)) | (v[1:-2] << np.uint32(16)) | (v[2:-1] << np.uint32(8)) | v[3:])
        ends = np.cumsum([len(p) for p in pieces])
        edges = np.stack([ends - [len(p) for p in pieces], ends - 3], 1).ravel()  # the next piece's context is left out
        sums = np.add.reduceat(np.vstack([costs, np.zeros((1, costs.shape[1]), costs.dtype)]), edges, 0, dtype=float)[::2]
        np.add.at(out, owners, sums)

    pieces, owners, held = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), _PIECE):
            piece = (t[at - 3 : at] if at else _PAD) + t[at : at + _PIECE]
            pieces.append(piece)
            owners.append(i)
            held += len(piece)
            if held >= _PIECE:
                flush(pieces, owners)
                pieces, owners, held = [], [], 0
    if pieces:
        flush(pieces, owners)
    return out


def _judged(model: Model | None, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
    """Language, posterior and strangeness of each text: its bits beyond ``SLACK`` as a multiple of what its bytes usually take."""
    lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
    names, scores, strange = [UNDECIDED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if model is not None and lettered.any():
        coded = [t.lower().encode() if ok else b"" for t, ok in zip(texts, lettered)]
        bits = code_lengths(model, coded)
        weight = model.prior - bits
        best = weight.argmax(1)
        posterior = 1 / np.exp2(weight - weight.max(1, keepdims=True)).sum(1)
        for i in np.flatnonzero(lettered).tolist():
            names[i], scores[i] = model.languages[best[i]], float(posterior[i])
            if len(model.usual) and model.usual[best[i]] > 0:
                strange[i] = max(0.0, float(bits[i, best[i]]) - SLACK) / (model.usual[best[i]] * len(coded[i]))
    return names, scores, strange


def _predictions(shared):
    """An Arrow function from texts to struct<lang_pred, score, strange>; only the texts go to Python, and a few at a time on."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            found: tuple[list, list, list] = ([], [], [])
            held: list[str] = []
            size = 0
            for i, value in enumerate(texts, 1):
                held.append(value.as_py() or "")
                size += len(held[-1])
                if i == len(texts) or size > _PIECE:
                    for column, more in zip(found, _judged(model, held), strict=True):
                        column += more
                    held, size = [], 0
            columns = [pa.array(c, t) for c, t in zip(found, (pa.string(), pa.float64(), pa.float64()), strict=True)]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score", "strange"])

    # it has one result for a text, but must not be run again for a filter on that
    return F.arrow_udf(run, "lang_pred string, score double, strange double").asNondeterministic()


def _found(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the training sample
    return docs.select(*keep, _predictions(shared)(F.col("text")).alias("__found"))


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score (the posterior of that language, 0 to 1).

    Only ``text`` is looked at. A text that is null or has no letter gets ``und`` and 0, as do all without a model.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    return _found(docs, model, keep).select(*keep, "__found.lang_pred", "__found.score")


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those rejected: no letters, no language with a posterior of ``LEAST_SCORE``, or a code length
    in the best one that is far beyond what its texts take (``STRANGE``, ``SLACK``), as of other languages or noise.

    A missing ``lang`` takes the predicted language; other columns stay. The model learns from the rows that have one.
    """
    found = _found(docs, train(docs, measure=True), docs.columns)
    kept = found.where((F.col("__found.lang_pred") != UNDECIDED) & (F.col("__found.score") >= LEAST_SCORE) & (F.col("__found.strange") <= STRANGE))
    return kept.withColumn("lang", F.coalesce("lang", "__found.lang_pred")).select(docs.columns)


def held_out(doc_id: Column) -> Column:
    """True for the third of ids that no model learns from; a null id is not held out, and not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])
