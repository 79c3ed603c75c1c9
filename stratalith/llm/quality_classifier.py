"""Quality classifier by co-training two views of a page.

One classifier sees the text's content only, the other the page's metadata only
(source, language, declared length). Both learn from a bounded sample of labelled
rows; over rounds each gives the rows it is surest of, among all others of the
corpus, to the other as pseudo-labels. Both are then calibrated on labelled rows
kept apart, and the calibrated views are combined into one score for every
document. Features are computed once and kept in the shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sampling import smallest_hashes
from .session import checkpointed
from .textvec import mix64, span_hashes, trimmed, utf8_chunks, word_spans

HASHED = 64
TEXT_WIDTH = 22 + HASHED
META_HASHED = 128
META_PAIRS = 3 + 2 * META_HASHED
META_WIDTH = META_PAIRS + META_HASHED
PACKED = 5  # the declared length, whether it is null, three slots


def _kinds() -> np.ndarray:
    t = np.zeros(256, np.uint8)  # 0: other marks
    t[[9, 10, 11, 12, 13, 32]] = 1
    t[0x30:0x3A] = 2
    t[0x61:0x7B] = 3
    t[0x41:0x5B] = 4
    t[[ord(c) for c in ".,;:!?'\"()-"]] = 5
    t[0x80:] = 6
    return t


KINDS = _kinds()
_ODD = [ord(c) for c in "#*&%$@|<>{}[]=_~^\\/+"]


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of byte kinds and odd marks, word lengths, repetition of words, and hashed common words."""
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1).astype(np.float64)
    out = np.zeros((n, TEXT_WIDTH), np.float32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    if len(data):
        out[:, :7] = np.bincount(row * 7 + KINDS[data], minlength=n * 7).reshape(n, 7) / size[:, None]
        odd = np.zeros(256, bool)
        odd[_ODD] = True
        out[:, 7] = np.bincount(row, weights=odd[data], minlength=n) / size
        out[:, 8] = np.bincount(row, weights=data == 10, minlength=n) / size
        out[:, 9] = np.bincount(row, weights=data == ord("|"), minlength=n) / size
    folded, starts, ends, first = word_spans(data, offsets)
    words = np.diff(first).astype(np.float64)
    many = np.maximum(words, 1)
    out[:, 10], out[:, 11] = np.log1p(size) / 10, np.log1p(words) / 10
    out[:, 12] = (words == 0) * 1.0
    if len(starts):
        keys = span_hashes(folded, starts, ends)
        doc = np.repeat(np.arange(n), np.diff(first))
        length = (ends - starts).astype(np.float64)
        out[:, 13] = np.bincount(doc, weights=length, minlength=n) / many / 10
        out[:, 14] = np.bincount(doc, weights=length > 20, minlength=n) / many
        out[:, 15] = np.bincount(doc, weights=length < 3, minlength=n) / many
        for k, column in ((1, 16), (2, 17), (3, 18)):
            same = np.zeros(len(keys))
            same[k:] = (keys[k:] == keys[:-k]) & (doc[k:] == doc[:-k])
            out[:, column] = np.bincount(doc, weights=same, minlength=n) / many
        order = np.lexsort((keys, doc))
        k, d = keys[order], doc[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        distinct = np.bincount(d, weights=new, minlength=n)
        out[:, 19] = distinct / many
        run = np.diff(np.append(np.flatnonzero(new), len(k)))
        most = np.zeros(n)
        np.maximum.at(most, d[new], run)
        out[:, 20] = most / many
        out[:, 21] = distinct / many * np.log1p(words) / 10
        place = (mix64(keys) % np.uint64(HASHED)).astype(np.int64)
        out[:, 22:] = np.bincount(doc * HASHED + place, minlength=n * HASHED).reshape(n, HASHED) / many[:, None]
    return out


def meta_slots(source: str | None, lang: str | None) -> tuple[int, ...]:
    """The slots of the source, the language and both together, each with a range of its own; nulls are values of their own."""
    said = (f"s={source}", f"l={lang}", f"s={source},l={lang}")
    return tuple(3 + j * META_HASHED + int(mix64(np.array([(j + 1 << 32) + zlib.crc32(x.encode())], np.uint64))[0]) % META_HASHED for j, x in enumerate(said))


def meta_features(packed: np.ndarray) -> np.ndarray:
    """Rows of the declared length over ten, its square, whether it is null, and the slots, from packed ones (length, null, three slots)."""
    out = np.zeros((len(packed), META_WIDTH))
    if len(packed):
        out[:, 0], out[:, 1], out[:, 2] = packed[:, 0] / 10, (packed[:, 0] / 10) ** 2, packed[:, 1]
        out[np.arange(len(packed))[:, None], packed[:, 2:].astype(np.int64)] = 1.0
    return out


class View(NamedTuple):
    """A logistic classifier of one view, with its scaling and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features, or of packed metadata, whose slots are looked up."""
        own = self.weight / self.scale
        start = self.bias - self.mean @ own
        if x.shape[1] != PACKED:
            return x @ own + start
        length = x[:, 0] / 10
        return start + length * own[0] + length**2 * own[1] + x[:, 1] * own[2] + own[x[:, 2:].astype(np.int64)].sum(axis=1)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.margin(x) + self.shift, -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(turns):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_view(x: np.ndarray, y: np.ndarray, pairs: int) -> View:
    """Columns from ``pairs`` on are held to a larger scale, so that few rows teach little there."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    scale[pairs:] = np.maximum(scale[pairs:], 2.0)
    varies, weight = np.ptp(x, axis=0) > 0, np.zeros(x.shape[1])
    weight[varies], bias = logistic(((x - mean) / scale)[:, varies], y)
    return View(mean, scale, weight, bias)


class Model(NamedTuple):
    text: View
    meta: View
    mix: np.ndarray  # of the calibrated text and metadata margins, and a constant

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = self.text.calibrated(text), self.meta.calibrated(meta)
        return sigmoid(self.mix[0] * t + self.mix[1] * m + self.mix[2]), sigmoid(t), sigmoid(m)


Surest = Callable[[list[View], list[set[int]]], list[tuple[int, int, int, np.ndarray, np.ndarray]]]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, surest: Surest, rounds: int = 4) -> Model | None:
    """A model of labelled rows (y 1 or 0), which in turn teach or calibrate. None where the labels hold one class only.

    ``surest`` gives, for two views and the keys that each has been taught already,
    the rows (view, value, key, text, meta) that a view is surest of.
    """
    if len(set(y.tolist())) < 2:
        return None
    every = np.arange(len(y))
    apart, taught = every[every % 4 == 0], every[every % 4 != 0]
    if len(set(y[taught].tolist())) < 2 or len(set(y[apart].tolist())) < 2:
        apart = taught = every
    views = [text, meta_features(meta)]
    extra: list[dict[int, tuple[int, np.ndarray]]] = [{}, {}]  # of each view, by key: what the other one told it
    for turn in range(rounds + 1):
        models = []
        for v in (0, 1):
            told = [extra[v][k] for k in sorted(extra[v])]
            rows = np.concatenate([views[v][taught], *(x[None] for _, x in told)])
            models.append(fit_view(rows, np.concatenate([y[taught], [c for c, _ in told]]).astype(np.float64), (TEXT_WIDTH, META_PAIRS)[v]))
        if turn < rounds:
            for v, value, key, *features in surest(models, [set(extra[1]), set(extra[0])]):
                extra[1 - v].setdefault(key, (value, meta_features(features[1][None])[0] if v == 0 else features[0]))
    done = []
    for v in (0, 1):
        slope, shift = logistic(models[v].margin(views[v][apart])[:, None], y[apart].astype(np.float64), ridge=1e-2)
        done.append(models[v]._replace(slope=float(slope[0]), shift=shift))
    both = np.stack([done[v].calibrated(views[v][apart]) for v in (0, 1)], axis=1)
    weight, bias = logistic(both, y[apart].astype(np.float64), ridge=0.1)
    return Model(done[0], done[1], np.append(weight, bias))


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text features, and packed metadata."""
    text = [np.zeros((0, TEXT_WIDTH), np.float32)] + [text_features(d, o) for _, _, d, o in utf8_chunks(batch.column("text"))]
    rows = list(zip(*(batch.column(c).to_pylist() for c in ("source", "lang")), strict=True))
    slots = {r: meta_slots(*r) for r in set(rows)}
    chars = batch.column("n_chars").to_pylist()
    meta = np.array([(np.log1p(max(c or 0, 0)), c is None, *slots[r]) for c, r in zip(chars, rows, strict=True)], np.float32).reshape(len(rows), PACKED)
    return np.concatenate(text), meta


FEATURES = "doc_id long, text binary, meta binary"


def _featuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, meta = _features(batch)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary()) for x in (text, meta))], ["doc_id", "text", "meta"])


def _unpacked(text: list[bytes], meta: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    read = lambda rows, width: np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), width)
    return read(text, TEXT_WIDTH).astype(np.float64), read(meta, PACKED).astype(np.float64)


BLOCK = 2048  # rows whose wide features are there at a time


def _blocks(batch: pa.RecordBatch, most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for lo in range(0, batch.num_rows, most):
        own = batch.slice(lo, most)
        yield own, *_unpacked(own.column("text").to_pylist(), own.column("meta").to_pylist())


def _scoring(model: Model | None, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, text, meta in _blocks(batch):
                score, t, m = model.scores(text, meta) if model else (np.ones(len(meta)),) * 3
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), *(pa.array(x) for x in (score, t, m, score >= least))], ["doc_id", "score", "text_score", "meta_score", "kept"])

    return run


def _picking(models: list[View], known: list[set[int]], sure: float, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of a task that each view is surest of, ``most`` for either value."""
    least = float(np.log(sure / (1 - sure)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], dict[int, float]] = {(v, c): {} for v in (0, 1) for c in (0, 1)}
        for batch in batches:
            for own, *views in _blocks(batch):
                keys = own.column("key").to_numpy()
                for v in (0, 1):
                    margin = np.round(models[v].margin(views[v]), 6)
                    for c, said in ((1, margin), (0, -margin)):
                        best = held[v, c]
                        best.update((k, m) for k, m in zip(keys[said >= least].tolist(), said[said >= least].tolist(), strict=True) if k not in known[v])
                        if len(best) > most:
                            held[v, c] = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:most])
        rows = [(v, c, k, m) for (v, c), best in held.items() for k, m in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.float64()))], ["view", "value", "key", "margin"])

    return run


def _cast() -> list[Column]:
    return [F.col(c).cast(k).alias(c) for c, k in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "long"))]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_cast())


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, text and meta features, and a key of all three."""
    rows = checkpointed(_columns(docs).mapInArrow(trimmed(_featuring), FEATURES))
    return rows.withColumn("key", F.xxhash64("doc_id", "text", "meta"))


def _surest(pool: DataFrame, sure: float, most: int, salts: int = 1024) -> Surest:
    """The ``most`` rows of the pool that a view is surest of, for either value: the best of a task, of a share of the keys, of all."""

    def run(models: list[View], known: list[set[int]]) -> list[tuple[int, int, int, np.ndarray, np.ndarray]]:
        found = pool.select("text", "meta", "key").mapInArrow(trimmed(_picking(models, known, sure, most)), "view int, value int, key long, margin double").distinct()
        best = lambda *by: F.row_number().over(Window.partitionBy("view", "value", *by).orderBy(F.desc("margin"), "key"))
        some = found.withColumn("salt", F.pmod("key", F.lit(salts))).withColumn("n", best("salt")).filter(F.col("n") <= most)
        chosen = some.withColumn("n", best()).filter(F.col("n") <= most).select("view", "value", "key").collect()
        if not chosen:
            return []
        wanted = pool.sparkSession.createDataFrame([(k,) for k in sorted({r["key"] for r in chosen})], "key long")
        rows = pool.join(F.broadcast(wanted), "key").groupBy("key").agg(F.min(F.struct("text", "meta")).alias("x")).collect()
        told = {r["key"]: _unpacked([bytes(r["x"]["text"])], [bytes(r["x"]["meta"])]) for r in rows}
        return [(r["view"], r["value"], r["key"], told[r["key"]][0][0], told[r["key"]][1][0]) for r in sorted(chosen)]

    return run


def train(features: DataFrame, labels: DataFrame, sample: int = 4000, rounds: int = 4, sure: float = 0.97, most: int = 200) -> Model | None:
    """A model from at most ``sample`` labelled documents, those of the smallest hashes of doc_id, and pseudo-labels of all others.

    Labels that contradict each other or are null teach nothing. Of rows that share
    a labelled doc_id one teaches. In a round each view tells the other of at most ``most`` rows
    of either value, with a probability of ``sure`` at least.
    """
    spark = features.sparkSession
    told = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most AND quality IN (0, 1)")
    chosen = {r["doc_id"]: int(r["quality"]) for r in smallest_hashes(told.select("doc_id", "quality", F.xxhash64("doc_id").alias("hash")), sample).collect()}
    if not chosen:
        return None
    ids = F.broadcast(spark.createDataFrame([(i,) for i in sorted(chosen)], "doc_id long"))
    rows = features.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "meta")).alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return None
    text, meta = _unpacked([bytes(r["x"]["text"]) for r in rows], [bytes(r["x"]["meta"]) for r in rows])
    pool = features.join(ids, "doc_id", "left_anti")
    return co_train(text, meta, np.array([chosen[r["doc_id"]] for r in rows]), _surest(pool, sure, most), rounds)


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options: float) -> DataFrame:
    """One row for each row of docs: doc_id, score, text_score, meta_score, kept (score >= least).

    Nulls in source, lang and n_chars are values of their own, a null text is
    empty; where the labels hold less than two classes, all documents score 1.
    """
    rows = featured(docs)
    model = train(rows, labels, **options)
    return rows.select("doc_id", "text", "meta").mapInArrow(trimmed(_scoring(model, least)), "doc_id long, score double, text_score double, meta_score double, kept boolean")


def _filtering(model: Model | None, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None or not batch.num_rows:
                yield batch.select(["row"])
                continue
            text, meta = _features(batch)
            for lo in range(0, batch.num_rows, BLOCK):
                own = slice(lo, lo + BLOCK)
                score = model.scores(text[own].astype(np.float64), meta[own].astype(np.float64))[0]
                yield batch.select(["row"]).slice(lo, BLOCK).filter(pa.array(score >= least))

    return run


def kept_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options: float) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    model = train(featured(docs), labels, **options)
    rows = docs.select(F.struct("*").alias("row"), *_cast())
    return rows.mapInArrow(trimmed(_filtering(model, least)), f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
