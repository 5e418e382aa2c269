"""Language identification by prediction by partial matching (PPM).

Training counts byte n-grams per language in Spark: a variable-order context
tree of up to ``order`` preceding bytes. A byte's code length follows PPM with
escape method C and exclusion: at the longest context seen, a symbol of count
c among n occurrences and d distinct symbols has probability c / (n + d); the
escape d / (n + d) leads to the next shorter context, without the symbols
already excluded, down to a uniform share of the bytes that remain. The
statistics stay frozen while scoring, so a text's exact code length is a sum
over its n-grams. The language with the shortest code wins.

The model is sparse: per language and order, the sorted n-grams that occur with
their counts, and the contexts with n, d and the mass that their symbols have in
the next shorter context. A context's symbols all occur after its suffix too, so
what exclusion leaves is n and d of the suffix less those two numbers, and a
code length follows the escapes without any dense table. Workers score the
distinct n-grams of a chunk of texts once and keep the results in a bounded
cache.

Training reads every labelled text, each distinct one of a language once (by a
hash of the text; ids play no part, so null or repeated ids and repeated rows
change nothing). Tasks count a few megabytes of text at a time, Spark sums the
counts of (language, n-gram), and the sums reach the driver: one row for each
n-gram that occurs, refused beyond ``most_bytes`` before they are collected.
Copies alone are shuffled with their texts. ``usual_bits`` scores the same texts.
A caller may ask for a sample: ``sample_docs`` distinct texts per language, those
of the smallest text hashes. Scoring is one narrow pass over all documents.

Defined results: null text or no letter: ``und``, score 0; equal code lengths:
the smaller language name; no training row at all: ``und`` for every document;
repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import bounded_chunks, id_and_bytes, prepare, read
from vitrine.session import materialize

ORDER = 3
MOST_BYTES = 1 << 29            # of a model
PIECE = 1 << 20                 # bytes scored at once
COUNTED = 4 << 20               # bytes counted at once
CACHE_CELLS = 2 << 20           # code lengths kept by a worker
_LETTER = re.compile(r"[^\W\d_]")


def _normal(body: bytes) -> bytes:
    return body.lower()      # of bytes: A-Z alone


# -- training -----------------------------------------------------------------------------------------

def draw(labelled: DataFrame, texts: int) -> DataFrame:
    """(lang, rank, text): per language ``texts`` distinct texts, ranked from 1 by a hash of the text."""
    rows = (labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
            .select("lang", "text", F.xxhash64("text").alias("hash")))
    keys = materialize(rows.select("lang", "hash").distinct(), "language-keys")
    sizes = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # Twice as many as are wanted are ranked: those below a share of the hashes.
    place = F.pmod("hash", F.lit(1 << 40)) / F.lit(float(1 << 40))
    # One row for each language, for which the model holds a tree anyway: the keys needn't be dealt by language.
    near = keys.join(F.broadcast(sizes), "lang").filter(place * F.col("n") < 2.0 * texts + 20)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 40)), "hash"))
    drawn = near.withColumn("rank", rank).filter(F.col("rank") <= texts).select("lang", "hash", "rank")
    # At most ``texts`` rows for each language: whole texts aren't shuffled to find them.
    return (rows.join(F.broadcast(drawn), ["lang", "hash"]).groupBy("lang", "rank")
            .agg(F.min(F.struct("hash", "text"))["text"].alias("text")))


def distinct_texts(labelled: DataFrame) -> DataFrame:
    """(lang, text): each distinct text of a language once, all of them."""
    rows = (labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
            .select("lang", "text", F.xxhash64("text").alias("hash")))
    copied = materialize(rows.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"),
                         "language-copies")
    # Only texts that have copies are shuffled.
    once = rows.join(copied, ["lang", "hash"], "left_anti").select("lang", "text")
    return once.unionByName(rows.join(copied, ["lang", "hash"], "left_semi").groupBy("lang", "hash")
                            .agg(F.min("text").alias("text")).select("lang", "text"))


def _grams_of(bodies: list[bytes], order: int, piece: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, how often) of whole texts for each order: those of the full order are counted, the shorter ones
    are their heads and what starts in a text's last ``order`` bytes."""
    kind = np.uint32 if order <= 3 else np.uint64
    full, ends = [np.zeros(0, kind)], [Counter() for _ in range(order + 1)]
    for body in bodies:
        for at in range(0, max(len(body) - order, 0), piece):
            s = np.frombuffer(body[at:at + piece + order], np.uint8)
            gram = np.zeros(len(s) - order, kind)
            for j in range(order + 1):
                gram = gram << kind(8) | s[j:len(s) - order + j]
            full.append(gram)
        end = body[max(len(body) - order, 0):]
        for i in range(len(end)):
            for k in range(len(end) - i):
                ends[k][int.from_bytes(end[i:i + k + 1], "big")] += 1
    gram, n = np.unique(np.concatenate(full), return_counts=True)
    out = []
    for k in range(order, -1, -1):
        rest = np.array(list(ends[k]), np.int64), np.array(list(ends[k].values()), np.int64)
        out.append((np.concatenate([gram.astype(np.int64), rest[0]]), np.concatenate([n, rest[1]])))
        gram = gram >> kind(8)
        heads = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        gram, n = gram[heads], np.add.reduceat(n, heads) if len(heads) else n
    return out[::-1]


def _ngrams(order: int, piece: int = PIECE, counted: int = COUNTED):
    """(lang, order, gram, n) of some megabytes of texts at a time; a gram holds order + 1 bytes, big-endian."""
    def counts(held):
        for lang, bodies in held.items():
            for k, (grams, n) in enumerate(_grams_of(bodies, order, piece)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), k, np.int32)),
                     pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "k", "gram", "n"])

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            lang, body = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text = _normal(body[i].as_py())
                held.setdefault(lang[i].as_py(), []).append(text)
                size += len(text)
                if size >= counted:
                    yield from counts(held)
                    held, size = {}, 0
        yield from counts(held)
    return run


def count_ngrams(labelled: DataFrame, order: int = ORDER, sample_docs: int | None = None) -> DataFrame:
    """(lang, k, gram, n) over all distinct texts of the labelled rows (text, lang), or a sample of them."""
    texts = distinct_texts(labelled) if sample_docs is None else draw(labelled, sample_docs)
    return (texts.select("lang", F.col("text").cast("binary").alias("body"))
            .mapInArrow(_ngrams(order), "lang string, k int, gram long, n long")
            .groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")))


def _low_bytes(key: np.ndarray, n: int) -> np.ndarray:
    return key & np.uint64((1 << 8 * n) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each key in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _narrow(n: np.ndarray) -> np.ndarray:
    """Counts in 32 bits, if they fit."""
    return n.astype(np.uint32 if not n.size or int(n.max()) < 1 << 32 else np.uint64)


class Tree:
    """One language's context tree: per order the n-grams with their counts, and the contexts with their totals."""

    def __init__(self, k: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int):
        self.grams, self.counts, self.contexts, self.totals = [], [], [], []
        for width in range(order + 1):
            mine = np.flatnonzero(k == width)
            mine = mine[np.argsort(gram[mine])]
            grams, counts = gram[mine].astype(np.uint64), n[mine].astype(np.int64)
            context = grams >> np.uint64(8)
            heads = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(grams) else np.zeros(0, np.int64)
            # n, d, and the mass of the same symbols after the next shorter context.
            below = np.zeros(len(grams), np.int64)
            if width and len(grams):
                at, _ = _find(self.grams[-1], _low_bytes(grams, width))
                below = self.counts[-1][at].astype(np.int64)
            total = [np.add.reduceat(x, heads) if len(heads) else x for x in (counts, np.ones(len(grams), np.int64), below)]
            self.grams.append(grams.astype(np.uint32 if width < 4 else np.uint64))
            self.counts.append(_narrow(counts))
            self.contexts.append(context[heads].astype(np.uint32 if width <= 4 else np.uint64))
            self.totals.append(_narrow(np.stack(total)))

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for part in (self.grams, self.counts, self.contexts, self.totals) for a in part)

    def bits(self, key: np.ndarray, width: int) -> np.ndarray:
        """Code lengths of the last bytes of ``key`` after the ``width`` bytes before them."""
        out, open_ = np.zeros(len(key)), np.ones(len(key), bool)
        gone_n, gone_d = np.zeros(len(key)), np.zeros(len(key))      # excluded, of the context at hand
        for w in range(width, -1, -1):
            at, found = _find(self.contexts[w], _low_bytes(key >> np.uint64(8), w).astype(self.contexts[w].dtype))
            n, d, below = np.where(found, self.totals[w][:, at], 0).astype(np.float64)
            left_n, left_d = n - gone_n, d - gone_d
            ask = np.flatnonzero(open_ & (left_d > 0))
            at, held = _find(self.grams[w], _low_bytes(key[ask], w + 1).astype(self.grams[w].dtype))
            out[ask] += np.log2(left_n[ask] + left_d[ask]) - np.log2(np.where(held, self.counts[w][at], left_d[ask]))
            open_[ask[held]] = False
            gone_n, gone_d = below, d
        out[open_] += np.log2(256 - gone_d[open_])
        return out


class PpmModel:
    """Frozen context trees of all languages."""

    def __init__(self, langs: list[str], trees: list[Tree], order: int = ORDER):
        if not 0 <= order <= 6:
            raise ValueError("an n-gram has one to seven bytes")
        self.langs, self.trees, self.order = langs, trees, order
        self._forget()

    def _forget(self) -> None:
        self.known, self.lengths = np.zeros(0, np.uint64), np.zeros((0, len(self.langs)))

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "trees": self.trees, "order": self.order}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    @property
    def nbytes(self) -> int:
        return sum(t.nbytes for t in self.trees)

    @classmethod
    def fit(cls, rows: dict[str, np.ndarray], order: int = ORDER) -> "PpmModel":
        lang = np.asarray(rows["lang"], object)
        langs = sorted(set(lang.tolist()))
        of = np.searchsorted(np.array(langs, object), lang) if len(lang) else np.zeros(0, np.int64)
        place = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[place], np.arange(len(langs) + 1))
        return cls(langs, [Tree(*(rows[c][place[a:b]] for c in ("k", "gram", "n")), order)
                           for a, b in zip(cuts[:-1], cuts[1:])], order)

    def _bits(self, key: np.ndarray, width: int) -> np.ndarray:
        return np.stack([t.bits(key, width) for t in self.trees], axis=1)

    def _known(self, key: np.ndarray) -> np.ndarray:
        """Code lengths of distinct, sorted n-grams of the full order, one column for each language."""
        at, there = _find(self.known, key)
        fresh = key[~there]
        if len(fresh):
            if (len(self.known) + len(fresh)) * len(self.langs) > CACHE_CELLS:
                self._forget()
                fresh = key
            keys = np.concatenate([self.known, fresh])
            lengths = np.concatenate([self.lengths, self._bits(fresh, self.order)])
            order = np.argsort(keys)
            self.known, self.lengths = keys[order], lengths[order]
            at, _ = _find(self.known, key)
        return self.lengths[at]

    def _score(self, parts: list[tuple[int, bytes, int]], total: np.ndarray) -> None:
        """Adds the bits of (text number, bytes, how many of them are context alone)."""
        sizes = np.array([len(b) for _, b, _ in parts])
        s = np.frombuffer(b"".join(b for _, b, _ in parts), np.uint8)
        first = np.cumsum(sizes) - sizes
        of, lead = np.array([i for i, _, _ in parts]), np.array([n for _, _, n in parts])
        key = np.zeros(len(s), np.uint64)
        for j in range(min(self.order, len(s) - 1), -1, -1):
            key[j:] |= s[:len(s) - j].astype(np.uint64) << np.uint64(8 * j)
        # The first bytes of a text have shorter contexts.
        for w in range(self.order):
            mine = np.flatnonzero((lead <= w) & (sizes > w))
            if len(mine):
                np.add.at(total, of[mine], self._bits(key[first[mine] + w], w))
        begin = np.minimum(np.maximum(lead, self.order), sizes) + first
        inside = np.zeros(len(s) + 1, np.int32)
        np.add.at(inside, begin, 1)
        np.add.at(inside, first + sizes, -1)
        at = np.cumsum(inside[:-1]) > 0
        grams, place = np.unique(key[at].astype(np.uint32) if self.order == 3 else key[at], return_inverse=True)
        if not len(grams):
            return
        lengths = self._known(grams.astype(np.uint64))
        size = first + sizes - begin
        full = np.flatnonzero(size > 0)
        starts = (np.cumsum(size) - size)[full]
        for lang in range(len(self.langs)):
            np.add.at(total[:, lang], of[full], np.add.reduceat(lengths[:, lang][place], starts))

    def all_code_lengths(self, bodies: list[bytes], piece: int = PIECE) -> np.ndarray:
        """Bits of each whole text under each language."""
        total = np.zeros((len(bodies), len(self.langs)))
        parts, held = [], 0
        for i, body in enumerate(bodies):
            body = _normal(body)
            for at in range(0, len(body), piece):
                lead = min(at, self.order)
                parts.append((i, body[at - lead:at + piece], lead))
                held += len(parts[-1][1])
                if held >= piece:
                    self._score(parts, total)
                    parts, held = [], 0
        if parts:
            self._score(parts, total)
        return total

    def code_lengths(self, body: bytes, piece: int = PIECE) -> np.ndarray:
        """Bits of one whole text under each language."""
        return self.all_code_lengths([body], piece)[0]

    def predict(self, bodies: list[bytes]) -> list[tuple[str, float, float | None]]:
        """(language, posterior of it under equal priors, bits per byte) of each text."""
        if not self.langs:
            return [("und", 0.0, None)] * len(bodies)
        out = []
        for body, bits in zip(bodies, self.all_code_lengths(bodies)):
            if not _LETTER.search(body.decode("utf-8", "replace")):
                out.append(("und", 0.0, None))
                continue
            best = int(np.argmin(bits))
            out.append((self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()),
                        float(bits[best] / len(body))))
        return out


def fit(labelled: DataFrame, order: int = ORDER, sample_docs: int | None = None, most_bytes: int = MOST_BYTES) -> PpmModel:
    """Train on all labelled rows (text, lang), or on ``sample_docs`` distinct texts of each language."""
    prepare(labelled.sparkSession)
    counts = materialize(count_ngrams(labelled, order, sample_docs), "language-ngrams")
    # An n-gram takes eight bytes of a model, and its counts more: what can't fit isn't collected.
    if 8 * counts.count() > most_bytes:
        raise ValueError(f"the model has more than most_bytes ({most_bytes} bytes)")
    rows = counts.toArrow()
    lang = rows["lang"].combine_chunks().dictionary_encode()
    langs = np.array(lang.dictionary.to_pylist(), object)[lang.indices.to_numpy(zero_copy_only=False)]
    model = PpmModel.fit({"lang": langs, **{c: rows[c].to_numpy() for c in ("k", "gram", "n")}}, order)
    if model.nbytes > most_bytes:
        raise ValueError(f"the model has {model.nbytes} bytes, more than most_bytes ({most_bytes})")
    return model


def usual_bits(labelled: DataFrame, model: PpmModel, share: float = 0.99, texts: int | None = None,
               trained: int | None = None) -> dict[str, float]:
    """Per language the bits per byte, to three decimals, that ``share`` of its distinct labelled texts stay below: of
    all of them; or of up to ``texts`` texts that a model of a sample wasn't trained on (it was on the first ``trained``
    ones), or, with less than a quarter of them, of those."""
    if (texts is None) != (trained is None):
        raise ValueError("texts and trained go together")
    if not model.langs:
        return {}
    spark = labelled.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    # The id of a text tells its language and whether the model knows it.
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(model.langs) for x in (lang, i)])
    if texts is None:
        rows = distinct_texts(labelled).withColumn("rank", F.lit(0))
    else:
        rows = draw(labelled, trained + texts)
    rows = rows.withColumn("doc_id", 2 * F.element_at(number, F.col("lang")) + (F.col("rank") > (trained or 0)).cast("int"))
    found = id_and_bytes(rows.filter("doc_id IS NOT NULL")).mapInArrow(
        _predict(shared), "doc_id long, lang_pred string, score double, bits_per_byte double")
    # At three decimals a language has some thousand values, however many texts.
    found = (found.withColumn("bits", F.round("bits_per_byte", 3)).filter("bits IS NOT NULL")
             .groupBy("doc_id", "bits").agg(F.count(F.lit(1)).alias("n")))
    rows = found.groupBy("doc_id").agg(F.percentile("bits", F.lit(share), F.col("n")).alias("bits"),
                                       F.sum("n").alias("n")).collect()      # two for each language
    by = {r.doc_id: r for r in rows}
    return {lang: by[2 * i + 1 if 2 * i + 1 in by and by[2 * i + 1].n >= texts // 4 else 2 * i].bits
            for i, lang in enumerate(model.langs) if 2 * i in by}


def _predict(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("bits_per_byte", pa.float64())])

    def run(batches):
        model = shared.value
        for ids, bodies in bounded_chunks(batches, PIECE):
            rows = [(i, *found) for i, found in zip(ids, model.predict(bodies))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return run


def identify(docs: DataFrame, model: PpmModel) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of every row (doc_id, text)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return id_and_bytes(docs).mapInArrow(
        _predict(shared), "doc_id long, lang_pred string, score double, bits_per_byte double")


def is_held_out(doc_id=None):
    """crc32(doc_id as text) mod 4 = 2: never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def query(spark, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from three quarters of them."""
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.filter(~is_held_out())))
    return found.withColumn("held_out", is_held_out()).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
