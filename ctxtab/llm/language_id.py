"""Language ID by segmentation-marginalised unigram models over a fixed public vocabulary.

Every language has a probability for each piece of a public tokenizer's vocabulary.  The likelihood
of a word (lower case, with the vocabulary's word mark in front) is the sum over all its
segmentations into pieces of the product of their probabilities, by the forward algorithm; pieces do
not cross white space, so a text is the product over its words.  A character that no piece covers
counts as an unknown piece, so that every text has a score.

Fitting.  Word counts of a bounded sample of labelled rows for each language (``SAMPLE`` rows in
expectation, taken by a hash of the id) are aggregated by Spark; expectation maximisation sums
expected piece counts (forward and backward) over partitions.  The vocabulary, and so the model, has
a fixed size.  The vocabulary file is a parameter and never trained here.

Scoring.  Tasks score each distinct word once (all words of one length together in numpy) and sum
over whole texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxtab.llm.words import ArrayLookup, pieces, released, small_batches
from ctxtab.session import cut_lineage

SAMPLE = 2000        # labelled rows for each language that a model is fitted on, in expectation
ROUNDS = 4           # of expectation maximisation
SMOOTH = 0.02        # added to the expected count of each piece
UNKNOWN = 1e-7       # probability of a character outside the vocabulary
MARK = "▁"
CACHE = 300_000      # distinct words whose scores a task keeps; more only means scoring some again
PART = 64            # characters of a word that are fitted at once
LETTER = regex.compile(r"\p{L}")


def vocabulary(path: str | None = None) -> list[str]:
    """Text pieces of a sentencepiece model file (default: the public 32k one)."""
    import sentencepiece
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    return [sp.id_to_piece(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Lattice:
    """Pieces inside words: which piece, if any, lies at each (start, length); found by polynomial hashes of substrings."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocab: list[str]):
        self.unknown = len(vocab)
        self.none = len(vocab) + 1
        self.longest = max(map(len, vocab), default=1)
        keys = np.zeros(len(vocab), np.uint64)
        for n in {len(v) for v in vocab}:
            at = [i for i, v in enumerate(vocab) if len(v) == n]
            for h in self._substrings([vocab[i] for i in at], n, n):
                pass
            keys[at] = h[:, 0]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces of the vocabulary share a hash")
        self.find = ArrayLookup(keys, self.none)

    def _substrings(self, words: list[str], n: int, most: int):
        """Hashes of the substrings of length 1, 2, ... most of words of n characters."""
        codes = np.array(words, f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        h = codes
        yield h
        for m in range(2, most + 1):
            h = h[:, :n - m + 1] * self.BASE + codes[:, m - 1:]
            yield h

    def by_length(self, words: Iterable[str]):
        """(positions of the words, piece ids of shape words x starts x lengths) for words of one length."""
        groups: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for k, w in enumerate(words):
            groups[len(w) + 1].append((k, MARK + w))
        for n, group in groups.items():
            step = max(1, 400_000 // (n * min(n, self.longest)))
            for a in range(0, len(group), step):
                part = group[a:a + step]
                yield np.array([k for k, _ in part]), self._ids([w for _, w in part], n)

    def _ids(self, words: list[str], n: int) -> np.ndarray:
        most = min(n, self.longest)
        ids = np.full((len(words), n, most), self.none, np.int32)
        for m, h in enumerate(self._substrings(words, n, most), 1):
            ids[:, :n - m + 1, m - 1] = self.find(h)
        lone = ids[:, :, 0]
        lone[lone == self.none] = self.unknown
        return ids

    def table(self, prob: np.ndarray) -> np.ndarray:
        """Piece probabilities (languages x pieces) with those of the unknown and the missing piece, pieces first."""
        k = len(prob)
        return np.concatenate([prob, np.full((k, 1), UNKNOWN), np.zeros((k, 1))], 1).T.copy()


def forward(ids: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood, scaled alpha, log scale at each position); alpha[:, i] sums all segmentations of the first i characters.

    Scales are taken out every few characters, so words of any length stay in range.
    """
    n, length, most = ids.shape
    k = table.shape[1]
    alpha = np.zeros((n, length + 1, k))
    alpha[:, 0] = 1
    scale = np.zeros((n, length + 1, k))
    for i in range(1, length + 1):
        total = np.zeros((n, k))
        for m in range(1, min(most, i) + 1):
            piece = ids[:, i - m, m - 1]
            if m > 4:  # long pieces are rare: only the words that have one
                at = np.flatnonzero(piece < len(table) - 1)
                total[at] += alpha[at, i - m] * table[piece[at]]
            else:
                total += alpha[:, i - m] * table[piece]
        alpha[:, i] = total
        scale[:, i] = scale[:, i - 1]
        if i % 8 == 0 and i < length:
            a = max(0, i - most + 1)
            top = alpha[:, a:i + 1].max(1)
            alpha[:, a:i + 1] /= top[:, None]
            scale[:, i] += np.log(top)
    with np.errstate(divide="ignore"):
        return np.log(alpha[:, length]) + scale[:, length], alpha, scale


def expected_counts(lattice: Lattice, words: list[str], n: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected number of times each piece is used in ``words`` (with counts ``n``) under one language."""
    table = lattice.table(prob[None, :])[:, 0]
    counts = np.zeros(lattice.none + 1)
    parts = [[w[i:i + PART] for i in range(0, len(w), PART)] for w in words]  # keeps products in range
    n = np.repeat(n, [len(p) for p in parts])
    for at, ids in lattice.by_length(w for p in parts for w in p):
        rows, length, most = ids.shape
        alpha = np.zeros((rows, length + 1))
        beta = np.zeros((rows, length + 1))
        alpha[:, 0] = beta[:, length] = 1
        p = table[ids]
        for i in range(1, length + 1):
            for m in range(1, min(most, i) + 1):
                alpha[:, i] += alpha[:, i - m] * p[:, i - m, m - 1]
        for i in range(length - 1, -1, -1):
            for m in range(1, min(most, length - i) + 1):
                beta[:, i] += p[:, i, m - 1] * beta[:, i + m]
        weight = np.where(alpha[:, length] > 0, n[at] / np.maximum(alpha[:, length], 1e-300), 0)
        for i in range(length):
            for m in range(1, min(most, length - i) + 1):
                np.add.at(counts, ids[:, i, m - 1], alpha[:, i] * p[:, i, m - 1] * beta[:, i + m] * weight)
    return counts[:lattice.unknown]


# Fixed value: the white space that str.split() knows, as a pattern of the JVM.
WHITE = r"[\x09-\x0D\x1C-\x1F\x85\p{Z}]+"


class Model:
    """Languages and the probability of each piece in each of them."""

    def __init__(self, langs: list[str], vocab: list[str], prob: np.ndarray):
        self.langs, self.vocab, self.prob = langs, vocab, prob

    def predict(self, texts: list[str | None], state: dict) -> tuple[list[str], list[float]]:
        """Language and posterior of each text; ``state`` keeps word scores between calls."""
        if "lattice" not in state:
            state.update(lattice=Lattice(self.vocab), known={}, scores=np.zeros((1024, len(self.langs))))
            state["table"] = state["lattice"].table(self.prob)
        split = [t.lower().split() if t is not None and self.langs and LETTER.search(t) else None for t in texts]
        if len(state["known"]) > CACHE:
            state["known"] = {}
        known = state["known"]
        fresh = list(set().union(*(w for w in split if w)) - known.keys())
        while len(state["scores"]) < len(known) + len(fresh):
            state["scores"] = np.concatenate([state["scores"], np.zeros_like(state["scores"])])
        base = len(known)
        for at, ids in state["lattice"].by_length(fresh):
            state["scores"][base + at] = forward(ids, state["table"])[0]
        known.update(zip(fresh, range(base, base + len(fresh))))
        langs, scores = [], []
        for words in split:
            if not words:
                langs.append("und")
                scores.append(0.0)
                continue
            total = state["scores"][[known[w] for w in words]].sum(0)
            best = int(total.argmax())  # ties to the first language by name
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def _prior(vocab: list[str]) -> np.ndarray:
    """Starting point: pieces are the likelier the shorter they are."""
    p = np.array([0.5 ** len(v) for v in vocab])
    return p / p.sum()


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocab: list[str] | None = None,
        sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Model of the non-null languages of ``labelled``."""
    vocab = vocabulary() if vocab is None else vocab
    spark: SparkSession = labelled.sparkSession
    labelled = labelled.where(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return Model([], vocab, np.zeros((0, len(vocab))))
    bound = spark.createDataFrame([(lang, int(min(1.0, sample / sizes[lang]) * 2**32)) for lang in langs], "_lang string, _bound long")
    chosen = labelled.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), F.xxhash64(F.lit(3), F.col(id_col).cast("string"), F.col(text_col)).alias("_h"))
    chosen = chosen.join(F.broadcast(bound), "_lang").where("pmod(_h, 4294967296) < _bound")
    words = (chosen.select("_lang", F.explode(F.split(F.lower("_text"), WHITE)).alias("word")).where("word <> ''")
             .groupBy("_lang", "word").agg(F.count("*").alias("n")))
    words = cut_lineage(words)
    index = {lang: k for k, lang in enumerate(langs)}
    prob = np.tile(_prior(vocab), (len(langs), 1))
    for _ in range(rounds):
        prob = _round(words, index, vocab, prob)
    return Model(langs, vocab, prob)


def _round(words: DataFrame, index: dict[str, int], vocab: list[str], prob: np.ndarray) -> np.ndarray:
    shared = words.sparkSession.sparkContext.broadcast((vocab, prob, index))

    def fn(batches):
        vocab, prob, index = shared.value
        lattice = Lattice(vocab)
        total = {}
        for pdf in batches:
            for lang, part in pdf.groupby("_lang"):
                c = expected_counts(lattice, part["word"].tolist(), part["n"].to_numpy(float), prob[index[lang]])
                total[lang] = total.get(lang, 0) + c
        import pandas as pd
        for lang, c in total.items():
            yield pd.DataFrame({"lang": index[lang], "piece": np.flatnonzero(c > 0), "c": c[c > 0]})

    sums = words.mapInPandas(released(fn), "lang int, piece int, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c")).toPandas()  # languages x vocabulary at most
    counts = np.full(prob.shape, SMOOTH)
    np.add.at(counts, (sums["lang"].to_numpy(), sums["piece"].to_numpy()), sums["c"].round(6).to_numpy())
    return counts / counts.sum(1, keepdims=True)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior (0 to 1).

    ``und`` with score 0 when the text is null, blank or has no letter, or the model knows no
    language.  Whole texts are read.  Columns with the names of the results are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(lang_out, score_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("_doc", docs.schema), T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())])

    def fn(batches):
        model, state = shared.value, {}
        for batch in batches:
            text = pc.struct_field(batch.column("_doc"), at)
            for a, b in pieces(text):
                langs, scores = model.predict(text.slice(a, b - a).to_pylist(), state)
                yield pa.RecordBatch.from_arrays([batch.column("_doc").slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["_doc", "_lang", "_score"])

    at = docs.columns.index(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    out = rows.mapInArrow(released(fn), schema)
    return out.select("_doc.*", F.col("_lang").alias(lang_out), F.col("_score").alias(score_out))


def held_out(id_col: str = "doc_id"):
    """True for the documents that are kept from fitting."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
